"""Word lists and constants shared by the column functions.

Everything here is plain data.  Users replace any of it by passing their own
``Lexicon``, ``TagRules`` or theme dictionary.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Results depend on these exact entries and their order.
# ---------------------------------------------------------------------------

CANONICAL_COLUMNS = ["review_id", "text", "rating", "date", "product"]

MENTION_COLUMNS = [
    "review_id", "product", "rating", "date", "sentence_id", "sentence",
    "doc_sentiment", "doc_compound",
    "aspect", "theme", "aspect_sentiment", "aspect_compound",
]

SENTIMENTS = ["positive", "neutral", "negative"]
CLASS_ORDER = ["negative", "neutral", "positive"]
POLARITIES = ["positive", "negative", "neutral", "conflict"]

POSITIVE_FROM = 0.05
NEGATIVE_FROM = -0.05

MIN_TERM_LENGTH = 3
MAX_TERM_WORDS = 4

NOISE_TERMS = [
    "thing", "things", "stuff", "lot", "lots", "bit", "everything", "something",
    "anything", "nothing", "one", "ones", "time", "times", "way", "ways", "day",
    "days", "week", "weeks", "month", "months", "year", "years", "today",
    "everyone", "someone", "anyone", "review", "reviews", "product", "item",
    "items", "money", "people", "guy", "guys", "everybody", "nobody",
]

THEME_KEYWORDS = {
    "battery": ["battery", "charge", "charging", "power"],
    "screen": ["screen", "display", "touchscreen"],
    "camera": ["camera", "photo", "photos", "picture", "lens", "video"],
    "price": ["price", "cost", "pricing", "expensive", "cheap", "value for"],
    "sound": ["sound", "audio", "speaker", "bass", "noise cancellation", "mic", "microphone"],
    "performance": ["performance", "speed", "fast", "lag", "software", "interface", "app"],
    "delivery": ["delivery", "shipping", "packaging", "arrived", "shipment"],
    "service": ["service", "support", "warranty", "customer"],
    "build": ["build", "quality", "strap", "material", "design", "premium"],
    "comfort": ["fit", "comfort", "comfortable", "wear"],
}

LABEL_ALIASES = {
    "positive": "positive", "pos": "positive", "label_2": "positive",
    "negative": "negative", "neg": "negative", "label_0": "negative",
    "neutral": "neutral", "neu": "neutral", "label_1": "neutral",
}

O_ID, B_ID, I_ID, IGNORE_ID = 0, 1, 2, -100

GOLD_FILES = {
    ("restaurants", "train"): "Restaurants_Train_v2.xml",
    ("restaurants", "test"): "Restaurants_Test_Gold.xml",
    ("laptops", "train"): "Laptop_Train_v2.xml",
    ("laptops", "test"): "Laptops_Test_Gold.xml",
}

# Constants of the published rule-based scorer (Hutto & Gilbert, ICWSM 2014).
BOOST = 0.293
CAPS_BOOST = 0.733
NEGATION_FACTOR = -0.74
BOOST_DECAY = (1.0, 0.95, 0.9)
BEFORE_CONTRAST = 0.5
AFTER_CONTRAST = 1.5
EXCLAMATION_STEP, EXCLAMATION_MAX = 0.292, 4
QUESTION_STEP, QUESTION_MAX, QUESTION_CAP = 0.18, 3, 0.96
NORMALISER = 15.0

# ---------------------------------------------------------------------------
# Defaults: small starter dictionaries, meant to be replaced by real ones.
# ---------------------------------------------------------------------------

DEFAULT_VALENCE = {
    "accurate": 1.5, "amazing": 2.8, "awesome": 3.1, "beautiful": 2.9, "best": 3.2,
    "better": 1.9, "bright": 1.9, "brilliant": 2.8, "clean": 1.7, "clear": 1.6,
    "comfortable": 2.3, "crisp": 1.6, "decent": 1.4, "delightful": 2.8, "delicious": 2.7,
    "durable": 1.7, "easily": 1.4, "easy": 1.9, "enjoy": 2.2, "enjoyed": 2.3,
    "excellent": 2.7, "fabulous": 2.4, "fantastic": 2.6, "fast": 1.2, "favorite": 2.0,
    "fine": 0.8, "flawless": 2.6, "fresh": 1.3, "friendly": 2.2, "fun": 2.3,
    "generous": 2.3, "glad": 2.0, "good": 1.9, "gorgeous": 3.0, "great": 3.1,
    "handy": 1.4, "happy": 2.7, "helpful": 1.8, "impressed": 2.1, "impressive": 2.3,
    "incredible": 2.6, "like": 1.5, "liked": 1.8, "love": 3.2, "loved": 2.9,
    "lovely": 2.8, "nice": 1.8, "nicely": 1.9, "outstanding": 3.0, "perfect": 2.7,
    "perfectly": 3.2, "pleasant": 2.3, "pleased": 1.9, "premium": 1.3, "quick": 1.0,
    "quickly": 1.0, "recommend": 1.5, "reliable": 1.8, "rich": 1.6, "secure": 1.4,
    "sharp": 1.0, "sleek": 1.6, "smooth": 1.5, "snappy": 1.4, "solid": 1.2,
    "sturdy": 1.5, "stunning": 2.5, "superb": 3.1, "tasty": 2.0, "terrific": 2.1,
    "thanks": 1.9, "tight": 0.4, "useful": 1.9, "value": 1.4, "wonderful": 2.7,
    "worth": 1.4, "wow": 2.8,
    "annoying": -1.7, "awful": -2.0, "bad": -2.5, "blurry": -1.4, "boring": -1.3,
    "broke": -1.8, "broken": -2.1, "buggy": -1.9, "cheap": -0.8, "complaint": -1.5,
    "crash": -1.7, "crashes": -1.8, "cracked": -1.6, "dead": -2.6, "dealbreaker": -2.4,
    "defective": -2.2, "dim": -1.0, "dirty": -1.9, "disappoint": -1.7,
    "disappointed": -2.1, "disappointing": -2.2, "disconnecting": -1.3, "drains": -1.2,
    "dreadful": -2.6, "error": -1.7, "expensive": -1.0, "fail": -2.3, "failed": -2.3,
    "faulty": -1.9, "fragile": -1.2, "frustrating": -1.9, "garbage": -2.3, "hate": -2.7,
    "hated": -3.2, "horrible": -2.5, "hot": -0.4, "ignored": -1.3, "inaccurate": -1.6,
    "lag": -1.3, "laggy": -1.7, "late": -0.9, "lousy": -2.5, "mediocre": -1.2,
    "mess": -1.5, "nightmare": -2.6, "noisy": -1.2, "overpriced": -1.8, "pathetic": -2.7,
    "poor": -2.1, "poorly": -2.0, "problem": -1.7, "problems": -1.7, "regret": -1.8,
    "rude": -2.0, "ruined": -2.1, "sad": -2.1, "scratches": -1.0, "slow": -1.2,
    "sluggish": -1.5, "steep": -0.7, "stopped": -0.9, "terrible": -2.1, "ugly": -2.3,
    "unhappy": -1.8, "unreliable": -1.9, "unusable": -2.2, "useless": -1.8,
    "waste": -1.8, "weak": -1.9, "worst": -3.1, "worse": -2.1, "wrong": -2.1,
}

DEFAULT_BOOSTERS = {
    **dict.fromkeys([
        "absolutely", "amazingly", "awfully", "completely", "considerably", "deeply",
        "enormously", "entirely", "especially", "exceptionally", "extremely", "fully",
        "greatly", "highly", "hugely", "incredibly", "intensely", "majorly", "more",
        "most", "particularly", "purely", "quite", "really", "remarkably", "so",
        "substantially", "thoroughly", "totally", "tremendously", "unbelievably",
        "unusually", "utterly", "very", "way",
    ], BOOST),
    **dict.fromkeys([
        "almost", "barely", "hardly", "kinda", "less", "little", "marginally",
        "occasionally", "partly", "scarcely", "slightly", "somewhat", "sorta",
    ], -BOOST),
}

DEFAULT_NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt",
    "hasnt", "havent", "isnt", "mustnt", "neither", "never", "none", "nope", "nor",
    "not", "nothing", "nowhere", "shouldnt", "wasnt", "werent", "without", "wont",
    "wouldnt", "rarely", "seldom", "despite",
]

DEFAULT_CONTRASTS = ["but"]

# Closed word classes and frequent non-nouns; whatever is not listed and not
# caught by a suffix rule counts as a noun.
DEFAULT_TAGS = {
    "DT": ["a", "an", "the", "this", "that", "these", "those", "each", "every", "some",
           "any", "no", "all", "both", "another", "either", "neither", "half"],
    "PRP": ["i", "I", "me", "my", "mine", "myself", "you", "your", "yours", "he", "him",
            "his", "she", "her", "hers", "it", "its", "itself", "we", "us", "our",
            "ours", "they", "them", "their", "theirs", "who", "whom", "whose", "which",
            "what"],
    "IN": ["about", "above", "after", "against", "as", "at", "before", "because", "by",
           "during", "for", "from", "if", "in", "into", "like", "of", "off", "on", "out",
           "over", "since", "than", "through", "to", "under", "until", "up", "while",
           "with", "without", "compared"],
    "CC": ["and", "but", "or", "nor", "so", "yet", "though", "although"],
    "RB": ["not", "n't", "very", "too", "also", "just", "really", "quite", "far", "fast",
           "well", "even", "here", "there", "when", "where", "how", "why", "never",
           "always", "again", "still", "now", "then", "however", "overall", "outdoors"],
    "VB": ["is", "am", "are", "was", "were", "be", "been", "being", "has", "have", "had",
           "do", "does", "did", "can", "could", "will", "would", "should", "may", "might",
           "must", "get", "gets", "got", "go", "goes", "went", "keep", "keeps", "feel",
           "feels", "felt", "take", "takes", "took", "make", "makes", "made", "last",
           "lasts", "sound", "sounds", "locks", "drains", "wish", "love", "hate", "think"],
    "JJ": ["good", "great", "bad", "terrible", "awful", "nice", "dim", "bright", "crisp",
           "slow", "quick", "easy", "high", "low", "poor", "rich", "solid", "decent",
           "average", "best", "better", "worst", "new", "old", "big", "small", "long",
           "short", "loud", "smooth", "tight", "clean", "cheap", "steep", "hot", "full",
           "own", "other", "more", "most", "much", "many", "few", "such", "two"],
}

# Ordered (suffix, tag) rules for words outside the dictionary; first match wins.
DEFAULT_SUFFIX_TAGS = [
    ("ness", "NN"), ("ment", "NN"), ("tion", "NN"), ("sion", "NN"), ("ity", "NN"),
    ("ly", "RB"),
    ("ful", "JJ"), ("less", "JJ"), ("ous", "JJ"), ("able", "JJ"), ("ible", "JJ"),
    ("ive", "JJ"), ("ish", "JJ"), ("est", "JJ"),
    ("ed", "VBD"),
]

DEFAULT_ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Jr", "Sr", "vs", "e.g", "i.e"]
