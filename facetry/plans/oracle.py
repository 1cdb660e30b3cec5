"""The same questions in DuckDB SQL, for checking the registered queries.

Written relationally on purpose (exploded words, windows, self joins) where the Spark
side works on arrays, so that the two do not share a mistake.
"""

from __future__ import annotations

from dataclasses import replace

from facetry.functions.terms import DEFAULT_RULES
from facetry.functions.text import PUNCTUATION, SPACE_CHARS
from facetry.functions.wordlists import DEFAULT_ABBREVIATIONS, NOISE_TERMS, THEME_KEYWORDS
from facetry.plans.queries import LEXICON, LONG_WORD, MATRIX_LIMIT, PART_THEMES, PHRASES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


SPACE = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ALNUM = r"\p{L}\p{N}"
TOKEN = rf"[{ALNUM}]+(?:['\x{{2019}}\-]+[{ALNUM}]+)*|[^{SPACE}{ALNUM}]"
TITLE = r"^[^\p{Lu}\p{Ll}]*\p{Lu}\p{Ll}*(?:[^\p{Lu}\p{Ll}]+\p{Lu}\p{Ll}*)*[^\p{Lu}\p{Ll}]*$"
SPACES = " || ".join(
    [q("".join(c for c in SPACE_CHARS if c == " "))]
    + [f"chr({ord(c)})" for c in SPACE_CHARS if c != " "]
)


def strip(expr: str) -> str:
    return f"trim({expr}, {SPACES})"


def split_sentences(text: str) -> str:
    """Mark every candidate boundary, then take back the guarded ones."""
    closers = "[\"'”’)\\]]{0,3}"
    marked = f"regexp_replace({text}, {q(f'([.!?]{closers})([{SPACE}]+)')}, '\\1\\2' || chr(1), 'g')"
    initials = q(rf"(^|[^{ALNUM}])([A-HJ-Z]\.)([{SPACE}]+)\x01")
    names = "|".join(a.replace(".", r"\.") for a in DEFAULT_ABBREVIATIONS)
    abbreviations = q(rf"(^|[^{ALNUM}])((?:{names})\.)([{SPACE}]+)\x01")
    ellipsis = q(rf"(\.\.)([{SPACE}]+)\x01(\p{{Ll}})")
    for pattern in (initials, initials, abbreviations, abbreviations, ellipsis):
        marked = f"regexp_replace({marked}, {pattern}, '\\1\\2\\3', 'g')"
    parts = f"list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')})"
    return f"list_filter({parts}, lambda s: s <> '')"


def explode(source: str, keys: str, array: str, pos: str, item: str) -> str:
    """``keys, pos, item`` with 0-based INTEGER positions."""
    return f"""
        select {keys}, cast(unnest(range(len(_a))) as integer) as {pos}, unnest(_a) as {item}
        from (select {keys}, {array} as _a from {source})"""


SENTENCES = explode("documents", "doc_id, lang", split_sentences("text"), "sentence_id", "sentence")


# -- terms ------------------------------------------------------------------

def default_noun(t: str) -> str:
    cases = [f"when not regexp_matches({t}, '\\p{{L}}') then 'SYM'"]
    cases += [f"when {t} in {in_list(w)} then {q(n)}" for n, w in DEFAULT_RULES.words.items()]
    cases += [f"when suffix({t}, {q(s)}) then {q(n)}" for s, n in DEFAULT_RULES.suffixes]
    return f"(case {' '.join(cases)} else {q(DEFAULT_RULES.default)} end) like 'NN%'"


def long_noun(t: str) -> str:
    return f"(length({t}) >= {LONG_WORD} and regexp_matches({t}, '\\p{{L}}'))"


def token_rows(source: str, keys: str, text: str) -> str:
    rows = explode(source, keys, f"regexp_extract_all({text}, {q(TOKEN)})", "pos", "raw")
    return f"""
        select {keys}, pos, case when pos = 0 and regexp_matches(raw, {q(TITLE)}) then lower(raw) else raw end as token
        from ({rows})"""


def term_rows(source: str, keys: str, text: str, noun, max_words: int = 4) -> str:
    """Noun runs by gaps and islands; ``keys, term, first_at``."""
    return f"""
        select {keys}, term, min(first_at) as first_at from (
            select {keys}, lower(string_agg(token, ' ' order by pos)) as term, min(pos) as first_at, count(*) as n
            from (select *, pos - row_number() over (partition by {keys} order by pos) as run
                  from ({token_rows(source, keys, text)}) where {noun('token')})
            group by {keys}, run)
        where length(term) >= 3 and n <= {max_words} and term not in {in_list(NOISE_TERMS)}
          and len(list_filter(string_split(term, ' '),
                  lambda w: length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) >= 2)) > 0
        group by {keys}, term"""


# -- sentiment --------------------------------------------------------------

def word_value(w: str, table) -> str:
    return f"(case {' '.join(f'when {w} = {q(k)} then {v!r}::double' for k, v in table.items())} end)"


def compound_rows(source: str, keys: str, text: str, lexicon=LEXICON) -> str:
    """``keys, compound`` over exploded words with lag windows."""
    bare = f"trim(w, {q(PUNCTUATION)})"
    words = (
        f"list_transform(list_filter(string_split(regexp_replace({text}, {q(f'[{SPACE}]+')}, ' ', 'g'), ' '), "
        f"lambda w: w <> ''), lambda w: case when length({bare}) > 2 then {bare} else w end)"
    )
    rows = explode(source, keys, words, "pos", "w")
    neg, con = in_list(lexicon.negations), in_list(lexicon.contrasts)
    known = in_list(lexicon.valence)
    lags = ", ".join(
        f"lag(w, {d}) over o as w{d}, lag(l, {d}) over o as l{d}" for d in (1, 2, 3)
    )

    def step(d: int, decay: float) -> str:
        v, low, word = f"v{d - 1}", f"l{d}", f"w{d}"
        boost = f"coalesce({word_value(low, lexicon.boosters)}, 0.0)"
        caps = f"(case when {boost} <> 0 and mixed and {word} = upper({word}) and {word} <> lower({word}) then 0.733::double else 0.0 end)"
        return f"""case when {low} is null or {low} in {known} then {v}
            else ({v} + ({boost} + {caps}) * (case when {v} < 0 then -1.0 else 1.0 end)::double * {decay}::double)
                 * (case when {low} in {neg} or contains({low}, 'n''t') then -0.74::double else 1.0::double end) end as v{d}"""

    return f"""
        with words as (select *, lower(w) as l from ({rows})),
        flags as (
            select *, {lags},
                bool_or(w = upper(w) and w <> lower(w)) over p and bool_or(not (w = upper(w) and w <> lower(w))) over p as mixed,
                min(case when l in {con} then pos end) over p as turn
            from words window o as (partition by {keys} order by pos), p as (partition by {keys})),
        s0 as (select *, {word_value('l', lexicon.valence)} as base from flags
               where l in {known} and l not in {in_list(lexicon.boosters)}),
        s1 as (select *, base + (case when mixed and w = upper(w) and w <> lower(w)
                    then (case when base > 0 then 0.733 else -0.733 end) else 0.0 end)::double as v0 from s0),
        s2 as (select *, {step(1, 1.0)} from s1),
        s3 as (select *, {step(2, 0.95)} from s2),
        s4 as (select *, {step(3, 0.9)} from s3),
        sums as (
            select {keys}, cast(sum(cast(floor(v3 * (case when turn is null or turn = pos then 1.0 when pos < turn then 0.5 else 1.5 end)::double
                * 1000000.0::double + 0.5::double) as bigint)) as bigint) / 1000000.0::double as t
            from s4 group by {keys}),
        scored as (
            select {keys}, coalesce(t, 0.0)::double as t,
                least(length({text}) - length(replace({text}, '!', '')), 4) * 0.292::double
                + (case when length({text}) - length(replace({text}, '?', '')) <= 1 then 0.0
                        when length({text}) - length(replace({text}, '?', '')) <= 3
                        then (length({text}) - length(replace({text}, '?', ''))) * 0.18::double else 0.96::double end)::double as extra
            from (select {keys}, {text} from {source}) left join sums using ({keys})),
        signed as (select {keys}, case when t > 0 then t + extra when t < 0 then t - extra else 0.0::double end as s, t from scored)
        select {keys}, case when t = 0 then 0.0::double else round(s / sqrt(s * s + 15.0::double), 4) end as compound
        from signed"""


def label(c: str) -> str:
    return f"case when {c} >= 0.05 then 'positive' when {c} <= -0.05 then 'negative' else 'neutral' end"


# -- cleaning and ingest ----------------------------------------------------

def clean(text: str) -> str:
    """Decodes the entities that occur in the data; ``&amp`` last, as it makes new ones."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&")):
        text = f"replace({text}, {q(name)}, {q(char)})"
    for pattern in ("<[^>]+>", rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+", f"[{SPACE}]+"):
        text = f"regexp_replace({text}, {q(pattern)}, ' ', 'g')"
    return f"trim({text})"


CANONICAL = """
    select doc_id as review_id, text, case when quality = 1 then 5.0::double end as rating,
        try_cast('2024-01-' || lpad(cast(1 + n_chars % 40 as varchar), 2, '0') as timestamp) as date,
        source as product
    from documents left join labels using (doc_id)
    where regexp_matches(text, '[^' || '""" + SPACE + """' || ']')"""

PIPE_REVIEWS = f"""
    with c as (select * from (select review_id, {clean('text')} as text, rating, date, product from ({CANONICAL})) where text <> ''),
    s as ({compound_rows("c", "review_id", "text")})
    select c.*, s.compound as doc_compound, {label('s.compound')} as doc_sentiment from c join s using (review_id)
"""


def theme_case(norm: str, themes) -> str:
    cases = [
        "when " + " or ".join(f"contains({norm}, {q(k)})" for k in keys) + f" then {q(name)}"
        for name, keys in themes.items()
    ]
    return f"case {' '.join(cases)} end"


def normal(term: str) -> str:
    """Norm of a term through its list of words."""
    words = f"string_split(regexp_replace({strip(f'lower({term})')}, {q(f'[{SPACE}]+')}, ' ', 'g'), ' ')"
    last = "w[-1]"
    one = f"""case when {last} like '%ies' and length({last}) > 3 then {last}[:-4] || 'y'
        when regexp_matches({last}, '(ses|xes|zes|ches|shes)$') then {last}[:-3]
        when {last} like '%s' and {last} not like '%ss' and length({last}) > 3 then {last}[:-2] else {last} end"""
    return f"(list_transform([{words}], lambda w: array_to_string(list_append(w[:-2], {one}), ' '))[1])"


PIPE_MENTIONS = f"""
    with r as ({PIPE_REVIEWS}),
    s as ({explode('r', 'review_id', split_sentences('text'), 'sentence_id', 'sentence')}),
    v as ({compound_rows('s', 'review_id, sentence_id', 'sentence')}),
    t as ({term_rows('s', 'review_id, sentence_id', 'sentence', default_noun)})
    select r.review_id, r.product, r.rating, r.date, s.sentence_id, s.sentence, r.doc_sentiment, r.doc_compound,
        t.term as aspect, coalesce({theme_case('n', THEME_KEYWORDS)}, n) as theme,
        {label('v.compound')} as aspect_sentiment, v.compound as aspect_compound
    from (select *, {normal('term')} as n from t) t
    join s using (review_id, sentence_id) join v using (review_id, sentence_id) join r using (review_id)
"""

# -- mention summaries ------------------------------------------------------

MENTIONS = """
    select l_orderkey as review_id, l_linenumber as sentence_id,
        case when l_orderkey % 23 <> 0 then p_brand end as product,
        case when l_orderkey % 17 <> 0 then cast(1 + l_quantity % 5 as double) end as rating,
        case when l_orderkey % 19 <> 0 then l_shipdate end as date,
        concat('s', l_orderkey, '-', l_linenumber) as sentence, p_name as aspect,
        split_part(p_name, ' ', 2) as theme,
        case when l_returnflag = 'A' then 'positive' when l_returnflag = 'R' then 'negative' else 'neutral' end as aspect_sentiment,
        round((l_discount - 0.05) * 20, 4) as aspect_compound
    from lineitem join part on l_partkey = p_partkey"""

COUNTS = """cast(count(*) filter (aspect_sentiment = 'positive') as bigint) as positive,
        cast(count(*) filter (aspect_sentiment = 'neutral') as bigint) as neutral,
        cast(count(*) filter (aspect_sentiment = 'negative') as bigint) as negative"""


def distribution(group: str, source: str = MENTIONS) -> str:
    return f"""
        select {group}, positive, neutral, negative, positive + neutral + negative as mentions,
            positive / (positive + neutral + negative) as pct_positive,
            negative / (positive + neutral + negative) as pct_negative,
            (positive - negative) / (positive + neutral + negative) as net_score
        from (select {group}, {COUNTS} from ({source}) where {group} is not null group by {group})"""


def trend(unit: str) -> str:
    return f"""
        select cast(date_trunc('{unit}', date) as timestamp) as period, {COUNTS}
        from ({MENTIONS}) where date is not null group by 1"""


def quotes(group: str, k: int) -> str:
    def side(name, order):
        return f"""
            select {group}, '{name}' as side, aspect_sentiment, aspect_compound, sentence from (
                select *, row_number() over (partition by {group} order by aspect_compound {order}, review_id, sentence_id, aspect_sentiment) as rn
                from ({MENTIONS})) where rn <= {k}"""
    return side("loved", "desc") + " union all " + side("hated", "asc")


OPINIONS = f"select review_id, count(distinct aspect_sentiment) > 1 as mixed from ({MENTIONS}) group by 1"
FILTERED = f"""
    select * from ({MENTIONS}) where (product in ('Brand#1', 'Brand#12', 'Brand#25') or product is null)
        and (rating between 2 and 4 or rating is null)"""

# -- evaluation -------------------------------------------------------------

COMPOUND_PAIRS = f"""
    select theme as dataset, 'compound' as model, aspect_sentiment as y_true, {label('aspect_compound')} as y_pred
    from ({MENTIONS})"""
RATING_PAIRS = f"""
    select theme as dataset, 'rating' as model, aspect_sentiment as y_true,
        case when rating >= 4 then 'positive' when rating <= 2 then 'negative' else 'neutral' end as y_pred
    from ({MENTIONS}) where rating is not null"""


def class_rows(pairs: str, keys: str, labels=("negative", "neutral", "positive")) -> str:
    """One row per key and class; precision, recall and F1 unrounded."""
    values = ", ".join(f"({q(x)})" for x in labels)
    return f"""
        select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f from (
            select {keys}, label, support, guessed,
                case when guessed > 0 then hit / guessed else 0 end as p,
                case when support > 0 then hit / support else 0 end as r
            from (select {keys}, label, count(*) filter (y_true = label and y_pred = label) as hit,
                    count(*) filter (y_true = label) as support, count(*) filter (y_pred = label) as guessed
                  from ({pairs}), (values {values}) as v(label) group by {keys}, label))"""


def score_rows(pairs: str, keys: str, observed: bool = False) -> str:
    keep = "where support + guessed > 0" if observed else ""
    return f"""
        select {keys}, n, accuracy, macro_f1 from
            (select {keys}, cast(count(*) as bigint) as n, round(avg(case when y_true = y_pred then 1.0 else 0.0 end), 4) as accuracy
             from ({pairs}) group by {keys})
        join (select {keys}, round(avg(f), 4) as macro_f1 from ({class_rows(pairs, keys)}) {keep} group by {keys}) using ({keys})"""


def metric_rows(pairs: str) -> str:
    return f"""
        select dataset, 'sentiment' as task, model, metric, value from (
            select dataset, model, cast(n as double) as n, accuracy::double as accuracy, macro_f1::double as macro_f1
            from ({score_rows(pairs, 'dataset, model')}))
        unpivot (value for metric in (n, accuracy, macro_f1))"""


FIRST_RUN = metric_rows(
    COMPOUND_PAIRS + f" union all select dataset, 'constant', y_true, 'neutral' from ({COMPOUND_PAIRS})"
)
SECOND_RUN = metric_rows(
    RATING_PAIRS + f" union all select dataset, 'compound', y_true, y_pred from ({RATING_PAIRS})"
)
UPSERT = f"""
    with old as ({FIRST_RUN}), new as ({SECOND_RUN})
    select * from new union all
    select * from old anti join new using (dataset, task, model, metric)"""


def extraction(gold: str, pred: str, keys: str) -> str:
    return f"""
        select {keys}, round(p, 4) as precision, round(r, 4) as recall,
            round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) as f1,
            tp as true_positives, fp as false_positives, fn as false_negatives,
            tp + fn as n_gold_terms, tp + fp as n_pred_terms
        from (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p,
                case when tp + fn > 0 then tp / (tp + fn) else 0 end as r
              from (select {keys}, cast(count(*) filter (g and p) as bigint) as tp,
                        cast(count(*) filter (p and g is null) as bigint) as fp,
                        cast(count(*) filter (g and p is null) as bigint) as fn
                    from (select distinct {keys}, sid, lower(trim(term)) as term, true as g from ({gold}) where trim(term) <> '')
                    full join (select distinct {keys}, sid, lower(trim(term)) as term, true as p from ({pred}) where trim(term) <> '')
                    using ({keys}, sid, term) group by {keys}))"""


# -- spans ------------------------------------------------------------------

GOLD_TEXT = f"""
    select lang as dataset, doc_id || '-' || sentence_id as sentence_id,
        regexp_replace(sentence, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') as text
    from ({SENTENCES})"""
# White-space tokens from the list of words and running lengths.
GOLD_TOKENS = f"""
    select dataset, sentence_id, cast(row_number() over (partition by dataset, sentence_id order by wpos) - 1 as integer) as pos,
        cast(start as integer) as start, cast(start + length(word) as integer) as "end"
    from (select *, coalesce(sum(length(word) + 1) over (partition by dataset, sentence_id order by wpos
                rows between unbounded preceding and 1 preceding), 0) as start
          from ({explode(f"({GOLD_TEXT})", "dataset, sentence_id",
                         f"string_split(regexp_replace(text, {q(f'[{SPACE}]')}, ' ', 'g'), ' ')", "wpos", "word")}))
    where word <> ''"""
GOLD_SPANS = f"""
    select dataset, sentence_id, cast(row_number() over (partition by dataset, sentence_id order by pos) - 1 as integer) as idx,
        cast(start + 1 as integer) as start, cast(coalesce(next_end, "end") as integer) as "end"
    from (select *, lead("end") over (partition by dataset, sentence_id order by pos) as next_end from ({GOLD_TOKENS}))
    where "end" - start >= 8"""
OWNED = f"""
    select t.dataset, t.sentence_id, t.pos, t.start, t."end", cast(min(s.idx) as integer) as span_idx
    from tok t left join spans s on t.dataset = s.dataset and t.sentence_id = s.sentence_id
        and t.start < s."end" and t."end" > s.start
    group by all"""
LABELS = f"""
    with tok as ({GOLD_TOKENS}), spans as ({GOLD_SPANS}), owned as ({OWNED})
    select *, case when span_idx is null then 0
        when span_idx is not distinct from lag(span_idx) over (partition by dataset, sentence_id order by pos) then 2
        else 1 end as label from owned"""
GOLD_TERMS = f"""
    select dataset, sentence_id, substr(text, s.start + 1, s."end" - s.start) as term,
        ['positive', 'negative', 'neutral', 'conflict'][(s.start + s.idx) % 4 + 1] as polarity, s.start, s."end"
    from ({GOLD_SPANS}) s join ({GOLD_TEXT}) t using (dataset, sentence_id)"""


def fold(key: str) -> str:
    return f"case when ('0x' || substr(md5({key} || '|42'), 1, 8))::bigint % 10000 < 1000 then 'dev' else 'train' end"


def run_rows(source: str, column: str) -> str:
    """Runs of B/I labels of a column: ``dataset, sentence_id, first, last``."""
    return f"""
        select dataset, sentence_id, min(pos) as first, max(pos) as last from (
            select *, sum(case when {column} = 1 or ({column} = 2 and coalesce(prev, 0) = 0) then 1 else 0 end)
                over (partition by dataset, sentence_id order by pos) as run
            from (select *, lag({column}) over (partition by dataset, sentence_id order by pos) as prev from ({source})))
        where {column} in (1, 2) group by dataset, sentence_id, run"""


PAIRS = f"""
    select dataset, sentence_id, term as aspect, start,
        case polarity when 'negative' then 0 when 'neutral' then 1 else 2 end as label,
        {fold("dataset || '|' || sentence_id || '|' || term || '|' || start")} as fold
    from ({GOLD_TERMS}) where polarity <> 'conflict'"""
MATRIX_PAIRS = f"""
    select dataset, m.model, polarity as y_true,
        case when m.model = 'lexicon' then {label('c.compound')}
             when length(term) % 2 = 0 then 'positive' else 'negative' end as y_pred
    from (select * from ({GOLD_TERMS}) where polarity <> 'conflict') g
    join ({compound_rows('(' + GOLD_TEXT + ')', 'dataset, sentence_id', 'text')}) c using (dataset, sentence_id),
    (values ('lexicon'), ('length')) as m(model)"""
MATRIX_GUESSES = f"""
    select dataset, 'nouns' as model, sentence_id as sid, term from ({term_rows('(' + GOLD_TEXT + ')', 'dataset, sentence_id', 'text', default_noun)})
    union all
    select dataset, 'long', sentence_id, term from ({term_rows('(' + GOLD_TEXT + ')', 'dataset, sentence_id', 'text', long_noun)})"""

LIMITED_IDS = f"""
    select dataset, sentence_id from ({GOLD_TEXT})
    qualify row_number() over (partition by dataset order by sentence_id) <= {MATRIX_LIMIT}"""

CLASS_SCORES = """
    select vec_id, label, x, list_transform(x, lambda v: exp(v - list_max(x))) as e
    from (select vec_id, label, [sum(v) filter (i % 3 = 1), sum(v) filter (i % 3 = 2), sum(v) filter (i % 3 = 0)] as x
          from (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings)
          group by vec_id, label)"""

WORDS = f"select distinct unnest(regexp_extract_all(text, {q(TOKEN)})) as term from documents"

def plain_words(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(coalesce({text}, ''), {q(f'[{SPACE}]+')}, ' ', 'g'), ' '), lambda w: w <> '')"


def word_type(w: str) -> str:
    return f"lower(regexp_replace({w}, {q(f'^[^{ALNUM}]+|[^{ALNUM}]+$')}, '', 'g'))"


CLOSERS = "[\"'”’)\\]]"


def ends_in_period(w: str) -> str:
    return f"regexp_matches({w}, {q(f'[{ALNUM}][.]{CLOSERS}*$')})"


ABBREVIATIONS = f"""
    with w as (select unnest({plain_words('text')}) as w from documents),
    t as (select {word_type('w')} as type, count(*) filter ({ends_in_period('w')}) as d, count(*) filter (not {ends_in_period('w')}) as r
          from w group by 1),
    c as (select *, sum(d) over () as dots, sum(d + r) over () as n,
              length(type) - length(replace(type, '.', '')) as inner_dots
          from t where regexp_matches(type, '\\p{{L}}'))
    select type, d as with_period, r as without_period,
        2 * (d * ln(0.99) + case when r = 0 then 0 else r * ln(1 - 0.99) end
             - d * ln(dots / n) - case when r = 0 then 0 else r * ln(1 - dots / n) end)
        * exp(-(length(type) - inner_dots)) * (inner_dots + 1) * pow((length(type) - inner_dots)::double, -r) as score
    from c where d > 0"""


def learned_split() -> str:
    """Candidate boundaries as marks, pieces as rows, and a running count of sentence starts."""
    closers = "[\"'”’)\\]]{0,3}"
    marked = f"regexp_replace(coalesce(text, ''), {q(f'([.!?]{closers})([{SPACE}]+)')}, '\\1\\2' || chr(1), 'g')"
    initials = q(rf"(^|[^{ALNUM}])([A-HJ-Z]\.)([{SPACE}]+)\x01")
    ellipsis = q(rf"(\.\.)([{SPACE}]+)\x01(\p{{Ll}})")
    for pattern in (initials, initials, ellipsis):
        marked = f"regexp_replace({marked}, {pattern}, '\\1\\2\\3', 'g')"
    return f"""
        with abbreviations as (select type from ({ABBREVIATIONS}) where score >= 0.3),
        pieces as ({explode('documents', 'doc_id', f'string_split({marked}, chr(1))', 'pos', 'piece')}),
        ended as (select *, regexp_extract({strip('piece')}, {q(f'([^{SPACE}]+)$')}, 1) as word from pieces),
        flagged as (select doc_id, pos, piece, type is not null as goes_on from ended
            left join abbreviations on {ends_in_period('word')} and {word_type('word')} = type),
        starts as (select *, coalesce(lag(goes_on) over (partition by doc_id order by pos), false) as inside from flagged),
        numbered as (select *, sum(case when inside then 0 else 1 end) over (partition by doc_id order by pos) as no from starts),
        whole as (select doc_id, no, {strip("string_agg(piece, '' order by pos)")} as sentence from numbered group by all)
        select doc_id, cast(row_number() over (partition by doc_id order by no) - 1 as integer) as sentence_id, sentence
        from whole where sentence <> ''"""


def joined_phrases() -> str:
    """``doc_id, text`` with the words of a phrase joined; no phrase of the list can overlap another."""
    trimmed = f"trim(lower(w || ' ' || lead(w) over (partition by doc_id order by pos)), {q(PUNCTUATION)})"
    return f"""
        select d.doc_id, coalesce(string_agg(case when inside then '_' when pos = 0 then '' else ' ' end || w, '' order by pos), '') as text
        from documents d left join (
            select *, coalesce(lag(hit) over (partition by doc_id order by pos), false) as inside from (
                select *, coalesce({trimmed} in {in_list(PHRASES)}, false) as hit
                from ({explode('documents', 'doc_id', plain_words('text'), 'pos', 'w')}))) using (doc_id)
        group by d.doc_id"""


PHRASE_LEXICON = replace(LEXICON, valence={**LEXICON.valence, **{p.replace(" ", "_"): v for p, v in PHRASES.items()}})

# -- term vectors -----------------------------------------------------------

VECTORS = f"""
    with pairs as (
        select distinct doc_id as c, term as t from ({term_rows(f'({SENTENCES})', 'doc_id, sentence_id', 'sentence', default_noun)})),
    marks as (
        select t, n % 64 as dim, case when (n // 64) % 2 = 0 then 1 else -1 end as sign
        from (select t, cast('0x' || substr(md5(t), 1 + 6 * j, 6) as bigint) as n
              from (select distinct t from pairs) cross join range(4) r(j))),
    sizes as (select c, case when count(*) > 1 then 1024 // (count(*) - 1) else 0 end as w from pairs group by 1),
    totals as (select c, dim, sum(sign) as s from pairs join marks using (t) group by all),
    terms as (select t, count(*) as contexts, sum(w) as w from pairs join sizes using (c) group by 1 having count(*) >= 2),
    shared as (select t, dim, sum(w * s) as v from pairs join sizes using (c) join totals using (c) group by all),
    own as (select t, dim, sum(sign) as s from marks group by all),
    cells as (
        select t, contexts, dim, cast(coalesce(v, 0) - w * coalesce(s, 0) as bigint) as v
        from terms cross join range(64) d(dim) left join shared using (t, dim) left join own using (t, dim))
    select t as aspect, contexts, string_agg(v, ',' order by dim) as sums, max(abs(v)) > 0 as meets_others from cells group by 1, 2"""


ORACLE: dict[str, str] = {
    "canonical_reviews": CANONICAL,
    "numbered_reviews": f"""
        select row_number() over (order by doc_id) as review_id, source as product, text from documents
        where regexp_matches(text, {q(f'[^{SPACE}]')})""",
    "csv_reviews": CANONICAL,
    "clean_pages": f"select * from (select page_id, {clean('html')} as text from pages) where text <> ''",
    "document_sentences": f"select doc_id, sentence_id, sentence from ({SENTENCES})",
    "turn_sentences": explode("conversations", "conv_id, turn, role", split_sentences("text"), "sentence_id", "sentence"),
    "first_documents": "select doc_id, source, n_chars from documents order by n_chars, doc_id limit 25",
    "aspect_mentions": f"""
        select doc_id, sentence_id, term as aspect from ({term_rows(f'({SENTENCES})', 'doc_id, sentence_id', 'sentence', default_noun)})""",
    "term_lists": f"""
        select doc_id, sentence_id, coalesce(terms, '') as terms from ({SENTENCES}) left join (
            select doc_id, sentence_id, string_agg(term, '|' order by first_at) as terms
            from ({term_rows(f'({SENTENCES})', 'doc_id, sentence_id', 'sentence', long_noun, 2)}) group by all)
        using (doc_id, sentence_id)""",
    "tag_table_mentions": f"""
        select doc_id, sentence_id, term as aspect from ({term_rows(f'({SENTENCES})', 'doc_id, sentence_id', 'sentence', long_noun)})""",
    "doc_sentiment": f"""
        select doc_id, compound as doc_compound, {label('compound')} as doc_sentiment
        from ({compound_rows('documents', 'doc_id', 'text')})""",
    "sentence_scores": f"""
        select doc_id, sentence_id, compound as aspect_compound, {label('compound')} as aspect_sentiment
        from ({compound_rows(f'({SENTENCES})', 'doc_id, sentence_id', 'sentence')})""",
    "doc_sentiment_by_table": compound_rows("documents", "doc_id", "text"),
    "pipeline_reviews": PIPE_REVIEWS,
    "pipeline_mentions": PIPE_MENTIONS,
    "pipeline_mentions_by_table": PIPE_MENTIONS,
    "pipeline_summary": distribution("theme", PIPE_MENTIONS),
    "saved_counts": f"""
        select (select count(*) from ({PIPE_REVIEWS})) as reviews,
            (select count(*) from ({explode(f'({PIPE_REVIEWS})', 'review_id', split_sentences('text'), 'sentence_id', 'sentence')})) as sentences,
            (select count(*) from ({PIPE_MENTIONS})) as mentions""",
    "normalized_terms": f"select term, {normal('term')} as norm from ({WORDS})",
    "term_themes": f"""
        select term as aspect, coalesce({theme_case('n', THEME_KEYWORDS)}, n) as theme
        from (select term, {normal('term')} as n from ({WORDS}))""",
    "part_themes": f"""
        select review_id, sentence_id, aspect, coalesce({theme_case('n', PART_THEMES)}, n) as theme
        from (select *, {normal('aspect')} as n from ({MENTIONS}))""",
    "theme_table_join": f"""
        select review_id, sentence_id, aspect, coalesce({theme_case('n', PART_THEMES)}, 'other') as theme
        from (select *, {normal('aspect')} as n from ({MENTIONS}))""",
    "aspect_vectors": f"select aspect, contexts, sums from ({VECTORS})",
    "learned_theme_checks": f"""
        select count(*) filter (meets_others) as terms, count(*) filter (meets_others) as with_theme, 0 as misnamed, 0 as split_clusters
        from ({VECTORS})""",
    "aspect_distribution": distribution("aspect"),
    "theme_distribution": distribution("theme"),
    "top_loved": f"select * from ({distribution('aspect')}) where mentions >= 2 order by net_score desc, mentions desc, aspect limit 8",
    "top_hated": f"select * from ({distribution('aspect')}) where mentions >= 3 order by net_score, mentions desc, aspect limit 8",
    "quotes": quotes("aspect", 2),
    "loved_quotes": f"select theme, sentence, aspect_compound from ({quotes('theme', 1)}) where side = 'loved'",
    "sentiment_by_rating": f"""
        select rating, aspect_sentiment, cast(count(*) as bigint) as count from ({MENTIONS}) where rating is not null group by all""",
    "trend_month": trend("month"),
    "trend_week": trend("week"),
    "trend_quarter": trend("quarter"),
    "trend_long": f"""
        select period, sentiment, count from ({trend('month')})
        unpivot (count for sentiment in (positive, neutral, negative))""",
    "mixed_review_count": f"select cast(count(*) filter (mixed) as bigint) as mixed_reviews from ({OPINIONS})",
    "mixed_rows": f"""
        select review_id, sentence_id, aspect, aspect_sentiment, aspect_compound from ({MENTIONS})
        where review_id in (select review_id from ({OPINIONS}) where mixed)""",
    "overview": f"""
        select (select count(distinct o_orderkey) from orders) as reviews, count(*) as mentions,
            count(distinct aspect) as distinct_aspects,
            (select count(*) from (select review_id from ({FILTERED}) group by 1 having count(distinct aspect_sentiment) > 1)) as mixed_reviews
        from ({FILTERED})""",
    "filtered_mentions": f"select review_id, sentence_id, product, rating, aspect from ({FILTERED})",
    "product_facets": f"select distinct product from ({MENTIONS}) where product is not null",
    "rating_facet": f"""
        select cast(floor(min(rating - 0.5)) as bigint) as low, cast(ceil(max(rating - 0.5)) as bigint) as high from ({MENTIONS})""",
    "distribution_long": f"""
        select aspect, mentions, net_score, sentiment, count from (
            select aspect, mentions, net_score, positive, neutral, negative from ({distribution('aspect')}) where mentions >= 2)
        unpivot (count for sentiment in (positive, neutral, negative))""",
    "net_scores": f"select theme, mentions, net_score from ({distribution('theme')}) where mentions >= 2",
    "trend_stream": """
        select cast(date_trunc('week', ts) as timestamp) as period,
            cast(count(*) filter (event_type = 'purchase') as bigint) as positive,
            cast(count(*) filter (event_type is distinct from 'purchase' and event_type is distinct from 'error') as bigint) as neutral,
            cast(count(*) filter (event_type = 'error') as bigint) as negative
        from events where ts is not null group by 1""",
    "overview_stream": """
        select count(*) as reviews, cast(sum(n) as bigint) as mentions, cast(count(*) filter (kinds > 1) as bigint) as mixed_reviews
        from (select user_id, count(*) as n, count(distinct event_type) filter (event_type in ('purchase', 'error')) as kinds
              from events where user_id is not null group by 1)""",
    "extraction_scores": extraction(
        f"select lang as dataset, 'long' as model, doc_id || '-' || sentence_id as sid, term from ({term_rows(f'({SENTENCES})', 'lang, doc_id, sentence_id', 'sentence', default_noun)})",
        f"select lang as dataset, 'long' as model, doc_id || '-' || sentence_id as sid, term from ({term_rows(f'({SENTENCES})', 'lang, doc_id, sentence_id', 'sentence', long_noun)})",
        "dataset, model",
    ),
    "sentiment_scores": score_rows(COMPOUND_PAIRS + " union all " + RATING_PAIRS, "dataset, model"),
    "class_report": f"""
        select dataset, label, round(p, 4) as precision, round(r, 4) as recall, round(f, 4) as f1, cast(support as bigint) as support
        from ({class_rows(COMPOUND_PAIRS, 'dataset')})""",
    "confusion": f"select y_true, y_pred, cast(count(*) as bigint) as count from ({COMPOUND_PAIRS}) group by all",
    "dev_scores": score_rows(
        f"select dataset, replace(y_true, 'neutral', 'positive') as y_true, replace(y_pred, 'neutral', 'positive') as y_pred from ({COMPOUND_PAIRS})",
        "dataset", observed=True,
    ),
    "metrics_upsert": UPSERT,
    "metrics_versions": UPSERT,
    "metrics_report": f"""
        select dataset, task, model, max(value) filter (metric = 'accuracy') as accuracy,
            max(value) filter (metric = 'macro_f1') as macro_f1, max(value) filter (metric = 'n') as n
        from ({FIRST_RUN}) group by all""",
    "gold_xml": f"""
        select dataset || '/' || sentence_id as sentence_id, term, polarity, start, "end"
        from ({GOLD_TERMS}) where polarity <> 'conflict'""",
    "bio_label_rows": f"""
        select dataset, sentence_id, {fold("dataset || '|' || sentence_id")} as fold,
            string_agg(label, ',' order by pos) as labels
        from ({LABELS}) group by all""",
    "bio_decode": f"""
        with runs as ({run_rows(LABELS, 'label')}), tok as ({GOLD_TOKENS})
        select distinct r.sentence_id, lower(trim(substr(text, a.start + 1, b."end" - a.start))) as term
        from runs r join tok a on a.dataset = r.dataset and a.sentence_id = r.sentence_id and a.pos = r.first
        join tok b on b.dataset = r.dataset and b.sentence_id = r.sentence_id and b.pos = r.last
        join ({GOLD_TEXT}) t on t.dataset = r.dataset and t.sentence_id = r.sentence_id""",
    "token_overlaps": f"""
        with tok as ({GOLD_TOKENS}), spans as ({GOLD_SPANS}), owned as ({OWNED})
        select sentence_id, pos, start, "end", span_idx from owned""",
    "span_scores": f"""
        with truth as ({run_rows(LABELS, 'label')}),
        guess as ({run_rows(f'select *, case when "end" - start >= 7 then 1 else 0 end as g from ({GOLD_TOKENS})', 'g')}),
        c as (select d.dataset,
                (select count(*) from truth t where t.dataset = d.dataset) as nt,
                (select count(*) from guess g where g.dataset = d.dataset) as np,
                (select count(*) from truth t join guess g using (dataset, sentence_id, first, last) where t.dataset = d.dataset) as tp
              from (select distinct lang as dataset from documents) d)
        select dataset, round(tp / np, 4) as precision, round(tp / nt, 4) as recall,
            round(case when tp > 0 then 2 * (tp / np) * (tp / nt) / (tp / np + tp / nt) else 0 end, 4) as f1,
            cast(tp as bigint) as true_spans_found, cast(nt as bigint) as n_true_spans, cast(np as bigint) as n_pred_spans
        from c""",
    "train_dev_split": f"select doc_id, source, {fold('doc_id::varchar')} as fold from documents",
    "pair_examples": PAIRS,
    "sentiment_matrix": score_rows(MATRIX_PAIRS, "dataset, model"),
    "extraction_matrix": f"""
        select e.*, n_sentences from ({extraction(
            f"select dataset, m.model, sentence_id as sid, term from ({GOLD_TERMS}), (values ('nouns'), ('long')) as m(model)",
            MATRIX_GUESSES, "dataset, model")}) e
        join (select dataset, cast(count(*) as bigint) as n_sentences from ({GOLD_TEXT}) group by 1) using (dataset)""",
    "limited_matrix": f"""
        select e.*, n_sentences from ({extraction(
            f"select dataset, m.model, sentence_id as sid, term from ({GOLD_TERMS}) join ({LIMITED_IDS}) using (dataset, sentence_id), (values ('nouns'), ('long')) as m(model)",
            f"select dataset, model, sid, term from ({MATRIX_GUESSES}) join (select dataset, sentence_id as sid from ({LIMITED_IDS})) using (dataset, sid)",
            "dataset, model")}) e
        join (select dataset, cast(count(*) as bigint) as n_sentences from ({LIMITED_IDS}) group by 1) using (dataset)""",
    "model_labels": f"""
        select vec_id, ['negative', 'neutral', 'positive'][list_position(e, list_max(e))] as label,
            round(e[3] / (e[1] + e[2] + e[3]) - e[1] / (e[1] + e[2] + e[3]), 6) as score,
            ['negative', 'neutral', 'positive'][label % 3 + 1] as raw_label
        from ({CLASS_SCORES})""",
    "model_hook": f"""
        with w as ({explode(f'({SENTENCES})', 'doc_id, sentence_id',
                            f"list_filter(string_split(regexp_replace(sentence, {q(f'[{SPACE}]+')}, ' ', 'g'), ' '), lambda x: x <> '')", 'pos', 'word')}),
        best as (select doc_id, sentence_id, count(*) as n, arg_min(word, pos - 1000000.0 * length(word)) as word from w group by all),
        s as (select doc_id, sentence_id, lower(word) as aspect,
                greatest(-1.0, least(1.0, (length(word) - n) / 8.0))::double as score from best)
        select doc_id, sentence_id, aspect, case when score > 0 then 'positive' when score < 0 then 'negative' else 'neutral' end as label, score
        from s""",
    "exact_split": """
        select doc_id, source, case when row_number() over (partition by source order by md5(doc_id::varchar || '|42'), doc_id)
            <= greatest(1, floor(count(*) over (partition by source) * 0.1)) then 'dev' else 'train' end as fold from documents""",
    "gold_folder": f"""
        with g as (select case when dataset in ('en', 'fr') then 'restaurants' else 'laptops' end as d,
            case when split_part(sentence_id, '-', 1)::bigint % 2 = 0 then 'test' else 'train' end as split, * from ({GOLD_TERMS}))
        select d as dataset, split, dataset || '/' || sentence_id as sentence_id, term, polarity, start, "end"
        from g where split = 'test' or polarity <> 'conflict'""",
    "learned_abbreviations": f"select * exclude (score), round(score, 6) as score, score >= 0.3 as abbreviation from ({ABBREVIATIONS})",
    "learned_sentences": learned_split(),
    "doc_sentiment_phrases": compound_rows(f"({joined_phrases()})", "doc_id", "text", PHRASE_LEXICON),
    "nested_metrics": UPSERT,
    "checked_tables": " union all ".join(
        [f"select {q(t)} as name, count(*) filter (regexp_matches(text, {q(f'[^{SPACE}]')})) as reviews, null as error from {t}"
         for t in ("documents", "conversations", "benchmark")]
        + [f"select {q(t)}, 0, 'Input is missing the required text column'" for t in ("pages", "part")]),
    "bare_reviews": f"""
        select conv_id * 1000 + turn as review_id, text, null::double as rating, null::timestamp as date, null::varchar as product
        from conversations where regexp_matches(text, {q(f'[^{SPACE}]')})""",
    "hook_pipeline": f"""
        with p as ({PIPE_REVIEWS}), s as ({explode('p', 'review_id, product, doc_sentiment', split_sentences('text'), 'sentence_id', 'sentence')}),
        w as ({explode('s', 'review_id, product, doc_sentiment, sentence_id', plain_words('sentence'), 'pos', 'word')}),
        best as (select review_id, product, doc_sentiment, sentence_id, count(*) as n,
                arg_min(word, pos - 1000000.0 * length(word)) as word from w group by all),
        scored as (select *, greatest(-1.0, least(1.0, (length(word) - n) / 8.0))::double as score from best)
        select review_id, product, sentence_id, lower(word) as aspect, doc_sentiment, score as aspect_compound,
            case when score > 0 then 'positive' when score < 0 then 'negative' else 'neutral' end as aspect_sentiment from scored""",
}
