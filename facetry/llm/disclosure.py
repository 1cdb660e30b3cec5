"""Sanitisation of personal data by information content.

Base entities are e-mail addresses, IP addresses, card and phone numbers, found by fixed
patterns.  Besides each value, its kind and its parts that recur (user and domain of an
address, network of an IP address, prefix of a number) are entities.  All words of a
document that holds an entity are its terms.  Over the whole corpus, documents are counted
that hold an entity (e), a term (t), and both (te).  With N documents,

    PMI(t, e) = log2(te * N / (t * e)),    IC(e) = log2(N / e),

and PMI / IC says how much of the entity's information the term discloses (1: all).  From
``GENERALISE`` on a term is generalised and from ``REMOVE`` on it is removed, in every
document that holds it, if chance does not explain it: the bound on the probability of te,
times the number of pairs tested, is at most ``ALPHA``.  For that test equal texts count
once.  A term within ``REACH`` words of one value in ``SUPPORT`` rows needs no test; there
copies count.

Null and empty texts have no entities.  Ids may be null or repeat; rows are counted one
by one.  An entity that all documents hold has no information and discloses nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.kernels import (
    NOT_WORD, column_buffers, keep, positions, scan, slices, word_hashes,
)
from facetry.operators.joins import lookup_join

# Fixed patterns of the contract.  A run of digits can only match from its first digit,
# so the look-behinds and possessive counts change no match but keep long runs linear.
KINDS = ("email", "ip", "card", "phone")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
NEEDED = re.compile(r"[0-9@]")

REACH = 8
SUPPORT = 3
GENERALISE = 0.85
REMOVE = 0.99
ALPHA = 0.05
SLOT_BITS = 23
PAIR_ROWS = 1 << 17
BLOCK_TERMS = 1 << 18
PLACEHOLDER = {
    "email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "cut": "",
}
ORDER = {k: i for i, k in enumerate(PLACEHOLDER)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str):
    """Matches of the address pattern, found from each "@" so that long words cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL_END.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    out = []
    if not NEEDED.search(text):
        return out
    if "@" in text:
        out += [(s, e, "email") for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = "".join(DIGITS.findall(m.group()))
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.findall(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def plain_value(kind: str, value: str) -> str:
    """The same for spellings of one entity."""
    return value.lower() if kind == "email" else value if kind == "ip" else "".join(DIGITS.findall(value))


def name_id(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big", signed=True)


def entity_id(kind: str, value: str) -> int:
    return name_id(f"{kind}:{plain_value(kind, value)}")


def entities_of(kind: str, value: str) -> set[int]:
    """The entity itself, its kind, and its parts that other entities can share."""
    plain = plain_value(kind, value)
    if kind == "email":
        user, domain = plain.split("@")
        parts = [f"user:{user}", f"domain:{domain}"]
    elif kind == "ip":
        parts = [f"net:{plain.rpartition('.')[0]}"]
    else:
        parts = [f"{kind} prefix:{plain[:6] if kind == 'card' else plain[:-7]}"]
    return {entity_id(kind, value), *map(name_id, [f"kind:{kind}", *parts])}


def terms_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end in code points, and hash, of every word."""
    data, offsets = column_buffers(pa.array([text]))
    starts, ends, _ = positions(offsets, data, NOT_WORD)
    hashes = word_hashes(data, starts, ends, lower=True).view(np.int64)
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    return at[starts], at[ends], hashes


def free_terms(text: str, spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``terms_of``, without the words of entities."""
    starts, ends, hashes = terms_of(text)
    free = np.ones(len(starts), bool)
    for s, e, _ in spans:
        free[(starts < e) & (ends > s)] = False
    return starts[free], ends[free], hashes[free]


def near_terms(text: str, spans, words) -> dict[int, np.ndarray]:
    """Entity -> hashes of the words near one of its occurrences."""
    starts, ends, hashes = words
    out: dict[int, set] = {}
    for s, e, kind in spans:
        a, b = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e)
        near = hashes[max(0, a - REACH) : b + REACH]
        out.setdefault(entity_id(kind, text[s:e]), set()).update(near.tolist())
    return {k: np.array(sorted(v), np.int64) for k, v in out.items()}


def candidates(docs: DataFrame) -> DataFrame:
    """Rows that can hold an entity: every kind needs a digit or an "@"."""
    return docs.where(F.col("text").rlike("[0-9@]"))


def holders(docs: DataFrame) -> DataFrame:
    """``text_hash, copies, text, entities, n_terms``: the distinct texts that hold entities."""
    rows = candidates(docs).select(F.xxhash64("text").alias("text_hash"), "text")

    def work(batch):
        index, entities, n_terms = [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            if spans := base_spans(text):
                index.append(row)
                entities.append(sorted(set().union(*(entities_of(k, text[s:e]) for s, e, k in spans))))
                n_terms.append(len(np.unique(free_terms(text, spans)[2])))
        found = batch.take(pa.array(index, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*found.columns, pa.array(entities, pa.list_(pa.int64())), pa.array(n_terms, pa.int64())],
            ["text_hash", "text", "entities", "n_terms"],
        )

    found = scan(
        rows, ["text_hash", "text"], work, "text_hash long, text string, entities array<long>, n_terms long"
    )
    return found.groupBy("text_hash").agg(
        F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("text", "entities", "n_terms"))
    )


def entity_counts(held: DataFrame, support: int) -> DataFrame:
    """``entity, e, e_texts``: rows and distinct texts, of the entities that can pass a test."""
    each = held.select(F.explode("entities").alias("entity"), "copies")
    found = each.groupBy("entity").agg(F.sum("copies").alias("e"), F.count("*").alias("e_texts"))
    return found.where((F.col("e_texts") > 1) | (F.col("e") >= support))


def entity_terms(held: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity, term, copies, near``: a row per text, entity and distinct word of the text.

    ``near`` is the copies again where the word stands near the entity.  Entities without a
    count are left out as far as a bitmap of fixed size tells them.
    """
    wanted = held.sparkSession.sparkContext.broadcast(slot_table(entities.select(F.col("entity").alias("term"))))

    def work(batch):
        out, size = [], 0
        for text, copies, own in zip(*(batch.column(c).to_pylist() for c in ("text", "copies", "entities"))):
            own = np.array(own, np.int64)
            own = own[wanted.value[slots(own)]]
            if not len(own):
                continue
            spans = base_spans(text)
            words = free_terms(text, spans)
            distinct, near = np.unique(words[2]), near_terms(text, spans, words)
            for e in own.tolist():
                close = np.isin(distinct, near[e]) if e in near else np.zeros(len(distinct), bool)
                out.append((np.full(len(distinct), e), distinct, np.full(len(distinct), copies), close * copies))
                size += len(distinct)
                if size > PAIR_ROWS:
                    yield packed(out)
                    out, size = [], 0
        if out:
            yield packed(out)

    def packed(rows):
        columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays(columns, ["entity", "term", "copies", "near"])

    return scan(
        held, ["text", "copies", "entities"], work, "entity long, term long, copies long, near long"
    )


def term_rows(batch: pa.RecordBatch, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word whose slot is wanted."""
    data, offsets = column_buffers(batch.column("text"))
    starts, ends, rows = positions(offsets, data, NOT_WORD)
    hashes = word_hashes(data, starts, ends, lower=True)
    hit = wanted[slots(hashes)]
    return hashes[hit], rows[hit]


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_table(terms: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (2**SLOT_BITS bits, 1 MB) with the slots of the terms."""
    slot = F.shiftrightunsigned("term", 64 - SLOT_BITS)
    blocks = terms.groupBy(F.floor(slot / 32768).alias("block")).agg(
        F.bitmap_construct_agg(F.pmod(slot, F.lit(32768))).alias("bits")
    ).collect()
    out = np.zeros(1 << SLOT_BITS, bool)
    for row in blocks:
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        out[row["block"] * 32768 : (row["block"] + 1) * 32768] = bits[:32768]
    return out


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, df``: documents of the whole corpus that hold each term."""
    wanted = docs.sparkSession.sparkContext.broadcast(slot_table(terms))

    def count(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        hashes, rows = term_rows(part, wanted.value)
        order = np.lexsort((rows, hashes))
        hashes, rows = hashes[order], rows[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        return np.unique(hashes[new], return_counts=True)

    def merge(found: list) -> tuple[np.ndarray, np.ndarray]:
        term, place = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
        return term, np.bincount(place, np.concatenate([n for _, n in found]), len(term)).astype(np.int64)

    def work(batches):
        """A task's counts leave it once: a row per term, not per term and slice."""
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for batch in batches:
            found = [merge(found + [count(part) for part in slices(batch)])]
        term, n = found[0]
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])

    counted = docs.select("text").mapInArrow(work, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("df"))


def significance(both: str, first, second, n) -> Column:
    """-ln of a bound on the chance of ``both`` or more joint texts (Chernoff, hypergeometric)."""
    def bound(draws, share):
        part = F.col(both) / draws
        other = F.when(part < 1, (draws - F.col(both)) * F.ln((1 - part) / (1 - share))).otherwise(F.lit(0.0))
        return F.when((part > share) & (share < 1), F.col(both) * F.ln(part / share) + other).otherwise(F.lit(0.0))

    return F.greatest(bound(first, second / n), bound(second, first / n))


def disclosing_terms(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``entity, term, pmi, ratio`` of the terms at or above the generalisation threshold."""
    n = F.lit(float(docs.count()))
    held = keep(holders(docs))
    tests = held.agg(F.sum(F.size("entities") * F.col("n_terms"))).first()[0] or 1
    entities = keep(entity_counts(held, support))
    both = keep(
        entity_terms(held, entities).groupBy("entity", "term").agg(
            F.sum("copies").alias("te"), F.count("*").alias("te_texts"), F.sum("near").alias("near")
        ).where((F.col("te_texts") > 1) | (F.col("near") >= support))
    )
    scored = lookup_join(lookup_join(both, entities, "entity", "inner"), term_counts(docs, both), "term", "inner")
    pmi = F.log2(F.col("te") * n / (F.col("df") * F.col("e")))
    content = F.log2(n / F.col("e"))
    sure = significance("te_texts", F.col("e_texts"), F.col("df"), n) >= math.log(tests / ALPHA)
    return (
        scored.where((content > 0) & (sure | (F.col("near") >= support)))
        .select("entity", "term", pmi.alias("pmi"), (pmi / content).alias("ratio"))
        .where(F.col("ratio") >= GENERALISE)
    )


def term_ratios(docs: DataFrame) -> DataFrame:
    """``term, ratio``: what is hidden wherever it stands, by the entity it discloses most of."""
    return keep(disclosing_terms(docs).groupBy("term").agg(F.max("ratio").alias("ratio")))


class Flags:
    """The flagged terms of all blocks, sorted, with their ratios: 16 bytes a term."""

    def __init__(self, blocks):
        terms = np.concatenate([b.value[0] for b in blocks])
        ratios = np.concatenate([b.value[1] for b in blocks])
        order = np.argsort(terms)
        self.terms, self.ratios = terms[order], ratios[order]
        self.wanted = np.zeros(1 << SLOT_BITS, bool)
        self.wanted[slots(self.terms)] = True

    def of_rows(self, batch: pa.RecordBatch) -> list[dict[int, float]]:
        """Term -> ratio of the flagged terms of each row."""
        out = [{} for _ in range(batch.num_rows)]
        hashes, rows = term_rows(batch, self.wanted)
        if len(hashes):
            hashes = hashes.view(np.int64)
            at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
            for i in np.flatnonzero(self.terms[at] == hashes).tolist():
                out[rows[i]][int(hashes[i])] = float(self.ratios[at[i]])
        return out


def flag_blocks(flags: DataFrame) -> list:
    """The flagged terms as broadcasts of about ``BLOCK_TERMS`` each."""
    n = max(1, -(-flags.count() // BLOCK_TERMS))
    out = []
    for k in range(n):
        block = flags.where(F.pmod("term", F.lit(n)) == k).select("term", "ratio").toArrow()
        arrays = [block.column(c).to_numpy() for c in ("term", "ratio")]
        out.append(flags.sparkSession.sparkContext.broadcast(arrays))
    return out


def all_spans(text: str, terms) -> tuple[list, list]:
    """Base spans, and base plus term spans."""
    base = base_spans(text)
    if not terms:
        return base, base
    starts, ends, hashes = terms_of(text)
    more = []
    for i in np.flatnonzero(np.isin(hashes, np.fromiter(terms, np.int64))).tolist():
        s, e = int(starts[i]), int(ends[i])
        if not any(s < b and e > a for a, b, _ in base):
            more.append((s, e, "cut" if terms[int(hashes[i])] >= REMOVE else "term"))
    return base, sorted(base + more, key=lambda x: (x[0], ORDER[x[2]], x[1]))


def redact(text: str, spans) -> str:
    """The text with every span replaced by the placeholder of its kind; overlaps merge."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], PLACEHOLDER[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def all_rows(docs: DataFrame, work: Callable, schema) -> DataFrame:
    """``work(batch, terms of each row)`` over all rows; documents do not move."""
    blocks, made = flag_blocks(term_ratios(docs)), []

    def run(batch):
        if not made:
            made.append(Flags(blocks))
        yield work(batch, made[0].of_rows(batch))

    return scan(docs, docs.columns, run, schema)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms`` for every row."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_terms"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long"

    def work(batch, disclosed):
        rows = []
        for doc, text, terms in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), disclosed):
            base, spans = all_spans(text or "", terms)
            kinds = [k for *_, k in base]
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((doc, *map(kinds.count, KINDS), digest, joined(spans), len(spans) - len(base)))
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.string() if n in ("base_sha256", "spans") else pa.int64())
             for n, c in zip(names, columns)], names,
        )

    return all_rows(docs.select("doc_id", "text"), work, schema)


def sanitise(docs: DataFrame) -> DataFrame:
    """The same rows and columns; entities and disclosing terms are replaced in ``text``."""
    names = docs.columns

    def work(batch, disclosed):
        texts = [
            text and redact(text, all_spans(text, terms)[1])
            for text, terms in zip(batch.column("text").to_pylist(), disclosed)
        ]
        at = batch.schema.get_field_index("text")
        out = batch.set_column(at, "text", pa.array(texts, batch.schema.field("text").type))
        return out.select(names)

    return all_rows(docs, work, docs.schema)
