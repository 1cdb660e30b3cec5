"""Byte pairs, conversation tries and conversation repair: library, brute force and odd rows."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from facetry.llm import burst_trie, byte_pairs, repair
from facetry.llm.queries import QUERIES

CONVERSATION = "conv_id long, turn long, role string, text string, pos long, head string, tid string, k int, audit int"
EXTRA = (1, "x", "y", 2, 3)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_pairs.default_path())


def encoded(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    ids, sizes = byte_pairs.encoder(byte_pairs.default_path()).encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_fragments_encode_as_the_library(library):
    rng = random.Random(11)
    letters = [*" \n\t\r\x0b\x1c\x85\xa0 　᠎ 'stmlreavdx.,!?éßĀ中文字🙂019½‍\x00<|>", "  ", "'s", "\n\n",
               "<|endoftext|>", "<|endoftext|", " ", "n't", "́"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 16))) for _ in range(20_000)] + ["z" * 50_000, "　" * 3000, ""]
    expected = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoded(texts) == expected


def test_forced_boundaries_hold_in_every_token():
    words = byte_pairs.vocabulary(byte_pairs.default_path())
    assert 0 < words.never.sum() < len(words.never)
    assert not any(words.never[a * 256 + b] for raw in words.raw[:-1] for a, b in zip(raw, raw[1:]))


def test_byte_pairs_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = set()
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.add((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in QUERIES["op13_byte_pairs"](spark, sf_dir).collect()]
    assert len(got) == len(docs) and set(got) == expected


def test_byte_pairs_of_odd_rows(spark):
    schema = "doc_id long, text string, ids string"
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a b", "x"), (2, "a b", "x"), (2, "a b", "x")], schema)
    out = byte_pairs.decode_documents(byte_pairs.encode_documents(odd)).collect()
    assert sorted((r["doc_id"] or 0, r["text"], len(r["ids"])) for r in out) == [
        (0, "a b", 2), (1, "", 0), (1, "", 0), (2, "a b", 2), (2, "a b", 2)]
    assert byte_pairs.decode_documents(byte_pairs.encode_documents(odd.limit(0))).count() == 0
    ids = spark.createDataFrame([(1, [64, None, 999_999, -5, 50256]), (2, None)], "doc_id long, ids array<int>")
    assert {tuple(r) for r in byte_pairs.decode_documents(ids).select("doc_id", "text").collect()} == {
        (1, "a<|endoftext|>"), (2, "")}


def conversations(rng):
    """Shared openings, nulls, ties, repeated rows, and one conversation with most of the rows."""
    rows = []
    for c in [*range(60), -7, 10**12, None]:
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", None, ""])
                         if rng.random() < 0.3 else ("user", "assistant")[t % 2],
                         rng.choice(["a.", "bé", " ", None, "", "a.\n"]) if rng.random() < 0.4 else "Same."))
    rows += [(3, t, ("user", "assistant")[t % 2], f"turn {t % 7}.") for t in range(20, 400)]
    return rows + rows[:5]


def ordered(rows, key):
    found = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            found[c].append((t, role, text))
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, key(x[1], x[2]))) for c, v in found.items()}


def tid(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def trie(sequences):
    members, kids, below, out = defaultdict(list), defaultdict(list), {}, set()
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in kids[p]) or 1
        saved = sum(below[k][1] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        below[p] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[p]) if len(sequences[c]) == len(p))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("segment,most", [(512, 256), (512, 3), (3, 4)])
def test_trie(segment, most, spark):
    """Small containers burst several times, small segments hang below each other and end in chains."""
    rows = conversations(random.Random(5))
    frame = spark.createDataFrame([r + EXTRA for r in rows], CONVERSATION)
    turns = {c: tuple((r, t) for _, r, t in v) for c, v in ordered(
        [(c, t, r or "", x or "") for c, t, r, x in rows], lambda r, x: tid(r, x)).items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = turns.get(base, ())[:h] + own[h:]
    if segment < 10:
        whole = {c: s[:40] for c, s in whole.items()}
        frame = spark.createDataFrame(
            [(c, i, tid(*turn), len(turn[1].encode())) for c, s in whole.items() for i, turn in enumerate(s)]
            + [(c, -1, None, 0) for c in whole], "conv_id long, pos long, tid binary, n_bytes long")
        got = burst_trie.prefix_nodes(frame, segment, most)
    else:
        got = burst_trie.prefix_nodes(burst_trie.shared_prefixes(frame), segment, most)
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == trie(whole)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], CONVERSATION)
    assert burst_trie.prefix_nodes(burst_trie.shared_prefixes(none)).collect() == []
    assert repair.repair_damaged(none).collect() == []


def plain_search(codes):
    """All edits by cost, then letters; the first that ends well."""
    queue, done = [(0, "", 0, repair.EMPTY)], set()
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if at == len(codes) and state in (repair.EMPTY, repair.A):
            return cost, audit
        if (at, state) in done:
            continue
        done.add((at, state))
        heapq.heappush(queue, (cost + 3, audit + "I", at, repair.DUE[state]))
        if at < len(codes):
            letter, cut = codes[at].lower(), 3 * codes[at].isupper()
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state))
            if letter != "x":
                heapq.heappush(queue, (cost + 3 + cut, audit + "R", at + 1, repair.DUE[state]))
                if state in repair.LEGAL.get(letter, {}):
                    heapq.heappush(queue, (cost + cut, audit + "K", at + 1, repair.LEGAL[letter][state]))


def test_search_is_optimal():
    rng = random.Random(2)
    for _ in range(3000):
        codes = "".join(rng.choices("suaoxSUAOua", k=rng.randint(0, 12)))
        assert repair.cheapest(codes) == plain_search(codes)
    assert repair.cheapest("uaxUoS" * 5000)[0] == 70_000


def test_repair(spark):
    rows = conversations(random.Random(8))
    got = {r[0]: tuple(r)[1:] for r in repair.repair_damaged(spark.createDataFrame([r + EXTRA for r in rows], CONVERSATION)).collect()}
    hurt = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        hurt += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after, white = ordered(hurt, lambda r, x: (r.encode(), x.encode())), "\x20\t\n\x0b\x0c\r"
    assert set(got) == {r[0] for r in rows if r[0] is not None}
    for c, found in got.items():
        seen, codes, counts, own = set(), "", [0, 0, 0], after.get(c, [])
        for _, role, text in own:
            tail = text.rstrip(white)[-1:]
            fault = 0 if not tail else 1 if (role, text) in seen else 2 if tail not in ".!?" else None
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in (0, 1) else letter.upper() if fault == 2 else letter
            if fault is not None:
                counts[fault] += 1
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit = plain_search(codes)
        lines, at, state = [], 0, repair.EMPTY
        for letter in audit:
            _, role, text = own[at] if letter != "I" else (0, "", "")
            state = {"D": state, "K": repair.LEGAL.get(role[:1], {}).get(state)}.get(letter, repair.DUE[state])
            role = role if letter == "K" else "user" if state == repair.U else "assistant"
            lines += [f"{role}:{text}"] if letter != "D" else []
            at += letter != "I"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert found == (gaps, *counts, illegal, cost, audit, digest)
