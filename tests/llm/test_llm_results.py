"""The dealt queries against DuckDB, brute force, exact round trips and held-out labels."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from facetry.llm import decontaminate, disclosure, packing, run_index, suffix_trees, token_groups
from facetry.llm.exchange import batched
from facetry.llm.kernels import column_buffers
from facetry.llm.oracle import ORACLE
from facetry.llm.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, spark, duck, sf_dir):
    got, expected = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and len(got)
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).itertuples(index=False)))
    clean = lambda f: [re.sub(r"(\d)\.0\b", r"\1", r) for r in rows(f)]
    assert clean(got) == clean(expected)


def test_suffix_trees_in_small_groups(spark, duck, sf_dir):
    """Many groups and small batches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = suffix_trees.remove_repeats(docs, group_suffixes=50, batch_bytes=1 << 11).toPandas()
    got["kept_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in got.pop("kept")]
    expected = duck.sql(ORACLE["op2_suffix_trees"]).df()[got.columns]
    assert set(got.itertuples(index=False, name=None)) == set(expected.itertuples(index=False, name=None))


def test_prefix_table_is_bounded():
    rng = np.random.default_rng(3)
    found, counts = suffix_trees.Prefixes(13), rng.integers(0, 40, (1, suffix_trees.PAIR))
    assert found.extend(counts, 30) and -found.tables[0].min() == suffix_trees.SPLIT_ROWS
    assert found.parts.max() == 2 and len(found.first) == found.tables[0].max() + 1


def test_ordered_batches(spark):
    ids = [None, None, *range(50), *range(10_000, 10_400), 10**12]
    docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    rows = batched(docs, 64, 1, most_cuts=4).collect()
    known = sorted((r["doc_id"], r["batch"]) for r in rows if r["doc_id"] is not None)
    numbers = [b for _, b in known]
    assert len(rows) == len(ids) and numbers == sorted(numbers) and len(set(numbers)) > 20
    assert {r["batch"] for r in rows if r["doc_id"] is None} == {max(r["batch"] for r in rows)} - set(numbers)


@pytest.mark.parametrize("most", [128, 2])
def test_run_index(most, spark, sf_dir, texts):
    """``most`` of 2 sends nearly all contexts down the path for frequent anchors."""
    count = Counter()
    raw = {d: (t or "").encode() for d, t in texts.items()}
    for b in raw.values():
        count.update(b[i : i + 400] for i in range(len(b) - 399))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in run_index.remove_repeated_bytes(docs, most=most).collect():
        b, gone = raw[r["doc_id"]], np.zeros(len(raw[r["doc_id"]]), bool)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        assert r["n_removed"] == gone.sum()
        assert r["n_spans"] == (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()
        assert bytes(r["kept"]) == bytes(np.frombuffer(b, np.uint8)[~gone])


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_token_groups(size, percent, spark, sf_dir, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, root = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.update((a, b))
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {tuple(r) for r in token_groups.link_documents(docs, size, percent).collect()}
    assert got == {(d, len(sets[d]), find(d), links[d]) for d in texts}


def test_masks_find_two_substitutions():
    for gaps in combinations(range(decontaminate.WINDOW), 2):
        assert any(
            all(bit == "0" or at + j not in gaps for j, bit in enumerate(mask))
            for mask in decontaminate.MASKS for at in range(decontaminate.WINDOW - len(mask) + 1)
        )


def test_decontamination(spark, sf_dir, duck, texts):
    items = dict(duck.sql("select item_id, text from benchmark").fetchall())
    words = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    item_words = {i: words(t) for i, t in items.items()}
    expected = set()
    for d, t in texts.items():
        w = words(t)
        where = {}
        for i, x in enumerate(w):
            where.setdefault(x, []).append(i)
        for item, v in item_words.items():
            shifts = Counter(i - j for j, x in enumerate(v) for i in where.get(x, ()))
            width = min(decontaminate.WINDOW, len(v))
            for shift, n in shifts.items():
                if n >= 0.8 * width:
                    same = [0 <= j + shift < len(w) and w[j + shift] == x for j, x in enumerate(v)]
                    if any(sum(same[k : k + width]) >= 0.8 * width for k in range(len(v) - width + 1)):
                        expected.add((d, item))
    docs, tests = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(docs, tests).collect()}
    assert got == expected
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(docs, tests, block_seeds=900).collect()} == expected


def test_packing_round_trip(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = QUERIES["op9_packing"](spark, sf_dir).toPandas()
    for doc, own in rows.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        for r in own.sort_values("piece").itertuples():
            assert r.start == r.piece * packing.CAPACITY
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert own["length"].sum() == len(ids)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= packing.CAPACITY
    assert rows["sequence_id"].nunique() <= packing.lower_bound(rows["length"].to_numpy()) + 1


def test_bounds_are_bounds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(1, 101, rng.integers(1, 60))
        assert -(-x.sum() // 100) <= packing.lower_bound(x, 100) <= packing.best_fit(x, 100)[0].max() + 1


def plain_spans(text):
    """The contract's patterns, word for word."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and disclosure.luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], disclosure.ORDER[s[2]], s[1]))


def test_personal_data(spark, sf_dir, texts):
    for text in (*texts.values(), "a@b@c.d.e a.b@c..d x@y.z@q.r 1.2.3.4.5.6.7.8 01.002.3.256 +1+2 (3) 4567890123 4111 1111 1111 1111-",
                 "é@ü.x ü4111-1111-1111-1111é @a.b +1 2@3.4"):
        assert disclosure.base_spans(text) == plain_spans(text)
    for r in QUERIES["op4_disclosure"](spark, sf_dir).collect():
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(disclosure.joined(base).encode()).hexdigest()
        assert set(disclosure.joined(base).split(",")) <= {*r["spans"].split(","), ""}


def test_disclosing_terms(spark):
    text = "contact zebrafish keeper at keeper@site.org about the usual matters"
    docs = [(i, text) for i in range(5)] + [(i, f"the usual contact keeper about at matters {i}") for i in range(5, 60)]
    out = {r["doc_id"]: r for r in disclosure.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0]["spans"].split(",") == ["cut:8:17", "email:28:43"] and out[7]["n_terms"] == 0
    clean = disclosure.sanitise(spark.createDataFrame(docs[:5] + docs[5:], "doc_id long, text string")).collect()
    assert {r["text"] for r in clean if r["doc_id"] < 5} == {"contact  keeper at [EMAIL] about the usual matters"}


def test_held_out_language(spark, sf_dir, duck):
    got = QUERIES["op5_language"](spark, sf_dir).toPandas()  # noqa: F841
    right = duck.sql("select avg((lang = lang_pred)::int) from got join documents using (doc_id) where held_out").fetchall()
    assert right[0][0] > 0.95


def test_terms_anywhere_in_a_document(spark):
    """Terms far from the entity count, and go from documents without an entity or a digit."""
    far = " ".join(["usual"] * 20)
    docs = [(i, f"zebrafish {far} keeper@site.org note{'abcdef'[i]}") for i in range(6)]
    docs += [(i, "zebrafish alone") for i in (6, 7)] + [(i, f"usual matters {i}") for i in range(8, 400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r for r in disclosure.find_personal_data(frame).collect()}
    assert len(out) == 400 and out[300]["n_terms"] == 0
    assert [out[i]["n_terms"] for i in (0, 5, 6, 7)] == [1] * 4 and out[6]["spans"] == "term:0:9"
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(frame).collect()}
    assert clean[7] == "[TERM] alone" and clean[0] == f"[TERM] {far} [EMAIL] notea" and clean[300] == "usual matters 300"


def test_terms_of_recurring_parts(spark):
    """No address recurs, but their domain does; words of one text, or of its copies, are chance."""
    docs = [(i, f"zebrafish keepers write to k{i}@site.org, word{'abcdef'[i]}") for i in range(6)]
    docs += [(i, "rareword twin x@other.net") for i in (6, 7)] + [(i, f"keepers write to {i}") for i in range(8, 400)]
    out = {r["doc_id"]: r for r in disclosure.find_personal_data(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [out[i]["spans"].split(",")[0] for i in range(6)] == ["cut:0:9"] * 6
    assert [out[i]["n_terms"] for i in range(9)] == [1] * 6 + [0] * 3


def test_visitors_are_dealt(spark, monkeypatch):
    """A family of near copies in groups of 8: no part has many visitors, all links are found once."""
    monkeypatch.setattr(token_groups, "GROUP_SETS", 8)
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame(
        [(i, " ".join([*words[:-1], f"end{i}"])) for i in range(60)], "doc_id long, text string")
    sets = token_groups.keep(token_groups.document_sets(docs))
    found = token_groups.set_links(sets, visitors=4).collect()
    assert len(found) == 60 and {r["links"] for r in found} == {59} and len({r["label"] for r in found}) == 1
    homes = spark.createDataFrame([(i, i % 2) for i in range(16)], "set_id long, grp long")
    visits = spark.createDataFrame([(i, 1) for i in range(100, 500)], "set_id long, to long")
    seats = token_groups.dealt_seats(homes, visits, 40).toPandas()
    guests = seats[~seats["member"]].groupby(["grp", "part"]).size()
    assert guests.sum() == 400 and guests.max() < 80 and len(guests) == 10
    assert (seats[seats["member"]].groupby(["grp", "part"]).size() == 8).all()


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_every_allowed_pattern_is_found(similarity):
    """Short items in long texts, short texts cut from long items, and full windows."""
    def alike(n):
        return next(s for s in range(n + 1) if s >= similarity * n)

    def found(item, text):
        block = decontaminate.Items([(1, " ".join(item))], similarity)
        data, offsets = column_buffers(pa.array([" ".join(text)]))
        return bool(list(decontaminate.overlaps_in(block, data, offsets, similarity)))

    rest = [f"q{i}" for i in range(20)]
    for n in (1, 2, 4, 5, 6, 8, 10, 12, 13):
        item = [f"w{i}" for i in range(n)]
        for misses in range(n - alike(n) + 2):
            for gaps in combinations(range(n), misses):
                text = [f"x{i}" if i in gaps else w for i, w in enumerate(item)]
                expected = misses <= n - alike(n)
                assert found(item, rest + text + rest[::-1]) == expected, (n, gaps)
                if n >= decontaminate.SHORTEST:
                    assert found(rest + item + rest[::-1], text) == expected, (n, gaps)
                elif n < 5:
                    assert not found(rest + item + rest[::-1], text)
