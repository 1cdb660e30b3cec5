"""Exact n-gram Jaccard self-join by a token-group matrix.

A document is the set of its distinct ``SHINGLE``-word shingles (of its one word sequence,
when it has fewer words); two documents link when |A & B| * 100 >= |A | B| * ``PERCENT``.

1. Batches of documents count every shingle of the corpus by an exchange of packed hashes.
   A document with more than |A| - ceil(PERCENT/100 * |A|) shingles that no other document
   has can link with none and is done.  The sets of the others are stored once.
2. Equal sets become one class with its number of copies.  Classes are partitioned into
   groups of similar ones: the class's most frequent shingle (by powers of two, then by
   hash) names the group.  Groups are at most ``GROUP_SETS`` sets on average; larger ones
   are dealt into several.
3. The matrix has a row per (group, shingle of the union of its members' prefixes).  In
   one order of all shingles, rare first, linked sets share at least ``SHARED`` shingles
   of their prefixes of length |A| - ceil(PERCENT/100 * |A|) + SHARED, so a group in which a
   query finds fewer cannot hold a partner and is not opened.
4. A group is opened by its members and by the visiting classes of groups before it, so
   each pair of sets meets once.  The visitors are dealt to parts of a group, each with
   all members, so no task holds more than a share of a large cluster.  There the union of all its shingles bounds a visitor's
   overlap once more before single members are counted, exactly.

Links are counted per class (copies included) and not written as pairs; within a group
they are joined to a tree, so a class leaves at most one edge per group.  Components of
those edges are found by spreading and shortcutting labels.

Texts: A-Z is lower-cased.  Null and empty texts and texts without words have the empty
set and link with nothing, not even each other.  A component's id is its smallest
doc_id; null ids are no candidates for it, so a component of nulls alone has a null id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.exchange import (
    by_group, dealt, meet, pack_sorted, rows_of, sorted_rows, text_bytes, unpack_sorted,
)
from facetry.llm.kernels import (
    column_buffers, grams, id_array, ids_of, keep, mix, positions, slices, whole, word_hashes,
)
from facetry.operators.joins import lookup_join

SHINGLE = 3
PERCENT = 90
SHARED = 4
GROUP_SETS = 512
GROUP_VISITORS = 2048
GROUP_SHINGLES = 500_000

SENT = "grp int, batch int, leaves binary, counts binary"
SENT_ARROW = pa.schema([("grp", pa.int32()), ("batch", pa.int32()), ("leaves", pa.binary()), ("counts", pa.binary())])
ANSWER = "batch int, grp int, levels binary"
ANSWER_ARROW = pa.schema([("batch", pa.int32()), ("grp", pa.int32()), ("levels", pa.binary())])
SETS = "doc_id long, n_shingles long, set_id long, home long, shared int, prefix array<long>, tokens binary"
SETS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("home", pa.int64()),
    ("shared", pa.int32()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary()),
])


def least_overlap(n: np.ndarray | int, percent: int):
    """Shingles that a set of n must share with any partner: ceil(percent / 100 * n)."""
    return -(-n * percent // 100)


def shingle_sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' sets end to end, each sorted, and the rows' offsets in them."""
    data, offsets = column_buffers(part.column("text"))
    starts, ends, rows = positions(offsets, data)
    words = word_hashes(data, starts, ends, lower=True)
    at = np.flatnonzero(whole(rows, size))
    hashes, owner = grams(words, size)[at], rows[at]
    count = np.bincount(rows, minlength=part.num_rows)
    first = np.searchsorted(rows, np.arange(part.num_rows))
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            hashes = np.concatenate([hashes, mix(grams(words, n)[first[short]] + np.uint64(n))])
            owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(part.num_rows + 1))


def groups_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ranges of hashes: ascending hashes are in ascending groups."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def batch_sets(table: pa.Table, size: int):
    """The batch's rows, their sets end to end with offsets, and its distinct shingles."""
    rows = sorted_rows(table)
    parts = [shingle_sets(p, size) for p in slices(rows)]
    hashes = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(p[1]) for p in parts)])
    distinct, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return rows, hashes, np.concatenate([[0], np.cumsum(sizes)]), distinct, inverse, counts


def spans_of(distinct: np.ndarray, n: int):
    cuts = np.searchsorted(groups_of(distinct, n), np.arange(n + 1))
    return [(g, int(a), int(b)) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def document_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, shared: int = SHARED) -> DataFrame:
    """A row per document; ``tokens`` and ``prefix`` only where a partner is possible."""
    total = text_bytes(docs)
    docs = dealt(docs, total)
    n_groups = max(1, total // 4 // GROUP_SHINGLES)

    def send(table: pa.Table) -> pa.Table:
        out = {f.name: [] for f in SENT_ARROW}
        _, _, _, distinct, _, counts = batch_sets(table, size)
        number = table.column("batch")[0].as_py()
        for group, a, b in spans_of(distinct, n_groups):
            row = (group, number, pack_sorted(distinct[a:b]), np.minimum(counts[a:b], 255).astype(np.uint8).tobytes())
            for column, value in zip(out.values(), row):
                column.append(value)
        return rows_of(out, SENT_ARROW)

    def answer(table: pa.Table) -> pa.Table:
        leaves = [unpack_sorted(x) for x in table.column("leaves").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
        _, inverse = np.unique(np.concatenate(leaves), return_inverse=True)
        levels = np.frexp(np.bincount(inverse, counts))[1].astype(np.uint8)[inverse]  # 1: once, 2: 2-3, ...
        ends = np.cumsum([len(x) for x in leaves]).tolist()
        parts = [levels[e - len(x) : e].tobytes() for e, x in zip(ends, leaves)]
        return rows_of({"batch": table.column("batch").to_numpy(), "grp": table.column("grp").to_numpy(),
                        "levels": parts}, ANSWER_ARROW)

    def describe(answers: pa.Table, table: pa.Table) -> pa.Table:
        rows, hashes, offsets, distinct, inverse, _ = batch_sets(table, size)
        found = dict(zip(answers.column("grp").to_pylist(), answers.column("levels").to_pylist()))
        level = np.zeros(len(distinct), np.uint8)
        for group, a, b in spans_of(distinct, n_groups):
            level[a:b] = np.frombuffer(found[group], np.uint8)
        level = level[inverse]
        doc, out = ids_of(rows.column("doc_id")), {f.name: [] for f in SETS_ARROW}
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            own, lv, n = hashes[a:b], level[a:b], b - a
            slack = n - least_overlap(n, percent)
            row = [n, None, None, None, None, None]
            if n and int((lv == 1).sum()) <= slack:
                c = min(shared, least_overlap(n, percent))
                order = np.lexsort((own, lv))[: slack + c]
                prefix = own[order][lv[order] > 1].view(np.int64)
                top = own[lv == lv.max()].min()
                name = mix(np.array([(own * (own >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(n)]))
                row = [n, int(name.view(np.int64)[0]), int(top.view(np.int64)), c, prefix, own.tobytes()]
            for column, value in zip(list(out.values())[1:], row):
                column.append(value)
        out["doc_id"] = doc
        columns = [id_array(doc), *(pa.array(out[f.name], f.type) for f in list(SETS_ARROW)[1:])]
        return pa.table(columns, schema=SETS_ARROW)

    return meet(by_group(by_group(docs, "batch", send, SENT), "grp", answer, ANSWER), docs, describe, SETS)


class Tree:
    """Union-find over small integers; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def open_group(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between a group's members and visitors, and in its part 0 among its members."""
    first = 0 if len(frame) and frame["part"].iloc[0] == 0 else int(frame["member"].sum())
    frame = frame.sort_values(["member", "set_id"], ascending=[False, True], ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in frame["tokens"]]
    size = np.array([len(s) for s in sets], np.int64)
    copies = frame["copies"].to_numpy(np.int64)
    inside = int(frame["member"].sum())
    union, place = np.unique(np.concatenate(sets[:inside] or [np.zeros(0, np.uint64)]), return_inverse=True)
    member = np.repeat(np.arange(inside), size[:inside])
    order = np.argsort(place, kind="stable")
    posting = member[order]
    begin = np.searchsorted(place[order], np.arange(len(union) + 1))
    tree, links = Tree(len(sets)), np.zeros(len(sets), np.int64)
    for q in range(first, len(sets)):
        if not len(union):
            break
        at = np.minimum(np.searchsorted(union, sets[q]), len(union) - 1)
        at = at[union[at] == sets[q]]
        if len(at) * 100 < percent * size[q]:
            continue  # the group's union bounds the overlap with every member
        a, n = begin[at], begin[at + 1] - begin[at]
        steps = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(posting[np.repeat(a, n) + steps], minlength=inside)
        if q < inside:
            both[: q + 1] = 0  # each pair once
        hit = np.flatnonzero(both * 100 >= percent * (size[q] + size[:inside] - both))
        links[q] += copies[hit].sum()
        links[hit] += copies[q]
        for m in hit.tolist():
            tree.join(q, m)
    root = [tree.root(i) for i in range(len(sets))]
    ids = frame["set_id"].to_numpy()
    return pd.DataFrame({"set_id": ids, "linked": ids[root], "links": links})


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable over edges (a, b), for all nodes on one."""
    both = keep(edges.union(edges.select("b", "a")).distinct().toDF("a", "b"))
    labels = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.toDF("b", "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select(
            "node", "label", F.least("label", "near").alias("next")
        )
        jump = labels.toDF("at", "further")  # the label of the label
        moved = keep(spread.join(jump, spread["next"] == jump["at"]).select(
            "node", F.least("next", "further").alias("next"), "label"
        ))
        changed = moved.where(F.col("next") != F.col("label")).limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def dealt_seats(homes: DataFrame, visits: DataFrame, visitors: int = GROUP_VISITORS) -> DataFrame:
    """``set_id, grp, part, member``: visitors dealt to parts of about ``visitors``, members in each part."""
    parts = visits.groupBy(F.col("to").alias("grp")).agg(F.ceil(F.count("*") / visitors).alias("parts"))
    members = homes.select("set_id", "grp").join(parts, "grp", "left")
    number = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)).cast("int") - 1))
    guests = lookup_join(visits.select("set_id", F.col("to").alias("grp")), parts, "grp", "inner")
    return members.select("set_id", "grp", number.alias("part"), F.lit(True).alias("member")).unionByName(
        guests.select("set_id", "grp", F.pmod(F.xxhash64("set_id"), "parts").cast("int").alias("part"),
                      F.lit(False).alias("member"))
    )


def set_links(
    sets: DataFrame, percent: int = PERCENT, shared: int = SHARED, visitors: int = GROUP_VISITORS,
) -> DataFrame:
    """``set_id, copies, links, label``: classes of equal sets, their links and component."""
    # Not stored: the sets move once, and stay where the seats join them.
    classes = sets.where(F.col("tokens").isNotNull()).groupBy("set_id").agg(
        F.count("*").alias("copies"), F.first("home").alias("home"), F.first("shared").alias("shared"),
        F.first("prefix").alias("prefix"), F.first("tokens").alias("tokens"),
    )
    sizes = classes.groupBy("home").agg(F.ceil(F.count("*") / GROUP_SETS).alias("parts"))
    homes = keep(classes.join(sizes, "home").select(
        "set_id", "shared", "prefix",
        F.xxhash64("home", F.pmod("set_id", "parts")).alias("grp"),
    ))
    words = homes.select("set_id", "grp", "shared", F.explode("prefix").alias("token"))
    matrix = words.groupBy("token", "grp").agg(F.min("shared").alias("least"))
    visits = keep(
        words.join(matrix.toDF("token", "to", "least"), "token").where(F.col("grp") < F.col("to"))
        .groupBy("set_id", "to").agg(F.count("*").alias("n"), F.least(F.min("least"), F.min("shared")).alias("c"))
        .where(F.col("n") >= F.col("c")).select("set_id", "to")
    )
    seats = dealt_seats(homes, visits, visitors)

    def opened(frame: pd.DataFrame) -> pd.DataFrame:
        return open_group(frame, percent)

    found = keep(
        seats.join(classes.select("set_id", "copies", "tokens"), "set_id").groupBy("grp", "part")
        .applyInPandas(opened, "set_id long, linked long, links long")
    )
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    labels = components(found.where(F.col("set_id") != F.col("linked")).select(
        F.col("set_id").alias("a"), F.col("linked").alias("b")
    ))
    return classes.select("set_id", "copies").join(links, "set_id", "left").join(
        labels.withColumnRenamed("node", "set_id"), "set_id", "left"
    ).select("set_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "set_id").alias("label"))


def link_documents(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, shared: int = SHARED,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row."""
    sets = keep(document_sets(docs, size, percent, shared))
    linked = set_links(sets, percent, shared)
    least = sets.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("first"))
    known = linked.join(least, "set_id")
    names = known.groupBy("label").agg(F.min("first").alias("component"))
    named = keep(known.join(names, "label").select("set_id", "component", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    return sets.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_links").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, pin: bool = True) -> DataFrame:
    """One row of each component stays, the one with the smallest id; all columns stay.

    Rows are told apart by their place, so rows that share an id, or have none, are each
    judged by their own text: of a component the first row with the smallest id stays (one
    without an id only if none has one), and a row that links with no other stays always.
    Places must be the same whenever ``docs`` is read, which a stored table promises; any
    other is stored first (``pin``).
    """
    docs = keep(docs) if pin else docs
    row = "_row"
    while row in docs.columns:
        row += "_"
    marked = docs.withColumn(row, F.monotonically_increasing_id())
    found = link_documents(marked.select(F.col(row).alias("doc_id"), "text"), size, percent)
    linked = keep(found.where(F.col("n_links") > 0).select(F.col("doc_id").alias("_at"), F.col("component_id").alias("_group")))
    ids = marked.select(F.col(row).alias("_at"), F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("_order"))
    first = linked.join(ids, "_at").groupBy("_group").agg(F.min("_order").alias("_first")).select(
        "_group", F.col("_first")[row].alias("_stays")
    )
    gone = lookup_join(linked, first, "_group", "inner").where(F.col("_at") != F.col("_stays")).select(
        F.col("_at").alias(row)
    )
    return marked.join(gone, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
