"""Prefix trie of conversations, built as a burst trie.

A turn is known by 16 bytes of the SHA-256 digest of role and text, a conversation by its
turn ids in order.  Equal conversations are one class with a weight.  Classes lie in
containers under trie heads; a container starts as everything below the root, and one
with more than ``CONTAINER`` classes bursts: its head becomes a node of its own, and its
classes move into containers by their next turn id.  Containers that are left are sorted
and swept into nodes, one at a time per task; the heads' figures then come from those of
the containers below, burst by burst.

A container sees at most ``SEGMENT`` turns.  What goes on longer is a class of a deeper
container, whose totals are handed to the node it hangs from.  Below the last depth at which
two classes still share a container nothing branches; those chains are swept all at once.
So neither a turn nor a conversation that holds a third of all rows gathers in a task.

Order: by turn (null first), then turn id.  Null role and text count as empty.  Rows with
a null conv_id belong to no conversation and are left out.  An empty table has no nodes;
repeated rows are turns of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.kernels import keep
from facetry.llm.turns import numbered
from facetry.operators.joins import lookup_join
from facetry.session import ship_package

SEGMENT = 512
CONTAINER = 256
CHUNK = 8192
SALTS = 16
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODE_SCHEMA = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE)
#: A swept row: a node, and for the top of a container also its names.
SWEPT_SCHEMA = NODE_SCHEMA + ", head string, parent string, j int"
SWEPT_TYPES = [pa.string() if c == "ends_sha256" else pa.int64() for c in NODE] + [pa.string(), pa.string(), pa.int32()]
CLASS = ["head", "parent", "j", "above", "top_bytes", "k", "ids", "sizes", "w", "c", "ends", "x_children", "x_leaves", "x_saved"]


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, tid, n_bytes`` of every turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(name, 1, 32)).alias("tid"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return numbered(rows, "conv_id", ["turn", "tid", "n_bytes"]).select("conv_id", "pos", "tid", "n_bytes")


def with_every_conversation(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds a row with ``pos`` -1 per conversation, which may have no turn."""
    return turns.select("conv_id", "pos", "tid", "n_bytes").unionByName(ids.select(
        "conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"),
        F.lit(0).cast("long").alias("n_bytes"),
    ))


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """Conversations that begin with up to eight turns of another: ``conv_id, pos, tid, n_bytes``.

    Conversation c takes its first h turns from c - c % 5, with h = crc32(c) % 9.
    """
    rows = keep(turn_ids(conversations))
    convs = rows.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int").alias("h"),
    )
    starts = rows.where("pos < 8").groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "tid", "n_bytes"))).alias("start")
    )
    convs = keep(convs.join(starts, "base", "left").select(
        "conv_id", "h", F.coalesce(F.slice("start", F.lit(1), F.col("h")), F.array()).alias("start")
    ).select("*", F.size("start").alias("b")))
    own = lookup_join(rows, convs.select("conv_id", "h", "b"), "conv_id", "inner").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "tid", "n_bytes"
    )
    taken = convs.select("conv_id", F.inline("start"))
    return with_every_conversation(own.unionByName(taken), convs)


def _digest_ends(rows: DataFrame) -> DataFrame:
    """``cls, ends``: digest of each class's conversations, numerically ascending.

    Ids are sorted over all partitions and joined in chunks; a class's chunks then pass
    one task as a stream, since the digest is sequential.
    """
    def join(batches):
        cls, ids = None, []
        out: list[tuple] = []
        for batch in batches:
            for here, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (here != cls or len(ids) == CHUNK):
                    out.append((cls, ids[0], ",".join(map(str, ids))))
                    ids = []
                cls = here
                ids.append(conv)
            if len(out) >= 4096:
                yield _batch(out, ["cls", "first", "part"], [pa.string(), pa.int64(), pa.string()])
                out = []
        if ids:
            out.append((cls, ids[0], ",".join(map(str, ids))))
        yield _batch(out, ["cls", "first", "part"], [pa.string(), pa.int64(), pa.string()])

    def digest(batches):
        cls = state = None
        for batch in batches:
            out: list[tuple] = []
            for here, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if here == cls:
                    state.update(b"," + part.encode())
                    continue
                if state is not None:
                    out.append((cls, state.hexdigest()))
                cls, state = here, hashlib.sha256(part.encode())
            yield _batch(out, ["cls", "ends"], [pa.string(), pa.string()])
        if state is not None:
            yield _batch([(cls, state.hexdigest())], ["cls", "ends"], [pa.string(), pa.string()])

    parts = rows.select("cls", "conv_id").repartitionByRange("cls", "conv_id").sortWithinPartitions(
        "cls", "conv_id"
    ).mapInArrow(join, "cls string, first long, part string")
    return parts.repartition("cls").sortWithinPartitions("cls", "first").select("cls", "part").mapInArrow(
        digest, "cls string, ends string"
    )


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _classes(turns: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal segments under equal paths; and the path of every conversation's segments.

    A path is the bitwise sum of two hashes of each segment before, so the paths of one
    conversation need no more than a running sum over its segments.
    """
    layer = F.greatest(F.lit(0), F.floor(F.col("pos") / segment)).cast("int")
    segments = turns.groupBy("conv_id", layer.alias("k")).agg(
        F.filter(F.sort_array(F.collect_list(F.struct("pos", "tid", "n_bytes"))), lambda t: t["pos"] >= 0).alias("t")
    ).select("conv_id", "k", F.col("t.tid").alias("ids"), F.col("t.n_bytes").alias("sizes"))
    segments = keep(segments.withColumns({
        "g1": F.xxhash64(F.lit(1), "k", "ids"), "g2": F.xxhash64(F.lit(2), "k", "ids"),
    }))
    order = Window.partitionBy("conv_id").orderBy("k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    paths = segments.select(
        "conv_id", "k", "g1", "g2", *[F.coalesce(F.bit_xor(f"g{i}").over(before), F.lit(0)).alias(f"p{i}") for i in (1, 2)],
        F.lead("k").over(order).isNull().alias("last"),
    )
    name = lambda k, *parts: F.concat_ws(":", k.cast("string"), *[F.hex(p) for p in parts])
    paths = keep(paths.select(
        "conv_id", "k", "last", name(F.col("k"), F.col("p1"), F.col("p2")).alias("head"),
        name(F.col("k"), *map(F.col, ("p1", "p2", "g1", "g2"))).alias("cls"),
        name(F.col("k") + 1, *[F.col(f"p{i}").bitwiseXOR(F.col(f"g{i}")) for i in (1, 2)]).alias("below"),
    ))
    classes = segments.drop("g1", "g2").join(paths, ["conv_id", "k"]).groupBy("cls").agg(
        *[F.first(c).alias(c) for c in ("k", "head", "below", "ids", "sizes")],
        F.count("*").alias("w"), F.min("conv_id").alias("c"), F.count_if(~F.col("last")).alias("more"),
    )
    return keep(classes.join(_digest_ends(paths.where("last")), "cls", "left")), paths


def _sweep(rows: list[dict], out: list[tuple], segment: int) -> None:
    """Nodes of one container: its classes in order of their turn ids, a stack of open nodes."""
    first = rows[0]
    j, k = first["j"], first["k"]
    rows.sort(key=lambda r: r["ids"][j:])
    base, keeps_top = k * segment, k == 0 or j > 0
    # An open node: depth, bytes, members, smallest member, children, leaves, saved, ends, rows of children.
    stack = [[j, first["top_bytes"], 0, None, 0, 0, 0, None, []]]

    def close():
        depth, size, n, c, children, leaves, saved, ends, below = stack.pop()
        leaves, saved = leaves if children else 1, saved + (n - 1) * size
        top = not stack
        at = c if keeps_top or not top else first["above"]
        for i in below:
            out[i] = (*out[i][:2], at, *out[i][3:])
        names = (first["head"], first["parent"], j) if top else (None, None, None)
        out.append((c, base + depth, first["above"] if top else None, n, children, leaves, saved, ends or NOTHING, *names))
        if not top:
            up = stack[-1]
            up[2] += n
            up[3] = c if up[3] is None else min(up[3], c)
            up[4] += 1
            up[5] += leaves
            up[6] += saved
            up[8].append(len(out) - 1)

    previous: list[bytes] = []
    for row in rows:
        ids = row["ids"]
        same = j
        while same < len(previous) and same < len(ids) and previous[same] == ids[same]:
            same += 1
        while stack[-1][0] > same:
            close()
        for depth in range(max(same, j) + 1, len(ids) + 1):
            stack.append([depth, row["sizes"][depth - 1], 0, None, 0, 0, 0, None, []])
        node = stack[-1]
        node[2] += row["w"]
        node[3] = row["c"] if node[3] is None else min(node[3], row["c"])
        node[4] += row["x_children"]
        node[5] += row["x_leaves"]
        node[6] += row["x_saved"]
        node[7] = row["ends"]
        previous = ids
    while stack:
        close()


def _swept(classes: DataFrame, segment: int) -> DataFrame:
    """Sweep containers: a partition holds many, sorted by head, and sweeps one after the other."""
    ship_package(classes.sparkSession)

    def work(batches):
        head, rows, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["head"] != head:
                    if rows:
                        _sweep(rows, out, segment)
                    head, rows = row["head"], []
                    if len(out) >= 8192:
                        yield _batch(out, [*NODE, "head", "parent", "j"], SWEPT_TYPES)
                        out = []
                rows.append(row)
        if rows:
            _sweep(rows, out, segment)
        yield _batch(out, [*NODE, "head", "parent", "j"], SWEPT_TYPES)

    return classes.select(*CLASS).repartition("head").sortWithinPartitions("head").mapInArrow(work, SWEPT_SCHEMA)


def _burst(classes: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Burst containers with more than ``most`` classes until none is left; also the heads of each round."""
    heads, settled, state = [], [], classes.select(*CLASS)
    while True:
        grown = keep(state.groupBy("head").agg(
            F.count("*").alias("n"), F.sum("w").alias("n_convs"), F.min("c").alias("conv_id"),
            *[F.first(c).alias(c) for c in ("parent", "j", "above", "top_bytes", "k")],
            F.max(F.when(F.size("ids") == F.col("j"), F.col("ends"))).alias("ends"),
        ).where(F.col("n") > most))
        if grown.isEmpty():
            break
        heads.append(grown)
        # The nodes below the top of a deeper segment have the node it hangs from as parent.
        parent = F.when((F.col("k") > 0) & (F.col("j") == 0), F.col("above")).otherwise(F.col("conv_id"))
        marked = lookup_join(state, grown.select("head", parent.alias("_top")), "head", "left", SALTS)
        settled.append(marked.where(F.col("_top").isNull()).select(*CLASS))
        moved = marked.where(F.col("_top").isNotNull() & (F.size("ids") > F.col("j")))
        state = keep(moved.select(
            F.md5(F.concat(F.encode("head", "utf-8"), F.get("ids", F.col("j")))).alias("head"), F.col("head").alias("parent"),
            (F.col("j") + 1).alias("j"), F.col("_top").alias("above"), F.get("sizes", F.col("j")).alias("top_bytes"),
            *CLASS[5:],
        ))
    return reduce(DataFrame.unionByName, settled, state), heads


def _layer(classes: DataFrame, segment: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the containers of one layer, and the totals of their tops."""
    containers, heads = _burst(classes, most)
    swept = keep(_swept(containers, segment))
    tops = swept.where(F.col("head").isNotNull())
    found, below = [swept], None
    for turn in range(len(heads) - 1, -1, -1):
        kids = tops.where(F.col("j") == turn + 1)
        kids = kids if below is None else kids.unionByName(below)
        sums = kids.groupBy(F.col("parent").alias("head")).agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("_saved")
        )
        below = keep(heads[turn].join(sums, "head").select(
            "conv_id", (F.col("k") * segment + F.col("j")).cast("long").alias("depth"),
            F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            (F.col("_saved") + (F.col("n_convs") - 1) * F.col("top_bytes")).alias("saved_tokens"),
            F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"), "head", "parent", "j",
        ))
        found.append(below)
    whole = reduce(DataFrame.unionByName, found)
    tops = whole.where("j = 0").select("head", *[
        F.col(c).alias(x) for c, x in (("n_children", "x_children"), ("n_leaves", "x_leaves"), ("saved_tokens", "x_saved"))
    ])
    return whole, tops


def _ready(classes: DataFrame) -> DataFrame:
    """Classes as containers that have not burst."""
    return classes.withColumns({
        "parent": F.lit(None).cast("string"), "j": F.lit(0), "top_bytes": F.lit(0).cast("long"),
        **{c: F.coalesce(c, F.lit(0)).cast("long") for c in ("x_children", "x_leaves", "x_saved")},
    })


def prefix_nodes(turns: DataFrame, segment: int = SEGMENT, most: int = CONTAINER) -> DataFrame:
    """All nodes of the prefix trie of ``conv_id, pos, tid, n_bytes`` (``pos`` -1: the conversation exists).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    classes, paths = _classes(turns, segment)
    shape = classes.groupBy("head").agg(F.first("k").alias("k"), F.count("*").alias("n")).agg(
        F.max("k").alias("longest"), F.max(F.when(F.col("n") > 1, F.col("k"))).alias("shared")
    ).first()
    longest, shared = shape["longest"] or 0, shape["shared"] or 0
    # Where deeper containers hang: the node at the end of a segment that some members go on from.
    hooks = classes.where("more > 0").select(F.col("below").alias("head"), F.col("c").alias("above"))
    top = classes.where("k = 0").withColumn("above", F.lit(None).cast("long"))
    deeper = lookup_join(classes.where("k > 0"), hooks, "head", "left", SALTS)
    found, totals = [], None
    if longest > shared:
        # Chains: one class per container from here on, so what lies below is a running sum.
        chain = paths.where(F.col("k") == shared + 1).select(F.col("conv_id").alias("c"), F.col("head").alias("chain"))
        rows = lookup_join(deeper.where(F.col("k") > shared), chain, "c", "inner", SALTS)
        own = (F.col("w") - 1) * F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
        later = Window.partitionBy("chain").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_own", own).withColumns({
            "x_children": (F.col("more") > 0).cast("long"), "x_leaves": (F.col("more") > 0).cast("long"),
            "x_saved": F.coalesce(F.sum("_own").over(later), F.lit(0)),
        })
        swept = keep(_swept(_ready(rows), segment))
        found.append(swept.withColumn("_k0", F.lit(False)))
        totals = swept.where("j = 0").select("head", *[
            F.col(c).alias(x) for c, x in (("n_children", "x_children"), ("n_leaves", "x_leaves"), ("saved_tokens", "x_saved"))
        ])
    for k in range(shared, -1, -1):
        layer = (deeper if k else top).where(F.col("k") == k)
        if totals is None:
            layer = layer.withColumns({c: F.lit(0) for c in ("x_children", "x_leaves", "x_saved")})
        else:
            going = layer.where("more > 0").join(totals.withColumnRenamed("head", "below"), "below", "left")
            layer = going.unionByName(layer.where("more = 0"), allowMissingColumns=True)
        whole, totals = _layer(_ready(layer), segment, most)
        found.append(whole.withColumn("_k0", F.lit(k == 0)))
    nodes = reduce(DataFrame.unionByName, found)
    # The top of a deeper container is the node it hangs from, which its own layer gives.
    return nodes.where(F.col("_k0") | F.col("j").isNull() | (F.col("j") > 0)).select(*NODE)
