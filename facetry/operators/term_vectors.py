"""Vectors of aspect terms from the terms they occur with, and themes from their clusters.

Random indexing: every term has a fixed sparse pattern of +1 and -1, a context adds up the
patterns of its terms, and a term's vector adds up its contexts without its own pattern.
Terms that occur with the same terms get similar vectors.  No pair of terms is formed:
the work is in proportion to the (context, term) rows, whatever a context holds.
All sums are integers, so the vectors do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.text import bind
from facetry.operators.joins import lookup_join
from facetry.session import ship_package, use_checkpoint_dir

DIMENSIONS = 64
MARKS = 4  # non-zero places of a pattern
WEIGHT = 1024  # what a context gives each of its terms, dealt over the other terms


def pattern(term: Column, dimensions: int = DIMENSIONS) -> Column:
    """The marks of a term as (dimension, sign), from the hex digits of its MD5 digest."""
    def mark(j: int) -> Column:
        number = F.conv(F.substring(F.md5(term), 1 + 6 * j, 6), 16, 10).cast("bigint")
        return F.struct(
            (number % dimensions).cast("int").alias("_dim"),
            F.when(F.floor(number / dimensions) % 2 == 0, 1).otherwise(-1).alias("_sign"),
        )

    return F.array(*[mark(j) for j in range(MARKS)])


def term_vectors(
    mentions: DataFrame, context_col: str = "review_id", term_col: str = "aspect",
    dimensions: int = DIMENSIONS, min_contexts: int = 2,
) -> DataFrame:
    """``term_col, contexts, sums`` of the terms in at least ``min_contexts`` contexts.

    ``sums`` has one bigint per dimension.  A context counts a term once, and its weight
    ``WEIGHT`` is dealt evenly over its other terms, rounded down, so long contexts do not
    outweigh short ones.  Rows without context or term are left out.  (Context, term) rows
    are moved twice at most: to their context, which one task holds, and as a term's sums
    over a task's contexts, in as few bytes as these need, to their term.
    """
    ship_package(mentions.sparkSession)
    # Repeats go before and after rows come together.
    pairs = mentions.select(F.col(context_col).alias("_context"), F.col(term_col).alias("_term")).dropna()
    marks = F.transform(pattern(F.col("_term"), dimensions), lambda m: m["_dim"] * 2 + F.when(m["_sign"] > 0, 1).otherwise(0))
    rows = pairs.repartition("_context").distinct().sortWithinPartitions("_context").select("_context", "_term", marks.alias("_marks"))
    parts = rows.mapInArrow(_context_sums(dimensions), PARTS)
    whole = parts.repartition("_term").sortWithinPartitions("_term").mapInArrow(_added(dimensions), "_term string, contexts bigint, _own bigint, _sums array<bigint>")
    own = lambda marks, i: F.aggregate(
        marks, F.lit(0), lambda a, m: a + F.when(m["_dim"] == i, m["_sign"]).otherwise(0)
    )
    # A term's own marks came back once per context with the context's weight.
    # The pattern is bound, as it would be spelt out anew for every dimension.
    return whole.filter(F.col("contexts") >= min_contexts).select(F.col("_term").alias(term_col), "contexts", bind(
        pattern(F.col("_term"), dimensions),
        lambda marks: F.transform("_sums", lambda s, i: s - F.col("_own") * own(marks, i)),
    ).alias("sums"))


PARTS = "_term string, contexts bigint, own bigint, part binary"
Batches = Iterator[pa.RecordBatch]


def runs(batches: Batches, name: str) -> Iterator[pa.Table]:
    """Rows that are ordered by a column, in tables that hold all rows of each of their values."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(name)
        # The last value may go on in the next batch.
        same = pc.equal(values, values[-1]).to_numpy(zero_copy_only=False)
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if waiting and (cut or waiting[-1].column(name)[-1] != values[0]):
            yield pa.Table.from_batches([*waiting, *([batch.slice(0, cut)] if cut else [])])
            waiting = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        waiting.append(batch.slice(cut))
    if waiting:
        yield pa.Table.from_batches(waiting)


def starts(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value other than the one before begins."""
    codes = pa.concat_arrays(column.chunks).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def _context_sums(dimensions: int) -> Callable[[Batches], Batches]:
    """From rows ordered by context: sums of its contexts for every term, in parts of at most ``HELD`` terms."""
    def run(batches):
        numbers, sums, counts = {}, np.zeros((HELD, dimensions), np.int64), np.zeros((HELD, 2), np.int64)
        for table in runs(batches, "_context"):
            at = starts(table["_context"])
            sizes = np.diff(np.append(at, table.num_rows))
            group = np.repeat(np.arange(len(at)), sizes)
            marks = pa.concat_arrays(table["_marks"].chunks).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.repeat(group, MARKS) * dimensions + (marks >> 1)
            context = np.bincount(place, (marks & 1) * 2 - 1, len(at) * dimensions).astype(np.int64).reshape(-1, dimensions)
            weight = np.where(sizes > 1, WEIGHT // np.maximum(sizes - 1, 1), 0)
            context *= weight[:, None]
            terms = table["_term"]
            for first in range(0, table.num_rows, STEP):
                here = slice(first, min(first + STEP, table.num_rows))
                names = terms.slice(first, STEP).to_pylist()
                if len(numbers) + len(names) > HELD:
                    yield from packed(numbers, sums, counts)
                    numbers.clear()
                    sums[:], counts[:] = 0, 0
                slot = np.array([numbers.setdefault(t, len(numbers)) for t in names], np.int64)
                np.add.at(sums, slot, context[group[here]])
                np.add.at(counts, slot, np.stack([np.ones(len(slot), np.int64), weight[group[here]]], axis=1))
        if numbers:
            yield from packed(numbers, sums, counts)

    return run


#: Terms whose sums a task holds, and rows added to them at one time.
HELD = 1 << 16
STEP = 1 << 13


def packed(numbers: dict[str, int], sums: np.ndarray, counts: np.ndarray) -> Batches:
    """Rows of ``PARTS``: a term's sums in the smallest integers that hold them all."""
    names, n = list(numbers), len(numbers)
    high, low = sums[:n].max(axis=1), sums[:n].min(axis=1)
    parts = np.empty(n, object)
    left = np.ones(n, bool)
    for kind in (np.int8, np.int16, np.int32, np.int64):
        fits = left & (high <= np.iinfo(kind).max) & (low >= np.iinfo(kind).min)
        left &= ~fits
        some = np.flatnonzero(fits)
        parts[some] = [row.tobytes() for row in sums[some].astype(kind)]
    yield pa.RecordBatch.from_arrays([
        pa.array(names, pa.string()), pa.array(counts[:n, 0]), pa.array(counts[:n, 1]), pa.array(parts, pa.binary()),
    ], ["_term", "contexts", "own", "part"])


def _added(dimensions: int) -> Callable[[Batches], Batches]:
    """From parts ordered by term: one row per term."""
    def run(batches):
        for table in runs(batches, "_term"):
            at = starts(table["_term"])
            group = np.repeat(np.arange(len(at)), np.diff(np.append(at, table.num_rows)))
            column = pa.concat_arrays(table["part"].chunks)
            widths = pc.binary_length(column).to_numpy(zero_copy_only=False) // dimensions
            sums = np.zeros((len(at), dimensions), np.int64)
            for width in np.unique(widths).tolist():
                for some in np.array_split(np.flatnonzero(widths == width), len(widths) // STEP + 1):
                    data = b"".join(column.take(pa.array(some)).to_pylist())
                    np.add.at(sums, group[some], np.frombuffer(data, f"<i{width}").reshape(-1, dimensions))
            add = lambda name: np.add.reduceat(table[name].to_numpy(), at)
            ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays(table["_term"].chunks).take(pa.array(at)), pa.array(add("contexts")), pa.array(add("own")),
                pa.ListArray.from_arrays(ends, pa.array(sums.ravel())),
            ], ["_term", "contexts", "_own", "_sums"])

    return run


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Add ``vector``, the sums at length one; terms that occur with no other term are left out."""
    length = F.sqrt(F.aggregate("sums", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # Bound, as it would be worked out anew for every dimension.
    unit = bind(length, lambda n: F.transform("sums", lambda x: x / n))
    return vectors.filter(length > 0).withColumn("vector", unit)


@dataclass(frozen=True)
class Clusters:
    """Terms with their cluster and theme, and the figure of every number of clusters tried."""

    terms: DataFrame
    k: int
    silhouettes: dict[int, float]


def cluster_terms(
    vectors: DataFrame, term_col: str = "aspect", ks: Sequence[int] = (4, 8, 16, 32), seed: int = 42
) -> Clusters:
    """k-means at each ``k``, the one with the best mean silhouette kept, the smallest on ties.

    ``terms``: ``term_col, contexts, cluster, theme``; a theme is called after its term with
    the most contexts, the first in order on ties.  The vectors are checkpointed, since
    every fit passes over them.  Only the figures and the centres come to the driver.
    Without vectors nothing is fitted; ``k`` is then 0.
    """
    use_checkpoint_dir(vectors.sparkSession)
    # Stored before their length is asked for in the filter and in the row, and after it without the columns no fit needs.
    units = unit_vectors(vectors.select(term_col, "contexts", "sums").checkpoint())
    ready = units.select(term_col, "contexts", array_to_vector("vector").alias("_features")).checkpoint()
    known = ready.select(vector_to_array("_features")).distinct().limit(max(ks)).count()
    measure = ClusteringEvaluator(featuresCol="_features", predictionCol="cluster")
    best, figures = None, {}
    for k in sorted({min(k, known) for k in ks if known > 1}):
        model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(ready)
        found = model.transform(ready)
        figures[k] = measure.evaluate(found) if len(model.clusterCenters()) > 1 else -1.0
        if best is None or figures[k] > figures[best[0]]:
            best = k, found
    k, found = best or (0, ready.withColumn("cluster", F.lit(0)))
    # The largest (contexts, reversed order) is found by the smallest (-contexts, term).
    names = found.groupBy("cluster").agg(F.min(F.struct(-F.col("contexts"), F.col(term_col)))[term_col].alias("theme"))
    terms = lookup_join(found.select(term_col, "contexts", "cluster"), names, "cluster")
    return Clusters(terms.select(term_col, "contexts", "cluster", "theme"), k, figures)


def add_learned_theme(mentions: DataFrame, terms: DataFrame, term_col: str = "aspect", theme_col: str = "theme") -> DataFrame:
    """Add the theme of the mention's term; a term without one is its own theme."""
    table = terms.select(term_col, F.col("theme").alias("_theme"))
    return lookup_join(mentions, table, term_col).select(
        *[c for c in mentions.columns if c != theme_col], F.coalesce("_theme", F.col(term_col)).alias(theme_col)
    )
