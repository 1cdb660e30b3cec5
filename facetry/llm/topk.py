"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors become integers, floor(1024 * x).  Candidate vectors are dealt into blocks; a
block's index holds, per dimension, the candidates sorted by value and cut into segments
by quantised value.  For a query each segment has an impact: the largest contribution of
its postings above that dimension's minimum.  Segments are processed by descending
impact over all dimensions, adding contributions to accumulators.  What a vector can
still gain is at most the sum of the next impacts of all dimensions; when no vector
outside the ``k`` best and a small set of possible members can reach the k-th best, the
scan stops, and the possible members are scored exactly.  Without that proof all
segments are processed, so the result is exact either way.

Queries meet every block (a stated query set against all rows, in blocks), each block
keeps ``k`` rows per query, and the best ``k`` of those remain.

Vectors that are null or hold null or non-finite components take no part.  A vector
shorter or longer than the most frequent length raises an error when multiplied, so
lengths are compared first: pairs of different lengths have no score.  Repeated rows
with one id are candidates each; a query's own id is never its candidate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.session import ship_package

K = 10
SCALE = 1024
BLOCK_VALUES = 1 << 21  # components of a block: 16 MB
QUERY_ROWS = 512
STEP = 128
POSSIBLE = 256


class ImpactIndex:
    """Impact-ordered postings of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, step: int = STEP):
        self.ids, self.vectors = ids, vectors
        self.segments = []  # per dimension: postings ascending by value, cuts, values at the cuts
        for d in range(vectors.shape[1]):
            order = np.argsort(vectors[:, d], kind="stable")
            values = vectors[order, d]
            level = values // step
            cuts = np.concatenate([[0], np.flatnonzero(level[1:] != level[:-1]) + 1, [len(order)]])
            self.segments.append((order, values, cuts))

    def search(self, query: np.ndarray, own: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to smaller ids."""
        n = len(self.ids)
        work, base = [], 0
        for d, w in enumerate(query.tolist()):
            if not w or not n:
                continue
            order, values, cuts = self.segments[d]
            least = min(w * int(values[0]), w * int(values[-1]))
            base += least
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                impact = max(w * int(values[a]), w * int(values[b - 1])) - least
                work.append((-impact, d, a, b, w, least))
        work.sort()
        acc = np.full(n, base, np.int64)
        possible = self.ids != own
        # next impact per dimension, and their sum: what a vector can still gain
        pending: dict[int, list[int]] = {}
        for impact, d, *_ in work:
            pending.setdefault(d, []).append(-impact)
        for impacts in pending.values():
            impacts.append(0)
            impacts.reverse()
        gain = sum(x[-1] for x in pending.values())
        for i, (_, d, a, b, w, least) in enumerate(work):
            order, values, _ = self.segments[d]
            acc[order[a:b]] += w * values[a:b] - least
            gain -= pending[d].pop()
            gain += pending[d][-1]
            if i % 64 == 63 and n > POSSIBLE:
                live = acc[possible]
                if len(live) > k:
                    floor = np.partition(live, len(live) - k)[len(live) - k]
                    possible &= acc + gain >= floor
                if np.count_nonzero(possible) <= POSSIBLE:
                    break
        at = np.flatnonzero(possible)
        exact = self.vectors[at] @ query
        best = np.lexsort((self.ids[at], -exact))[:k]
        return self.ids[at][best], exact[best]


def usable(vector: Column) -> Column:
    """True where all components are finite numbers."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: integer components of the usable vectors."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * SCALE)).cast("array<long>").alias("v")
    )


def block_count(amount: Column, rows: DataFrame, size: int) -> int:
    return max(1, -(-(rows.agg(F.sum(amount)).first()[0] or 0) // size))


def packed(rows: DataFrame, n: int, name: str) -> DataFrame:
    """Rows gathered into ``n`` lists, dealt by a hash of the row."""
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int").alias(name)
    return rows.groupBy(block, F.size("v").alias("length")).agg(
        F.collect_list("vec_id").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(f"{name}_values")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of each query."""
    ship_package(vectors.sparkSession)
    n_blocks, n_asks = (
        block_count(F.size(F.coalesce("embedding", F.array())), vectors, BLOCK_VALUES),
        block_count(F.lit(1), queries, QUERY_ROWS),
    )
    blocks = packed(integers(vectors), n_blocks, "block")
    asked = packed(integers(queries).dropDuplicates(["vec_id", "v"]), n_asks, "ask")

    def work(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                ids = np.asarray(row.block_ids, np.int64)
                index = ImpactIndex(ids, np.asarray(row.block_values, np.int64).reshape(len(ids), -1))
                own = np.asarray(row.ask_ids, np.int64)
                for q, vector in zip(own, np.asarray(row.ask_values, np.int64).reshape(len(own), -1)):
                    found, scores = index.search(vector, q, k)
                    out.append(pd.DataFrame({"query_id": q, "vec_id": found, "score": scores}))
            if out:
                yield pd.concat(out)

    # The queries visit every block: a row per block and list of queries, dealt by both.
    pairs = blocks.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1)))).join(
        asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))),
        ["block", "ask", "length"],
    )
    found = pairs.drop("length").mapInPandas(work, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
