"""Batches of documents that trade packed arrays with groups.

Documents are cut into batches by ranges of ``doc_id`` where their order counts, and are
dealt by a hash where it does not.  A batch sends each group one row
with packed arrays, a group answers each batch with one row, and the answers meet the
batch's documents again.  The documents are shuffled once (both uses read one exchange);
a key that many documents share is one entry per batch, so no group sees its copies.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.session import ship_package

BATCH_BYTES = 4 << 20
CUTS = 256


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def batched(
    docs: DataFrame, total_bytes: int, batch_bytes: int = BATCH_BYTES, most_cuts: int = CUTS,
) -> DataFrame:
    """Adds ``batch``, a range of doc_id; a later batch has larger ids.

    At most ``most_cuts`` quantiles are taken, whatever the input, and each range between two
    of them is divided evenly by value.  Rows with null ids are the last batch.
    """
    ship_package(docs.sparkSession)
    n = max(1, -(-total_bytes // batch_bytes))
    place = F.col("doc_id").cast("double")
    ranges = min(n, most_cuts)
    found = docs.where(F.col("doc_id").isNotNull()).select(place.alias("p")).approxQuantile(
        "p", [i / ranges for i in range(ranges + 1)], 1 / (8 * ranges)
    )
    bounds = sorted(set(found)) or [0.0]
    number = F.greatest(F.lit(0), F.size(F.filter(F.array(*map(F.lit, bounds)), lambda c: c <= place)) - 1)
    inner = -(-n // ranges)
    if inner > 1:
        edges = F.array(*map(F.lit, [*bounds, bounds[-1] + 1]))
        low, high = F.get(edges, number), F.get(edges, number + 1)
        part = F.floor((place - low) / (high - low) * inner).cast("int")
        number = number * inner + F.greatest(F.lit(0), F.least(F.lit(inner - 1), part))
    last = (len(bounds) + 1) * inner
    return docs.select(
        "doc_id", "text", F.when(place.isNull(), last).otherwise(number).cast("int").alias("batch")
    )


def dealt(docs: DataFrame, total_bytes: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Adds ``batch`` by a hash of the row and of the task that reads it.

    So neither missing, repeated or clumped ids nor repeated rows gather in a batch: of
    equal rows only those that one task reads lie together.  The rule is the same at every size.
    """
    ship_package(docs.sparkSession)
    n = max(1, -(-total_bytes // batch_bytes))
    number = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int")
    return docs.select("doc_id", "text", number.alias("batch"))


def sorted_rows(table: pa.Table) -> pa.RecordBatch:
    """A batch's documents in one fixed order, so that every visit sees the same arrays."""
    table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    batches = table.combine_chunks().to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], table.schema)


def by_group(frame: DataFrame, key: str, work: Callable, schema: str) -> DataFrame:
    return frame.groupBy(key).applyInArrow(work, schema)


def meet(answers: DataFrame, docs: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(answers of a batch, documents of a batch)``."""
    return answers.groupBy("batch").cogroup(docs.groupBy("batch")).applyInArrow(work, schema)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their differences; high planes compress away."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def rows_of(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
