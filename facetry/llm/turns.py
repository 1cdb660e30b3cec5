"""Rows of a conversation in order, however many one conversation has."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.kernels import keep


def _runs(column: pa.Array) -> list[tuple[object, int]]:
    """Values that stand side by side, with their lengths."""
    encoded = pc.run_end_encode(column)
    ends = encoded.run_ends.to_pylist()
    return list(zip(encoded.values.to_pylist(), [b - a for a, b in zip([0, *ends], ends)]))


def numbered(rows: DataFrame, key: str, order: list[str], cuts: list[Column | str] | None = None) -> DataFrame:
    """Adds ``pos``, from 0, to the rows of each ``key`` in the given order (nulls first).

    Rows are sorted over all partitions and stored, so a key with many rows lies in several
    of them.  Partitions are ranges of ``cuts``, by default the order itself; they must not
    contradict it.  Only the first key of a partition can go on from an earlier one; how many
    rows it has there is all that the driver learns, one line per partition.  ``key`` may
    not be null.
    """
    stored = keep(
        rows.repartitionByRange(*[F.asc_nulls_first(c) for c in (key, *(cuts or order))])
        .sortWithinPartitions(*[F.asc_nulls_first(c) for c in (key, *order)])
    ).withColumn("_part", F.spark_partition_id())

    def edges(batches):
        first = last = part = None
        heads = tails = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(1)[0].as_py()
                for value, n in _runs(batch.column(0)):
                    if first is None:
                        first = value
                    if value == first:
                        heads += n
                    tails = tails + n if value == last else n
                    last = value
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "heads": heads, "last": last, "tails": tails}])

    kind = rows.schema[key].dataType.simpleString()
    found = stored.select(key, "_part").mapInArrow(
        edges, f"part long, first {kind}, heads long, last {kind}, tails long"
    ).collect()
    before, carried, open_key = {}, 0, None
    for e in sorted(found, key=lambda e: e["part"]):
        before[e["part"]] = carried if e["first"] == open_key else 0
        carried = e["tails"] + (before[e["part"]] if e["first"] == e["last"] else 0)
        open_key = e["last"]
    at, part_at, names = stored.columns.index(key), stored.columns.index("_part"), [*rows.columns, "pos"]

    def number(batches):
        value, n = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = []
            for here, length in _runs(batch.column(at)):
                if n is None:
                    n = before[batch.column(part_at)[0].as_py()]
                elif here != value:
                    n = 0
                places.extend(range(n, n + length))
                value, n = here, n + length
            columns = [c for i, c in enumerate(batch.columns) if i != part_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return stored.mapInArrow(number, f"{schema}, pos long")
