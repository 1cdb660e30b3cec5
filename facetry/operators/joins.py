"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.sources.reviews import BLOCKS

SALTS = 4


def in_blocks(rows: DataFrame, by: Sequence[str] = (), name: str = "_deal") -> DataFrame:
    """The rows with the number of a block in ``name``, dealt by it; a block is in one task.

    A row's block follows from a hash of the columns ``by``, by default of all that have
    one.  What is found out per block meets its rows where they are, so they are moved once
    for two readers.
    """
    usable = [c for c in rows.columns if _hashable(rows, c)]
    blocks = BLOCKS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64(*(by or usable)), F.lit(blocks)).cast("int")).repartition(name)
    # Always true.  It asks for all columns, as readers of different ones would each have the rows moved for them.
    return dealt.filter((F.monotonically_increasing_id() >= 0) | (F.xxhash64(*usable) == 0))


def lookup_join(
    rows: DataFrame, table: DataFrame, key: str, how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join rows to a table with unique keys (``how``: left, inner or left_semi).

    Every key is dealt over ``salts`` values by a hash of the whole row, and the table is
    repeated once per value, so each side is read once and the plan is the same at every
    size.  A table that comes out of an aggregation on the key would otherwise be joined
    without a shuffle of its own, and adaptive execution only splits partitions below
    shuffles on both sides; the salt brings these shuffles back, so a key with most of
    the rows is split further than ``salts``.  Small tables are still broadcast.
    NULL keys match nothing and are dealt out like the rest.
    """
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if _hashable(rows, c)]), F.lit(salts)).cast("int")
    copies = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    left = rows.withColumn("_salt", deal)
    return left.join(table.withColumn("_salt", copies), [key, "_salt"], how).drop("_salt")


def _hashable(rows: DataFrame, column: str) -> bool:
    """Maps and variants have no hash."""
    kind = rows.schema[column].dataType.simpleString()
    return "map<" not in kind and "variant" not in kind
