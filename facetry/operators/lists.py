"""Values from tables for the elements of a row's arrays, found once per block of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from facetry.operators.joins import in_blocks, lookup_join
from facetry.session import ship_package


def whole(column: pa.ChunkedArray) -> pa.Array:
    """A column of a table as one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def lookup_lists(rows: DataFrame, wanted: Mapping[str, tuple[Column, DataFrame]], by: Sequence[str] = ()) -> DataFrame:
    """Adds an array for each name: the values that a table has for the elements of an array of strings.

    ``wanted``: by name the array, and a table ``token, value`` of any size with unique
    tokens and values of text or double.  An element the table lacks has NULL.  Rows are
    moved once, by blocks.  A block asks for its distinct elements, and the answers meet
    its rows in one task, which holds a block at a time.  ``by``: columns to deal by.
    """
    ship_package(rows.sparkSession)
    dealt = in_blocks(rows, by)
    answers, kinds = [], {}
    for i, (name, (array, table)) in enumerate(wanted.items()):
        asked = dealt.select(F.col("_deal").alias("_block"), F.explode_outer(F.array_distinct(array)).alias("token"))
        # A block asks once, so no element has more rows than there are blocks.
        found = lookup_join(asked.filter(F.col("token").isNotNull()).distinct(), table.select("token", "value"), "token", "inner", salts=1)
        kinds[name] = DoubleType() if table.schema["value"].dataType == DoubleType() else StringType()
        number = kinds[name] == DoubleType()
        answers.append(found.select(
            "_block", F.lit(i).alias("_list"), "token", (F.lit(None) if number else F.col("value")).cast("string").alias("text"),
            (F.col("value") if number else F.lit(None)).cast("double").alias("number"),
        ))
    names, columns = list(wanted), rows.columns
    values = ["number" if kinds[n] == DoubleType() else "text" for n in names]
    sides = dealt.select("_deal", *columns, *[array.alias(f"_of{i}") for i, (array, _) in enumerate(wanted.values())])

    def work(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for name in columns:
            kind = block[name].type
            # Values come in the session's time zone and are taken in UTC.
            out.append(block[name].cast(pa.timestamp(kind.unit, "UTC")) if pa.types.is_timestamp(kind) and kind.tz else block[name])
        of = whole(answers["_list"]).to_numpy(zero_copy_only=False)
        for i, value in enumerate(values):
            own = answers.take(pa.array(np.flatnonzero(of == i)))
            lists = whole(block[f"_of{i}"])
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            found = whole(own[value]).take(pc.index_in(lists.flatten(), value_set=whole(own["token"]), skip_nulls=True))
            out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), found))
        return pa.table(out, [*columns, *names])

    given = StructType([*rows.schema.fields, *[StructField(n, ArrayType(kinds[n])) for n in names]])
    both = reduce(DataFrame.unionByName, answers)
    return sides.groupBy("_deal").cogroup(both.groupBy("_block")).applyInArrow(work, given)
