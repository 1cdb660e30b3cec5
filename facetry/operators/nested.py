"""Recursive merge of nested documents on the VARIANT type.

A document becomes rows of (path, leaf), the merge is two equi-joins on paths, and the
documents are put together again level by level.  Everything is keyed by document and
path, so neither many documents nor a large one gathers anywhere but in its own result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.session import use_checkpoint_dir

_KIND = "substring_index(schema_of_variant(_v), '<', 1)"


def leaves(documents: DataFrame, key: str, value: str) -> DataFrame:
    """``key, path array<string>, leaf variant`` for every value that is no filled object.

    Lists are leaves; an empty object is one too.  One pass per level of nesting.
    """
    use_checkpoint_dir(documents.sparkSession)
    spark, found = documents.sparkSession, []
    level = documents.filter(F.col(value).isNotNull()).select(
        F.col(key).alias("_k"), F.array().cast("array<string>").alias("path"), F.col(value).alias("_v")
    )
    while True:
        kinds = level.withColumn("_text", F.to_json("_v")).withColumn(
            "_open", (F.expr(_KIND) == "OBJECT") & (F.col("_text") != "{}")
        ).checkpoint()
        found.append(kinds.filter(~F.col("_open")).select("_k", "path", F.col("_v").alias("leaf")))
        inside = kinds.filter("_open")
        if inside.isEmpty():
            break
        level = inside.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(
            "_k", F.concat("path", F.array("key")).alias("path"), F.col("value").alias("_v")
        )
    return reduce(DataFrame.unionByName, found).withColumnRenamed("_k", key)


def _prefixes(rows: DataFrame, key: str) -> DataFrame:
    """``key, path, at``: a path with each of its proper beginnings and itself."""
    steps = F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    return rows.select(key, "path", F.explode(steps).alias("at"))


def merged_leaves(existing: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Leaves of the merged documents: a new one wins at every depth, others are kept."""
    old, fresh = leaves(existing, key, value), leaves(new, key, value)
    filled = F.to_json("leaf") != "{}"
    # An old value goes if a new one stands at it or above it, or anywhere below it.
    above = _prefixes(old, key).join(
        fresh.filter(filled).select(key, F.col("path").alias("at")), [key, "at"], "left_semi"
    ).select(key, "path")
    same = old.join(fresh.select(key, "path"), [key, "path"], "left_semi").select(key, "path")
    below = _prefixes(fresh, key).select(key, F.col("at").alias("path"))
    kept = old.join(above.unionByName(same).unionByName(below).distinct(), [key, "path"], "left_anti")
    # An empty object adds nothing where there is an object already.
    under = _prefixes(kept, key).select(key, F.col("at").alias("path")).distinct()
    useful = fresh.filter(filled).unionByName(fresh.filter(~filled).join(under, [key, "path"], "left_anti"))
    return kept.unionByName(useful)


def documents_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value variant`` put together from leaves; members are in order of their names."""
    use_checkpoint_dir(rows.sparkSession)
    level = rows.select(key, "path", F.to_json("leaf").alias("_json")).checkpoint()
    depth = level.agg(F.max(F.size("path"))).first()[0] or 0
    for n in range(depth, 0, -1):
        name = F.to_json(F.struct(F.element_at("path", -1).alias("k")))
        # {"k":"name"} gives the quoted name.
        quoted = F.substring(name, F.lit(6), F.length(name) - 6)
        inner = level.filter(F.size("path") == n).select(
            key, F.slice("path", F.lit(1), F.lit(n - 1)).alias("path"), quoted.alias("_name"), "_json"
        ).groupBy(key, "path").agg(F.sort_array(F.collect_list(F.struct("_name", "_json"))).alias("_m"))
        text = F.concat(F.lit("{"), F.array_join(
            F.transform("_m", lambda m: F.concat(m["_name"], F.lit(":"), m["_json"])), ","
        ), F.lit("}"))
        level = level.filter(F.size("path") < n).unionByName(inner.select(key, "path", text.alias("_json"))).checkpoint()
    return level.select(key, F.parse_json("_json").alias(value))


def deep_merge(existing: DataFrame, new: DataFrame, key: str = "id", value: str = "document") -> DataFrame:
    """Merge documents with equal keys; those on one side only are kept as they are.

    Objects merge member by member; anything else is replaced by the new value.  Keys must
    be unique and not null on either side; a null document counts as absent.
    """
    return documents_of(merged_leaves(existing, new, key, value), key, value)
