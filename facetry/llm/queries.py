"""The registered queries of the dealt operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import (
    burst_trie, byte_pairs, decontaminate, disclosure, language, packing, repair, revisits, run_index, suffix_trees,
    token_groups, topk, toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def web_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as archive records: one response, and two later revisits of its URL.

    Times, tags and dates follow from the page; the second revisit names another tag
    where the id is divisible by 5, and no validator at all where it is by 7.
    """
    pages = table(spark, sf_dir, "pages")
    hour = F.pmod(F.col("page_id") * 7919, F.lit(5000))
    i = F.col("_i")
    # Columns rather than structs, so that a reader of URLs and times does not pay for headers; tags are made once a page.
    rows = pages.select(
        "page_id", "url", hour.alias("_hour"), F.substring(F.md5("html"), 1, 12).alias("_tag"),
        F.octet_length("html").cast("string").alias("_length"), F.explode(F.array(*map(F.lit, range(3)))).alias("_i"),
    )
    tag, length = F.col("_tag"), F.col("_length")
    at = lambda hours: F.timestamp_seconds(F.lit(1704067200) + (F.col("_hour") + hours) * 3600)
    day = lambda hours: F.date_format(at(hours), "yyyy-MM-dd HH:mm:ss")
    answer = F.create_map(
        F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), day(0),
        F.lit("Content-Length"), length, F.lit("Cache-Control"), F.lit("max-age=60"),
    )
    first = F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag), F.lit("Date"), day(24),
                         F.lit("Content-Length"), F.lit("0"))
    second = (
        F.when(F.col("page_id") % 7 == 0, F.create_map(F.lit("Date"), day(-48)))
        .when(F.col("page_id") % 5 == 0, F.create_map(F.lit("Date"), day(-48), F.lit("ETag"), F.lit("other")))
        .otherwise(F.create_map(F.lit("Date"), day(-48), F.lit("ETag"), tag, F.lit("Cache-Control"), F.lit("no-cache")))
    )
    return rows.select(
        (F.col("page_id") * 3 + i).alias("record_id"), "url",
        at(F.when(i == 0, 0).when(i == 1, 24).otherwise(-48)).alias("ts"),
        F.when(i == 0, "response").otherwise("revisit").alias("kind"),
        F.when(i == 0, answer).when(i == 1, first).otherwise(second).alias("headers"),
    )


def op1_revisits(spark, sf_dir):
    found = revisits.resolve_revisits(web_records(spark, sf_dir))
    return found.select(
        "revisit_id", "url", "status", "response_id", revisits.header_text(F.col("headers")).alias("headers")
    )


def op2_suffix_trees(spark, sf_dir):
    found = suffix_trees.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op3_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_disclosure(spark, sf_dir):
    return disclosure.find_personal_data(table(spark, sf_dir, "documents"))


def op5_language(spark, sf_dir):
    return language.identify_language(table(spark, sf_dir, "documents"))


def op6_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op7_run_index(spark, sf_dir):
    found = run_index.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_token_groups(spark, sf_dir):
    return token_groups.link_documents(table(spark, sf_dir, "documents"))


def op11_burst_trie(spark, sf_dir):
    turns = burst_trie.shared_prefixes(table(spark, sf_dir, "conversations"))
    return burst_trie.prefix_nodes(turns)


def op12_repair(spark, sf_dir):
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_byte_pairs(spark, sf_dir):
    coded = byte_pairs.round_trip(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_revisits, op2_suffix_trees, op3_toxicity, op4_disclosure, op5_language, op6_topk,
        op7_run_index, op8_decontaminate, op9_packing, op10_token_groups, op11_burst_trie, op12_repair, op13_byte_pairs,
    )
}
