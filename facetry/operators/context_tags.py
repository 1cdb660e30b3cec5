"""Part-of-speech tags in context: a hidden Markov model counted from a tagged corpus.

Counting is two aggregations: tags by token, and tags by the tag before.  The token table
may be of any size and is joined by equi-join, with the distinct tokens of a block of
sentences, so that neither a token's every occurrence nor its scores are moved; the
transitions have a row per pair of tags.  What bounds the model that tasks hold is the tag
set and the tokens of a block.  The best path of a sentence is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from facetry.functions.terms import distinct_terms, is_valid_term
from facetry.functions.text import MARK, bind
from facetry.functions.wordlists import MAX_TERM_WORDS, MIN_TERM_LENGTH
from facetry.operators.joins import lookup_join
from facetry.operators.lists import whole
from facetry.operators.tagger import viterbi
from facetry.session import ship_package
from facetry.sources.reviews import BLOCKS

START = ""
MOST_TAGS = 200


@dataclass
class TagModel:
    """``tags`` in order; ``steps``: log-probability by tag before (the last row: none) and tag;
    ``emissions``: ``token, scores``, one log-probability per tag; ``unknown``: those of other tokens.
    """

    tags: list[str]
    steps: list[list[float]]
    emissions: DataFrame
    unknown: list[float]


def count_tags(tagged: DataFrame, keys: list[str], smoothing: float = 1.0, words: str | None = None) -> TagModel:
    """Learn from rows ``keys, pos, token, tag``; ``pos`` orders a sentence.

    ``words``: a row is a sentence, and this array has its ``token, tag`` in order; then
    only counts are moved.  Counts are smoothed by ``smoothing``.  Words without a token or
    tag are left out.  A corpus with more than ``MOST_TAGS`` tags is an error.
    """
    if words is None:
        rows = tagged.filter(F.col("tag").isNotNull() & F.col("token").isNotNull())
        before = F.lag("tag", 1, START).over(Window.partitionBy(*keys).orderBy("pos"))
        rows = rows.withColumn("_before", before)
    else:
        kept = F.filter(words, lambda w: w["tag"].isNotNull() & w["token"].isNotNull())
        steps = bind(kept, lambda k: F.transform(k, lambda w, i: F.struct(
            w["token"].alias("token"), w["tag"].alias("tag"),
            F.when(i == 0, START).otherwise(F.get(k, i - 1)["tag"]).alias("_before"),
        )))
        rows = tagged.select(F.inline_outer(steps)).filter(F.col("token").isNotNull())
    pairs = rows.groupBy("_before", "tag").agg(F.count("*").alias("n"))
    # A row per pair of tags; one more than allowed tells that there are too many.
    found = pairs.limit((MOST_TAGS + 1) ** 2 + 1).collect()
    tags = sorted({r["tag"] for r in found})
    if len(tags) > MOST_TAGS:
        raise ValueError(f"{len(tags)} tags; at most {MOST_TAGS} can be told apart in context")
    number = {t: i for i, t in enumerate(tags)}
    seen = np.zeros((len(tags) + 1, len(tags)))
    for r in found:
        seen[number[r["_before"]] if r["_before"] in number else len(tags), number[r["tag"]]] += r["n"]
    steps = [[math.log((n + smoothing) / (row.sum() + smoothing * len(tags))) for n in row.tolist()] for row in seen]
    totals = {t: float(seen[:, i].sum()) for t, i in number.items()}
    counts = rows.groupBy("token", "tag").agg(F.count("*").alias("n")).groupBy("token").agg(
        F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("_n")
    )
    # One more kind of token stands for all unseen ones.
    scores = F.array(*[
        F.ln((F.coalesce(F.try_element_at("_n", F.lit(t)), F.lit(0)) + smoothing) / F.lit(totals[t] + smoothing)) for t in tags
    ])
    unknown = [math.log(smoothing / (totals[t] + smoothing)) for t in tags]
    return TagModel(tags, steps, counts.select("token", scores.alias("scores")), unknown)


#: Tokens whose scores are spelt out at one time.
PART = 1 << 18


def tag_sentences(
    sentences: DataFrame, model: TagModel, key: str = "_key", tokens_col: str = "_tokens",
    deal: str | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """``key, tags`` for ``key`` (unique) and an array of tokens; sentences without tokens give no row.

    Sentences go in blocks.  A block asks the token table for its distinct tokens, and the
    answers meet its sentences in one task, which holds a block at a time.  ``deal``: a
    column with the number of a block that ``sentences`` are dealt by already, equal for
    rows of one key.  Rows that share a key are one sentence, merged by the places of
    their tokens.  ``keep``: give back every row, with these columns, beside its key's tags.
    """
    spark = sentences.sparkSession
    ship_package(spark)
    if deal is None:
        blocks = BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
        sentences = sentences.withColumn("_deal", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).repartition("_deal")
    dealt = sentences.select(F.col(deal or "_deal").alias("_deal"), F.col(key).alias("_name"), F.col(tokens_col).alias("_words"), *keep)
    asked = dealt.select(F.col("_deal").alias("_block"), F.explode_outer(F.array_distinct("_words")).alias("token"))
    # A block asks once, so no token has more rows than there are blocks.
    known = lookup_join(asked.filter(F.col("token").isNotNull()).distinct(), model.emissions, "token", "inner", salts=1)
    names, steps, unknown = pa.array(model.tags, pa.string()), np.array(model.steps), np.array(model.unknown)

    def work(block: pa.Table, answers: pa.Table) -> pa.Table:
        lists = whole(block["_words"])
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.index_in(lists.flatten(), value_set=whole(answers["token"]), skip_nulls=True).fill_null(answers.num_rows)
        at = at.to_numpy(zero_copy_only=False)
        scores = whole(answers["scores"]).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(unknown))
        scores = np.concatenate([scores, unknown[None]])
        # Keys are numbered by the first row that has them.
        of_row = whole(block["_name"]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        count = int(of_row.max(initial=-1)) + 1
        if count < len(of_row):
            owner, place = np.repeat(of_row, sizes), np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rank = np.unique(scores, axis=0, return_inverse=True)[1].ravel()
            at = at[np.lexsort((rank[at], place, owner))]
            sizes = np.bincount(of_row, sizes, count).astype(np.int64)
        ends, labels = np.cumsum(sizes), np.zeros(len(at), np.int64)
        first = 0
        while first < count:
            begin = int(ends[first - 1]) if first else 0
            to = max(first + 1, int(np.searchsorted(ends, begin + PART, "right")))
            rows = slice(begin, int(ends[to - 1]))
            labels[rows] = viterbi(scores[at[rows]], steps, sizes[first:to])
            first = to
        tags = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), names.take(pa.array(labels)))
        chosen = np.arange(len(of_row)) if keep else np.unique(of_row, return_index=True)[1]
        chosen = pa.array(chosen[sizes[of_row[chosen]] > 0])
        rest = [whole(block[c]).take(chosen) for c in ("_name", *keep)]
        return pa.table([*rest, tags.take(pa.array(of_row).take(chosen))], [key, *keep, "tags"])

    kinds = [StructField(c, sentences.schema[c].dataType) for c in (key, *keep)]
    given = StructType([*kinds, StructField("tags", ArrayType(StringType()))])
    return dealt.groupBy("_deal").cogroup(known.groupBy("_block")).applyInArrow(work, given)


def tagged_terms(
    tokens: Column, tags: Column, min_length: int = MIN_TERM_LENGTH, max_words: int = MAX_TERM_WORDS
) -> Column:
    """Aspect terms from runs of noun tags, as ``functions.terms.aspect_terms`` has them."""
    kept = F.zip_with(tokens, tags, lambda w, t: F.when(t.startswith("NN"), w).otherwise(F.lit(MARK)))
    runs = F.transform(F.split(F.lower(F.array_join(kept, " ")), MARK), lambda r: F.trim(r))
    return bind(runs, lambda found: distinct_terms(
        F.filter(found, lambda r: (r != "") & is_valid_term(r, min_length, max_words))
    ))
