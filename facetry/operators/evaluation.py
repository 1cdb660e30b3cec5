"""Metrics against gold annotations.

Every function takes ``keys`` (for example dataset and model) and scores all groups
in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.spans import label_runs
from facetry.functions.text import strip
from facetry.functions.wordlists import CLASS_ORDER, IGNORE_ID

METRIC_KEYS = ["dataset", "task", "model", "metric"]


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def term_sets(terms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct normalised terms per sentence; blank and NULL terms are dropped."""
    return terms.select(
        *keys, F.col("sentence_id").cast("string").alias("sentence_id"),
        F.lower(strip(F.col("term").cast("string"))).alias("term"),
    ).filter(F.col("term") != "").distinct()


def extraction_scores(gold: DataFrame, pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Micro precision, recall and F1 over the term sets of all sentences.

    Both sides are stacked and grouped once by (keys, sentence, term), which costs
    one exchange of pre-combined rows where a full outer join would take several.
    """
    def side(df, is_gold):
        # No distinct here: the grouping below removes duplicates.
        rows = df.select(
            *keys, F.col("sentence_id").cast("string").alias("sentence_id"),
            F.lower(strip(F.col("term").cast("string"))).alias("term"),
        ).filter(F.col("term") != "")
        return rows.withColumn("_gold", F.lit(is_gold)).withColumn("_pred", F.lit(not is_gold))

    return _cell_scores(side(gold, True).unionByName(side(pred, False)), keys)


def list_scores(rows: DataFrame, sides: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``extraction_scores`` where both sides come from one row.

    ``sides`` makes ``array<array<string>>``: the gold terms and the predicted ones of the
    row, in this order.  They are worked out together, in one scan.  Rows may share a
    ``sentence_id``: their terms are one set, as in ``extraction_scores``.
    """
    lists = rows.select(
        *keys, F.col("sentence_id").cast("string").alias("sentence_id"), F.posexplode_outer(sides).alias("_side", "_terms")
    )
    terms = lists.select(*keys, "sentence_id", "_side", F.explode_outer("_terms").alias("term"))
    both = terms.select(
        *keys, "sentence_id", F.lower(strip(F.col("term"))).alias("term"),
        (F.col("_side") == 0).alias("_gold"), (F.col("_side") == 1).alias("_pred"),
    ).filter(F.col("term") != "")
    return _cell_scores(both, keys)


def _cell_scores(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores of ``keys, sentence_id, term, _gold, _pred``."""
    cells = both.groupBy(*keys, "sentence_id", "term").agg(
        F.max("_gold").alias("_gold"), F.max("_pred").alias("_pred")
    )
    g, p = F.col("_gold"), F.col("_pred")
    counts = cells.groupBy(*keys).agg(
        F.count_if(g & p).alias("true_positives"),
        F.count_if(p & ~g).alias("false_positives"),
        F.count_if(g & ~p).alias("false_negatives"),
    )
    return _term_metrics(counts, keys)


def array_scores(rows: DataFrame, gold: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """``extraction_scores`` of two term arrays in the row of their sentence, plus ``n_sentences``.

    A row is a sentence.  The sets are compared in the row, so that counts per group are
    all that is shuffled.
    """
    def distinct_terms(name: str) -> Column:
        terms = F.transform(F.col(name), lambda t: F.lower(strip(t.cast("string"))))
        return F.coalesce(F.array_distinct(F.filter(terms, lambda t: t != "")), F.array().cast("array<string>"))

    sets = rows.select(*keys, distinct_terms(gold).alias("_gold"), distinct_terms(pred).alias("_pred"))
    sizes = sets.select(
        *keys, F.size("_gold").alias("_g"), F.size("_pred").alias("_p"),
        F.size(F.array_intersect("_gold", "_pred")).alias("_both"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = sizes.groupBy(*keys).agg(
        total(F.col("_both")).alias("true_positives"),
        total(F.col("_p") - F.col("_both")).alias("false_positives"),
        total(F.col("_g") - F.col("_both")).alias("false_negatives"),
        F.count("*").alias("n_sentences"),
    )
    return _term_metrics(counts, keys, ["n_sentences"])


def _term_metrics(counts: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    scored = counts.withColumn("_p", _ratio(tp, tp + fp)).withColumn("_r", _ratio(tp, tp + fn))
    return scored.select(
        *keys,
        F.round("_p", 4).alias("precision"), F.round("_r", 4).alias("recall"),
        F.round(_f1(F.col("_p"), F.col("_r")), 4).alias("f1"),
        "true_positives", "false_positives", "false_negatives",
        (tp + fn).alias("n_gold_terms"), (tp + fp).alias("n_pred_terms"), *more,
    )


def _class_counts(pairs: DataFrame, labels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    true, pred = F.col("y_true"), F.col("y_pred")
    aggs = [F.count("*").alias("n"), F.count_if(true == pred).alias("_correct")]
    for i, label in enumerate(labels):
        aggs += [
            F.count_if((true == label) & (pred == label)).alias(f"_tp{i}"),
            F.count_if(true == label).alias(f"_true{i}"),
            F.count_if(pred == label).alias(f"_pred{i}"),
        ]
    return pairs.groupBy(*keys).agg(*aggs)


def _class_f1(i: int) -> tuple[Column, Column, Column]:
    precision = _ratio(F.col(f"_tp{i}"), F.col(f"_pred{i}"))
    recall = _ratio(F.col(f"_tp{i}"), F.col(f"_true{i}"))
    return precision, recall, _f1(precision, recall)


def sentiment_scores(
    pairs: DataFrame, keys: Sequence[str] = (), labels: Sequence[str] = CLASS_ORDER,
    observed_only: bool = False, expected: DataFrame | None = None,
) -> DataFrame:
    """``n, accuracy, macro_f1`` of columns ``y_true, y_pred``; no rows is an error.

    ``expected`` has the ``keys`` of the groups asked for: those are scored, and one of
    them without rows is an error too.

    The macro average is over the given labels, or with ``observed_only`` over those
    that occur on either side.  Labels outside the list count as errors.
    """
    counts = _class_counts(pairs, labels, keys)
    if expected is not None:
        counts = expected.select(*keys).distinct().join(counts, list(keys), "left")
    f1_sum, present = F.lit(0.0), F.lit(0)
    for i in range(len(labels)):
        f1_sum = f1_sum + _class_f1(i)[2]
        present = present + F.when(F.col(f"_true{i}") + F.col(f"_pred{i}") > 0, 1).otherwise(0)
    classes = present if observed_only else F.lit(len(labels))
    n = F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, F.raise_error(F.lit("no examples to score")).cast("bigint")).otherwise(F.col("n"))
    return counts.select(
        *keys, n.alias("n"),
        F.round(_ratio(F.col("_correct"), F.col("n")), 4).alias("accuracy"),
        F.round(_ratio(f1_sum, classes), 4).alias("macro_f1"),
    )


def class_report(
    pairs: DataFrame, keys: Sequence[str] = (), labels: Sequence[str] = CLASS_ORDER
) -> DataFrame:
    """Precision, recall, F1 and support, one row per class."""
    counts = _class_counts(pairs, labels, keys)
    rows = []
    for i, label in enumerate(labels):
        precision, recall, f1 = _class_f1(i)
        rows.append(F.struct(
            F.lit(label).alias("label"), F.round(precision, 4).alias("precision"),
            F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"),
            F.col(f"_true{i}").alias("support"),
        ))
    return counts.select(*keys, F.inline(F.array(*rows)))


def confusion(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("count"))


def span_scores(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Entity-level micro scores of arrays ``true_labels`` and ``pred_labels``.

    Positions ignored on the true side are removed from both before the runs are
    read; a run counts when both of its ends agree.
    """
    pairs = F.filter(
        F.arrays_zip(F.col("true_labels").alias("t"), F.col("pred_labels").alias("p")),
        lambda x: x["t"] != IGNORE_ID,
    )
    kept = rows.select(*keys, pairs.alias("_pairs"))
    runs = kept.select(
        *keys,
        label_runs(F.transform("_pairs", lambda x: x["t"])).alias("_true"),
        label_runs(F.transform("_pairs", lambda x: x["p"])).alias("_pred"),
    )
    counts = runs.groupBy(*keys).agg(
        F.coalesce(F.sum(F.size(F.array_intersect("_true", "_pred"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum(F.size("_true")), F.lit(0)).alias("_t"),
        F.coalesce(F.sum(F.size("_pred")), F.lit(0)).alias("_p"),
    )
    precision, recall = _ratio(F.col("_tp"), F.col("_p")), _ratio(F.col("_tp"), F.col("_t"))
    return counts.select(
        *keys, F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
        F.round(_f1(precision, recall), 4).alias("f1"),
        F.col("_tp").alias("true_spans_found"), F.col("_t").alias("n_true_spans"),
        F.col("_p").alias("n_pred_spans"),
    )


def metrics_table(scores: DataFrame, task: str) -> DataFrame:
    """Long form ``dataset, task, model, metric, value`` of a scores table."""
    values = [c for c in scores.columns if c not in ("dataset", "model")]
    typed = scores.select("dataset", "model", *[F.col(c).cast("double").alias(c) for c in values])
    long = typed.unpivot(["dataset", "model"], values, "metric", "value")
    return long.select("dataset", F.lit(task).alias("task"), "model", "metric", "value")


def upsert_metrics(existing: DataFrame, new: DataFrame, keys: Sequence[str] = METRIC_KEYS) -> DataFrame:
    """New values win, other existing values stay."""
    return existing.join(new, list(keys), "left_anti").unionByName(new)


def report_rows(metrics: DataFrame) -> DataFrame:
    """The lines of a results report: headline metrics per dataset, task and model."""
    wanted = ["precision", "recall", "f1", "accuracy", "macro_f1", "n"]
    return metrics.groupBy("dataset", "task", "model").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in wanted]
    ).orderBy("dataset", "task", "model")
