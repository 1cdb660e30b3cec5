"""Term vectors against plain sums, clusters on planted groups."""

import hashlib
import random
from collections import defaultdict

from facetry.operators.term_vectors import add_learned_theme, cluster_terms, term_vectors

KINDS = "review_id bigint, aspect string"


def marks(term):
    digest = hashlib.md5(term.encode()).hexdigest()
    for j in range(4):
        number = int(digest[6 * j: 6 * j + 6], 16)
        yield number % 64, 1 if number // 64 % 2 == 0 else -1


def by_pairs(rows):
    """Every term against every other term of its contexts."""
    contexts = defaultdict(set)
    for context, term in rows:
        if context is not None and term is not None:
            contexts[context].add(term)
    sums, seen = defaultdict(lambda: [0] * 64), defaultdict(int)
    for terms in contexts.values():
        for a in terms:
            seen[a] += 1
            for b in terms - {a}:
                for dim, sign in marks(b):
                    sums[a][dim] += 1024 // (len(terms) - 1) * sign
    return {t: (n, sums[t]) for t, n in seen.items() if n >= 2}


def test_vectors_equal_all_pairs(spark):
    rng = random.Random(2)
    # One context has a third of the rows; nulls, repeats and a context of one term.
    rows = [(0 if rng.random() < 0.33 else rng.randrange(1, 40), f"term {rng.randrange(60)}") for _ in range(700)]
    rows += [(None, "term 1"), (3, None), (99, "alone"), (98, "alone"), rows[0], (5, "é"), (6, "é")]
    got = term_vectors(spark.createDataFrame(rows, KINDS).repartition(5)).collect()
    assert {r["aspect"]: (r["contexts"], r["sums"]) for r in got} == by_pairs(rows)


def test_planted_groups_become_themes(spark):
    rng = random.Random(4)
    groups = [[f"{name}{i}" for i in range(8)] for name in ("tent", "stove", "boat")]
    rows = []
    for review in range(600):
        group = groups[review % 3]
        rows += [(review, t) for t in [group[0], *rng.sample(group[1:], 4)]]
    rows += [(1000, "alone"), (1001, "alone")]
    mentions = spark.createDataFrame(rows, KINDS)
    found = cluster_terms(term_vectors(mentions), ks=(2, 3, 6))
    assert found.k == 3 and set(found.silhouettes) == {2, 3, 6}
    themes = {r["aspect"]: r["theme"] for r in found.terms.collect()}
    assert themes == {t: g[0] for g in groups for t in g}
    named = add_learned_theme(mentions, found.terms)
    assert named.count() == len(rows) and named.columns == ["review_id", "aspect", "theme"]
    assert named.filter("aspect = 'alone' and theme = 'alone'").count() == 2


def test_no_terms(spark):
    none = term_vectors(spark.createDataFrame([], KINDS))
    found = cluster_terms(none)
    assert none.count() == 0 and found.k == 0 and found.terms.count() == 0


def test_a_pattern_is_spelt_once_per_term(spark, capsys):
    """The digests of a pattern were worked out for every dimension, which took most of the time."""
    rows = spark.createDataFrame([(i % 3, f"term {i}") for i in range(9)], KINDS)
    plan = term_vectors(rows, min_contexts=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform" in plan and "md5" in plan
    for line in plan.splitlines():
        # A digest below the lambda over the sums would stand in the aggregate of a dimension.
        assert "aggregate(array(" not in line or "md5" not in line


def test_rows_of_a_context_come_in_many_batches(spark):
    """Terms of a context were moved once per mark and a term's sums once per block; now twice, whatever batches they come in."""
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(1, 9), f"t{rng.randrange(90)}") for _ in range(600)]
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, "7")
    try:
        found = term_vectors(spark.createDataFrame(rows, KINDS))
        assert {r["aspect"]: (r["contexts"], r["sums"]) for r in found.collect()} == by_pairs(rows)
    finally:
        spark.conf.set(name, before)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 2 and "_salt" not in plan


def test_sums_are_sent_in_the_bytes_they_need():
    import numpy as np

    from facetry.operators.term_vectors import packed

    sums = np.array([[1, -128], [200, 0], [1 << 20, 0], [1 << 40, -1]])
    (batch,) = packed({"a": 0, "b": 1, "c": 2, "d": 3}, sums, np.ones((4, 2), np.int64))
    assert [len(x) for x in batch.column("part").to_pylist()] == [2, 4, 8, 16]
