"""Every registered query against its DuckDB counterpart."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from facetry.plans.oracle import ORACLE
from facetry.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows_of(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if pd.api.types.is_datetime64_any_dtype(frame[c]):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_numeric_dtype(frame[c]) and not pd.api.types.is_bool_dtype(frame[c]):
            frame[c] = frame[c].astype("float64").round(9) + 0.0
    frame = frame.astype(object).where(frame.notna(), None).replace("NaT", None)
    return sorted(map(tuple, frame.itertuples(index=False, name=None)), key=str)


def test_registry():
    assert set(ORACLE) <= set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) - set(ORACLE) == {
        "theme_clusters", "classifier_dev_scores", "tagger_dev_scores", "stored_matrix", "context_tags", "context_mentions",
    }


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir).toPandas()
    expected = duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) > 0
    assert rows_of(got) == rows_of(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    out = entry_module.entry(spark)
    assert "net_score" in out.columns and out.limit(1).count() == 1
