"""Each registered query against the SQL that an independent engine answers on the same tables."""

import os

import duckdb
import numpy as np
import pytest

from corpusloom.registry import QUERIES, SQL


def rows(df):
    cols = sorted(df.columns)
    plain = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted(tuple(repr(float(v) + 0.0) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else str(v) for v in r) for r in plain.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        path = f"{data}/{f}" + ("/*.parquet" if os.path.isdir(f"{data}/{f}") else "")
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, data, oracle):
    got, want = QUERIES[name](spark, data).toPandas(), oracle.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 6


ODD = [(1, "a b a b c the cat"), (2, None), (3, ""), (4, "x"), (None, "a b a b"), (5, "the the a b"), (6, "Été_1 été_1 9 9 9"), (7, "of the"), *((i, "left right left " * (i % 3 + 1) + "p" * (i % 2 + 1)) for i in range(10, 40)), *((i, f"word{i} up down") for i in range(40, 140))]


@pytest.mark.parametrize("more", [[], [(1, "a b q a b")], [(None, "a b"), (40, None), (41, "left right")]])
@pytest.mark.parametrize("name", ["bigram_counts", "dfm_trim", "vocabulary_top"])
def test_terms_of_odd_texts(spark, tmp_path, name, more):
    """Ids that come twice, null ids, and texts without tokens or pairs."""
    docs = [(i, t, f"src{(i or 0) % 3}", "en") for i, t in ODD + more]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(SQL[name]).df()
    assert len(want) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["bigram_counts", "vocabulary_top"])
def test_texts_of_unique_ids_are_not_shuffled(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "hashpartitioning(id" not in plan


def test_trimmed_rows_are_not_shuffled_by_term(spark, data):
    """Where few terms are kept."""
    plan = QUERIES["dfm_trim"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(term" not in plan
