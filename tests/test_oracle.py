"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from corpusforge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return str(v) if not isinstance(v, int | str | bool | type(None)) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want


#: Queries without SQL; tests/test_further.py and the tests of their modules hold each against plain Python.
WITHOUT_SQL = {"clean_full", "seg_maxmatch", "seg_viterbi", "seg_hmm", "seg_neural", "seg_calibrate", "kmeans_sizes", "kmeans_best_k", "ward_labels", "logistic_gd", "tree_predict", "method_comparison",
               "seg_rule", "seg_search", "seg_full", "tag_counts", "pca_2d", "logistic_documents", "tree_documents", "graph_network"}


def test_queries_without_sql_are_known():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == WITHOUT_SQL


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
