import duckdb
import pandas as pd
import pytest

from lexarbor.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def values(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(None if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_is_its_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(values(got), key=str) == sorted(values(want), key=str)


def test_queries_without_sql_are_tested_by_value_elsewhere():
    # near_dup_survivors, pca, transrate: test_operators; landmark_map, svm_pad, lr_predict, tfidf_logistic: test_models; network_runs: test_network
    assert set(queries.QUERIES) - set(oracle.SQL) == {"landmark_map", "lr_predict", "near_dup_survivors", "network_runs", "pca", "svm_pad", "tfidf_logistic", "transrate"}
