"""Driver contract: entry runs, every oracle has a query, a sample of queries matches DuckDB."""

import duckdb
import pytest

import __spark_entry__ as E
from tableprep.sources.tables import TABLES, table_path

from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["o_orderpriority", "n_orders", "mean_price", "max_price", "mean_custkey"]


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 50


@pytest.mark.parametrize("name", ["clean_orders_by_priority", "dedup_keep_first", "tfidf_weights", "feature_engineer",
                                  "select_kbest_anova", "stage_score", "target_encode_oof", "weighted_vote"])
def test_query_matches_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    exp = con.execute(E.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(exp.columns)
    a = sorted(map(repr, got[cols].itertuples(index=False, name=None)))
    b = sorted(map(repr, exp[cols].itertuples(index=False, name=None)))
    assert a == b
