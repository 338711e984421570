import duckdb
import pytest

import __spark_entry__ as entry
from lexispark.plans import catalog

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", ["postings", "features_all", "bm25_plus_top10", "predict_with_dictionary", "grid_best", "metrics_per_query"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    form = lambda v: f"{v:.5g}" if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(map(form, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)
