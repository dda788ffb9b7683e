"""Panel queries against their SQL at the smallest scale, where that scale is there."""

import os
import sys

import duckdb
import pytest

from factorloom.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
SOME = ("dense_spine", "align_panel", "pivot_panel", "spike_clean", "default_mask_m", "ewma_span24", "vol_forecast", "asof_rate", "ratio_roic",
        "ratio_earningsgrowth", "bucket_features", "bucket_mean_returns", "sample_table", "splits_rolling_fixed", "cv_groups", "portfolio_value", "catalog_versions")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{file}'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    found = QUERIES[name](spark, DIR)
    assert sorted(found.columns) == sorted(names)
    norm = lambda v: round(v, 5) if isinstance(v, float) else str(v)
    key = lambda r: tuple(str(x) for x in r)
    ours = sorted(([norm(v) for v in r] for r in found.select(*names).collect()), key=key)
    theirs = sorted(([norm(v) for v in r] for r in cursor.fetchall()), key=key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert abs(x - y) < 1e-4 if isinstance(x, float) and isinstance(y, float) else x == y


def test_masked_means_of_a_last_month_that_is_good(spark, tmp_path, monkeypatch):
    """The last month's forward returns are missing; its SQL has them at the lower bound of the clip."""
    duckdb.sql("""SELECT i AS l_partkey, 50::DOUBLE AS l_quantity, 50::DOUBLE * (1200 + 7 * i + k * k * (i + 3) % 101) AS l_extendedprice, TIMESTAMP '2000-01-01' + INTERVAL 1 DAY * k AS l_shipdate
        FROM range(425) AS days(k), range(6) AS brands(i)""").write_parquet(str(tmp_path / "lineitem.parquet"))
    duckdb.sql("SELECT i AS p_partkey, 'Brand#' || i AS p_brand FROM range(6) AS brands(i)").write_parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(sys.modules[__name__], "DIR", str(tmp_path))
    test_equals_sql(spark, "bucket_mean_returns_masked")
    last = [r for r in QUERIES["bucket_mean_returns_masked"](spark, str(tmp_path)).collect() if str(r.date) == "2001-02-28"]
    assert sum(r.n_obs for r in last) == 6 and {r.mean_ret for r in last if r.n_obs} == {-0.5}


def test_every_sql_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
