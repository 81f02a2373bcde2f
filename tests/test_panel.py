import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import catalog
from strandline.operators import macro, panel, performance, regression

SF = "/root/testdata/sf0.001"
CHECKED = ["perf_stats", "returns", "asof_backward", "factor_vs_reference", "regime_performance", "corr_matrix", "macro_correlations", "block_ranks", "classify_states", "factor_attribution", "vol_target", "concentration", "diversification_ratio"]
CHECKED += ["corr_by_regime", "rolling_beats", "trend_overlay", "sleeve_table", "psr", "yoy", "trend", "flag_share_by_state", "strongest_by_regime", "resample_month_end", "state_card", "empirical_cone", "episode_replay", "portfolio_state_means"]

CHECKED += ["look_through_with_home", "shrink_identity", "vol_target_with_cash", "tbill_gate", "top_drivers", "quality_checks", "align_months", "resample_with_gaps", "hold_forward", "extract_constituents", "extract_weight_pairs"]
CHECKED += ["read_monthly_block", "read_chart_json", "write_table", "factor_prior", "blend_report", "zone_exposure", "scramble_iid"]
#: These need the months of a larger table.
CHECKED_LARGE = ["walk_forward", "rebalance_drift", "sharpe_diff_test", "pbo_cscv", "hac_ols", "outlook_backtest"]


def rows(df):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df), key=str)


@pytest.mark.parametrize(("name", "sf_dir"), [*((n, SF) for n in CHECKED), *((n, "/root/testdata/sf0.01") for n in CHECKED_LARGE)])
def test_query_equals_sql(spark, name, sf_dir):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "part", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalog.queries()[name](spark, sf_dir)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert rows(tuple(r) for r in got.collect()) == rows(want)


def small(spark, values, series="A | Reference"):
    months = [dt.date(2000 + i // 12, i % 12 + 1, 28) for i in range(len(values))]
    df = spark.createDataFrame([(series, m, v) for m, v in zip(months, values, strict=True)], "series string, month date, level double")
    return panel.split_key(df.withColumn("month", F.last_day("month")))


def test_perf_stats_by_hand(spark):
    r = performance.perf_stats(small(spark, [100.0, 110.0, 99.0])).first()
    assert r.months == 2 and math.isclose(r.cagr, 0.99**6 - 1) and math.isclose(r.max_drawdown, -0.1)


def test_unknown_region_and_weights_are_errors(spark):
    p = small(spark, [1.0, 2.0])
    with pytest.raises(ValueError):
        panel.drop_region(p, "Mars")
    wrong = spark.createDataFrame([("x", "A | Reference", 3.4), ("y", "A | Reference", 1.0), ("z", "B | Value", 1.0)], "portfolio string, series string, weight double")
    assert {(r.portfolio, r.problem) for r in panel.validate_weights(wrong, p).collect()} == {("x", "sum"), ("z", "unknown")}
    with pytest.raises(ValueError):
        panel.checked_weights(wrong, p)


def test_norm_cdf_keeps_null(spark):
    got = [r[0] for r in spark.createDataFrame([(None,), (0.0,), (1.959964,), (-1.0,)], "z double").select(macro.norm_cdf(F.col("z"))).collect()]
    assert got[0] is None and abs(got[1] - 0.5) < 2e-7 and abs(got[2] - 0.975) < 2e-7 and abs(got[3] - 0.158655) < 2e-6


def test_overlay_is_invested_until_it_has_a_signal(spark):
    p = panel.returns(small(spark, [100.0 * 1.01**i for i in range(8)] + [60.0, 50.0, 40.0]))
    got = [r.exposure for r in performance.trend_overlay(p, window=4).orderBy("month").collect()]
    assert got[:4] == [1.0] * 4 and got[-1] == 0.0


def test_transition_rows_sum_to_one(spark):
    t = catalog.queries()["transition_matrix"](spark, "/root/testdata/sf0.01").groupBy("from_state").agg(F.sum("p").alias("p"))
    assert all(r.p is None or abs(r.p - 1) < 1e-5 for r in t.collect())


def test_half_split_of_a_flat_series_is_null(spark):
    p = panel.returns(small(spark, [100.0] * 9))
    assert performance.half_split_sharpe(p).first()["first_half"] is None


def test_regression_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(90, 3)), rng.normal(size=90)
    months = [dt.date(1990 + i // 12, i % 12 + 1, 28) for i in range(90)]
    rows = spark.createDataFrame([("a", m, *map(float, r), float(v)) for m, r, v in zip(months, x, y, strict=True)], "series string, month date, x1 double, x2 double, x3 double, y double")
    got = {r.term: r for r in regression.hac_ols(rows, ("series",), "y", ["x1", "x2", "x3"]).collect()}
    z = np.column_stack([np.ones(90), x])
    inverse = np.linalg.inv(z.T @ z)
    b = inverse @ z.T @ y
    g = z * (y - z @ b)[:, None]
    s = g.T @ g
    for j in (1, 2, 3):
        s += (1 - j / 4) * (g[j:].T @ g[:-j] + g[:-j].T @ g[j:])
    se = np.sqrt(np.diag(inverse @ s @ inverse))
    for i, term in enumerate(["alpha", "x1", "x2", "x3"]):
        assert math.isclose(got[term].coef, b[i], rel_tol=1e-9) and math.isclose(got[term].se, se[i], rel_tol=1e-9) and not got[term].singular
    twice = regression.hac_ols(rows.withColumn("x4", F.col("x1") * 2), ("series",), "y", ["x1", "x4"]).collect()
    assert all(r.singular for r in twice)
