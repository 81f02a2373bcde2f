"""Fixed tables, names of estimators, tails of distributions and rank tests against closed forms and table values."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.normal import correlation_p
from strandline.operators import covariance, inference, walkforward
from strandline.sources import files


def test_fixed_tables(spark):
    rows = files.literal_table(spark, "transcribed").collect()
    sums = {}
    for r in rows:
        sums[r.series, r.dim] = sums.get((r.series, r.dim), 0) + r.weight_pct
    assert len(sums) == 6 and all(98 <= v <= 102 for (_, dim), v in sums.items() if dim != "stock") and all(v < 100 for (_, dim), v in sums.items() if dim == "stock")
    assert all(sum(r.series == s and r.dim == "stock" for r in rows) == 10 for s, _ in sums)
    modern, historic = ({r.regime for r in files.literal_table(spark, f"episodes_{u}").collect()} for u in ("modern", "historic"))
    assert "COVID crash" in modern - historic and historic - modern == {"OPEC stagflation", "Volcker squeeze", "Black Monday era"}
    with pytest.raises(ValueError, match="transcribed"):
        files.literal_table(spark, "episodes")


def test_unknown_estimators_are_errors(spark):
    months = [dt.date(2000 + i // 12, i % 12 + 1, 28) for i in range(30)]
    x = np.random.default_rng(1).normal(size=(30, 3))
    rows = spark.createDataFrame([(f"s{j}", m, float(v)) for m, line in zip(months, x, strict=True) for j, v in enumerate(line)], "series string, month date, ret double")
    pairs = covariance.covariance_pairs(rows)
    with pytest.raises(ValueError, match="constant_correlation, identity, sample"):
        covariance.estimate(pairs, "other")
    got = {(r.i, r.j): r for r in covariance.estimate(pairs, "sample").collect()}
    assert all(np.isclose(got[f"s{i}", f"s{j}"].cov, np.cov(x, rowvar=False)[i, j]) for i in range(3) for j in range(3)) and len(got) == 9
    for name in ("constant_correlation", "identity"):
        assert np.isclose(sum(r.cov for r in covariance.estimate(pairs, name).collect() if r.i == r.j), x.var(axis=0).sum())


def test_p_of_a_correlation_is_students(spark):
    def tail(t, df):  # twice the area beyond t, by the trapezium rule on the angle
        z = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, 200_001)
        y = np.cos(z) ** (df - 1)
        return 2 * math.gamma((df + 1) / 2) / math.sqrt(math.pi) / math.gamma(df / 2) * np.trapezoid(y, z)

    cases = [(r, n) for r in (-0.9, -0.3, 0.0, 0.45, 0.7) for n in (3, 4, 5, 6, 7, 12, 31)]
    got = spark.createDataFrame(cases, "r double, n long").select("r", "n", correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert all(math.isclose(x.p, tail(abs(x.r) * math.sqrt((x.n - 2) / (1 - x.r**2)), x.n - 2), rel_tol=1e-5) for x in got)
    edge = spark.createDataFrame([(1.0, 5), (-1.0, 6), (None, 5), (0.5, 2)], "r double, n long").select(correlation_p(F.col("r"), F.col("n"))).collect()
    assert [x[0] for x in edge] == [0.0, 0.0, None, None]


def test_tails_and_range_points():
    for x in (0.5, 3.0, 11.0):
        assert math.isclose(inference._gamma_tail(1.0, x / 2), math.exp(-x / 2), rel_tol=1e-10)  # two degrees of freedom
        assert math.isclose(inference._gamma_tail(0.5, x / 2), math.erfc(math.sqrt(x / 2)), rel_tol=1e-10)  # one
        assert math.isclose(inference._gamma_tail(2.0, x / 2), math.exp(-x / 2) * (1 + x / 2), rel_tol=1e-10)  # four
        assert math.isclose(inference._f_tail(x, 2, 10), (1 + x / 5) ** -5, rel_tol=1e-3)
    for k, q in ((2, 2.772), (3, 3.314), (5, 3.858), (10, 4.474)):  # table values of the range at 5 % and infinite degrees of freedom
        assert abs(inference._range_point(0.95, k) - q) < 2e-3


def test_ranks_of_equal_series_do_not_differ(spark):
    rng = np.random.default_rng(2)
    months = [dt.date(2000 + i // 12, i % 12 + 1, 28) for i in range(120)]
    rows = [(f"s{j}", m, float(rng.normal(0.01 + 0.02 * (j == 0), 0.03))) for m in months for j in range(5)]
    got = inference.friedman_nemenyi(spark.createDataFrame(rows, "series string, month date, ret double").withColumn("month", F.last_day("month"))).collect()
    ranks = {r.series: r.avg_rank for r in got}
    chi = 12 * 10 / 30 * (sum(v * v for v in ranks.values()) - 5 * 36 / 4)
    assert len(got) == 5 and math.isclose(sum(ranks.values()), 15) and all(math.isclose(r.chi2, chi) and math.isclose(r.critical_difference, 3.858 / math.sqrt(2) * math.sqrt(30 / 60), rel_tol=1e-3) for r in got)
    assert all(r.differs_from_best == (r.gap_to_best > r.critical_difference) for r in got) and min(ranks, key=ranks.get) == "s0"


def test_correlations_with_every_region(spark):
    rng = np.random.default_rng(3)
    months = [dt.date(2000 + i // 12, i % 12 + 1, 28) for i in range(24)]
    refs = {g: rng.normal(size=24) for g in ("A", "B", "C")}
    panel = spark.createDataFrame([(g, "Reference", m, float(v)) for g, r in refs.items() for m, v in zip(months, r, strict=True)], "region string, factor string, month date, ret double")
    own = rng.normal(size=24)
    got = {r.region: r for r in walkforward.region_correlations(spark.createDataFrame([("x", m, float(v)) for m, v in zip(months, own, strict=True)], "series string, month date, ret double"), panel).collect()}
    assert set(got) == {"A", "B", "C"} and all(np.isclose(got[g].corr, np.corrcoef(own, refs[g])[0, 1]) and got[g].n == 24 for g in refs)
