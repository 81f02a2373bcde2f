"""More queries on the panel: regimes' correlations, sleeves, overlays, years' changes, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _d, _r, panel, query
from .catalog_exposure import _WEIGHTS, _weights
from .catalog_states import _CDF, _STATES, _states
from .operators import exposure as E
from .operators import macro as M
from .operators import panel as P
from .operators import performance as A
from .plans import fixtures as X

_BY_SERIES = "PARTITION BY series ORDER BY month"


@query(
    f""", g AS (SELECT rg.regime, rt.series, rt.month, rt.ret FROM rt JOIN rg ON month BETWEEN s AND e WHERE ret IS NOT NULL),
  gn AS (SELECT regime, count(DISTINCT series) AS n FROM g GROUP BY regime),
  gm AS (SELECT regime, month FROM g JOIN gn USING (regime) GROUP BY regime, month, n HAVING count(*) = n),
  gc AS (SELECT g.* FROM g JOIN gm USING (regime, month))
  SELECT a.regime, a.series AS i, b.series AS j, {_r("corr(a.ret, b.ret) AS corr")}, count(*) AS n FROM gc a JOIN gc b ON a.regime = b.regime AND a.month = b.month AND a.series < b.series GROUP BY ALL HAVING count(*) >= 4"""
)
def corr_by_regime(s, d):
    return A.corr_by_regime(panel(s, d), X.regimes(s))


@query(
    f"""SELECT series, count(*) AS n_windows, {_r("avg(b) AS beats", "avg(a) AS ahead")} FROM (SELECT series, count(*) OVER w AS k,
  CASE WHEN avg(ret) OVER w / stddev_samp(ret) OVER w > avg(mkt) OVER w / stddev_samp(mkt) OVER w THEN 1.0 ELSE 0.0 END AS b,
  CASE WHEN sum(ln(1 + ret)) OVER w > sum(ln(1 + mkt)) OVER w THEN 1.0 ELSE 0.0 END AS a
  FROM rt JOIN mk USING (month) WHERE ret IS NOT NULL WINDOW w AS ({_BY_SERIES} ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)) WHERE k = 36 GROUP BY series"""
)
def rolling_beats(s, d):
    p = panel(s, d)
    return A.rolling_beats(p, p.filter(F.col("ret").isNotNull()).groupBy("month").agg(F.avg("ret").alias("bench")))


@query(
    f"""SELECT series, {_d("month")}, {_r("exposure", "exposure * ret AS managed")} FROM (SELECT *, coalesce(lag(sig) OVER ({_BY_SERIES}), 1.0) AS exposure FROM (
  SELECT *, CASE WHEN count(*) OVER w = 10 THEN CASE WHEN lvl > avg(lvl) OVER w THEN 1.0 ELSE 0.0 END END AS sig FROM (
  SELECT *, exp(sum(ln(1 + ret)) OVER ({_BY_SERIES})) AS lvl FROM rt WHERE ret IS NOT NULL) WINDOW w AS ({_BY_SERIES} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)))"""
)
def trend_overlay(s, d):
    return A.trend_overlay(panel(s, d)).select("series", "month", "exposure", "managed")


_MOMENTS = "avg(ret) AS m, stddev_pop(ret) AS sd, (avg(ret * ret * ret) - 3 * avg(ret) * avg(ret * ret) + 2 * pow(avg(ret), 3)) / pow(stddev_pop(ret), 3) AS skew, kurtosis_pop(ret) AS exkurt"


@query(
    f"""SELECT series, count(*) AS months, {_r("avg(ret) * 12 AS mean_excess", "stddev_samp(ret) * sqrt(12.0) AS ann_vol", "avg(ret) / stddev_samp(ret) * sqrt(12.0) AS sharpe",
  "avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(12.0) AS sortino", "(avg(ret * ret * ret) - 3 * avg(ret) * avg(ret * ret) + 2 * pow(avg(ret), 3)) / pow(stddev_pop(ret), 3) AS skew",
  "kurtosis_pop(ret) AS exkurt", "min(ret) AS worst_month", "min(dd) AS max_drawdown", "regr_slope(ret, mkt) AS beta")}
  FROM (SELECT *, lvl / max(lvl) OVER ({_BY_SERIES}) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + ret)) OVER ({_BY_SERIES})) AS lvl FROM rt JOIN mk USING (month) WHERE ret IS NOT NULL)) GROUP BY series"""
)
def sleeve_table(s, d):
    p = panel(s, d)
    return A.sleeve_table(p, p.filter(F.col("ret").isNotNull()).groupBy("month").agg(F.avg("ret").alias("mkt")))


@query(
    f"""SELECT series, months, {_r("sr", f"CASE WHEN z IS NOT NULL THEN {_CDF.format('z')} END AS psr")} FROM (SELECT *, CASE WHEN months >= 3 AND den > 0 THEN sr * sqrt(months - 1) / sqrt(den) END AS z FROM (
  SELECT series, months, m / sd AS sr, 1 - skew * m / sd + (exkurt + 2) / 4 * m / sd * m / sd AS den FROM (SELECT series, count(*) AS months, {_MOMENTS} FROM rt WHERE ret IS NOT NULL GROUP BY series)))"""
)
def psr(s, d):
    return A.psr(panel(s, d))


@query(f"SELECT indicator, {_d('month')}, {_r('value', '(value / nullif(lag(value, 12) OVER (PARTITION BY indicator ORDER BY month), 0) - 1) * 100 AS yoy')} FROM ind", macro=True)
def yoy(s, d):
    return P.yoy(X.indicators(s, d))


@query(f"{_STATES} SELECT indicator, {_d('month')}, {_r('smooth', 'trend')} FROM (SELECT td.*, sm.smooth FROM td JOIN sm USING (indicator, month))", macro=True)
def trend(s, d):
    from .catalog import AS_OF

    return M.trend(P.drop_unfinished(X.indicators(s, d), AS_OF)).select("indicator", "month", "smooth", "trend")


@query(
    f"""{_STATES}, fl AS (SELECT month, t < lag(t, 12) OVER (ORDER BY month) AS flag FROM (SELECT month, sum(CAST(level AS DECIMAL(28,4))) AS t FROM rt GROUP BY month))
  SELECT state, {_r("avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END) AS share")}, count(*) AS n FROM st JOIN fl USING (month) WHERE flag IS NOT NULL GROUP BY state""",
    macro=True,
)
def flag_share_by_state(s, d):
    total = panel(s, d).groupBy("month").agg(F.sum(F.col("level").cast("decimal(28,4)")).cast("double").alias("value"))
    flags = P.yoy(total.withColumn("indicator", F.lit("total"))).select("month", (F.col("yoy") < 0).alias("flag")).filter(F.col("flag").isNotNull())
    return M.flag_share_by_state(_states(s, d), flags)


@query(
    f"""SELECT regime, series, indicator, {_r("corr")}, n FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY round(abs(corr), 9) DESC, series, indicator) AS p FROM (
  SELECT regime, series, indicator, corr(ret, f) AS corr, count(*) AS n FROM cf JOIN rt USING (series, ret) JOIN rg ON month BETWEEN s AND e WHERE lag = 0 AND basis = 'chg' GROUP BY ALL HAVING count(*) >= 6) WHERE corr IS NOT NULL) WHERE p = 1""",
    macro=True,
)
def strongest_by_regime(s, d):
    return M.strongest_by_regime(M.macro_corr_by_regime(panel(s, d), X.indicators(s, d), X.regimes(s)))


@query(
    f"""SELECT event_type, {_d("month")}, {_r("value")} FROM (SELECT event_type, last_day(CAST(ts AS DATE)) AS month, arg_max(value, struct_pack(ts := ts, value := value)) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL)"""
)
def resample_month_end(s, d):
    """The events cover whole months without a gap, so the calendar adds no rows."""
    return P.resample_month_end(X.table(s, d, "events"), "event_type", "ts", "value")


@query(
    f"""{_STATES}, lt AS (SELECT * FROM st ORDER BY month DESC LIMIT 1), pb AS (SELECT month, lag(state, 6) OVER (ORDER BY month) AS prior_state FROM st),
  nx AS (SELECT tm.* FROM tm JOIN lt ON from_state = lt.state)
  SELECT strftime(lt.month, '%Y-%m-%d') AS as_of, lt.state, {_r("growth_score", "inflation_score")}, prior_state,
  (SELECT count(*) FROM st WHERE month > coalesce((SELECT max(month) FROM st WHERE state <> (SELECT state FROM lt)), DATE '1900-01-01')) AS months_in_state,
  {_r("(SELECT p FROM nx WHERE to_state = from_state) AS stay_prob", "(SELECT CASE WHEN p < 1 THEN 1 / (1 - p) ELSE p / 0.0 END FROM nx WHERE to_state = from_state) AS expected_duration")},
  (SELECT to_state FROM nx WHERE to_state <> from_state AND n > 0 ORDER BY n DESC, CASE to_state WHEN 'Reflation' THEN 0 WHEN 'Stagflation' THEN 1 WHEN 'Deflationary bust' THEN 2 ELSE 3 END LIMIT 1) AS likely_next
  FROM lt JOIN pb USING (month)""",
    macro=True,
)
def state_card(s, d):
    states = _states(s, d)
    return M.state_card(states, M.transition_matrix(states))


@query(
    f"""{_STATES}, mo AS (SELECT state, lead(growth_score, 3) OVER (ORDER BY month) - growth_score AS dg, lead(inflation_score, 3) OVER (ORDER BY month) - inflation_score AS di FROM st)
  SELECT state, count(*) AS n, {_r(*(f"quantile_cont({c}, {p / 100}) AS {axis}_p{p}" for axis, c in (("growth", "dg"), ("inflation", "di")) for p in (10, 25, 75, 90)))}
  FROM mo WHERE dg IS NOT NULL GROUP BY state HAVING count(*) >= 15""",
    macro=True,
)
def empirical_cone(s, d):
    return M.empirical_cone(_states(s, d))


@query(
    f"""{_WEIGHTS}, pm AS (SELECT portfolio, month, sum(weight * ret) AS ret FROM wt JOIN rt USING (series) WHERE ret IS NOT NULL GROUP BY portfolio, month HAVING count(*) = 2),
  ep AS (SELECT regime, s, portfolio, month, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY regime, portfolio ORDER BY month)) AS lvl FROM pm JOIN rg ON month BETWEEN s AND e),
  ed AS (SELECT *, lvl / max(lvl) OVER (PARTITION BY regime, portfolio ORDER BY month) - 1 AS dd FROM ep)
  SELECT regime AS episode, portfolio, count(*) AS n_months, {_r("arg_max(lvl, month) - 1 AS cum_return", "min(dd) AS max_drawdown", "min(ret) AS worst_month")} FROM ed GROUP BY regime, s, portfolio
  HAVING count(*) >= 2 AND min(month) <= last_day(s + to_months(CASE WHEN s = last_day(s) THEN 2 ELSE 1 END))"""
)
def episode_replay(s, d):
    return E.episode_replay(E.portfolio_returns(_weights(s, d), panel(s, d)), X.regimes(s))


@query(f"{_WEIGHTS}{_STATES} SELECT portfolio, state, {_r('sum(weight * mean_ret) AS mean_ret')}, sum(weight * mean_ret) = min(sum(weight * mean_ret)) OVER (PARTITION BY portfolio) AS is_worst FROM wt JOIN sp USING (series) GROUP BY portfolio, state HAVING count(*) = 2", macro=True)
def portfolio_state_means(s, d):
    return E.portfolio_state_means(_weights(s, d), M.state_performance(panel(s, d), _states(s, d)))
