"""Queries on growth and inflation states and on overlays, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import AS_OF, _d, _r, panel, query
from .operators import macro as M
from .operators import panel as P
from .operators import performance as A
from .plans import fixtures as X

_COMPONENTS = ", ".join(f"('{a}', '{i}', {s}, {str(p).lower()})" for a, i, s, p in X.COMPONENTS)
#: The normal distribution of the named column, by the formula that the operator uses.
_CDF = """0.5 * (1 + sign({0}) * (1 - (1 / (1 + 0.3275911 * abs({0}) / sqrt(2.0))) * (0.254829592 + (1 / (1 + 0.3275911 * abs({0}) / sqrt(2.0))) * (-0.284496736
  + (1 / (1 + 0.3275911 * abs({0}) / sqrt(2.0))) * (1.421413741 + (1 / (1 + 0.3275911 * abs({0}) / sqrt(2.0))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs({0}) / sqrt(2.0))) * 1.061405429)))) * exp(-{0} * {0} / 2)))"""

_STATES = f""", sm AS (
  SELECT indicator, month, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS smooth FROM ind WHERE month < last_day(DATE '{AS_OF}')
  WINDOW w AS (PARTITION BY indicator ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
td AS (SELECT indicator, month, smooth - lag(smooth, 6) OVER (PARTITION BY indicator ORDER BY month) AS trend FROM sm),
zs AS (SELECT indicator, month, trend / nullif(stddev_samp(trend) OVER (PARTITION BY indicator), 0) AS z FROM td),
sc AS (SELECT axis, month, CASE WHEN max(CASE WHEN prim THEN z END) IS NOT NULL THEN avg(sgn * z) END AS s FROM zs JOIN (VALUES {_COMPONENTS}) c(axis, indicator, sgn, prim) USING (indicator) GROUP BY axis, month),
ss AS (SELECT axis, month, s / nullif(stddev_samp(s) OVER (PARTITION BY axis), 0) AS score FROM sc),
gi AS (SELECT * FROM (SELECT month, max(score) FILTER (WHERE axis = 'growth') AS g, max(score) FILTER (WHERE axis = 'inflation') AS i FROM ss GROUP BY month) WHERE g IS NOT NULL AND i IS NOT NULL),
gp AS (SELECT *, {_CDF.format("g")} AS pg, {_CDF.format("i")} AS pi FROM gi),
st AS (SELECT month, g AS growth_score, i AS inflation_score, pg * (1 - pi) AS p_goldilocks, pg * pi AS p_reflation, (1 - pg) * pi AS p_stagflation, (1 - pg) * (1 - pi) AS p_deflationary_bust,
  g > 0 AS growth_up, i > 0 AS inflation_up, CASE WHEN g > 0 AND i > 0 THEN 'Reflation' WHEN i > 0 THEN 'Stagflation' WHEN g <= 0 THEN 'Deflationary bust' ELSE 'Goldilocks' END AS state FROM gp),
sn AS (SELECT * FROM (VALUES ('Reflation'), ('Stagflation'), ('Deflationary bust'), ('Goldilocks')) n(name)),
mv AS (SELECT state AS f, lead(state) OVER (ORDER BY month) AS t FROM st),
tc AS (SELECT a.name AS from_state, b.name AS to_state, (SELECT count(*) FROM mv WHERE f = a.name AND t = b.name) AS n FROM sn a CROSS JOIN sn b),
tm AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY from_state), 0) AS p FROM tc),
sp AS (SELECT state, series, count(*) AS n, avg(ret) AS mean_ret, pow(1 + avg(ret), 12.0) - 1 AS annualised, stddev_samp(ret) * sqrt(12.0) AS ann_vol
  FROM rt JOIN st USING (month) WHERE ret IS NOT NULL GROUP BY state, series HAVING count(*) >= 3)
"""

_PRIMARY = " ".join(f"JOIN (SELECT sm.month, ind.value, sm.smooth FROM sm JOIN ind USING (indicator, month) WHERE indicator = '{i}') {n} USING (month)" for i, n in (("order_count", "gs"), ("unit_price", "fs")))


def _states(s, d):
    return M.classify_states(P.drop_unfinished(X.indicators(s, d), AS_OF), X.components(s))


@query(f"{_STATES} SELECT {_d('month')}, {_r('growth_score', 'inflation_score', 'p_goldilocks', 'p_reflation', 'p_stagflation', 'p_deflationary_bust', 'gs.value AS growth_value', 'gs.smooth AS growth_smooth', 'fs.value AS inflation_value', 'fs.smooth AS inflation_smooth')}, growth_up, inflation_up, state FROM st {_PRIMARY} WHERE month >= DATE '1998-01-31'", macro=True)
def classify_states(s, d):
    return M.classify_states(P.drop_unfinished(X.indicators(s, d), AS_OF), X.components(s), "1998-01-31")


@query(f"{_STATES} SELECT from_state, to_state, n, {_r('p')} FROM tm", macro=True)
def transition_matrix(s, d):
    return M.transition_matrix(_states(s, d))


@query(f"{_STATES} SELECT state, count(*) AS n, {_r('count(*) / sum(count(*)) OVER () AS share')} FROM st GROUP BY state", macro=True)
def state_frequency(s, d):
    return M.state_frequency(_states(s, d))


@query(
    f"""{_STATES} SELECT state, strftime(min(month), '%Y-%m-%d') AS start, strftime(max(month), '%Y-%m-%d') AS end, count(*) AS months FROM (
  SELECT *, row_number() OVER (ORDER BY month) - row_number() OVER (PARTITION BY state ORDER BY month) AS run FROM st) GROUP BY state, run""",
    macro=True,
)
def state_spells(s, d):
    return M.state_spells(_states(s, d))


@query(f"{_STATES} SELECT state, series, n, {_r('mean_ret', 'annualised', 'ann_vol')} FROM sp", macro=True)
def state_performance(s, d):
    return M.state_performance(panel(s, d), _states(s, d))


@query(
    f"""{_STATES} SELECT state, series, {_r("mean_ret")}, best, worst FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY round(mean_ret, 12) DESC, series) AS best,
  row_number() OVER (PARTITION BY state ORDER BY round(mean_ret, 12), series) AS worst FROM sp) WHERE best <= 3 OR worst <= 3""",
    macro=True,
)
def state_leaders(s, d):
    return M.state_leaders(M.state_performance(panel(s, d), _states(s, d)))


@query(
    f"""{_STATES}, ex AS (SELECT st.state, a.region, a.factor, a.ret - b.ret AS e FROM rt a JOIN rt b ON a.region = b.region AND a.month = b.month AND b.factor = 'Reference' AND a.factor <> 'Reference'
  JOIN st ON st.month = a.month WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL),
  er AS (SELECT state, region, factor, count(*) AS n, avg(e) AS m, avg(CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END) AS h FROM ex GROUP BY ALL HAVING count(*) >= 3)
  SELECT state, factor, CAST(sum(n) AS BIGINT) AS n_obs, {_r("sum(m * n) / sum(n) AS mean_excess", "sum(h * n) / sum(n) AS hit_rate")}, count(*) AS n_regions FROM er GROUP BY state, factor""",
    macro=True,
)
def factor_attribution(s, d):
    return M.factor_attribution(panel(s, d), _states(s, d))


@query(
    f"""{_STATES}, v0 AS (SELECT u.state, u.p FROM (SELECT unnest([struct_pack(state := 'Reflation', p := p_reflation), struct_pack(state := 'Stagflation', p := p_stagflation),
  struct_pack(state := 'Deflationary bust', p := p_deflationary_bust), struct_pack(state := 'Goldilocks', p := p_goldilocks)]) AS u FROM (SELECT * FROM st ORDER BY month DESC LIMIT 1))),
  v1 AS (SELECT to_state AS state, sum(v0.p * coalesce(tm.p, 0)) AS p FROM v0 JOIN tm ON state = from_state GROUP BY to_state),
  v2 AS (SELECT to_state AS state, sum(v1.p * coalesce(tm.p, 0)) AS p FROM v1 JOIN tm ON state = from_state GROUP BY to_state)
  SELECT to_state AS state, {_r("sum(v2.p * coalesce(tm.p, 0)) AS p")} FROM v2 JOIN tm ON state = from_state GROUP BY to_state""",
    macro=True,
)
def outlook(s, d):
    states = _states(s, d)
    return M.outlook(states, M.transition_matrix(states))


@query(
    f"""{_STATES}, vl AS (SELECT month, growth_score, inflation_score, (growth_score - lag(growth_score, 6) OVER (ORDER BY month)) / 6 AS gv, (inflation_score - lag(inflation_score, 6) OVER (ORDER BY month)) / 6 AS iv FROM st)
  SELECT {_d("month")}, {_r("growth_score", "inflation_score", "gv AS growth_velocity", "growth_score + 6 * gv AS growth_ahead", "iv AS inflation_velocity", "inflation_score + 6 * iv AS inflation_ahead")} FROM vl""",
    macro=True,
)
def momentum_signs(s, d):
    return M.momentum_signs(_states(s, d))


@query(f"SELECT regime, series, indicator, {_r('corr(ret, f) AS corr')}, count(*) AS n FROM cf JOIN rt USING (series, ret) JOIN rg ON month BETWEEN s AND e WHERE lag = 0 AND basis = 'chg' GROUP BY ALL HAVING count(*) >= 6", macro=True)
def macro_corr_by_regime(s, d):
    return M.macro_corr_by_regime(panel(s, d), X.indicators(s, d), X.regimes(s))


@query(
    f"""SELECT series, indicator, best_lag, {_r("best", "now")} FROM (SELECT series, indicator, arg_max(lag, round(abs(corr), 12) * 1000 - lag / 1e9) AS best_lag, max(abs(corr)) AS best, max(abs(corr)) FILTER (WHERE lag = 0) AS now
  FROM mc WHERE corr IS NOT NULL AND basis = 'chg' GROUP BY series, indicator) WHERE best - now > 0.10""",
    macro=True,
)
def lead_improvement(s, d):
    return M.lead_improvement(M.macro_correlations(panel(s, d), X.indicators(s, d)))


_EXPOSED = "SELECT series, {d}, {r} FROM ({rows})".replace("{d}", _d("month")).replace(
    "{r}", _r("exposure", "exposure * ret + (1 - exposure) * cash AS managed", "coalesce(abs(exposure - lag(exposure) OVER (PARTITION BY series ORDER BY month)), 0) AS turnover")
)


@query(
    _EXPOSED.format(
        rows="""SELECT *, 0.0 AS cash, CASE WHEN k >= 6 AND vol > 0 THEN least(1.0, 0.10 / vol) ELSE 1.0 END AS exposure FROM (SELECT *, stddev_samp(ret) OVER w * sqrt(12.0) AS vol, count(ret) OVER w AS k
  FROM rt WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))"""
    )
)
def vol_target(s, d):
    return A.vol_target(panel(s, d)).select("series", "month", "exposure", "managed", "turnover")


#: Cash earns a little, and nothing is known of it in two Decembers.
_CASH = f"(SELECT month, CASE WHEN month(month) = 12 AND year(month) IN (1997, 1999) THEN 0.0 ELSE {X.RF} + month(month) / 10000.0 END AS cash FROM (SELECT DISTINCT month FROM rt))"


def _cash(p):
    months = p.select("month").distinct().filter("NOT (month(month) = 12 AND year(month) IN (1997, 1999))")
    return months.select("month", (F.lit(X.RF) + F.month("month") / 10000.0).alias("cash"))


@query(
    _EXPOSED.format(
        rows=f"""SELECT * FROM (SELECT *, CASE WHEN k >= 6 AND vol > 0 THEN least(1.0, 0.12 / vol) ELSE 1.0 END AS exposure FROM (SELECT *, stddev_samp(ret) OVER w * sqrt(12.0) AS vol, count(ret) OVER w AS k
  FROM rt JOIN {_CASH} USING (month) WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))) WHERE month >= DATE '1997-01-31'"""
    )
)
def vol_target_with_cash(s, d):
    p, start = panel(s, d), F.lit("1997-01-31").cast("date")
    own, before = p.filter(F.col("month") >= start), p.filter(F.col("month") < start)
    return A.vol_target(own, 0.12, cash=_cash(p), history=before).select("series", "month", "exposure", "managed", "turnover")


_GATED = """SELECT *, coalesce(lag(sig) OVER (PARTITION BY series ORDER BY month), 1.0) AS exposure FROM (
  SELECT *, CASE WHEN count(*) OVER w = 12 AND t IS NOT NULL THEN CASE WHEN exp(sum(ln(1 + ret)) OVER w) - 1 > t THEN 1.0 ELSE 0.0 END END AS sig FROM rt JOIN {cash} USING (month) WHERE ret IS NOT NULL
  WINDOW w AS (PARTITION BY series ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


@query(_EXPOSED.format(rows=_GATED.format(cash=f"(SELECT *, 0.05 AS t FROM {_CASH})")))
def absolute_momentum(s, d):
    p = panel(s, d)
    return A.trend_overlay(p, "absmom", threshold=0.05, cash=_cash(p)).select("series", "month", "exposure", "managed", "turnover")


@query(_EXPOSED.format(rows=_GATED.format(cash=f"(SELECT *, CASE WHEN count(*) OVER v = 12 THEN exp(sum(ln(1 + cash)) OVER v) - 1 END AS t FROM {_CASH} WINDOW v AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))")))
def tbill_gate(s, d):
    p = panel(s, d)
    return A.tbill_gate(p, _cash(p)).select("series", "month", "exposure", "managed", "turnover")


@query(f"SELECT series, {_r('avg(CASE WHEN p <= n // 2 THEN ret END) / nullif(stddev_samp(CASE WHEN p <= n // 2 THEN ret END), 0) * sqrt(12.0) AS first_half', 'avg(CASE WHEN p > n // 2 THEN ret END) / nullif(stddev_samp(CASE WHEN p > n // 2 THEN ret END), 0) * sqrt(12.0) AS second_half')} FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) AS p, count(*) OVER (PARTITION BY series) AS n FROM rt WHERE ret IS NOT NULL) GROUP BY series")
def half_split_sharpe(s, d):
    return A.half_split_sharpe(panel(s, d))


@query(f"SELECT series, {_r('avg(ret - mkt) * 12 AS active', 'stddev_samp(ret - mkt) * sqrt(12.0) AS tracking_error', 'avg(ret - mkt) * sqrt(12.0) / stddev_samp(ret - mkt) AS information_ratio')} FROM rt JOIN mk USING (month) WHERE ret IS NOT NULL GROUP BY series")
def active_stats(s, d):
    p = panel(s, d)
    return A.active_stats(p, p.filter(F.col("ret").isNotNull()).groupBy("month").agg(F.avg("ret").alias("bench")))


@query(
    f"""SELECT month, {_r("avg(c) AS avg_corr")} FROM (SELECT strftime(month, '%Y-%m-%d') AS month, corr(x, y) OVER w AS c, count(*) OVER w AS k FROM (
  SELECT a.month, a.series AS i, b.series AS j, a.ret AS x, b.ret AS y FROM rt a JOIN rt b ON a.month = b.month AND a.series < b.series AND a.factor = 'Reference' AND b.factor = 'Reference'
  WHERE a.month IN (SELECT month FROM rt WHERE factor = 'Reference' AND ret IS NOT NULL GROUP BY month HAVING count(*) = (SELECT count(DISTINCT series) FROM rt WHERE factor = 'Reference' AND ret IS NOT NULL)))
  WINDOW w AS (PARTITION BY i, j ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)) WHERE k = 36 GROUP BY month"""
)
def rolling_avg_pairwise_corr(s, d):
    return A.rolling_avg_pairwise_corr(panel(s, d))


@query(f"SELECT {_d('month')}, series, {_r('score', '1.0 / count(*) OVER (PARTITION BY month) AS w')} FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, series) AS r FROM (SELECT series, month, CASE WHEN count(ret) OVER w = 12 THEN exp(sum(ln(1 + ret)) OVER w) - 1 END AS score FROM rt WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE score IS NOT NULL) WHERE r <= 6")
def momentum_weights(s, d):
    return A.momentum_weights(panel(s, d))
