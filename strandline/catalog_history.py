"""Queries on long history, priors and blends, ratios and exposures to zones, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _d, _r, panel, query
from .catalog_exposure import _COV, _EXPOSURE, _WEIGHTS, _covariance, _weights
from .catalog_states import _STATES, _states
from .operators import exposure as E
from .operators import history as H
from .operators import macro as M
from .operators import panel as P
from .operators import performance as A
from .plans import fixtures as X

#: The modern sample, and fewer months than the defaults ask for, as the panel has eighty.
_SINCE, _LONG, _MODERN = "1998-07-31", 8, 3
_LEAST = {"least_long": _LONG, "least_modern": _MODERN}
_COUNTERPART = {"AUTOMOBILE": "mom", "MACHINERY": "hml"}

_LF = f"{X.FACTORS_SQL}, lf AS (UNPIVOT (SELECT month, mkt_rf, hml, mom FROM fc) ON mkt_rf, hml, mom INTO NAME factor VALUE value)"
_BASE = f"{_STATES}{_LF}"


def _factors(s, d):
    return H.long_factors(X.research_factors(panel(s, d)), ["mkt_rf", "hml", "mom"])


def _modern(s, d):
    """The panel from the modern sample on, so that the factors' history is longer."""
    return panel(s, d).filter(F.col("month") >= F.lit(_SINCE).cast("date"))


_ERA = f"""le AS (SELECT sample, state, factor, count(*) AS n, avg(value) AS mean, pow(1 + avg(value), 12.0) - 1 AS ann_return, stddev_samp(value) * sqrt(12.0) AS ann_vol, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate
  FROM (SELECT 'long' AS sample, * FROM lf JOIN st USING (month) UNION ALL SELECT 'modern', * FROM lf JOIN st USING (month) WHERE month >= DATE '{_SINCE}') GROUP BY ALL HAVING count(*) >= 6)"""


@query(f"{_BASE}, {_ERA} SELECT sample, state, factor, n, {_r('mean', 'ann_return', 'ann_vol', 'hit_rate')} FROM le", macro=True)
def long_vs_modern(s, d):
    return H.long_vs_modern(_factors(s, d), _states(s, d), _SINCE)


@query(
    f"""{_BASE}, {_ERA} SELECT state, factor, {_r("l AS long", "m AS modern")}, coalesce(sign(l) = sign(m), false) AS signs_agree FROM (
  SELECT state, factor, max(mean) FILTER (WHERE sample = 'long') AS l, max(mean) FILTER (WHERE sample = 'modern') AS m FROM le GROUP BY state, factor)""",
    macro=True,
)
def sign_agreement(s, d):
    return H.sign_agreement(H.long_vs_modern(_factors(s, d), _states(s, d), _SINCE))


_MAP = ", ".join(f"('{a}', '{b}')" for a, b in _COUNTERPART.items())
_PRIORS = f"""
md AS (SELECT * FROM rt WHERE month >= DATE '{_SINCE}' AND ret IS NOT NULL),
ed AS (SELECT min(month) AS a, max(month) AS b FROM md),
er AS (SELECT nm, state, avg(value) AS long_mean, count(*) AS n_long, sign(avg(value)) = sign(avg(value) FILTER (WHERE month >= a)) AS agree FROM (
  SELECT factor AS nm, month, value FROM lf UNION ALL SELECT 'mkt', month, mkt_rf + rf FROM fc) JOIN st USING (month), ed WHERE month <= b GROUP BY ALL HAVING count(*) >= {_LONG} AND count(*) FILTER (WHERE month >= a) >= {_MODERN}),
ep AS (SELECT factor, month, avg(x.ret - y.ret) AS e FROM md x JOIN (SELECT region, month, ret FROM md WHERE factor = 'Reference') y USING (region, month) WHERE factor <> 'Reference' GROUP BY factor, month),
fp AS (SELECT factor, state, beta, beta * long_mean AS long_diff, n_long, agree FROM (
  SELECT ep.factor, nm, regr_slope(e, value) AS beta FROM ep JOIN (VALUES {_MAP}) c(factor, nm) ON c.factor = ep.factor JOIN lf ON lf.factor = nm AND lf.month = ep.month GROUP BY ALL HAVING count(*) >= 36) JOIN er USING (nm)),
mp AS (SELECT region, state, beta, beta * long_mean AS long_mean, n_long, agree FROM (
  SELECT region, regr_slope(ret, mkt_rf + rf) AS beta FROM md JOIN fc USING (month) WHERE factor = 'Reference' GROUP BY region HAVING count(*) >= 36), er WHERE nm = 'mkt')"""


@query(f"{_BASE}, {_PRIORS} SELECT factor, state, {_r('beta', 'long_diff')}, n_long, agree FROM fp", macro=True)
def factor_prior(s, d):
    return H.factor_prior(_modern(s, d), _factors(s, d), _states(s, d), _COUNTERPART, **_LEAST)


@query(f"{_BASE}, {_PRIORS} SELECT region, state, {_r('beta', 'long_mean')}, n_long, agree FROM mp", macro=True)
def market_prior(s, d):
    return H.market_prior(_modern(s, d), _market(s, d), _states(s, d), **_LEAST)


def _market(s, d):
    return X.research_factors(panel(s, d)).select("month", (F.col("mkt_rf") + F.col("rf")).alias("mkt"))


#: Proxies: changes of two indicators as returns, one of them called cash.
_PROXIES = """
px AS (SELECT * FROM (SELECT CASE indicator WHEN 'unit_price' THEN 'Asset | Gold' ELSE 'Asset | Cash (T-bill)' END AS series, month, value / lag(value) OVER (PARTITION BY indicator ORDER BY month) - 1 AS ret FROM ind
  WHERE indicator IN ('unit_price', 'avg_total') AND month < DATE '2001-11-30') WHERE ret IS NOT NULL),
op AS (SELECT series, state, avg(ret) AS long_mean, count(*) AS n_long, sign(avg(ret)) = sign(avg(ret) FILTER (WHERE month >= a)) AS agree FROM px JOIN st USING (month), ed WHERE month <= b AND series NOT LIKE '%Cash%'
  GROUP BY ALL HAVING count(*) >= {} AND count(*) FILTER (WHERE month >= a) >= {})""".format(_LONG, _MODERN)


def _proxies(s, d):
    name = F.when(F.col("indicator") == "unit_price", "Asset | Gold").otherwise("Asset | Cash (T-bill)")
    rows = X.indicators(s, d).filter("indicator IN ('unit_price', 'avg_total') AND month < '2001-11-30'")
    return P.split_key(P.returns(rows.select(name.alias("series"), "month", F.col("value").alias("level"))))


@query(f"{_BASE}, {_PRIORS}, {_PROXIES} SELECT series, state, {_r('long_mean')}, n_long, agree FROM op", macro=True)
def own_prior(s, d):
    return H.own_prior(_proxies(s, d), _modern(s, d), _states(s, d), **_LEAST)


_MEANS = "ms AS (SELECT state, series, avg(ret) AS m, count(*) AS n FROM (SELECT series, month, ret FROM md UNION ALL SELECT series, month, ret FROM px WHERE month IN (SELECT month FROM md)) JOIN st USING (month) GROUP BY ALL HAVING count(*) >= 3)"


def _means(s, d):
    p = _modern(s, d)
    own = P.append_proxies(p.select("series", "month", "ret"), _proxies(s, d).select("series", "month", "ret"))
    return H.state_means(own, _states(s, d))


@query(f"{_STATES} SELECT state, series, {_r('avg(ret) AS mean_ret')}, count(*) AS n FROM rt JOIN st USING (month) WHERE ret IS NOT NULL AND month BETWEEN DATE '1998-01-31' AND DATE '2000-12-31' GROUP BY ALL HAVING count(*) >= 3", macro=True)
def state_means(s, d):
    return H.state_means(panel(s, d), _states(s, d), 3, "1998-01-31", "2000-12-31")


_CELLS = "mc2 AS (SELECT *, split_part(series, ' | ', 1) AS region, split_part(series, ' | ', 2) AS factor FROM ms)"
_BLEND = f"""{_MEANS}, {_CELLS},
rf2 AS (SELECT c.region, c.state, c.m AS ref, CASE WHEN p.agree THEN (c.n * c.m + p.n_long * p.long_mean) / (c.n + p.n_long) ELSE c.m END AS anc FROM mc2 c LEFT JOIN mp p USING (region, state) WHERE c.factor = 'Reference'),
bl AS (SELECT c.state, c.series, c.n,
  CASE WHEN c.region = 'Asset' THEN op.n_long WHEN c.factor = 'Reference' THEN mp.n_long ELSE fp.n_long END AS n_long,
  coalesce(CASE WHEN c.region = 'Asset' THEN op.agree WHEN c.factor = 'Reference' THEN mp.agree ELSE fp.agree AND ref IS NOT NULL END, false) AS gate,
  CASE WHEN c.region <> 'Asset' AND c.factor <> 'Reference' AND ref IS NOT NULL THEN m - ref ELSE m END AS modern,
  CASE WHEN c.region = 'Asset' THEN op.long_mean WHEN c.factor = 'Reference' THEN mp.long_mean ELSE fp.long_diff END AS mapped_long,
  CASE WHEN c.region <> 'Asset' AND c.factor <> 'Reference' THEN coalesce(anc, 0) ELSE 0 END AS base
  FROM mc2 c LEFT JOIN rf2 ON rf2.region = c.region AND rf2.state = c.state LEFT JOIN fp ON fp.factor = c.factor AND fp.state = c.state LEFT JOIN mp ON mp.region = c.region AND mp.state = c.state LEFT JOIN op ON op.series = c.series AND op.state = c.state),
bf AS (SELECT *, CASE WHEN gate THEN n_long / (n + n_long) ELSE 0 END AS weight_on_long, base + CASE WHEN gate THEN (n * modern + n_long * mapped_long) / (n + n_long) ELSE modern END AS fin FROM bl)"""


def _blend(s, d, f):
    p, states = _modern(s, d), _states(s, d)
    factors = H.factor_prior(p, _factors(s, d), states, _COUNTERPART, **_LEAST)
    return f(_means(s, d), factors, H.own_prior(_proxies(s, d), p, states, **_LEAST), H.market_prior(p, _market(s, d), states, **_LEAST))


@query(f"{_BASE}, {_PRIORS}, {_PROXIES}, {_BLEND} SELECT state, series, n, n_long, gate, {_r('modern', 'mapped_long', 'weight_on_long', 'fin AS final')} FROM bf", macro=True)
def blend_report(s, d):
    return _blend(s, d, H.blend_report)


@query(f"{_BASE}, {_PRIORS}, {_PROXIES}, {_BLEND} SELECT state, series, {_r('fin AS mean_ret')}, n FROM bf", macro=True)
def blend_means(s, d):
    return _blend(s, d, H.blend_means)


_VIEWS = """ol AS (SELECT state, p FROM (VALUES ('Reflation', 0.4), ('Stagflation', 0.3), ('Deflationary bust', 0.2), ('Goldilocks', 0.1)) v(state, p)),
ve AS (SELECT a.state, a.factor, avg(a.m - b.m) AS d, max(a.n) AS n FROM mc2 a JOIN mc2 b ON a.state = b.state AND a.region = b.region AND b.factor = 'Reference' AND a.factor <> 'Reference' GROUP BY ALL)"""


@query(
    f"""{_BASE}, {_PRIORS}, {_PROXIES}, {_MEANS}, {_CELLS}, {_VIEWS} SELECT factor, {_r("sum(p * CASE WHEN agree THEN (n * d + n_long * long_diff) / (n + n_long) ELSE d END) / sum(p) AS q", "0.4 AS confidence")},
  count(*) FILTER (WHERE agree) AS anchored_states FROM ve JOIN ol USING (state) LEFT JOIN fp USING (factor, state) GROUP BY factor""",
    macro=True,
)
def rule_views(s, d):
    outlook = s.createDataFrame([("Reflation", 0.4), ("Stagflation", 0.3), ("Deflationary bust", 0.2), ("Goldilocks", 0.1)], "state string, p double")
    prior = H.factor_prior(_modern(s, d), _factors(s, d), _states(s, d), _COUNTERPART, **_LEAST)
    return H.rule_views(_means(s, d), outlook, prior)


@query(
    f"""SELECT factor, series, {_r("sum(x) AS loading")} FROM (SELECT a.factor, a.series, 1.0 / count(*) OVER (PARTITION BY a.factor) AS x FROM (SELECT DISTINCT series, region, factor FROM rt) a WHERE factor <> 'Reference' AND region <> 'ASIA'
  UNION ALL SELECT a.factor, a.region || ' | Reference', -1.0 / count(*) OVER (PARTITION BY a.factor) FROM (SELECT DISTINCT series, region, factor FROM rt) a WHERE factor <> 'Reference' AND region <> 'ASIA') GROUP BY ALL"""
)
def view_loadings(s, d):
    return H.view_loadings(panel(s, d).filter("region <> 'ASIA' OR factor <> 'Reference'").select("series"))


@query(
    f"""{_LF} SELECT factor, count(*) AS months, {_r("avg(value) * 12 AS mean_ann", "stddev_samp(value) * sqrt(12.0) AS ann_vol", "avg(value) / stddev_samp(value) * sqrt(count(*)) AS t_mean",
  "(avg(pow(value, 3)) - 3 * avg(value) * avg(value * value) + 2 * pow(avg(value), 3)) / pow(stddev_pop(value), 3) AS skew", "kurtosis_pop(value) AS exkurt", "min(value) AS worst_month")} FROM lf GROUP BY factor"""
)
def factor_table(s, d):
    return A.factor_table(_factors(s, d))


_EXCESS = "SELECT series, ret - rf AS e, mkt_rf FROM rt JOIN fc USING (month) WHERE ret IS NOT NULL"


@query(
    f"""{X.FACTORS_SQL} SELECT series, months, {_r("mean_excess", "sharpe", "downside_dev", "beta", "cer_1", "cer_3", "cer_5", "cer_10", "mean_excess / nullif(downside_dev, 0) AS sortino", "CASE WHEN beta > 0 THEN mean_excess / beta END AS treynor")} FROM (
  SELECT series, count(*) AS months, avg(e) * 12 AS mean_excess, avg(e) / stddev_samp(e) * sqrt(12.0) AS sharpe, sqrt(avg(pow(least(e, 0), 2))) * sqrt(12.0) AS downside_dev, covar_samp(e, mkt_rf) / var_samp(mkt_rf) AS beta,
  {", ".join(f"(avg(e) - {g} / 2.0 * var_samp(e)) * 12 AS cer_{g}" for g in (1, 3, 5, 10))} FROM ({_EXCESS}) GROUP BY series)"""
)
def ratios(s, d):
    return A.ratios(panel(s, d), X.research_factors(panel(s, d)))


@query(
    f"""SELECT regime AS span, series, count(*) AS months, {_r("CASE WHEN count(*) >= 12 THEN avg(ret - 0.002) / stddev_samp(ret - 0.002) * sqrt(12.0) END AS sharpe", "CASE WHEN count(*) >= 15 THEN exp(sum(ln(1 + ret))) - 1 END AS cum_return")}
  FROM rt JOIN rg ON month BETWEEN s AND e WHERE ret IS NOT NULL GROUP BY regime, series"""
)
def subperiods(s, d):
    return A.subperiods(panel(s, d), X.regimes(s), X.RF)


@query(
    f""", gr AS (SELECT sample, region, factor, exp(sum(ln(1 + ret)) * 12 / count(*)) - 1 AS g FROM (SELECT 'full' AS sample, * FROM rt UNION ALL SELECT 'since', * FROM rt WHERE month >= DATE '1999-01-31') WHERE ret IS NOT NULL GROUP BY ALL)
  SELECT sample, a.factor, {_r("avg(a.g - b.g) AS mean_gap")}, count(*) FILTER (WHERE a.g > b.g) AS wins, count(*) AS n_regions, {_r("max(spread) AS spread")} FROM gr a JOIN (SELECT sample, region, g FROM gr WHERE factor = 'Reference') b USING (sample, region)
  JOIN (SELECT sample, max(g) - min(g) AS spread FROM gr GROUP BY sample) USING (sample) WHERE a.factor <> 'Reference' GROUP BY sample, a.factor"""
)
def menu_facts(s, d):
    return A.menu_facts(panel(s, d), "1999-01-31")


@query(
    f"""SELECT count(*) AS n_regions, {_r("avg(raw) AS raw", "avg(x) AS excess")} FROM (SELECT region, corr(a, b) AS raw, corr(a - r, b - r) AS x FROM (SELECT region, month, max(ret) FILTER (WHERE factor = 'MACHINERY') AS a,
  max(ret) FILTER (WHERE factor = 'AUTOMOBILE') AS b, max(ret) FILTER (WHERE factor = 'Reference') AS r FROM rt GROUP BY region, month) WHERE a IS NOT NULL AND b IS NOT NULL AND r IS NOT NULL GROUP BY region)"""
)
def factor_pair_corr(s, d):
    return A.factor_pair_corr(panel(s, d), "MACHINERY", "AUTOMOBILE")


@query(
    f"""SELECT 'premium' AS series, {_d("month")}, {_r("avg(e) AS ret")} FROM (SELECT region, month, avg(a.ret) - max(b.ret) - 0.0015 / 12 AS e FROM (SELECT * FROM rt WHERE factor <> 'Reference' AND ret IS NOT NULL) a
  JOIN (SELECT region, month, ret FROM rt WHERE factor = 'Reference' AND ret IS NOT NULL) b USING (region, month) GROUP BY region, month) GROUP BY month"""
)
def region_neutral_premium(s, d):
    return A.region_neutral_premium(panel(s, d), 0.0015)


_ZONES = [("North", "NATION_0"), ("North", "NATION_1"), ("South", "NATION_2"), ("South", "NATION_3"), ("South", "NATION_4")]


@query(
    f"""{_EXPOSURE}, cs AS (SELECT series AS sheet, category, weight_pct FROM lt WHERE dim = 'country' AND series <> 'ASIA | MACHINERY'), zn AS (SELECT * FROM (VALUES {", ".join(map(str, _ZONES))}) z(zone, category))
  SELECT portfolio, coalesce(zone, 'Rest of world') AS zone, {_r("sum(weight * weight_pct) / 100 AS share")} FROM wt JOIN cs ON sheet = CASE WHEN series = 'ASIA | MACHINERY' THEN 'ASIA | Reference' ELSE series END LEFT JOIN zn USING (category) GROUP BY ALL"""
)
def zone_exposure(s, d):
    """One series has no sheet and borrows its region's."""
    lookup = X.look_through(s, d).filter("series <> 'ASIA | MACHINERY'")
    held = _weights(s, d).unionAll(s.createDataFrame([("one region", "Asset | Gold", 0.1)], "portfolio string, series string, weight double"))
    return E.zone_exposure(held, lookup, s.createDataFrame(_ZONES, "zone string, country string"))


@query(f"{_WEIGHTS} SELECT portfolio, split_part(series, ' | ', 2) AS bucket, {_r('sum(weight) AS share')} FROM wt WHERE series IN (SELECT series FROM rt) GROUP BY ALL")
def bucket_exposure(s, d):
    return E.bucket_exposure(_weights(s, d).join(panel(s, d).select("series").distinct(), "series", "left_semi"))


_SPEC = [("equal", "equity_equal", 1.0), ("mixed", "equity_equal", 0.6), ("mixed", "AMERICA | Reference", 0.4), ("broken", "equity_equal", 0.5), ("broken", "Asset | Gold", 0.5)]


@query(
    f"""SELECT portfolio, series, {_r("sum(w) AS weight")} FROM (SELECT portfolio, series, CASE portfolio WHEN 'equal' THEN 1.0 ELSE 0.6 END / count(*) OVER (PARTITION BY portfolio) AS w FROM (SELECT DISTINCT series FROM rt WHERE region = 'ASIA'), (VALUES ('equal'), ('mixed')) v(portfolio)
  UNION ALL SELECT DISTINCT 'mixed', series, 0.4 FROM rt WHERE series = 'AMERICA | Reference') GROUP BY portfolio, series"""
)
def archetype_weights(s, d):
    return E.archetype_weights(s.createDataFrame(_SPEC, "portfolio string, key string, weight double"), panel(s, d).select("series"), "ASIA | ")


@query(
    f"""{_COV}, sg AS (SELECT portfolio, sqrt(sum(part)) AS sigma FROM pc GROUP BY portfolio), gw AS (SELECT portfolio, sum(abs(weight) * sqrt(cov)) AS g, count(*) FILTER (WHERE weight > 0.01) AS n_holdings FROM wt JOIN sk ON series = i AND i = j GROUP BY portfolio),
  pm AS (SELECT portfolio, month, sum(weight * ret) AS ret FROM wt JOIN rt USING (series) WHERE ret IS NOT NULL GROUP BY portfolio, month HAVING count(*) = 2),
  pl AS (SELECT *, 100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio ORDER BY month)) AS level FROM pm),
  pp AS (SELECT portfolio, last_day(min(month) - INTERVAL 1 MONTH) AS month, 100.0 AS level FROM pl GROUP BY portfolio UNION ALL SELECT portfolio, month, level FROM pl),
  pd AS (SELECT *, level / lag(level) OVER w - 1 AS ret, level / max(level) OVER w - 1 AS dd FROM pp WINDOW w AS (PARTITION BY portfolio ORDER BY month))
  SELECT portfolio, count(ret) AS months, {_r("pow(arg_max(level, month) / arg_min(level, month), 12.0 / count(ret)) - 1 AS cagr", "stddev_samp(ret) * sqrt(12.0) AS ann_vol", "avg(ret) * 12 / (stddev_samp(ret) * sqrt(12.0)) AS sharpe", "min(dd) AS max_drawdown")},
  max(n_holdings) AS n_holdings, {_r("max((g / sigma) * (g / sigma)) AS dr2")} FROM pd JOIN sg USING (portfolio) JOIN gw USING (portfolio) GROUP BY portfolio"""
)
def benchmark_table(s, d):
    from .operators.walkforward import levels_of

    weights = _weights(s, d)
    stats = A.perf_stats(levels_of(E.portfolio_returns(weights, panel(s, d)).withColumnRenamed("portfolio", "series")))
    return E.benchmark_table(stats.drop("start", "end"), weights, E.diversification_ratio(weights, _covariance(s, d)))


@query(f"{_STATES} SELECT {_d('month')}, state FROM st WHERE month >= DATE '2000-01-31'", macro=True)
def classify_states_from(s, d):
    return M.classify_states(P.drop_unfinished(X.indicators(s, d), "2001-11-30"), X.components(s), "2000-01-31").select("month", "state")
