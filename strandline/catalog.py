"""Queries over the driver's tables and the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import macro as M
from .operators import panel as P
from .operators import performance as A
from .plans import fixtures as X
from .plans.scratch import settled

AS_OF = "2001-11-30"

_LEVELS = """
lv AS (
  SELECT r_name || ' | ' || f AS series, r_name AS region, f AS factor, month, CAST(max(d) AS DATE) AS date, CAST(sum(amount) AS DOUBLE) AS level
  FROM (SELECT r_name, n_name, l_partkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Reference' ELSE c_mktsegment END AS f, CAST(l_shipdate AS DATE) AS d,
               last_day(CAST(l_shipdate AS DATE)) AS month, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  GROUP BY r_name, f, month),
fin AS (SELECT * FROM lv WHERE month < DATE '2001-11-30'),
rt AS (SELECT *, level / lag(level) OVER (PARTITION BY series ORDER BY month) - 1 AS ret FROM fin),
ns AS (SELECT count(DISTINCT series) AS n FROM rt WHERE ret IS NOT NULL),
cm AS (SELECT month FROM rt WHERE ret IS NOT NULL GROUP BY month HAVING count(*) = (SELECT n FROM ns)),
rc AS (SELECT * FROM rt WHERE ret IS NOT NULL AND month IN (SELECT month FROM cm)),
pr AS (SELECT a.month, a.series AS i, b.series AS j, a.ret AS x, b.ret AS y FROM rc a JOIN rc b ON a.month = b.month AND a.series < b.series),
rg AS (SELECT * FROM (VALUES {regimes}) t(regime, s, e)),
mk AS (SELECT month, avg(ret) AS mkt FROM rt WHERE ret IS NOT NULL GROUP BY month)
""".format(regimes=", ".join(f"('{r}', DATE '{s}', DATE '{e}')" for r, s, e in X.REGIMES))  # fmt: skip

_MACRO = """
ind AS (
  SELECT indicator, month, value FROM (
    SELECT last_day(CAST(o_orderdate AS DATE)) AS month, CAST(count(*) AS DOUBLE) AS order_count,
           CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) / count(*) AS urgent_share,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_total FROM orders GROUP BY 1)
  UNPIVOT (value FOR indicator IN (order_count, urgent_share, avg_total))
  UNION ALL
  SELECT indicator, month, value FROM (
    SELECT last_day(CAST(l_shipdate AS DATE)) AS month,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS unit_price,
           CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_discount,
           CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) AS return_share FROM lineitem GROUP BY 1)
  UNPIVOT (value FOR indicator IN (unit_price, avg_discount, return_share))),
ft AS (
  SELECT indicator, month, 'level' AS basis, value AS f FROM ind
  UNION ALL SELECT * FROM (SELECT indicator, month, 'chg', value - lag(value) OVER (PARTITION BY indicator ORDER BY month) AS f FROM ind) WHERE f IS NOT NULL),
cf AS (
  SELECT r.series, r.ret, f.indicator, f.basis, g.lag, f.f FROM ft f CROSS JOIN (VALUES (0), (1), (3), (6), (12)) g(lag)
  JOIN rt r ON r.ret IS NOT NULL AND r.month = last_day(f.month + to_months(g.lag))),
mc AS (
  SELECT series, indicator, basis, lag, CASE WHEN count(*) >= 36 THEN corr(ret, f) END AS corr, count(*) AS n, count(*) < 36 AS insufficient FROM cf GROUP BY ALL)
"""

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None, macro: bool = False, name: str = ""):
    """Register a query with the SQL of its rows; the SQL may use the panel's (and indicators') tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        _FOUND[name or f.__name__] = (lambda s, d: _rounded(f(s, d)), None if sql is None else f"WITH {_LEVELS}{',' + _MACRO if macro else ''} {sql}")
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits and dates as text, as the SQL has them."""
    kinds = {"double": lambda c: F.round(c, 6) + F.lit(0.0), "date": lambda c: F.date_format(c, "yyyy-MM-dd")}
    return df.select(*(kinds[k](F.col(c)).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes))


def _r(*names: str) -> str:
    """SQL for expressions of the form "expr AS name", rounded to six digits."""
    return ", ".join("round({}, 6) + 0.0 AS {}".format(*n.rsplit(" AS ", 1)) if " AS " in n else f"round({n}, 6) + 0.0 AS {n}" for n in names)


def _d(*names: str) -> str:
    return ", ".join(f"strftime({n}, '%Y-%m-%d') AS {n}" for n in names)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.returns(P.drop_unfinished(X.levels(spark, sf_dir), AS_OF))


@query(f"""SELECT series, count(ret) AS months, strftime(min(month), '%Y-%m-%d') AS start, strftime(max(month), '%Y-%m-%d') AS end,
  {_r("pow(arg_max(level, month) / arg_min(level, month), 12.0 / count(ret)) - 1 AS cagr", "stddev_samp(ret) * sqrt(12.0) AS ann_vol", "avg(ret) * 12 / (stddev_samp(ret) * sqrt(12.0)) AS sharpe", "min(dd) AS max_drawdown")}
  FROM (SELECT *, level / max(level) OVER (PARTITION BY series ORDER BY month) - 1 AS dd FROM rt) GROUP BY series""")
def perf_stats(s, d):
    return A.perf_stats(P.drop_unfinished(X.levels(s, d), AS_OF))


@query(f"SELECT series, {_d('month')}, {_r('level', 'ret')} FROM rt")
def returns(s, d):
    return panel(s, d).select("series", "month", "level", "ret")


@query(f"SELECT series, {_d('month')}, {_r('level / max(level) OVER (PARTITION BY series ORDER BY month) - 1 AS dd')} FROM rt")
def drawdown(s, d):
    return P.drawdown(panel(s, d)).select("series", "month", "dd")


@query(f"SELECT series, {_d('month')}, {_r('100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY series ORDER BY month)) AS path')} FROM rt WHERE ret IS NOT NULL")
def growth_path(s, d):
    return P.growth_path(panel(s, d)).select("series", "month", "path")


@query("SELECT series, region, factor, count(*) AS n FROM rt GROUP BY ALL")
def split_key(s, d):
    return P.split_key(panel(s, d).select("series")).groupBy("series", "region", "factor").agg(F.count("*").alias("n"))


@query(f"SELECT series, {_d('month')}, {_r('ret')} FROM rc")
def complete_months(s, d):
    return P.complete_months(panel(s, d), "ret").select("series", "month", "ret")


@query(f"SELECT series, {_d('month')}, {_r('level')} FROM rt WHERE month >= (SELECT min(month) FROM (SELECT month FROM rt GROUP BY month HAVING count(*) = (SELECT count(DISTINCT series) FROM rt)))")
def common_window(s, d):
    return P.common_window(panel(s, d)).select("series", "month", "level")


@query(f"SELECT series, {_d('month')}, {_r('level')} FROM rt WHERE month BETWEEN DATE '1996-01-31' AND DATE '1998-12-31'")
def window_slice(s, d):
    return P.window_slice(panel(s, d), "1996-01-31", "1998-12-31").select("series", "month", "level")


@query(f"SELECT series, {_d('month')}, {_r('level')} FROM rt WHERE month NOT BETWEEN DATE '1998-07-31' AND DATE '1998-12-31'")
def drop_window(s, d):
    return P.drop_window(panel(s, d), "1998-07-31", "1998-12-31").select("series", "month", "level")


@query("SELECT series, count(*) AS n FROM rt WHERE region <> 'ASIA' GROUP BY series")
def drop_region(s, d):
    return P.drop_region(panel(s, d), "ASIA").groupBy("series").agg(F.count("*").alias("n"))


@query("SELECT 'all' AS menu, series, count(*) AS n FROM rt GROUP BY series UNION ALL SELECT 'asia', series, count(*) FROM rt WHERE region = 'ASIA' GROUP BY series UNION ALL SELECT 'references', series, count(*) FROM rt WHERE factor = 'Reference' GROUP BY series")
def menus(s, d):
    specs = {"all": F.lit(True), "asia": F.col("region") == "ASIA", "references": F.col("factor") == "Reference"}
    return P.menus(panel(s, d), specs).groupBy("menu", "series").agg(F.count("*").alias("n"))


@query(f"SELECT series, {_d('month')}, {_r('level / first_value(level) OVER (PARTITION BY series ORDER BY month) * 100 AS rebased')} FROM rt WHERE month >= DATE '1997-01-31'")
def rebase(s, d):
    return P.rebase(panel(s, d), "1997-01-31").select("series", "month", "rebased")


@query(f"SELECT series, block, n, {_d('month')}, {_r('ret')} FROM (SELECT series, CAST(floor((p - 1) / 3) AS BIGINT) AS block, count(*) AS n, max(month) AS month, exp(sum(ln(1 + ret))) - 1 AS ret FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) AS p FROM rt WHERE ret IS NOT NULL) GROUP BY ALL)")
def compound_blocks(s, d):
    return P.compound_blocks(panel(s, d))


@query(f"SELECT series, {_r('stddev_samp(ret) * sqrt(12.0) AS ann_vol', 'corr(ret, b) AS autocorr')} FROM (SELECT *, lag(ret) OVER (PARTITION BY series ORDER BY month) AS b FROM rt) GROUP BY series")
def period_average_check(s, d):
    return P.period_average_check(panel(s, d))


@query("SELECT count(*) AS n_rows, count(DISTINCT (series, month)) AS n_keys, count(*) = count(DISTINCT (series, month)) AS is_unique FROM rt")
def key_uniqueness(s, d):
    return P.key_uniqueness(panel(s, d), ["series", "month"])


@query(f"SELECT series, {_d('month', 'held_from')}, {_r('held')} FROM (SELECT r.series, r.month, max(q.month) AS held_from, arg_max(q.level, q.month) AS held FROM rt r LEFT JOIN rt q ON q.series = r.series AND month(q.month) = 6 AND q.month <= r.month GROUP BY r.series, r.month)")
def asof_backward(s, d):
    p = panel(s, d).select("series", "month", "level")
    junes = p.filter(F.month("month") == 6).select("series", "month", F.col("level").alias("held"), F.col("month").alias("held_from"))
    return P.asof_backward(p.select("series", "month"), junes, ["series"], ["held", "held_from"])


_PAIR = "(SELECT a.*, b.level AS ref, a.level / lag(a.level) OVER w - 1 AS r, b.level / lag(b.level) OVER w - 1 AS rr FROM rt a JOIN rt b ON a.region = b.region AND a.month = b.month AND b.factor = 'Reference' AND a.factor <> 'Reference' WINDOW w AS (PARTITION BY a.series ORDER BY a.month))"


@query(f"""SELECT region, factor, strftime(s, '%Y-%m-%d') AS overlap_start, {_r("ref_cagr", "factor_cagr", "factor_cagr - ref_cagr AS excess_cagr", "hit_rate")} FROM (
  SELECT region, factor, min(month) AS s, pow(arg_max(ref, month) / arg_min(ref, month), 12.0 / (count(*) - 1)) - 1 AS ref_cagr,
  pow(arg_max(level, month) / arg_min(level, month), 12.0 / (count(*) - 1)) - 1 AS factor_cagr, avg(CASE WHEN r > rr THEN 1.0 WHEN r <= rr THEN 0.0 END) AS hit_rate FROM {_PAIR} GROUP BY region, factor)""")
def factor_vs_reference(s, d):
    return A.factor_vs_reference(panel(s, d))


_REGIME = """rp AS (
  SELECT regime, region, factor, series, count(ret2) AS months, arg_max(level, month) / arg_min(level, month) - 1 AS total_return,
         pow(arg_max(level, month) / arg_min(level, month), 12.0 / nullif(count(ret2), 0)) - 1 AS annualised, stddev_samp(ret2) * sqrt(12.0) AS ann_vol
  FROM (SELECT rg.regime, rt.*, level / lag(level) OVER (PARTITION BY regime, series ORDER BY month) - 1 AS ret2 FROM rt JOIN rg ON month BETWEEN s AND e)
  GROUP BY ALL HAVING count(ret2) >= 1),
rx AS (SELECT a.*, CASE WHEN a.factor <> 'Reference' THEN a.annualised - b.annualised END AS excess_vs_ref FROM rp a LEFT JOIN rp b ON a.regime = b.regime AND a.region = b.region AND b.factor = 'Reference')"""


@query(f", {_REGIME} SELECT regime, region, factor, series, months, {_r('total_return', 'annualised', 'ann_vol', 'excess_vs_ref')} FROM rx")
def regime_performance(s, d):
    return A.regime_performance(panel(s, d), X.regimes(s))


@query(f", {_REGIME} SELECT regime, arg_max(series, annualised) AS best, arg_min(series, annualised) AS worst, {_r('max(annualised) AS best_return', 'min(annualised) AS worst_return')} FROM rx GROUP BY regime")
def regime_leaders(s, d):
    return A.regime_leaders(A.regime_performance(panel(s, d), X.regimes(s)))


@query(f", {_REGIME} SELECT regime, factor, {_r('avg(excess_vs_ref) AS mean_excess')}, count(*) AS n_regions FROM rx WHERE excess_vs_ref IS NOT NULL GROUP BY regime, factor")
def excess_by_factor(s, d):
    return A.excess_by_factor(A.regime_performance(panel(s, d), X.regimes(s)))


@query(f", c AS (SELECT i, j, corr(x, y) AS corr FROM pr GROUP BY i, j) SELECT i, j, {_r('corr')} FROM (SELECT * FROM c UNION ALL SELECT j, i, corr FROM c UNION ALL SELECT DISTINCT series, series, 1.0 FROM rc)")
def corr_matrix(s, d):
    rows = settled(P.complete_months(panel(s, d), "ret"))  # read four times
    return A.corr_matrix(A.corr_pairs(rows, complete=False), names=rows)


@query(f", c AS (SELECT i, j, corr(x, y) AS corr FROM pr GROUP BY i, j), k AS (SELECT corr, CASE WHEN split_part(i, ' | ', 2) = 'Reference' AND split_part(j, ' | ', 2) = 'Reference' THEN 'references' WHEN split_part(i, ' | ', 1) = split_part(j, ' | ', 1) THEN 'same region' WHEN split_part(i, ' | ', 2) = split_part(j, ' | ', 2) THEN 'same factor' ELSE 'other' END AS relation FROM c) SELECT relation, count(*) AS n_pairs, {_r('avg(corr) AS mean_corr', 'min(corr) AS min_corr')} FROM (SELECT corr, relation FROM k UNION ALL SELECT corr, 'all' FROM k) GROUP BY relation")
def avg_pairwise_corr(s, d):
    return A.avg_pairwise_corr(A.corr_pairs(panel(s, d)))


@query(f"SELECT region, factor, {_r('avg(ret) AS mean_ret')}, count(*) AS n FROM rt WHERE ret IS NOT NULL GROUP BY CUBE (region, factor)")
def cube_summary(s, d):
    return A.cube_summary(panel(s, d))


@query(f"SELECT series, {_d('month')}, {_r('score')} FROM (SELECT series, month, CASE WHEN count(ret) OVER w = 12 THEN exp(sum(ln(1 + ret)) OVER w) - 1 END AS score FROM rt WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))")
def momentum_score(s, d):
    return A.momentum_score(panel(s, d)).select("series", "month", "score")


_BLOCKS = """(SELECT *, count(score) OVER (PARTITION BY block) AS k, count(*) OVER (PARTITION BY block) AS n FROM (
  SELECT series, CAST(floor((p - 1) / 12) AS BIGINT) AS block, {score} AS score FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) AS p FROM rc) GROUP BY ALL HAVING count(*) >= 6))"""
_RANKED = f"SELECT series, block, {_r('score')}, {_r('rank() OVER (PARTITION BY block ORDER BY score DESC) + (count(*) OVER (PARTITION BY block, score) - 1) / 2.0 AS rank')} FROM {_BLOCKS} WHERE k = n"


@query(_RANKED.format(score="avg(ret) / nullif(stddev_samp(ret), 0)"))
def block_ranks(s, d):
    return A.block_ranks(panel(s, d))


@query(_RANKED.format(score="exp(sum(ln(1 + ret))) - 1"))
def block_ranks_by_return(s, d):
    return A.block_ranks(panel(s, d), metric="return")


@query(f"SELECT indicator, {_d('month')}, {_r('value', 'value - lag(value) OVER (PARTITION BY indicator ORDER BY month) AS chg')} FROM ind", macro=True)
def changes(s, d):
    return M.changes(X.indicators(s, d))


@query(f"SELECT indicator, {_d('first', 'last')}, n FROM (SELECT indicator, min(month) AS first, max(month) AS last, count(*) AS n FROM ind GROUP BY indicator)", macro=True)
def indicator_meta(s, d):
    return P.indicator_meta(X.indicators(s, d))


@query(f"SELECT series, indicator, basis, lag, {_r('corr')}, n, insufficient FROM mc", macro=True)
def macro_correlations(s, d):
    return M.macro_correlations(panel(s, d), X.indicators(s, d))


@query(f"SELECT series, indicator, {_r('CASE WHEN count(*) >= 36 THEN regr_slope(ret, f) END AS beta', 'CASE WHEN count(*) >= 36 THEN regr_r2(ret, f) END AS r2')}, count(*) AS n FROM cf WHERE lag = 0 AND basis = 'chg' GROUP BY series, indicator", macro=True)
def macro_beta(s, d):
    return M.macro_beta(panel(s, d), X.indicators(s, d))


_DRIVEN = "(SELECT split_part(series, ' | ', 2) AS factor, indicator, avg(corr) AS mean_corr FROM mc WHERE basis = 'chg' AND lag = 0 AND corr IS NOT NULL GROUP BY ALL)"


@query(
    f"""SELECT factor, side, rank, indicator, {_r("mean_corr")} FROM (SELECT *, 'positive' AS side, row_number() OVER (PARTITION BY factor ORDER BY round(mean_corr, 12) DESC, indicator) AS rank FROM {_DRIVEN}
  UNION ALL SELECT *, 'negative', row_number() OVER (PARTITION BY factor ORDER BY round(mean_corr, 12), indicator) FROM {_DRIVEN}) WHERE rank <= 3""",
    macro=True,
)
def top_drivers(s, d):
    return M.top_drivers(M.macro_correlations(panel(s, d), X.indicators(s, d)))


@query(f"SELECT indicator, series, {_r('corr')} FROM (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY round(abs(corr), 12) DESC, series) AS p FROM mc WHERE basis = 'chg' AND lag = 0 AND corr IS NOT NULL) WHERE p = 1", macro=True)
def most_sensitive(s, d):
    return M.most_sensitive(M.macro_correlations(panel(s, d), X.indicators(s, d)))


@query(f"SELECT series, indicator, {_r('beta', 'r2')}, n FROM (SELECT series, indicator, regr_slope(ret, f) AS beta, regr_r2(ret, f) AS r2, count(*) AS n FROM cf WHERE lag = 0 AND basis = 'chg' GROUP BY ALL HAVING count(*) >= 36) ORDER BY round(r2, 12) DESC, series, indicator LIMIT 10", macro=True)
def top_betas(s, d):
    return M.top_betas(M.macro_beta(panel(s, d), X.indicators(s, d)))


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """All registered queries; the modules register theirs when they are imported."""
    for name in ("exposure", "states", "more", "shape", "files", "history", "race", "inference", "regression", "search", "placebo"):
        import_module(f".catalog_{name}", __package__)
    return _FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
