"""Queries on races of weight rules, with the same rows in SQL where rules have a closed form."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _d, _r, panel, query
from .catalog_exposure import _MOMENTS
from .catalog_states import _CASH, _cash
from .functions import dense, finance
from .operators import covariance as V
from .operators import panel as P
from .operators import performance as A
from .operators import walkforward as R
from .plans import fixtures as X
from .plans.scratch import settled
from .sources.files import FEES_BPS

#: The panel has some eighty months: shorter than the defaults.
WARMUP, REFIT, TILT = 36, 12, "MACHINERY"
ALL = "SELECT 'all' AS menu, series, region, factor, month, ret FROM rt WHERE ret IS NOT NULL"


def race_sql(menus: str = ALL, protocols: str = f"SELECT menu, t, {WARMUP} AS w, {REFIT} AS r, 1000 AS win FROM sz", bps: float = 10.0) -> str:
    """Tables of a race over menus: ps (placed), sd (refits), ws (weights), tn (turnover), hr (held rows), rr (the race)."""
    return f""", pm AS ({menus}),
pn AS (SELECT menu, count(DISTINCT series) AS n FROM pm GROUP BY menu),
pk AS (SELECT menu, month FROM pm JOIN pn USING (menu) GROUP BY menu, month, n HAVING count(*) = n),
ps AS (SELECT pm.*, row_number() OVER (PARTITION BY menu, series ORDER BY month) AS pos FROM pm JOIN pk USING (menu, month)),
sz AS (SELECT menu, max(pos) AS t FROM ps GROUP BY menu),
sd AS (SELECT menu, CAST(g.i AS INTEGER) AS refit, greatest(1, w + r * g.i - win + 1) AS lo, w + r * g.i AS hi, least(w + r * g.i + r, t) AS hold_hi FROM ({protocols}), range(0, 100) g(i) WHERE w + r * g.i < t AND t > w + r),
ws AS (
  SELECT menu, '1/N' AS rule, refit, series, 1.0 / count(*) OVER (PARTITION BY menu, refit) AS w FROM sd JOIN (SELECT DISTINCT menu, series FROM ps) USING (menu)
  UNION ALL SELECT menu, '1/N {TILT}', refit, series, 1.0 / count(*) OVER (PARTITION BY menu, refit) FROM sd JOIN (SELECT DISTINCT menu, series FROM ps WHERE factor = '{TILT}') USING (menu)
  UNION ALL SELECT menu, 'Momentum', refit, series, 1.0 / count(*) OVER (PARTITION BY menu, refit) FROM (SELECT sd.menu, refit, series, row_number() OVER (PARTITION BY sd.menu, refit ORDER BY round(score, 12) DESC, series) AS k
    FROM sd JOIN (SELECT menu, series, pos, CASE WHEN count(*) OVER w = 12 THEN exp(sum(ln(1 + ret)) OVER w) - 1 END AS score FROM ps WINDOW w AS (PARTITION BY menu, series ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) m
    ON m.menu = sd.menu AND m.pos = hi WHERE score IS NOT NULL) WHERE k <= 6
  UNION ALL SELECT menu, 'Inverse variance', refit, series, v / sum(v) OVER (PARTITION BY menu, refit) FROM (SELECT menu, refit, series, 1 / var_samp(ret) AS v FROM sd JOIN ps USING (menu) WHERE pos BETWEEN lo AND hi GROUP BY ALL)),
rf AS (SELECT *, lag(refit) OVER (PARTITION BY menu, rule ORDER BY refit) AS prev FROM (SELECT DISTINCT menu, rule, refit FROM ws)),
tn AS (SELECT menu, rule, refit, CASE WHEN max(prev) IS NULL THEN 0 ELSE sum(abs(d)) / 2 END AS turn FROM (SELECT menu, rule, refit, prev, series, sum(w) AS d FROM (
  SELECT rf.menu, rf.rule, rf.refit, prev, series, w FROM rf JOIN ws USING (menu, rule, refit) UNION ALL SELECT rf.menu, rf.rule, rf.refit, prev, series, -w FROM rf JOIN ws ON ws.menu = rf.menu AND ws.rule = rf.rule AND ws.refit = rf.prev)
  GROUP BY ALL) GROUP BY menu, rule, refit),
hr AS (SELECT ws.menu, ws.rule, ws.refit, ws.series, ws.w, pos, month, ret, hi, hold_hi FROM ws JOIN sd USING (menu, refit) JOIN ps ON ps.menu = ws.menu AND ps.series = ws.series AND pos > hi AND pos <= hold_hi),
rr AS (SELECT *, gross - {bps} / 10000 * turnover AS net FROM (SELECT menu, rule, refit, pos, month, sum(w * ret) AS gross, CASE WHEN pos = max(hi) + 1 THEN max(turn) ELSE 0 END AS turnover FROM hr JOIN tn USING (menu, rule, refit) GROUP BY menu, rule, refit, pos, month)),
ls AS (SELECT menu, rule, avg(net) / nullif(stddev_samp(net), 0) * sqrt(12.0) AS sharpe FROM rr GROUP BY menu, rule)"""


_RACE = race_sql()


def placed_of(s, d, by: tuple[str, ...] = (), p: DataFrame | None = None) -> DataFrame:
    """The race's panel, settled, as every step of a race reads it."""
    return settled(R.positions((panel(s, d) if p is None else p).filter("ret IS NOT NULL"), by))


def schedule_of(placed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return R.refit_schedule(placed, WARMUP, REFIT, by=by, short="skip")


def rules_of(placed: DataFrame, schedule: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The rules with a closed form, settled, as holding and turnover both read them."""
    parts = (R.equal_weights(placed, schedule, by), R.naive_tilts(placed, schedule, TILT, by), R.momentum_at_refits(placed, schedule, by=by))
    return settled(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def race_of(s, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    placed = placed_of(s, d)
    schedule = schedule_of(placed)
    weights = rules_of(placed, schedule)
    return placed, schedule, weights, R.walk_forward(weights, placed, schedule)


@query(f"{_RACE} SELECT refit, CAST(lo AS INTEGER) AS train_lo, CAST(hi AS INTEGER) AS train_hi, CAST(hi + 1 AS INTEGER) AS hold_lo, CAST(hold_hi AS INTEGER) AS hold_hi, strftime(month, '%Y-%m-%d') AS hold_month FROM sd JOIN (SELECT DISTINCT pos, month FROM ps) ON pos = hi + 1")
def refit_schedule(s, d):
    return schedule_of(placed_of(s, d)).select("refit", "train_lo", "train_hi", "hold_lo", "hold_hi", "hold_month")


@query(f"{race_sql(protocols=f'SELECT menu, t, {WARMUP} AS w, {REFIT} AS r, 24 AS win FROM sz')} SELECT refit, series, count(*) AS n, {_r('avg(ret) AS mean_ret')} FROM sd JOIN ps USING (menu) WHERE pos BETWEEN lo AND hi GROUP BY refit, series")
def train_slices(s, d):
    """Rolling windows of two years."""
    placed = placed_of(s, d)
    rows = R.train_slices(placed, R.refit_schedule(placed, WARMUP, REFIT, 24, short="skip"))
    return rows.groupBy("refit", "series").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"))


_WEIGHTED = f"{_RACE} SELECT rule, refit, series, {_r('w')} FROM ws WHERE rule IN "


@query(f"{_WEIGHTED} ('1/N')")
def equal_weights(s, d):
    placed = placed_of(s, d)
    return R.equal_weights(placed, schedule_of(placed))


@query(f"{_WEIGHTED} ('Momentum')")
def momentum_at_refits(s, d):
    placed = placed_of(s, d)
    return R.momentum_at_refits(placed, schedule_of(placed))


@query(f"{_WEIGHTED} ('1/N {TILT}', 'Inverse variance')")
def naive_tilts(s, d):
    placed = placed_of(s, d)
    return R.naive_tilts(placed, schedule_of(placed), TILT)


@query(f"{_RACE} SELECT rule, refit, {_r('turn AS turnover')} FROM tn")
def turnover(s, d):
    return R.turnover(race_of(s, d)[2])


@query(f"{_RACE} SELECT rule, {_d('month')}, refit, {_r('gross', 'turnover', 'net')} FROM rr")
def walk_forward(s, d):
    return race_of(s, d)[3]


_LEVELS_OF = """lv2 AS (SELECT rule, month, 100 * exp(sum(ln(1 + {v})) OVER (PARTITION BY rule ORDER BY month)) AS level FROM {t}),
lb AS (SELECT rule, last_day(min(month) - INTERVAL 1 MONTH) AS month, 100.0 AS level FROM lv2 GROUP BY rule UNION ALL SELECT rule, month, level FROM lv2),
ld AS (SELECT *, level / lag(level) OVER w - 1 AS ret, level / max(level) OVER w - 1 AS dd FROM lb WINDOW w AS (PARTITION BY rule ORDER BY month))"""
_PERF = (
    "pow(arg_max(level, month) / arg_min(level, month), 12.0 / count(ret)) - 1 AS cagr",
    "stddev_samp(ret) * sqrt(12.0) AS ann_vol",
    "avg(ret) * 12 / (stddev_samp(ret) * sqrt(12.0)) AS sharpe",
    "min(dd) AS max_drawdown",
)


@query(
    f"""{_RACE}, {_LEVELS_OF.format(v="net", t="rr")}, sg AS (SELECT rule, avg(gross) / stddev_samp(gross) * sqrt(12.0) AS g, sum(turnover) / count(DISTINCT refit) AS m FROM rr GROUP BY rule)
  SELECT rule, count(ret) AS months, strftime(min(month), '%Y-%m-%d') AS start, strftime(max(month), '%Y-%m-%d') AS end, {_r(*_PERF, "max(g) AS sharpe_gross", "max(m) AS mean_turnover")} FROM ld JOIN sg USING (rule) GROUP BY rule"""
)
def race_summary(s, d):
    return R.race_summary(race_of(s, d)[3])


@query(f"{_RACE} SELECT bps, rule, {_r('avg(gross - bps / 10000 * turnover) / stddev_samp(gross - bps / 10000 * turnover) * sqrt(12.0) AS sharpe')} FROM rr, (VALUES (0.0::DOUBLE), (10.0), (50.0)) v(bps) GROUP BY bps, rule")
def net_of_costs(s, d):
    return R.net_of_costs(race_of(s, d)[3], (0.0, 10.0, 50.0))


_BPS = {k: v for k, v in FEES_BPS.items() if not k.startswith("Asset")}
_FEES = "CASE WHEN factor = 'Reference' THEN 15.0 ELSE 30.0 END + CASE WHEN region = 'AFRICA' THEN 10.0 ELSE 0 END"


@query(
    f"""{_RACE}, fr AS (SELECT rule, refit, sum(w * f) / 12 AS fee FROM ws JOIN (SELECT DISTINCT series, ({_FEES}) / 10000 AS f FROM rt) USING (series) GROUP BY rule, refit),
  f1 AS (SELECT rule, month, fee, net - fee AS ret FROM rr JOIN fr USING (rule, refit)),
  f2 AS (SELECT * FROM f1 UNION ALL SELECT '1/N half', month, 0.5 * f1.fee, 0.5 * rr.gross - 0.5 * f1.fee FROM f1 JOIN rr USING (rule, month) WHERE rule = '1/N'),
  f3 AS (SELECT a.*, CASE WHEN a.rule <> '1/N' THEN a.ret - b.ret END AS act FROM f2 a LEFT JOIN f2 b ON b.rule = '1/N' AND b.month = a.month)
  SELECT rule, count(*) AS months, {_r("avg(fee) * 12 AS fee_ann", "avg(ret) / stddev_samp(ret) * sqrt(12.0) AS sharpe", "avg(act) * 12 AS active_ann", "avg(act) / stddev_samp(act) * sqrt(12.0) AS information_ratio")} FROM f3 GROUP BY rule"""
)
def net_of_fees(s, d):
    """An overlay holds half of 1/N and pays half its fee."""
    placed, _, weights, race = race_of(s, d)
    fees = placed.select("series").distinct().select("series", finance.series_fee(F.col("series"), _BPS, ("AFRICA",)).alias("fee"))
    half = race.filter("rule = '1/N'").select(F.lit("1/N half").alias("rule"), F.lit("1/N").alias("base"), "month", F.lit(0.5).alias("exposure"), (F.col("gross") * 0.5).alias("ret"))
    return R.net_of_fees(race, weights, fees, half)


_DRIFT = """
vl AS (SELECT *, w * exp(sum(ln(1 + ret)) OVER (PARTITION BY rule, refit, series ORDER BY pos)) AS val FROM hr),
mt AS (SELECT rule, refit, pos, month, sum(w * ret) AS r, sum(val) AS v FROM vl GROUP BY ALL),
df AS (SELECT rule, refit, pos, sum(abs(w * (1 + ret) / (1 + r) - w)) / 2 AS drift FROM vl JOIN mt USING (rule, refit, pos) GROUP BY ALL),
en AS (SELECT rule, refit, series, val / v AS w FROM vl JOIN mt USING (rule, refit, pos) WHERE pos = hold_hi),
ht AS (SELECT rule, refit, sum(abs(d)) / 2 AS t FROM (SELECT rule, refit, series, sum(w) AS d FROM (SELECT rule, refit, series, w FROM ws JOIN rf USING (menu, rule, refit) WHERE prev IS NOT NULL
  UNION ALL SELECT rf.rule, rf.refit, series, -w FROM rf JOIN en ON en.rule = rf.rule AND en.refit = rf.prev) GROUP BY ALL) GROUP BY ALL),
dd AS (SELECT mt.*, drift, CASE WHEN row_number() OVER k = 1 THEN turn ELSE 0 END AS paid, CASE WHEN row_number() OVER k = 1 THEN coalesce(ht.t, 0) ELSE 0 END AS hp, coalesce(lag(drift) OVER k, 0) AS ld, coalesce(lag(v) OVER k, 1) AS lv3
  FROM mt JOIN df USING (rule, refit, pos) JOIN tn USING (rule, refit) LEFT JOIN ht USING (rule, refit) WINDOW k AS (PARTITION BY rule, refit ORDER BY pos))"""


@query(f"{_RACE}, {_DRIFT} SELECT rule, {_d('month')}, {_r('r - 0.001 * paid AS constant_mix', 'r - 0.001 * paid - 0.001 * ld AS monthly_trades', 'v / lv3 - 1 - 0.001 * hp AS buy_and_hold', 'drift')} FROM dd")
def rebalance_drift(s, d):
    placed, schedule, weights, _ = race_of(s, d)
    return R.rebalance_drift(weights, placed, schedule)


_PARTS = "ptb AS (SELECT rule, series, c AS contribution, c / sum(c) OVER (PARTITION BY rule) AS share FROM (SELECT rule, series, sum(w * ret) AS c FROM hr GROUP BY ALL))"


@query(f"{_RACE}, {_PARTS} SELECT rule, series, {_r('contribution', 'share')} FROM ptb")
def sleeve_attribution(s, d):
    placed, schedule, weights, _ = race_of(s, d)
    return R.sleeve_attribution(weights, placed, schedule)


@query(f"{_RACE}, {_PARTS} SELECT rule, rank, series, {_r('contribution', 'share')} FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY round(share, 12) DESC, series) AS rank FROM ptb) WHERE rank <= 3")
def top_attribution(s, d):
    placed, schedule, weights, _ = race_of(s, d)
    return R.top_attribution(R.sleeve_attribution(weights, placed, schedule))


_GROUPS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_LOO = race_sql("SELECT menu, series, region, factor, month, ret FROM rt, (VALUES ('none'), " + ", ".join(f"('{g}')" for g in _GROUPS) + ") m(menu) WHERE ret IS NOT NULL AND menu <> region")


def _menu_race(placed: DataFrame) -> DataFrame:
    schedule = schedule_of(placed, ("menu",))
    return R.walk_forward(rules_of(placed, schedule, ("menu",)), placed, schedule, ("menu",))


def _leave_one_out(s, d):
    return R.sharpe_of(_menu_race(placed_of(s, d, ("menu",), R.drop_groups(panel(s, d), _GROUPS))), ("menu",))


@query(f"{_LOO} SELECT menu, rule, {_r('sharpe')} FROM ls")
def leave_one_out(s, d):
    return _leave_one_out(s, d)


@query(
    f"""{_LOO} SELECT rule, max(rank) FILTER (WHERE menu = 'none') AS base_rank, max(rank) AS worst_rank, min(rank) AS best_rank, count(*) AS n_runs FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY menu ORDER BY round(sharpe, 12) DESC, rule) AS INTEGER) AS rank FROM ls WHERE sharpe IS NOT NULL) GROUP BY rule"""
)
def rank_slip(s, d):
    return R.rank_slip(_leave_one_out(s, d).withColumnRenamed("menu", "run"))


_SHIFTS = (0, 6, 12, 18, 60)
_SHIFTED = race_sql(
    f"""SELECT k AS menu, series, region, factor, month, ret FROM rt JOIN (SELECT month, row_number() OVER (ORDER BY month) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT month FROM rt WHERE ret IS NOT NULL)) USING (month),
  (VALUES {", ".join(f"({k})" for k in _SHIFTS)}) v(k) WHERE ret IS NOT NULL AND p > k AND n - k >= {WARMUP + REFIT + 1}"""
)


def _shifted(s, d):
    return R.sharpe_of(_menu_race(placed_of(s, d, ("menu",), R.shifted_windows(panel(s, d), _SHIFTS, WARMUP + REFIT + 1))), ("menu",))


@query(f"{_SHIFTED} SELECT CAST(menu AS INTEGER) AS menu, rule, {_r('sharpe')} FROM ls")
def shifted_windows(s, d):
    return _shifted(s, d)


@query(
    f"""{_SHIFTED} SELECT a.rule, {_r("quantile_cont(a.sharpe, 0.5) AS median", "min(a.sharpe) AS lowest", "max(a.sharpe) AS highest", "avg(CASE WHEN a.sharpe > b.sharpe THEN 1.0 ELSE 0.0 END) AS ahead", "avg(CASE WHEN a.rule = top THEN 1.0 ELSE 0.0 END) AS first")}
  FROM ls a LEFT JOIN (SELECT menu, sharpe FROM ls WHERE rule = '1/N') b USING (menu) JOIN (SELECT menu, arg_max(rule, round(sharpe, 12)) AS top FROM ls GROUP BY menu) USING (menu) GROUP BY a.rule"""
)
def dispersion(s, d):
    return R.dispersion(_shifted(s, d).withColumnRenamed("menu", "run"))


_PROTOCOLS = [("w36", 36, 12, None), ("w24", 24, 12, None), ("roll24", 36, 12, 24), ("refit6", 36, 6, None), ("w600", 600, 12, None)]
_GRID = race_sql(
    "SELECT menu, series, region, factor, month, ret FROM rt, (VALUES " + ", ".join(f"('{n}')" for n, *_ in _PROTOCOLS) + ") m(menu) WHERE ret IS NOT NULL",
    "SELECT menu, t, w, r, win FROM sz JOIN (VALUES " + ", ".join(f"('{n}', {w}, {r}, {win or 1000})" for n, w, r, win in _PROTOCOLS) + ") p(menu, w, r, win) USING (menu)",
)


def _protocols(s, d):
    placed, schedule = R.protocol_grid(placed_of(s, d), _PROTOCOLS)
    return R.sharpe_of(R.walk_forward(rules_of(placed, schedule, ("menu",)), placed, schedule, ("menu",)), ("menu",))


@query(f"{_GRID} SELECT menu, rule, {_r('sharpe')} FROM ls")
def protocol_grid(s, d):
    return _protocols(s, d)


@query(
    f"""{_GRID}, rk AS (SELECT *, row_number() OVER (PARTITION BY menu ORDER BY round(sharpe, 12) DESC, rule) AS rank FROM ls),
  wd AS (SELECT menu AS cell, CAST(max(rank) FILTER (WHERE rule = 'Inverse variance') AS DOUBLE) AS rank, max(sharpe) FILTER (WHERE rule = 'Momentum') - max(sharpe) FILTER (WHERE rule = '1/N') AS gap FROM rk GROUP BY menu),
  ck AS (SELECT cell, 'leader' AS "check", rank AS value, rank = 1 AS holds FROM wd UNION ALL SELECT cell, 'capped', gap, gap >= 0 FROM wd)
  SELECT a.cell, a."check", {_r("a.value AS value")}, a.holds, CASE WHEN NOT b.holds THEN 'stale' WHEN NOT a.holds THEN 'flips' ELSE 'holds' END AS verdict FROM ck a JOIN ck b ON b."check" = a."check" AND b.cell = 'w36'"""
)
def sensitivity_flips(s, d):
    return R.sensitivity_flips(_protocols(s, d).withColumnRenamed("menu", "cell"), "Inverse variance", "Momentum", "1/N", "w36")


@query(
    f"""{_RACE}, hf AS (SELECT rule, avg(CASE WHEN p <= n // 2 THEN net END) / stddev_samp(CASE WHEN p <= n // 2 THEN net END) * sqrt(12.0) AS first_half, avg(CASE WHEN p > n // 2 THEN net END) / stddev_samp(CASE WHEN p > n // 2 THEN net END) * sqrt(12.0) AS second_half
    FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY month) AS p, count(*) OVER (PARTITION BY rule) AS n FROM rr) GROUP BY rule),
  bt AS (SELECT rule, count(*) AS n_windows, avg(b) AS beats FROM (SELECT a.rule, count(*) OVER w AS k, CASE WHEN avg(a.net) OVER w / stddev_samp(a.net) OVER w > avg(b.net) OVER w / stddev_samp(b.net) OVER w THEN 1.0 ELSE 0.0 END AS b
    FROM rr a JOIN rr b ON b.rule = '1/N' AND b.month = a.month WINDOW w AS (PARTITION BY a.rule ORDER BY a.month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE k = 24 GROUP BY rule),
  cr AS (SELECT rr.rule, region, corr(net, ret) AS c FROM rr JOIN (SELECT region, month, ret FROM rt WHERE factor = 'Reference' AND ret IS NOT NULL) USING (month) GROUP BY ALL),
  cn AS (SELECT rule, region, c FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY round(c, 9) DESC, region DESC) AS k FROM cr) WHERE k = 1)
  SELECT rule AS series, {_r("first_half", "second_half")}, n_windows, {_r("beats")}, region, {_r("c AS corr")} FROM hf LEFT JOIN bt USING (rule) LEFT JOIN cn USING (rule)"""
)
def exposure_diagnostics(s, d):
    rows = race_of(s, d)[3].select(F.col("rule").alias("series"), "month", F.col("net").alias("ret"))
    return R.exposure_diagnostics(rows, panel(s, d), rows.filter("series = '1/N'").select("month", F.col("ret").alias("bench")), 24)


#: Two-sided p of a rank correlation rho of n menus, by Student's distribution as a finite sum.
_SPEARMAN_P = """CASE WHEN n >= 3 THEN greatest(0, 1 - CASE WHEN n % 2 = 1 THEN 2 / pi() * (asin(least(abs(rho), 1)) + abs(rho) * coalesce(list_sum(list_transform(range(0, CAST((n - 3) / 2 AS BIGINT)), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(sqrt(greatest(1 - rho * rho, 0)), 2 * k + 1))), 0))
  ELSE abs(rho) * coalesce(list_sum(list_transform(range(0, CAST((n - 2) / 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(greatest(1 - rho * rho, 0), k))), 0) END) END AS p"""


@query(
    f"""{_LOO}, cr AS (SELECT menu, avg(c) AS mean_corr FROM (SELECT a.menu, a.series, b.series, corr(a.ret, b.ret) AS c FROM ps a JOIN ps b ON a.menu = b.menu AND a.pos = b.pos AND a.series < b.series GROUP BY ALL) GROUP BY menu),
  sp AS (SELECT menu, stddev_samp(m) AS spread FROM (SELECT menu, series, avg(ret) AS m FROM ps GROUP BY ALL) GROUP BY menu),
  me AS (SELECT menu, 'mean_corr' AS measure, mean_corr AS value FROM cr UNION ALL SELECT menu, 'spread', spread FROM sp),
  gp AS (SELECT a.menu, a.rule, a.sharpe - b.sharpe AS gap FROM ls a JOIN ls b ON b.menu = a.menu AND b.rule = '1/N' WHERE a.rule <> '1/N'),
  rk AS (SELECT rule, measure, rank() OVER (PARTITION BY rule, measure ORDER BY round(value, 12) DESC) + (count(*) OVER (PARTITION BY rule, measure, round(value, 12)) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY rule, measure ORDER BY round(gap, 12) DESC) + (count(*) OVER (PARTITION BY rule, measure, round(gap, 12)) - 1) / 2.0 AS ry FROM me JOIN gp USING (menu))
  SELECT rule, measure, n, {_r("rho AS spearman", _SPEARMAN_P)} FROM (SELECT rule, measure, count(*) AS n, corr(rx, ry) AS rho FROM rk GROUP BY rule, measure)"""
)
def menu_study(s, d):
    """Menus without each region: does a rule's gap to 1/N go with the menu's correlation or spread?"""
    placed = placed_of(s, d, ("menu",), R.drop_groups(panel(s, d), _GROUPS))
    pairs = A.corr_pairs(placed, ("menu",), complete=False).groupBy("menu").agg(F.avg("corr").alias("value")).select("menu", F.lit("mean_corr").alias("measure"), "value")
    means = placed.groupBy("menu", "series").agg(F.avg("ret").alias("m")).groupBy("menu").agg(F.stddev_samp("m").alias("value")).select("menu", F.lit("spread").alias("measure"), "value")
    sharpe = R.sharpe_of(_menu_race(placed), ("menu",))
    even = sharpe.filter("rule = '1/N'").select("menu", F.col("sharpe").alias("b"))
    gaps = sharpe.filter("rule <> '1/N'").join(even, "menu").select("menu", "rule", (F.col("sharpe") - F.col("b")).alias("gap"))
    return R.menu_study(pairs.unionAll(means), gaps)


#: Menus of two eras: the whole panel, it without each region, and it with two proxies; the names are era/menu.
_ERAS = {"all": "1990-01-31", "late": "1996-01-31"}
_ERA_MENUS = race_sql(
    " UNION ALL ".join(
        f"""SELECT '{e}/' || menu AS menu, series, region, factor, month, ret FROM rt, (VALUES ('none'), {", ".join(f"('{g}')" for g in _GROUPS)}) m(menu) WHERE ret IS NOT NULL AND menu <> region AND month >= DATE '{since}'
  UNION ALL SELECT '{e}/with assets', series, region, factor, month, ret FROM rt WHERE ret IS NOT NULL AND month >= DATE '{since}'
  UNION ALL SELECT '{e}/with assets', series, 'Asset', split_part(series, ' | ', 2), month, ret FROM px WHERE month IN (SELECT month FROM rt WHERE ret IS NOT NULL) AND month >= DATE '{since}'"""
        for e, since in _ERAS.items()
    )
)
_PX = """, px AS (SELECT * FROM (SELECT CASE indicator WHEN 'unit_price' THEN 'Asset | Gold' ELSE 'Asset | Cash (T-bill)' END AS series, month, value / lag(value) OVER (PARTITION BY indicator ORDER BY month) - 1 AS ret FROM ind
  WHERE indicator IN ('unit_price', 'avg_total') AND month < DATE '2001-11-30') WHERE ret IS NOT NULL)"""
_RECONCILED = f"""{_PX}{_ERA_MENUS},
ax AS (SELECT menu, series, pos, ret - avg(ret) OVER (PARTITION BY menu, series) AS x FROM ps),
am AS (SELECT a.menu, a.series AS i, b.series AS j, count(*) AS n, avg(a.x * b.x) AS c, avg(a.x * a.x * b.x * b.x) AS m22, avg(a.x * a.x * a.x * b.x) AS m31 FROM ax a JOIN ax b ON a.menu = b.menu AND a.pos = b.pos GROUP BY ALL),
a1 AS (SELECT am.*, a.c AS vi, b.c AS vj, sqrt(a.c * b.c) AS root FROM am JOIN am a ON a.menu = am.menu AND a.i = am.i AND a.j = am.i JOIN am b ON b.menu = am.menu AND b.i = am.j AND b.j = am.j),
ar2 AS (SELECT menu, avg(c / root) FILTER (WHERE i < j) AS mean_corr, min(c / root) FILTER (WHERE i < j) AS min_corr, count(*) FILTER (WHERE i = j) AS n_series FROM a1 GROUP BY menu),
a2 AS (SELECT a1.*, mean_corr AS r, CASE WHEN i = j THEN vi ELSE mean_corr * root END AS f, m22 - c * c AS pi, CASE WHEN i = j THEN 0 ELSE sqrt(vj / vi) * (m31 - vi * c) END AS th FROM a1 JOIN ar2 USING (menu)),
a3 AS (SELECT menu, least(1, greatest(0, (sum(pi) - sum(pi) FILTER (WHERE i = j) - max(r) * sum(th)) / sum((c - f) * (c - f)) / max(n))) AS delta FROM a2 GROUP BY menu),
a4 AS (SELECT menu, pow(sum(CASE WHEN i = j THEN sqrt(c) END), 2) / sum(delta * f + (1 - delta) * c) AS dr2 FROM a2 JOIN a3 USING (menu) GROUP BY menu),
ag AS (SELECT a.menu, a.rule, a.m / a.s - b.m / b.s AS d FROM (SELECT menu, rule, avg(net) AS m, stddev_pop(net) AS s, count(*) AS n FROM rr GROUP BY ALL HAVING count(*) >= 24) a JOIN (SELECT menu, rule, avg(net) AS m, stddev_pop(net) AS s FROM rr GROUP BY ALL) b ON b.menu = a.menu AND b.rule = '1/N' AND a.rule <> '1/N'),
me AS (UNPIVOT (SELECT menu, CAST(n_series AS DOUBLE) AS n_series, mean_corr, min_corr, 1 / mean_corr AS inv_mean_corr, dr2 FROM ar2 JOIN a4 USING (menu)) ON n_series, mean_corr, min_corr, inv_mean_corr, dr2 INTO NAME measure VALUE value)"""


def _reconciled(s, d) -> tuple[DataFrame, DataFrame]:
    """Measures and races' gaps of every menu of both eras; the menus of all eras are keys of one race."""
    p = panel(s, d).filter("ret IS NOT NULL").select("series", "region", "factor", "month", "ret")
    name = F.when(F.col("indicator") == "unit_price", "Asset | Gold").otherwise("Asset | Cash (T-bill)")
    own = X.indicators(s, d).filter("indicator IN ('unit_price', 'avg_total') AND month < '2001-11-30'").select(name.alias("series"), "month", F.col("value").alias("level"))
    proxies = P.split_key(P.returns(own)).filter("ret IS NOT NULL")
    menus = R.drop_groups(p, _GROUPS).unionByName(P.append_proxies(p, proxies).withColumn("menu", F.lit("with assets")))
    eras = [menus.filter(F.col("month") >= F.lit(since).cast("date")).withColumn("menu", F.concat(F.lit(f"{e}/"), "menu")) for e, since in _ERAS.items()]
    placed = placed_of(s, d, ("menu",), eras[0].unionByName(eras[1]))
    return R.menu_measures(placed, ("menu",)), R.menu_gaps(_menu_race(placed), ("menu",), replicates=0)


@query(f"{_RECONCILED} SELECT split_part(menu, '/', 1) AS era, split_part(menu, '/', 2) AS menu, measure, {_r('value')} FROM (SELECT * FROM me UNION ALL SELECT menu, 'gap of ' || rule, d * sqrt(12.0) FROM ag)", macro=True)
def menu_reconciliation(s, d):
    """Every menu's measures and the rules' gaps to 1/N, by era."""
    measures, gaps = _reconciled(s, d)
    both = measures.unionByName(gaps.filter("gap IS NOT NULL").select("menu", F.concat(F.lit("gap of "), "rule").alias("measure"), F.col("gap").alias("value")))
    parts = F.split("menu", "/")
    return both.select(parts[0].alias("era"), parts[1].alias("menu"), "measure", "value")


@query(
    f"""{_RECONCILED}, sc2 AS (SELECT split_part(menu, '/', 1) AS era, scope, rule, measure, value, d FROM me JOIN ag USING (menu), (VALUES ('all menus'), ('equity menus')) s(scope) WHERE (scope = 'all menus' OR menu NOT LIKE '%assets') AND measure IN ('dr2', 'mean_corr')),
  rk AS (SELECT *, rank() OVER (PARTITION BY era, scope, rule, measure ORDER BY round(value, 12)) + (count(*) OVER (PARTITION BY era, scope, rule, measure, round(value, 12)) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY era, scope, rule, measure ORDER BY round(d * sqrt(12.0), 12)) + (count(*) OVER (PARTITION BY era, scope, rule, measure, round(d * sqrt(12.0), 12)) - 1) / 2.0 AS ry FROM sc2)
  SELECT era, scope, rule, measure, n, {_r("rho AS spearman", _SPEARMAN_P)} FROM (SELECT era, scope, rule, measure, count(*) AS n, corr(rx, ry) AS rho FROM rk GROUP BY ALL)""",
    macro=True,
)
def menu_spearman(s, d):
    """Does a rule's gap go with a menu's bets or correlation, by era and with or without the menus that hold assets?"""
    measures, gaps = _reconciled(s, d)
    scope = F.explode(F.when(F.col("menu").endswith("assets"), F.array(F.lit("all menus"))).otherwise(F.array(F.lit("all menus"), F.lit("equity menus"))))
    keyed = measures.filter("measure IN ('dr2', 'mean_corr')").withColumn("era", F.split("menu", "/")[0]).withColumn("scope", scope)
    return R.menu_study(keyed, gaps.withColumn("era", F.split("menu", "/")[0]).withColumn("scope", scope), ("era", "scope"))


_CORRELATED = f"""{_RACE} SELECT rr.rule AS series, region, count(*) AS n, {_r("corr(net, ret) AS corr")} FROM rr JOIN (SELECT region, month, ret FROM rt WHERE factor = 'Reference' AND ret IS NOT NULL) USING (month) GROUP BY ALL"""


@query(_CORRELATED)
def region_correlations(s, d):
    """Every rule with every region's Reference."""
    return R.region_correlations(race_of(s, d)[3].select(F.col("rule").alias("series"), "month", F.col("net").alias("ret")), panel(s, d))


_EVEN = "SELECT '{}' AS estimator, {} FROM (SELECT *, count(*) FILTER (WHERE i = j) OVER () AS k FROM {})"


@query(
    f"""{_MOMENTS}, ts AS (SELECT avg(c) FILTER (WHERE i = j) AS m, (sum(c * c) - count(*) FILTER (WHERE i = j) * pow(avg(c) FILTER (WHERE i = j), 2)) / count(*) FILTER (WHERE i = j) AS d2, (sum(m22) - sum(c * c)) / (max(n) * count(*) FILTER (WHERE i = j)) AS b2 FROM mo),
  id2 AS (SELECT i, j, n, CASE WHEN d2 > 0 THEN least(b2, d2) / d2 ELSE 0 END AS delta, c, m FROM mo, ts), e2 AS (SELECT i, j, n, delta, delta * CASE WHEN i = j THEN m ELSE 0 END + (1 - delta) * c AS cov FROM id2), e3 AS (SELECT i, j, n, 0.0 AS delta, cs AS cov FROM mo)
  {" UNION ALL ".join(_EVEN.format(n, _r("max(delta) AS delta", "sqrt(sum(cov) * 12) / max(k) AS ann_vol"), t) for n, t in (("constant_correlation", "sk"), ("identity", "e2"), ("sample", "e3")))}"""
)
def estimator_switch(s, d):
    """The volatility of equal weights by each estimator."""
    pairs = settled(V.covariance_pairs(panel(s, d)))
    vol = F.sqrt(F.sum("cov") * 12) / F.count_if(F.col("i") == F.col("j"))
    return reduce(DataFrame.unionByName, [V.estimate(pairs, e).agg(F.max("delta").alias("delta"), vol.alias("ann_vol")).withColumn("estimator", F.lit(e)) for e in V.ESTIMATORS])


@query(f"{_RACE} SELECT rule, strftime(m.month, '%Y-%m-%d') AS month, h.series, {_r('h.w AS w')} FROM (SELECT DISTINCT month FROM ps) m JOIN (SELECT ws.*, q.month AS start FROM ws JOIN sd USING (menu, refit) JOIN (SELECT DISTINCT pos, month FROM ps) q ON pos = hi + 1 WHERE rule = 'Momentum') h ON start = (SELECT max(month) FROM sd JOIN (SELECT DISTINCT pos, month FROM ps) ON pos = hi + 1 WHERE month <= m.month)")
def weights_held(s, d):
    placed = placed_of(s, d)
    schedule = schedule_of(placed)
    return R.held_at(R.momentum_at_refits(placed, schedule), schedule, placed)


@query(
    f"""{_RACE}, g1 AS (SELECT rr.month, gross AS ret, cash, turnover FROM rr JOIN {_CASH} USING (month) WHERE rule = '1/N'),
  ex AS (SELECT *, CASE WHEN k >= 6 AND vol > 0 THEN least(1.0, 0.03 / vol) ELSE 1.0 END AS exposure FROM (SELECT *, stddev_samp(ret) OVER w * sqrt(12.0) AS vol, count(*) OVER w AS k FROM g1 WINDOW w AS (ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)))
  SELECT '1/N + vol-target' AS rule, {_d("month")}, {_r("exposure * ret + (1 - exposure) * cash AS gross", "turnover + coalesce(abs(exposure - lag(exposure) OVER (ORDER BY month)), 0) AS turnover")} FROM ex"""
)
def overlay_race(s, d):
    """A volatility target on the equal-weight race; it pays its base's turnover and its own."""
    race = race_of(s, d)[3].filter("rule = '1/N'")
    base = race.select(F.concat("rule", F.lit(" + vol-target")).alias("series"), "month", F.col("gross").alias("ret"), F.col("turnover").alias("base"))
    over = A.vol_target(base, 0.03, cash=_cash(panel(s, d)))
    return over.select(F.col("series").alias("rule"), "month", F.col("managed").alias("gross"), (F.col("base") + F.col("turnover")).alias("turnover"))


# Rules that need a dense solve: no SQL; tested against closed forms and conditions of optimality.


def dense_race(s, d, estimator: str = "constant_correlation") -> tuple[DataFrame, DataFrame, DataFrame]:
    placed = placed_of(s, d)
    schedule = schedule_of(placed)
    return placed, schedule, settled(R.fit_weights(placed, schedule, tuple(dense.RULES), estimator=estimator))


@query(None)
def fit_weights(s, d):
    return dense_race(s, d)[2]


@query(None)
def fit_weights_nonlinear(s, d):
    return dense_race(s, d, "nonlinear")[2]


@query(None)
def walk_forward_dense(s, d):
    placed, schedule, weights = dense_race(s, d)
    return R.race_summary(R.walk_forward(weights, placed, schedule))


@query(None)
def menu_diagnostics(s, d):
    """Bets that each menu without a region holds: correlations and independent bets by pairs, the spectrum from each menu's correlation matrix, all on the shrunk covariance."""
    placed = placed_of(s, d, ("menu",), R.drop_groups(panel(s, d), _GROUPS))
    cov = settled(V.shrink_constant_correlation(V.covariance_pairs(placed, ("menu",), complete=False), ("menu",)))
    sd = cov.filter("i = j").select("menu", "i", F.sqrt("cov").alias("sd"))
    corr = settled(cov.join(sd, ["menu", "i"]).join(sd.withColumnsRenamed({"i": "j", "sd": "sd_j"}), ["menu", "j"]).select("menu", "i", "j", (F.col("cov") / F.col("sd") / F.col("sd_j")).alias("corr"), "cov", "sd"))
    off = F.when(F.col("i") != F.col("j"), F.col("corr"))
    own = F.when(F.col("i") == F.col("j"), F.col("sd"))
    bets = corr.groupBy("menu").agg(F.count(own).alias("n_series"), F.avg(off).alias("mean_corr"), F.min(off).alias("min_corr"), (F.pow(F.sum(own), 2) / F.sum("cov")).alias("dr2_equal"))

    def shares(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        share = dense.spectrum(cells.pivot(index="i", columns="j", values="corr").to_numpy())
        some = share[share > 1e-12]
        return pd.DataFrame({"menu": [key[0]], "pc1_share": share[0], "n_pcs_90": int((share.cumsum() < 0.9).sum()) + 1, "entropy_bets": np.exp(-some @ np.log(some))})

    found = corr.select("menu", "i", "j", "corr").groupBy("menu").applyInPandas(shares, "menu string, pc1_share double, n_pcs_90 bigint, entropy_bets double")
    return bets.join(found, "menu").select("menu", "n_series", "mean_corr", "min_corr", "pc1_share", "n_pcs_90", "entropy_bets", "dr2_equal")


@query(None)
def implied_and_posterior(s, d):
    """Implied and posterior monthly returns of each menu's series, with one view: the first series over the last, at its own mean gap."""
    placed = placed_of(s, d, ("menu",), R.drop_groups(panel(s, d), _GROUPS[:2]))

    def blend(series: list[str], x: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
        anchor = dense.risk_budgets(cov)
        pi, _ = dense.implied_returns(cov, anchor, float((x @ anchor).mean()))
        view = np.zeros((1, len(series)))
        view[0, 0], view[0, -1] = 1.0, -1.0
        after = dense.posterior(pi, cov, len(x), view, view @ x.mean(axis=0), np.array([0.5]))
        return pd.DataFrame({"series": series, "anchor": anchor, "implied": pi, "posterior": after})

    return R.by_matrix(placed, ("menu",), blend, "series string, anchor double, implied double, posterior double")


@query(
    f"""{_LOO}, dx2 AS (SELECT menu, series, pos, ret - avg(ret) OVER (PARTITION BY menu, series) AS x FROM ps),
  mo2 AS (SELECT a.menu, a.series AS i, b.series AS j, count(*) AS n, avg(a.x * b.x) AS c, avg(a.x * a.x * b.x * b.x) AS m22, avg(a.x * a.x * a.x * b.x) AS m31 FROM dx2 a JOIN dx2 b ON a.menu = b.menu AND a.pos = b.pos GROUP BY ALL),
  p1 AS (SELECT mo2.*, a.c AS vi, b.c AS vj, sqrt(a.c * b.c) AS root FROM mo2 JOIN mo2 a ON a.menu = mo2.menu AND a.i = mo2.i AND a.j = mo2.i JOIN mo2 b ON b.menu = mo2.menu AND b.i = mo2.j AND b.j = mo2.j),
  p2 AS (SELECT p1.*, r, CASE WHEN i = j THEN vi ELSE r * root END AS f, m22 - c * c AS pi, CASE WHEN i = j THEN 0 ELSE sqrt(vj / vi) * (m31 - vi * c) END AS th FROM p1 JOIN (SELECT menu, avg(c / root) FILTER (WHERE i <> j) AS r FROM p1 GROUP BY menu) USING (menu)),
  dl AS (SELECT menu, least(1, greatest(0, (sum(pi) - sum(pi) FILTER (WHERE i = j) - max(r) * sum(th)) / sum((c - f) * (c - f)) / max(n))) AS delta FROM p2 GROUP BY menu),
  sk AS (SELECT menu, i, j, delta, delta * f + (1 - delta) * c AS cov FROM p2 JOIN dl USING (menu))
  SELECT menu, CAST(count(*) FILTER (WHERE i = j) AS BIGINT) AS n, {_r("max(delta) AS delta", "pow(sum(CASE WHEN i = j THEN sqrt(cov) END), 2) / sum(cov) AS dr2")} FROM sk GROUP BY menu"""
)
def menu_dr2(s, d):
    """Shrinkage and independent bets of equal weights for every menu at once."""
    placed = placed_of(s, d, ("menu",), R.drop_groups(panel(s, d), _GROUPS))
    cov = V.shrink_constant_correlation(V.covariance_pairs(placed, ("menu",), complete=False), ("menu",))
    own = F.when(F.col("i") == F.col("j"), F.sqrt("cov"))
    return cov.groupBy("menu").agg(F.count(own).alias("n"), F.max("delta").alias("delta"), (F.pow(F.sum(own), 2) / F.sum("cov")).alias("dr2"))
