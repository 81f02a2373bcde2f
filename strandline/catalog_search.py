"""Queries on candidate portfolios, nearest past months and the outlook's record, with the same rows in SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _d, _r, panel, query
from .catalog_exposure import _EXPOSURE, _MOMENTS, _covariance
from .catalog_states import _STATES, _states
from .operators import history as H
from .operators import panel as P
from .operators import search as S
from .plans import fixtures as X
from .plans.scratch import settled

_SERIES = [f"ASIA | {f}" for f in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Reference")]
_PARTS = 4
_IMPORTANCE = {"return": 6.0, "risk": 2.0, "diversification": 4.0}

_DEALT = ", ".join(f"range({_PARTS + 1}) r{i}(n{i})" for i in range(5))
_CAND = f"""ca AS (SELECT concat_ws('-', {", ".join(f"n{i}" for i in range(5))}) AS portfolio, unnest([{", ".join(f"'{s}'" for s in _SERIES)}]) AS series, unnest([{", ".join(f"n{i}" for i in range(5))}]) / {_PARTS}.0 AS weight
  FROM {_DEALT} WHERE {" + ".join(f"n{i}" for i in range(5))} = {_PARTS}), cw AS (SELECT portfolio, series, CAST(weight AS DOUBLE) AS weight FROM ca WHERE weight > 0)"""


@query(f", {_CAND} SELECT portfolio, series, {_r('weight')} FROM cw WHERE series IN (SELECT series FROM rt)")
def compositions(s, d):
    return S.compositions(s, _SERIES, _PARTS).join(panel(s, d).select("series").distinct(), "series", "left_semi")


_SCORED = f"""{_STATES}{_MOMENTS}{_EXPOSURE[_EXPOSURE.index(", sl AS") : _EXPOSURE.index("xp AS")].rstrip().rstrip(",")}, {_CAND},
cg AS (SELECT portfolio, sum(weight * m) AS g FROM cw JOIN (SELECT series, avg(ret) AS m FROM rt WHERE ret IS NOT NULL GROUP BY series) USING (series) GROUP BY portfolio),
cr2 AS (SELECT a.portfolio, -sqrt(sum(a.weight * sk.cov * b.weight)) * sqrt(12.0) AS r FROM cw a JOIN sk ON sk.i = a.series JOIN cw b ON b.portfolio = a.portfolio AND b.series = sk.j GROUP BY a.portfolio),
cd AS (SELECT portfolio, exp(avg(-ln(h))) AS b FROM (SELECT portfolio, dim, sum(p * p) / 10000 AS h FROM (SELECT portfolio, dim, category, sum(weight * weight_pct) AS p FROM cw JOIN lt USING (series) GROUP BY ALL) GROUP BY ALL) GROUP BY portfolio),
cf2 AS (SELECT portfolio, min(m) AS f FROM (SELECT portfolio, state, sum(weight * mean_ret) AS m FROM (SELECT *, count(*) OVER (PARTITION BY portfolio) AS nh FROM cw) JOIN sp USING (series) GROUP BY portfolio, state HAVING count(*) = max(nh)) GROUP BY portfolio),
cv2 AS (SELECT portfolio, g AS "return", r AS risk, b AS diversification, f AS floor, {", ".join(f"100 * ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS score_{n}" for c, n in (("g", "return"), ("r", "risk"), ("b", "diversification"), ("f", "floor")))}
  FROM cg JOIN cr2 USING (portfolio) JOIN cd USING (portfolio) JOIN cf2 USING (portfolio)),
ct2 AS (SELECT *, 6 / 12.0 * score_return + 2 / 12.0 * score_risk + 4 / 12.0 * score_diversification AS total FROM cv2)"""
_SCORES = _r('"return"', "risk", "diversification", "floor", "score_return", "score_risk", "score_diversification", "score_floor", "total")


def _scores(s, d):
    p, candidates = panel(s, d), settled(S.compositions(s, _SERIES, _PARTS))
    means = p.filter("ret IS NOT NULL").groupBy("series").agg(F.avg("ret").alias("mean_ret"))
    scores = S.candidate_scores(candidates, means, _covariance(s, d), X.look_through(s, d), H.state_means(p, _states(s, d)), _IMPORTANCE)
    return candidates, settled(scores)


@query(f"{_SCORED} SELECT portfolio, {_SCORES} FROM ct2", macro=True)
def candidate_scores(s, d):
    return _scores(s, d)[1]


#: Half of a portfolio in a series at most, and three quarters in a group of factors.
_GROUPED = ["MACHINERY", "FURNITURE"]
_ALLOWED = f"""al AS (SELECT portfolio, max(weight) = 0.5 OR max(gh) = 0.75 AS at_cap FROM (SELECT portfolio, series, weight, greatest(sum(CASE WHEN split_part(series, ' | ', 2) IN ('MACHINERY', 'FURNITURE') THEN weight ELSE 0 END) OVER p, sum(CASE WHEN split_part(series, ' | ', 2) NOT IN ('MACHINERY', 'FURNITURE') THEN weight ELSE 0 END) OVER p) AS gh
  FROM cw WINDOW p AS (PARTITION BY portfolio)) GROUP BY portfolio HAVING max(weight) <= 0.5 AND max(gh) <= 0.75)"""


def _allowed(s, candidates):
    group = F.when(F.split("series", r" \| ", 2)[1].isin(*_GROUPED), "goods").otherwise("rest")
    groups = candidates.select("series").distinct().select("series", F.lit("kind").alias("dim"), group.alias("category"), F.lit(1.0).alias("share"))
    return S.within_caps(candidates, {"series": 0.5, "kind": 0.75}, groups)


@query(f"{_SCORED}, {_ALLOWED} SELECT portfolio, {_SCORES}, at_cap FROM ct2 JOIN al USING (portfolio) ORDER BY round(total, 12) DESC, portfolio LIMIT 1", macro=True)
def pick_candidate(s, d):
    candidates, scores = _scores(s, d)
    return S.pick_candidate(scores, _allowed(s, candidates))


@query(f"{_SCORED}, {_ALLOWED} SELECT portfolio, {_SCORES}, at_cap FROM ct2 JOIN al USING (portfolio) WHERE risk >= -0.9 ORDER BY round(floor, 12) DESC, portfolio LIMIT 1", macro=True)
def pick_maximin(s, d):
    candidates, scores = _scores(s, d)
    return S.pick_candidate(scores, _allowed(s, candidates), "floor", {"risk": -0.9})


#: Growth and the deepest fall of every candidate at constant weights, on the panel's complete months.
_PATHS = """cp0 AS (SELECT portfolio, month, sum(weight * ret) AS r FROM cw JOIN rc USING (series) GROUP BY ALL), cp1 AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY portfolio ORDER BY month)) AS v FROM cp0),
cp2 AS (SELECT portfolio, pow(arg_max(v, month), 12.0 / count(*)) - 1 AS cagr, min(dd) AS max_drawdown FROM (SELECT *, v / max(v) OVER (PARTITION BY portfolio ORDER BY month) - 1 AS dd FROM cp1) GROUP BY portfolio)"""


def _paths(s, d, candidates):
    return S.candidate_paths(candidates, P.complete_months(panel(s, d), "ret"))


@query(f", {_CAND}, {_PATHS} SELECT portfolio, {_r('cagr', 'max_drawdown')} FROM cp2")
def candidate_paths(s, d):
    return _paths(s, d, S.compositions(s, _SERIES, _PARTS))


_TARGETED = "SELECT portfolio, {}, at_cap, {} FROM ct2 JOIN al USING (portfolio) JOIN cp2 USING (portfolio) WHERE {} ORDER BY round({}, 12) DESC, portfolio LIMIT 1"


def _pick(s, d, by, least):
    candidates, scores = _scores(s, d)
    return S.pick_candidate(scores, _allowed(s, candidates), by, least, _paths(s, d, candidates))


@query(f"{_SCORED}, {_ALLOWED}, {_PATHS} {_TARGETED.format(_SCORES, _r('cagr', 'max_drawdown'), 'max_drawdown >= -0.6001', 'total')}", macro=True)
def pick_within_drawdown(s, d):
    """No candidate that ever fell by more than 60 %."""
    return _pick(s, d, "total", {"max_drawdown": -0.6})


@query(f"{_SCORED}, {_ALLOWED}, {_PATHS} {_TARGETED.format(_SCORES, _r('cagr', 'max_drawdown'), 'cagr >= -0.0201 AND max_drawdown >= -0.7501', 'floor')}", macro=True)
def pick_by_two_targets(s, d):
    """The best worst state among candidates that meet a target of growth and one of drawdown."""
    return _pick(s, d, "floor", {"cagr": -0.02, "max_drawdown": -0.75})


# Presets: two menus, each with scores, groupings and caps of its own.

_MENUS = {"ASIA": _SERIES, "EUROPE": [n.replace("ASIA", "EUROPE") for n in _SERIES]}
_PRESETS = [("growth", "ASIA", "total", 6, 2, 4, 0), ("balanced", "ASIA", "total", 4, 4, 4, 0), ("with floor", "EUROPE", "total", 4, 2, 2, 6), ("defensive", "EUROPE", "floor", 0, 0, 0, 1), ("free", "EUROPE", "total", 6, 2, 4, 0), ("narrow", "ASIA", "total", 6, 2, 4, 0), ("empty", "ASIA", "floor", 0, 0, 0, 1)]
_CAPS = [("growth", "series", 0.5), ("growth", "zone", 0.55), ("growth", "kind", 0.75), ("balanced", "series", 0.5), ("balanced", "kind", 0.5), ("with floor", "zone", 0.5), ("defensive", "series", 0.25), ("defensive", "kind", 0.75), ("narrow", "series", 0.1), ("empty", "zone", 0.34), ("empty", "series", 0.25)]
_IN = f"split_part(series, ' | ', 2) IN ({', '.join(f"'{g}'" for g in _GROUPED)})"
_GROUPS_SQL = f"""gr AS (SELECT series, 'kind' AS dim, CASE WHEN {_IN} THEN 'goods' ELSE 'rest' END AS category, 1.0 AS share FROM (SELECT DISTINCT series FROM rt) UNION ALL
  SELECT series, 'zone', CASE WHEN CAST(right(category, 1) AS INTEGER) % 3 = 0 THEN 'zone 0' WHEN CAST(right(category, 1) AS INTEGER) % 3 = 1 THEN 'zone 1' ELSE 'zone 2' END, sum(weight_pct) / 100 FROM lt WHERE dim = 'country' GROUP BY 1, 2, 3)"""


def _menu_sql(menu: str) -> str:
    """The candidates and scores of a menu, its tables named by the menu."""
    own = _SCORED[_SCORED.index(_CAND) :].replace("'ASIA | ", f"'{menu} | ")
    return re.sub(r"\b(ca|cw|cg|cr2|cd|cf2|cv2|ct2)\b", rf"\1_{menu}", own)


_EVERY = " UNION ALL ".join(f"SELECT '{m}' AS menu, * FROM {{0}}_{m}" for m in _MENUS)
_PROFILES = f"""{_SCORED[: _SCORED.index(_CAND)]}{", ".join(_menu_sql(m) for m in _MENUS)}, {_GROUPS_SQL}, cw AS ({_EVERY.format("cw")}), ct2 AS ({_EVERY.format("ct2")}),
ps0 AS (SELECT * FROM (VALUES {", ".join(map(str, _PRESETS))}) p(preset, menu, objective, i1, i2, i3, i4)), cb AS (SELECT preset, dim, min(cap) AS cap FROM (SELECT * FROM (VALUES {", ".join(map(str, _CAPS))}) c(preset, dim, cap) UNION ALL SELECT preset, 'series', 1.0 FROM ps0) GROUP BY ALL),
ho AS (SELECT menu, portfolio, 'series' AS dim, series AS category, weight AS held FROM cw UNION ALL SELECT menu, portfolio, dim, category, sum(weight * share) FROM cw JOIN gr USING (series) GROUP BY ALL),
rm AS (SELECT preset, menu, portfolio, min(cap - held) AS room FROM (SELECT menu, portfolio, dim, max(held) AS held FROM ho GROUP BY ALL) JOIN cb USING (dim) JOIN ps0 USING (preset, menu) GROUP BY ALL HAVING min(cap - held) >= -1e-9),
vl AS (SELECT preset, menu, objective, portfolio, round(CASE WHEN objective = 'floor' THEN "floor" ELSE (i1 * score_return + i2 * score_risk + i3 * score_diversification + i4 * score_floor) / (i1 + i2 + i3 + i4) END, 12) AS v, room FROM ct2 JOIN ps0 USING (menu) LEFT JOIN rm USING (preset, menu, portfolio)),
bd AS (SELECT preset, menu, 'caps below 100 %: ' || string_agg(dim, ', ' ORDER BY dim) AS problem FROM cb JOIN ps0 USING (preset) JOIN (SELECT menu, dim, count(DISTINCT category) AS n FROM ho GROUP BY ALL) USING (menu, dim) WHERE cap * n < 1 - 1e-9 GROUP BY ALL)"""


def menu_groups(s, d):
    """Two kinds of factors, and three zones of countries by the share that each series has of them."""
    series = panel(s, d).select("series").distinct()
    kind = F.when(F.split("series", r" \| ", 2)[1].isin(*_GROUPED), "goods").otherwise("rest")
    zone = F.concat(F.lit("zone "), F.substring("category", -1, 1).cast("int") % 3)
    zones = X.look_through(s, d).filter("dim = 'country'").groupBy("series", zone.alias("category")).agg((F.sum("weight_pct") / 100).alias("share"))
    return series.select("series", F.lit("kind").alias("dim"), kind.alias("category"), F.lit(1.0).alias("share")).unionByName(zones.withColumn("dim", F.lit("zone")))


def menu_candidates(s) -> DataFrame:
    return reduce(DataFrame.unionByName, [S.compositions(s, names, _PARTS).withColumn("menu", F.lit(m)) for m, names in _MENUS.items()])


@query(
    f"""{_PROFILES} SELECT preset, menu, objective, arg_min(portfolio, struct_pack(v := -v, p := portfolio)) FILTER (WHERE room IS NOT NULL) AS best, round(max(v) FILTER (WHERE room IS NOT NULL), 6) + 0.0 AS value, arg_min(portfolio, struct_pack(v := -v, p := portfolio)) AS twin, round(max(v), 6) + 0.0 AS twin_value,
  round(max(v) - max(v) FILTER (WHERE room IS NOT NULL), 6) + 0.0 AS price, arg_min(room <= 1e-9, struct_pack(v := -v, p := portfolio)) FILTER (WHERE room IS NOT NULL) AS at_cap,
  coalesce(max(problem), CASE WHEN max(v) FILTER (WHERE room IS NOT NULL) IS NULL THEN 'no candidate inside the caps' END) AS problem FROM vl LEFT JOIN bd USING (preset, menu) WHERE v IS NOT NULL GROUP BY preset, menu, objective""",
    macro=True,
)
def profiles(s, d):
    p, candidates = panel(s, d), settled(menu_candidates(s))
    means = settled(p.filter("ret IS NOT NULL").groupBy("series").agg(F.avg("ret").alias("mean_ret")))
    cov, lookup, states = _covariance(s, d), settled(X.look_through(s, d)), settled(H.state_means(p, _states(s, d)))
    scores = [S.candidate_scores(candidates.filter(F.col("menu") == m).drop("menu"), means, cov, lookup, states, _IMPORTANCE).withColumn("menu", F.lit(m)) for m in _MENUS]
    presets = s.createDataFrame([(*r[:3], *map(float, r[3:])) for r in _PRESETS], "preset string, menu string, objective string, " + ", ".join(f"importance_{c} double" for c in S.OBJECTIVES))
    caps = s.createDataFrame(_CAPS, "preset string, dim string, cap double")
    return S.profiles(settled(reduce(DataFrame.unionByName, scores)), presets, caps, candidates, settled(menu_groups(s, d)))


_FEATURES = """, af AS (SELECT *, vg - lag(vg, 3) OVER o AS ag, vi - lag(vi, 3) OVER o AS ai FROM (SELECT month, state, growth_score AS g, inflation_score AS i, row_number() OVER o AS pos, (growth_score - lag(growth_score, 6) OVER o) / 6 AS vg,
  (inflation_score - lag(inflation_score, 6) OVER o) / 6 AS vi, lead(state, 3) OVER o AS outcome FROM st WINDOW o AS (ORDER BY month)) WINDOW o AS (ORDER BY month)),
ak AS (SELECT * FROM af WHERE ag IS NOT NULL), asd AS (SELECT stddev_pop(g) AS s1, stddev_pop(i) AS s2, stddev_pop(vg) AS s3, stddev_pop(vi) AS s4, stddev_pop(ag) AS s5, stddev_pop(ai) AS s6 FROM ak),
an AS (SELECT * FROM (SELECT a.month, b.month AS analog, b.outcome, d AS distance, row_number() OVER (PARTITION BY a.month ORDER BY round(d, 9), b.pos) AS rank FROM ak a JOIN ak b ON abs(a.pos - b.pos) > 6 AND b.outcome IS NOT NULL, asd,
  LATERAL (SELECT sqrt(pow((a.g - b.g) / s1, 2) + pow((a.i - b.i) / s2, 2) + pow((a.vg - b.vg) / s3, 2) + pow((a.vi - b.vi) / s4, 2) + pow((a.ag - b.ag) / s5, 2) + pow((a.ai - b.ai) / s6, 2)) AS d)) WHERE rank <= 20)"""


@query(f"{_STATES}{_FEATURES} SELECT {_d('month')}, rank, strftime(analog, '%Y-%m-%d') AS analog, {_r('distance')}, outcome FROM an", macro=True)
def analogs(s, d):
    return S.analogs(settled(_states(s, d)))


@query(f"{_STATES}{_FEATURES} SELECT {_d('month')}, outcome AS state, {_r('count(*) / max(k) AS p')} FROM (SELECT *, count(*) OVER (PARTITION BY month) AS k FROM an) GROUP BY month, outcome", macro=True)
def analog_outlook(s, d):
    return S.analog_outlook(S.analogs(settled(_states(s, d))))


#: The nearest months known at t: deviations so far, outcomes seen by then.
_ASOF = """, akk AS (SELECT *, """ + ", ".join(f"coalesce(nullif(stddev_samp({c}) OVER (ORDER BY pos), 0), 1) AS s{i}" for i, c in enumerate(("g", "i", "vg", "vi", "ag", "ai"))) + """ FROM ak),
an2 AS (SELECT * FROM (SELECT a.pos AS t, b.pos AS u, b.outcome, d AS distance, row_number() OVER (PARTITION BY a.pos ORDER BY round(d, 9), b.pos) AS rank, count(*) OVER (PARTITION BY a.pos) AS k FROM akk a JOIN ak b ON b.pos <= a.pos - 3,
  LATERAL (SELECT sqrt(pow((a.g - b.g) / s0, 2) + pow((a.i - b.i) / s1, 2) + pow((a.vg - b.vg) / s2, 2) + pow((a.vi - b.vi) / s3, 2) + pow((a.ag - b.ag) / s4, 2) + pow((a.ai - b.ai) / s5, 2)) AS d)) WHERE rank <= 20 AND k >= 12)"""


@query(f"{_STATES}{_FEATURES}{_ASOF} SELECT CAST(t AS INTEGER) AS t, CAST(rank AS INTEGER) AS rank, CAST(u AS INTEGER) AS u, {_r('distance')}, outcome FROM an2", macro=True)
def asof_analogs(s, d):
    return S.asof_analogs(settled(_states(s, d)))


@query(
    f"""{_STATES}{_FEATURES}{_ASOF}, bk2 AS (SELECT month, state, row_number() OVER (ORDER BY month) AS t, lead(state) OVER (ORDER BY month) AS nx, lead(state, 3) OVER (ORDER BY month) AS outcome FROM st),
  mo3 AS (SELECT pos AS t, CASE WHEN g + 3 * vg > 0 AND i + 3 * vi > 0 THEN 'Reflation' WHEN i + 3 * vi > 0 THEN 'Stagflation' WHEN g + 3 * vg > 0 THEN 'Goldilocks' ELSE 'Deflationary bust' END AS a FROM af WHERE vg IS NOT NULL),
  sh2 AS (SELECT t, outcome AS a, count(*) / sum(count(*)) OVER (PARTITION BY t) AS p FROM an2 GROUP BY t, outcome),
  ask AS (SELECT t, state, outcome FROM bk2 WHERE t > 24 AND outcome IS NOT NULL AND t IN (SELECT t FROM an2) AND t IN (SELECT t FROM mo3)),
  ch AS (SELECT t, a, b, n / sum(n) OVER (PARTITION BY t, a) AS q FROM (SELECT ask.t, m.state AS a, m.nx AS b, count(*) AS n FROM ask JOIN bk2 m ON m.t < ask.t AND m.nx IS NOT NULL GROUP BY ALL)),
  n1 AS (SELECT t, coalesce(b, a) AS a, sum(coalesce(q, 1)) AS p FROM (SELECT t, state AS a FROM ask) LEFT JOIN ch USING (t, a) GROUP BY 1, 2),
  n2 AS (SELECT t, coalesce(b, a) AS a, sum(p * coalesce(q, 1)) AS p FROM n1 LEFT JOIN ch USING (t, a) GROUP BY 1, 2),
  n3 AS (SELECT t, coalesce(b, a) AS a, sum(p * coalesce(q, 1)) AS p FROM n2 LEFT JOIN ch USING (t, a) GROUP BY 1, 2),
  fa AS (SELECT 'markov' AS method, t, a, p FROM n3 UNION ALL SELECT 'persistence', t, state, 1.0 FROM ask UNION ALL SELECT 'analog', t, a, p FROM sh2 UNION ALL SELECT 'momentum', t, a, 1.0 FROM mo3),
  fo AS (SELECT method, ask.t, state, outcome, name, coalesce(p, 0) AS p FROM ask CROSS JOIN sn CROSS JOIN (SELECT DISTINCT method FROM fa) LEFT JOIN fa USING (method, t) WHERE fa.a IS NULL OR fa.a = name
    UNION ALL SELECT m.method, ask.t, state, outcome, name, 0 FROM ask CROSS JOIN sn CROSS JOIN (SELECT DISTINCT method FROM fa) m WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.method = m.method AND fa.t = ask.t AND fa.a = name)),
  fm AS (SELECT method, t, state, outcome, sum(pow(p - CASE WHEN name = outcome THEN 1 ELSE 0 END, 2)) AS br, arg_max(name, struct_pack(p := round(p, 12), n := name)) AS call FROM fo GROUP BY ALL)
  SELECT method, count(*) AS n, {_r("avg(CASE WHEN call = outcome THEN 1.0 ELSE 0.0 END) AS hit_rate", "avg(br) AS brier")}, count(*) FILTER (WHERE state <> outcome) AS turns, {_r("avg(CASE WHEN call = outcome THEN 1.0 ELSE 0.0 END) FILTER (WHERE state <> outcome) AS turns_caught")} FROM fm GROUP BY method""",
    macro=True,
)
def outlook_backtest(s, d):
    return S.outlook_backtest(settled(_states(s, d)))
