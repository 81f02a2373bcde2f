"""Queries on the race under scrambled labels, with the same rows in SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog_history as L
from .catalog import _d, _r, panel, query
from .catalog_exposure import _EXPOSURE
from .catalog_inference import _HASH, _IID, _ST
from .catalog_race import race_sql, schedule_of
from .catalog_search import _GROUPS_SQL, menu_groups
from .catalog_states import _STATES, _states
from .operators import history as H
from .operators import inference as I
from .operators import maximin as X
from .operators import panel as P
from .operators import search as S
from .operators import walkforward as R
from .plans.scratch import settled

REPS = 40
BY, ARM = ("menu",), ("arm", "mode", "rep")
_FACTORS = ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Reference")
_EQUITY = [f"ASIA | {f}" for f in _FACTORS]
#: Menus and into how many equal parts a candidate is dealt: the region's series, and they with two proxies.
_MENUS = {"equity": (_EQUITY, 10), "assets": ([*_EQUITY, "Asset | Cash (T-bill)", "Asset | Gold"], 5)}
#: rule, menu, caps.
_RULES = [("Maximin", "equity", {}), ("Maximin capped", "equity", {"series": 0.3, "kind": 0.6, "zone": 0.5}), ("Maximin all-weather", "assets", {"series": 0.4, "kind": 0.8})]
_CAPS = [(rule, menu, dim, cap) for rule, menu, caps in _RULES for dim, cap in ({"series": 1.0} | caps).items()]


def _dealt_sql(menu: str) -> str:
    names, parts = _MENUS[menu]
    n = [f"n{i}" for i in range(len(names))]
    return f"""SELECT '{menu}' AS menu, portfolio, series, CAST(k / {parts}.0 AS DOUBLE) AS weight FROM (SELECT concat_ws('-', {", ".join(n)}) AS portfolio, unnest([{", ".join(f"'{x}'" for x in names)}]) AS series, unnest([{", ".join(n)}]) AS k
  FROM {", ".join(f"range({parts + 1}) r{i}({x})" for i, x in enumerate(n))} WHERE {" + ".join(n)} = {parts}) WHERE k > 0"""


_PANELS = f"""SELECT 'equity' AS menu, series, region, factor, month, ret FROM rt WHERE region = 'ASIA' AND ret IS NOT NULL UNION ALL SELECT 'assets', series, region, factor, month, ret FROM rt WHERE region = 'ASIA' AND ret IS NOT NULL
  UNION ALL SELECT 'assets', series, 'Asset', split_part(series, ' | ', 2), month, ret FROM px WHERE month IN (SELECT month FROM rt WHERE region = 'ASIA' AND ret IS NOT NULL)"""
_KEY = "menu, arm, mode, rep"
_LOOK = _EXPOSURE[_EXPOSURE.index(", sl AS") : _EXPOSURE.index("xp AS")].rstrip().rstrip(",")
_LABELS = f"""sa AS (SELECT 'real' AS arm, 'none' AS mode, -1 AS rep, month, state FROM st UNION ALL SELECT 'placebo', 'iid', CAST(rep AS INTEGER), month, state FROM sc2
  UNION ALL SELECT 'placebo', 'circular', CAST(rep AS INTEGER), b.month, a.state FROM ss0 a, range({REPS}) r(rep), ss0 b WHERE b.pos = (a.pos + 1 + {_HASH.format("'12345|' || rep")} % (a.n - 1)) % a.n)"""


def placebo_sql(adjust: str = "an0 AS (SELECT * FROM sm2)", modes: str = "true") -> str:
    """Tables of the placebo race: sm2 (training means), an0 (after an adjustment), pk3 (picks), w3 (weights), r3 (the race), rec (its record)."""
    return f"""{L._BASE}, {L._PRIORS}, {L._PROXIES}{_LOOK}{race_sql(_PANELS)}, {_ST}, {_IID.replace("range(20)", f"range({REPS})")}, {_LABELS}, {_GROUPS_SQL.replace("FROM (SELECT DISTINCT series FROM rt)", "FROM (SELECT DISTINCT series FROM ps)")},
cw3 AS ({" UNION ALL ".join(map(_dealt_sql, _MENUS))}),
ho3 AS (SELECT menu, portfolio, 'series' AS dim, series AS category, weight AS held FROM cw3 UNION ALL SELECT menu, portfolio, dim, category, sum(weight * share) FROM cw3 JOIN gr USING (series) GROUP BY ALL),
al3 AS (SELECT rule, menu, portfolio FROM (SELECT menu, portfolio, dim, max(held) AS held FROM ho3 GROUP BY ALL) JOIN (VALUES {", ".join(map(str, _CAPS))}) c(rule, menu, dim, cap) USING (menu, dim) GROUP BY ALL HAVING min(cap - held) >= -1e-9),
sm2 AS (SELECT {_KEY}, refit, state, series, avg(ret) AS m, count(*) AS n FROM sd JOIN ps USING (menu) JOIN sa USING (month) WHERE pos BETWEEN lo AND hi AND {modes} GROUP BY ALL HAVING count(*) >= 3), {adjust},
cv3 AS (SELECT {_KEY}, refit, portfolio, state, sum(weight * m) AS v FROM (SELECT *, count(*) OVER (PARTITION BY menu, portfolio) AS nh FROM cw3) JOIN an0 USING (menu, series) GROUP BY ALL HAVING count(*) = max(nh)),
fl3 AS (SELECT {_KEY}, refit, portfolio, min(v) AS floor FROM cv3 GROUP BY ALL HAVING count(*) >= 2),
pk3 AS (SELECT {_KEY}, rule, refit, arg_min(portfolio, struct_pack(v := -round(floor, 12), p := portfolio)) AS portfolio, arg_min(floor, struct_pack(v := -round(floor, 12), p := portfolio)) AS floor FROM fl3 JOIN al3 USING (menu, portfolio) GROUP BY ALL),
w3 AS (SELECT {_KEY}, rule, refit, series, weight AS w FROM pk3 JOIN cw3 USING (menu, portfolio) UNION ALL SELECT 'equity', arm, mode, rep, rule, refit, series, w FROM (SELECT DISTINCT arm, mode, rep, refit FROM pk3) JOIN ws USING (refit) WHERE menu = 'equity' AND rule = '1/N'),
rf3 AS (SELECT *, lag(refit) OVER (PARTITION BY {_KEY}, rule ORDER BY refit) AS prev FROM (SELECT DISTINCT {_KEY}, rule, refit FROM w3)),
tn3 AS (SELECT {_KEY}, rule, refit, CASE WHEN max(prev) IS NULL THEN 0 ELSE sum(abs(d)) / 2 END AS turn FROM (SELECT {_KEY}, rule, refit, prev, series, sum(w) AS d FROM (
  SELECT {_KEY}, rule, refit, prev, series, w FROM rf3 JOIN w3 USING ({_KEY}, rule, refit) UNION ALL SELECT {_KEY}, rule, rf3.refit, prev, series, -w FROM rf3 JOIN (SELECT {_KEY}, rule, refit AS prev, series, w FROM w3) USING ({_KEY}, rule, prev)) GROUP BY ALL) GROUP BY ALL),
r3 AS (SELECT {_KEY}, rule, refit, month, gross, turnover, gross - 0.001 * turnover AS net FROM (SELECT {_KEY}, rule, refit, month, sum(w * ret) AS gross, CASE WHEN max(pos) = max(hi) + 1 THEN max(turn) ELSE 0 END AS turnover
  FROM w3 JOIN tn3 USING ({_KEY}, rule, refit) JOIN sd USING (menu, refit) JOIN ps ON ps.menu = w3.menu AND ps.series = w3.series AND pos > hi AND pos <= hold_hi GROUP BY {_KEY}, rule, refit, month)),
rec AS (SELECT {_KEY}, rule, 'sharpe' AS metric, avg(net) / nullif(stddev_samp(net), 0) * sqrt(12.0) AS v FROM r3 GROUP BY ALL
  UNION ALL SELECT {_KEY}, rule, 'floor', min(m) FROM (SELECT {_KEY}, rule, state, avg(net) AS m FROM r3 JOIN st USING (month) GROUP BY ALL HAVING count(*) >= 3) GROUP BY {_KEY}, rule)"""


def _candidates(s) -> DataFrame:
    return settled(reduce(DataFrame.unionByName, [S.compositions(s, names, parts).withColumn("menu", F.lit(m)) for m, (names, parts) in _MENUS.items()]))


def _race(s, d, labels: DataFrame, adjust=None) -> DataFrame:
    """The race of all rules and 1/N on both menus under all labels."""
    equity = panel(s, d).filter("region = 'ASIA' AND ret IS NOT NULL").select("series", "region", "factor", "month", "ret")
    assets = P.append_proxies(equity, L._proxies(s, d).filter("ret IS NOT NULL"))
    placed = settled(R.positions(equity.withColumn("menu", F.lit("equity")).unionByName(assets.withColumn("menu", F.lit("assets"))), BY))
    schedule, candidates = settled(schedule_of(placed, BY)), _candidates(s)
    caps = s.createDataFrame(_CAPS, "preset string, menu string, dim string, cap double")
    proxies = s.createDataFrame([(n, "kind", "rest", 1.0) for n in _MENUS["assets"][0] if n.startswith("Asset")], "series string, dim string, category string, share double")
    allowed = S.inside_caps(candidates, caps, menu_groups(s, d).unionByName(proxies), BY).withColumnRenamed("preset", "rule")
    control = R.equal_weights(placed.filter("menu = 'equity'"), schedule, BY)
    return settled(X.regime_race(placed, schedule, labels, candidates, settled(allowed), control, BY, ARM, adjust=adjust))


def _labels(s, d, modes=("circular", "iid")) -> tuple[DataFrame, DataFrame]:
    states = settled(_states(s, d).select("month", "state"))
    return states, settled(X.placebo_labels(states, modes, REPS))


def _record(s, d) -> DataFrame:
    states, labels = _labels(s, d)
    return X.race_record(_race(s, d, labels), states, (*BY, *ARM, "rule"))


_PLACEBO = placebo_sql()


@query(f"{_PLACEBO} SELECT menu, arm, mode, rep, rule, {_d('month')}, CAST(refit AS INTEGER) AS refit, {_r('gross', 'turnover', 'net')} FROM r3 WHERE mode <> 'iid'", macro=True)
def placebo_race(s, d):
    """The months of the race under the real labels and those turned round."""
    return _race(s, d, _labels(s, d, ("circular",))[1])


@query(f"{_PLACEBO} SELECT {_KEY}, rule, metric, {_r('v AS value')} FROM rec", macro=True)
def placebo(s, d):
    return _record(s, d)


@query(
    f"""{_PLACEBO} SELECT a.rule, a.metric, a.mode, {_r("max(b.v) AS real", "avg(a.v) AS null_mean", "stddev_samp(a.v) AS null_sd", "quantile_cont(a.v, 0.05) AS null_p05", "quantile_cont(a.v, 0.95) AS null_p95")}, count(*) AS n,
  {_r("(1 + count(*) FILTER (WHERE round(a.v, 12) >= round(b.v, 12))) / (1 + count(*)) AS p")} FROM rec a JOIN rec b ON a.arm = 'placebo' AND b.arm = 'real' AND a.rule = b.rule AND a.metric = b.metric GROUP BY a.rule, a.metric, a.mode""",
    macro=True,
)
def permutation_verdict(s, d):
    return I.permutation_verdict(_record(s, d))


#: The training means of all arms and refits drawn to their long-run counterparts where the eras agree.
_ANCHORED = f"""mc3 AS (SELECT *, split_part(series, ' | ', 1) AS region, split_part(series, ' | ', 2) AS factor FROM sm2),
rf4 AS (SELECT c.menu, c.arm, c.mode, c.rep, c.refit, c.region, c.state, c.m AS ref, CASE WHEN p.agree THEN (c.n * c.m + p.n_long * p.long_mean) / (c.n + p.n_long) ELSE c.m END AS anc FROM mc3 c LEFT JOIN mp p USING (region, state) WHERE c.factor = 'Reference'),
an1 AS (SELECT c.*, ref, anc, fp.agree AND ref IS NOT NULL AS fa, fp.long_diff, fp.n_long AS fn, op.agree AS oa, op.long_mean AS ol, op.n_long AS onn FROM mc3 c LEFT JOIN rf4 USING ({_KEY}, refit, region, state) LEFT JOIN fp ON fp.factor = c.factor AND fp.state = c.state LEFT JOIN op ON op.series = c.series AND op.state = c.state),
sm3 AS (SELECT {_KEY}, refit, state, series, CASE WHEN region = 'Asset' THEN CASE WHEN oa THEN (n * m + onn * ol) / (n + onn) ELSE m END WHEN factor = 'Reference' THEN anc
  WHEN fa THEN anc + (n * (m - ref) + fn * long_diff) / (n + fn) WHEN ref IS NOT NULL THEN anc + m - ref ELSE m END AS m, n FROM an1),
an0 AS (SELECT * FROM sm3)"""


def _switched(s, d) -> tuple[DataFrame, DataFrame]:
    """The race with and without the anchor on the same labels."""
    states, labels = _labels(s, d, ("circular",))
    modern, every = L._modern(s, d), _states(s, d)
    factors = settled(H.factor_prior(modern, L._factors(s, d), every, L._COUNTERPART, **L._LEAST))
    own, markets = settled(H.own_prior(L._proxies(s, d), modern, every, **L._LEAST)), settled(H.market_prior(modern, L._market(s, d), every, **L._LEAST))
    keys = (*BY, *ARM, "refit")
    on = _race(s, d, labels, lambda means: H.blend_means(means, factors, own, markets, keys)).withColumn("switch", F.lit("on"))
    return states, on.unionByName(_race(s, d, labels).withColumn("switch", F.lit("off")))


_OFF, _ON = placebo_sql(modes="mode <> 'iid'"), placebo_sql(_ANCHORED, "mode <> 'iid'")
_SWITCH = f"{_OFF}, {_ON[_ON.index('mc3 AS') : _ON.index('cv3 AS')].replace('an0 AS', 'an9 AS')}" + _ON[_ON.index("cv3 AS") :].replace("an0", "an9")
_SWITCH = _OFF + re.sub(r"\b(cv3|fl3|pk3|w3|rf3|tn3|r3|rec)\b", r"\1_on", _SWITCH[len(_OFF) :])


@query(
    f"""{_SWITCH}, ab AS (SELECT x.arm, x.rep, x.rule, x.metric, x.v - y.v AS g FROM rec_on x JOIN rec y USING (menu, arm, mode, rep, rule, metric) WHERE x.v - y.v IS NOT NULL)
  SELECT a.rule, a.metric, {_r("max(b.g) AS delta_real", "avg(a.g) AS null_mean", "stddev_samp(a.g) AS null_sd", "avg(CASE WHEN round(a.g, 12) > 0 THEN 1.0 ELSE 0.0 END) AS share_positive")}, count(*) AS n,
  {_r("(1 + count(*) FILTER (WHERE round(a.g, 12) >= round(b.g, 12))) / (1 + count(*)) AS p")} FROM ab a JOIN ab b ON a.arm = 'placebo' AND b.arm = 'real' AND a.rule = b.rule AND a.metric = b.metric GROUP BY a.rule, a.metric""",
    macro=True,
)
def paired_ab(s, d):
    """The switch is the anchor: training means drawn to the long run, or as they are."""
    states, both = _switched(s, d)
    return I.paired_ab(X.race_record(both, states, (*BY, *ARM, "switch", "rule")))
