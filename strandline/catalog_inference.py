"""Queries on tests of races, with the same draws and rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _d, _r, panel, query
from .catalog_states import _CDF, _STATES, _states
from .operators import covariance as V
from .operators import inference as I
from .operators import macro as M
from .operators import panel as P
from .operators import paths as H
from .operators import performance as A
from .operators import walkforward as R
from .plans import fixtures as X
from .plans.scratch import settled

#: Replicates of the bootstraps; the queries that show every drawn month have fewer.
REPS, SHOWN = 4999, 499

#: Contestants: the regions' mean of each factor, and the mean of all series.
_CN = "cn AS (SELECT factor AS series, month, avg(ret) AS ret FROM rc GROUP BY factor, month UNION ALL SELECT '1/N', month, avg(ret) FROM rc GROUP BY month)"
_PAIRS = f""", {_CN}, pq AS (SELECT x.series AS x_name, y.series AS y_name, x.month, x.ret AS x, y.ret AS y, row_number() OVER (PARTITION BY x.series, y.series ORDER BY x.month) - 1 AS pos
  FROM cn x JOIN cn y ON x.month = y.month AND y.series = '1/N' AND x.series <> '1/N')"""
_GAPS = """
gm AS (SELECT x_name, y_name, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x * x) AS mxx, avg(y * y) AS myy FROM pq GROUP BY ALL),
gd AS (SELECT *, sqrt(mxx - mx * mx) AS sx, sqrt(myy - my * my) AS sy, greatest(3, CAST(round_even(pow(n, 1 / 3.0), 0) AS BIGINT)) AS b, greatest(1, CAST(floor(4 * pow(n / 100.0, 2 / 9.0)) AS BIGINT)) AS m FROM gm),
gw AS (SELECT *, mx / sx - my / sy AS delta, mxx / pow(sx, 3) AS wx, -myy / pow(sy, 3) AS wy, -mx / (2 * pow(sx, 3)) AS wxx, my / (2 * pow(sy, 3)) AS wyy FROM gd WHERE n >= 24),
iu AS (SELECT pq.x_name, pq.y_name, pos, n, m, wx * (x - mx) + wy * (y - my) + wxx * (x * x - mxx) + wyy * (y * y - myy) AS u FROM pq JOIN gw USING (x_name, y_name)),
hg AS (SELECT a.x_name, a.y_name, max(a.n) AS n, sum(a.u * b.u * CASE WHEN a.pos = b.pos THEN 1 WHEN (a.pos - b.pos) / a.m <= 0.5 THEN 2 * (1 - 6 * pow((a.pos - b.pos) / a.m, 2) + 6 * pow((a.pos - b.pos) / a.m, 3)) ELSE 4 * pow(1 - (a.pos - b.pos) / a.m, 3) END) AS g
  FROM iu a JOIN iu b ON a.x_name = b.x_name AND a.y_name = b.y_name AND b.pos BETWEEN a.pos - a.m AND a.pos GROUP BY ALL),
gp AS (SELECT gw.*, sqrt(g) / gw.n AS se FROM gw JOIN hg USING (x_name, y_name))"""


def _draws(seeds: str, of: str, keys: str, reps: int = REPS, block: str = "b") -> str:
    """Blocks' draws for every key of a table that has n and b."""
    return f"""(SELECT {keys}, seed, rep, n, b, blk, blk * b + o AS pos, (start + o) % n AS src FROM (SELECT *, unnest(range(0, least(b, n - blk * b))) AS o FROM (
  SELECT {keys}, seed, rep, n, b, blk, CAST('0x' || substr(md5(seed || '|' || rep || '|' || blk), 1, 8) AS BIGINT) % n AS start FROM (SELECT {keys}, n, b, unnest(range(0, CAST(ceil(n / b) AS BIGINT))) AS blk FROM {of}), (VALUES {seeds}) s(seed), range({reps}) r(rep))))"""


def _boot(seeds: str = "(7)") -> str:
    return f"""
bs AS (SELECT i.x_name, i.y_name, seed, rep, n, b, blk, sum(pq.x) AS x, sum(pq.y) AS y, sum(pq.x * pq.x) AS xx, sum(pq.y * pq.y) AS yy FROM {_draws(seeds, "gw", "x_name, y_name")} i JOIN pq ON pq.x_name = i.x_name AND pq.y_name = i.y_name AND pq.pos = src GROUP BY ALL),
bm AS (SELECT x_name, y_name, seed, rep, n, b, sum(x) / max(n) AS mx, sum(y) / max(n) AS my, sum(xx) / max(n) AS mxx, sum(yy) / max(n) AS myy FROM bs GROUP BY ALL),
bw AS (SELECT *, mx / sx - my / sy AS dd, mxx / pow(sx, 3) AS wx, -myy / pow(sy, 3) AS wy, -mx / (2 * pow(sx, 3)) AS wxx, my / (2 * pow(sy, 3)) AS wyy FROM (SELECT *, sqrt(mxx - mx * mx) AS sx, sqrt(myy - my * my) AS sy FROM bm)),
bv AS (SELECT w.x_name, w.y_name, w.seed, w.rep, max(dd) AS dd, sum(pow(wx * (s.x - w.b * mx) + wy * (s.y - w.b * my) + wxx * (s.xx - w.b * mxx) + wyy * (s.yy - w.b * myy), 2)) / max(w.b) / max(w.n // w.b) / max(w.n) AS var
  FROM bw w JOIN bs s USING (x_name, y_name, seed, rep) WHERE s.blk < w.n // w.b GROUP BY ALL),
bt AS (SELECT bv.x_name, bv.y_name, seed, rep, (dd - delta) / sqrt(var) AS t, delta / se AS d FROM bv JOIN gp USING (x_name, y_name) WHERE var > 0)"""


def contestants(s, d) -> DataFrame:
    rows = P.complete_months(panel(s, d), "ret").withColumn("series", F.explode(F.array("factor", F.lit("1/N"))))
    return settled(rows.groupBy("series", "month").agg(F.avg("ret").alias("ret")))


def pairs_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("series").alias("x_name")).distinct().filter("x_name <> '1/N'").withColumn("y_name", F.lit("1/N"))


@query(f"{_PAIRS}, {_GAPS} SELECT rep, blk AS block, pos, src FROM {_draws('(7)', 'gw', 'x_name', SHOWN)} WHERE x_name = 'Reference'")
def block_index(s, d):
    n = contestants(s, d).filter("series = 'Reference'").agg(F.count("*").cast("int").alias("n")).filter("n >= 24")
    return I.block_index(n, SHOWN).select("rep", F.col("block").cast("long").alias("block"), F.col("pos").cast("long").alias("pos"), F.col("src").cast("long").alias("src")).withColumn("rep", F.col("rep").cast("long"))


@query(f"{_PAIRS}, {_GAPS} SELECT rep, {_r('avg(x) AS mean_ret', 'max(x) AS best')} FROM {_draws('(7)', 'gw', 'x_name', SHOWN)} i JOIN pq ON pq.x_name = i.x_name AND pq.pos = src WHERE i.x_name = 'Reference' GROUP BY rep")
def resample(s, d):
    rows = I.pair_rows(contestants(s, d), pairs_of(contestants(s, d))).filter("x_name = 'Reference'")
    index = I.block_index(rows.agg(F.count("*").cast("int").alias("n")).filter("n >= 24"), SHOWN)
    return I.resample(rows.select("pos", "x"), index).groupBy(F.col("rep").cast("long").alias("rep")).agg(F.avg("x").alias("mean_ret"), F.max("x").alias("best"))


_P = "(1 + count(*) FILTER (WHERE abs(t) >= abs(d))) / (1 + count(*))"


@query(
    f"""{_PAIRS}, {_GAPS}, {_boot()}, bp AS (SELECT x_name, y_name, seed, {_P} AS p_boot, count(*) AS used FROM bt GROUP BY ALL)
  SELECT x_name, y_name, seed, n, {_r("mx / sx AS sharpe_x", "my / sy AS sharpe_y", "delta", "se", f"2 * ({_CDF.format('(-abs(delta / se))')}) AS p_hac", "p_boot")}, used FROM gp JOIN bp USING (x_name, y_name)"""
)
def sharpe_diff_test(s, d):
    rows = contestants(s, d)
    return I.sharpe_diff_test(rows, pairs_of(rows), REPS)


@query(
    f"""{_PAIRS}, {_GAPS}, {_boot("(1), (2), (3)")}, bp AS (SELECT x_name, y_name, seed, {_P} AS p FROM bt GROUP BY ALL)
  SELECT x_name, y_name, count(p) AS n_seeds, {_r("min(p) AS p_min", "max(p) AS p_max", "avg(p) AS p_mean", "stddev_samp(p) AS p_sd")} FROM bp GROUP BY ALL"""
)
def seed_stability(s, d):
    rows = contestants(s, d)
    return I.seed_stability(I.sharpe_diff_test(rows, pairs_of(rows), REPS, (1, 2, 3)))


def _ratio_sql(f: str) -> str:
    """The gap of a ratio written with {{c}} for the column; m is the market."""
    gap = f"{f.format(c='x')} - {f.format(c='y')}"
    return f"""{X.FACTORS_SQL}{_PAIRS}, re AS (SELECT x_name, y_name, pos, x - rf AS x, y - rf AS y, mkt_rf AS m FROM pq JOIN fc USING (month)),
  ro AS (SELECT x_name, y_name, count(*) AS n, greatest(3, CAST(round_even(pow(count(*), 1 / 3.0), 0) AS BIGINT)) AS b, {gap} AS delta FROM re GROUP BY ALL),
  rb2 AS (SELECT i.x_name, i.y_name, rep, {gap} AS g FROM {_draws("(7)", "ro", "x_name, y_name")} i JOIN re ON re.x_name = i.x_name AND re.y_name = i.y_name AND re.pos = src GROUP BY ALL),
  rc2 AS (SELECT *, avg(g) OVER (PARTITION BY x_name, y_name) AS centre FROM rb2 WHERE g IS NOT NULL)
  SELECT x_name, y_name, {_r("max(delta) AS delta", "quantile_cont(g, 0.025) AS ci_lo", "quantile_cont(g, 0.975) AS ci_hi", "(1 + count(*) FILTER (WHERE abs(round(g - centre, 12)) >= round(abs(delta), 12))) / (1 + count(*)) AS p_boot")}, count(*) AS used
  FROM rc2 JOIN ro USING (x_name, y_name) GROUP BY ALL"""


def _ratio_test(s, d, stat):
    rows = contestants(s, d)
    return I.ratio_diff_test(rows, pairs_of(rows), X.research_factors(panel(s, d)), stat, REPS)


@query(_ratio_sql("avg({c}) * sqrt(12.0) / nullif(sqrt(avg(pow(least({c}, 0), 2))), 0)"))
def sortino_diff_test(s, d):
    return _ratio_test(s, d, "sortino")


@query(_ratio_sql("CASE WHEN covar_pop({c}, m) / nullif(var_pop(m), 0) > 0 THEN avg({c}) * 12 / (covar_pop({c}, m) / var_pop(m)) END"))
def treynor_diff_test(s, d):
    return _ratio_test(s, d, "treynor")


@query(_ratio_sql("(avg({c}) - 2.5 * var_samp({c})) * 12"))
def cer_diff_test(s, d):
    return _ratio_test(s, d, "cer5")


@query(
    f"""{_PAIRS}, {_GAPS}, {_boot()}, ob AS (SELECT x_name, delta / se AS t0, row_number() OVER (ORDER BY round(abs(delta / se), 12) DESC, x_name) AS rank FROM gp),
  ms AS (SELECT x_name, rep, t, t0, rank, max(abs(t)) OVER (PARTITION BY rep ORDER BY rank DESC) AS most FROM bt JOIN ob USING (x_name)),
  ct AS (SELECT x_name, t0, rank, count(*) FILTER (WHERE most >= abs(t0)) AS k, count(*) FILTER (WHERE abs(t) >= abs(t0)) AS k1, count(*) FILTER (WHERE t >= t0) AS k2 FROM ms GROUP BY ALL), rn AS (SELECT count(DISTINCT rep) AS reps FROM bt)
  SELECT x_name, {_r("t0 AS t", "(1 + k1) / (1 + reps) AS p_single", "(1 + k2) / (1 + reps) AS p_one_sided", "max((1 + k) / (1 + reps)) OVER (ORDER BY rank) AS p_rw")} FROM ct, rn"""
)
def sharpe_romano_wolf(s, d):
    return I.sharpe_romano_wolf(contestants(s, d), "1/N", REPS)


#: For the six contestants: (1 - g) z(1 - 1/6) + g z(1 - 1/(6 e)).
_BEST_OF_SIX = (1 - I.EULER) * I.NormalDist().inv_cdf(1 - 1 / 6) + I.EULER * I.NormalDist().inv_cdf(1 - 1 / (6 * I.math.e))
_DSR = f"""
cs AS (SELECT series, count(*) AS months, avg(ret) / stddev_pop(ret) AS sr, (avg(pow(ret, 3)) - 3 * avg(ret) * avg(ret * ret) + 2 * pow(avg(ret), 3)) / pow(stddev_pop(ret), 3) AS g3, kurtosis_pop(ret) AS k FROM cn GROUP BY series),
s0 AS (SELECT sqrt(var_samp(sr)) * {_BEST_OF_SIX} AS sr0 FROM cs),
ds AS (SELECT series, months, sr, sr0, CASE WHEN months >= 3 AND den > 0 THEN (sr - sr0) * sqrt(months - 1) / sqrt(den) END AS z FROM (SELECT *, 1 - g3 * sr + (k + 2) / 4 * sr * sr AS den FROM cs, s0))"""


@query(f", {_CN}, {_DSR} SELECT series, months, {_r('sr', 'sr0', f'CASE WHEN z IS NOT NULL THEN {_CDF.format("z")} END AS dsr')} FROM ds")
def deflated_sharpe(s, d):
    return I.deflated_sharpe(contestants(s, d))


@query(
    f"""{_PAIRS}, {_DSR}, {_GAPS}, {_boot()}, bp AS (SELECT x_name, y_name, {_P} AS p_boot FROM bt GROUP BY ALL)
  SELECT series, {_r("sr * sqrt(12.0) AS sharpe_ann", f"{_CDF.format('z')} AS dsr")}, y_name AS bench, {_r("delta * sqrt(12.0) AS delta_ann", "p_boot", f"2 * ({_CDF.format('(-abs(delta / se))')}) AS p_hac")} FROM ds JOIN gp ON x_name = series JOIN bp USING (x_name, y_name)"""
)
def inference_table(s, d):
    return I.inference_table(contestants(s, d), ("1/N",), REPS)


@query(
    f"""{_PAIRS.replace(_CN, f"c0 AS ({_CN[7:-1]}), cn AS (SELECT series, month, ret - {X.RF} AS ret FROM c0)")}, {_DSR}, {_GAPS}, {_boot()}, bp AS (SELECT x_name, y_name, {_P} AS p_boot FROM bt GROUP BY ALL),
  l0 AS (SELECT series, month, 100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY series ORDER BY month)) AS level FROM c0), l1 AS (SELECT series, last_day(min(month) - INTERVAL 1 MONTH) AS month, 100.0 AS level FROM l0 GROUP BY series UNION ALL SELECT series, month, level FROM l0),
  l2 AS (SELECT *, level / lag(level) OVER w - 1 AS r, level / max(level) OVER w - 1 AS dd FROM l1 WINDOW w AS (PARTITION BY series ORDER BY month)),
  l3 AS (SELECT series, pow(arg_max(level, month) / 100, 12.0 / count(r)) - 1 AS cagr, stddev_samp(r) * sqrt(12.0) AS ann_vol, min(dd) AS max_drawdown FROM l2 GROUP BY series)
  SELECT series, {_r("cagr", "ann_vol", "max_drawdown", "sr * sqrt(12.0) AS sharpe_ann", f"{_CDF.format('z')} AS dsr", "delta * sqrt(12.0) AS delta_ann", "p_boot")} FROM l3 JOIN ds USING (series) LEFT JOIN gp ON x_name = series LEFT JOIN bp USING (x_name, y_name)"""
)
def race_table(s, d):
    rows = contestants(s, d)
    return I.race_table(A.perf_stats(R.levels_of(rows)), rows.withColumn("ret", F.col("ret") - X.RF), "1/N", REPS)


_SPLITS = f""", {_CN}, bk AS (SELECT series, CASE WHEN pos < (t % 16) * (t // 16 + 1) THEN pos // (t // 16 + 1) ELSE t % 16 + (pos - (t % 16) * (t // 16 + 1)) // greatest(t // 16, 1) END AS block, count(*) AS n, sum(ret) AS s1, sum(ret * ret) AS s2
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS pos, count(*) OVER (PARTITION BY series) AS t FROM cn) WHERE t >= 32 GROUP BY ALL),
sp2 AS (SELECT i AS id FROM range(65536) r(i) WHERE bit_count(i) = 8),
hs AS (SELECT id, series, sum(n) FILTER (WHERE side) AS n1, sum(s1) FILTER (WHERE side) AS a1, sum(s2) FILTER (WHERE side) AS b1, sum(n) FILTER (WHERE NOT side) AS n2, sum(s1) FILTER (WHERE NOT side) AS a2, sum(s2) FILTER (WHERE NOT side) AS b2
  FROM (SELECT *, (id & (1::BIGINT << block)) <> 0 AS side FROM sp2, bk) GROUP BY id, series),
sh AS (SELECT id, series, a1 / n1 / sqrt((b1 - a1 * a1 / n1) / (n1 - 1)) AS own, a2 / n2 / sqrt((b2 - a2 * a2 / n2) / (n2 - 1)) AS other FROM hs),
om AS (SELECT id, count(*) AS k, count(*) FILTER (WHERE round(other, 12) < round(star, 12)) / (count(*) - 1) AS omega FROM (SELECT *, first_value(other) OVER (PARTITION BY id ORDER BY round(own, 12) DESC, series) AS star FROM sh) GROUP BY id)"""


@query(f"{_SPLITS} SELECT coalesce(max(k), 0) AS n_trials, count(*) AS n_combos, {_r('avg(CASE WHEN omega <= 0.5 THEN 1.0 ELSE 0.0 END) AS pbo')} FROM om")
def pbo_cscv(s, d):
    return I.pbo_cscv(contestants(s, d))


@query(
    f""", {_CN}, b0 AS (SELECT series, CAST(floor((p - 1) / 12) AS BIGINT) AS block, avg(ret) / nullif(stddev_samp(ret), 0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) AS p FROM cn) GROUP BY ALL HAVING count(*) >= 6),
  rk AS (SELECT series, rank() OVER (PARTITION BY block ORDER BY score DESC) + (count(*) OVER (PARTITION BY block, score) - 1) / 2.0 AS rank FROM b0)
  SELECT series, {_r("avg(rank) AS avg_rank")}, count(*) AS n_blocks, (SELECT count(DISTINCT series) FROM rk) AS n_series FROM rk GROUP BY series"""
)
def average_ranks(s, d):
    return I.average_ranks(contestants(s, d))


@query(None)
def friedman_nemenyi(s, d):
    return I.friedman_nemenyi(contestants(s, d))


_ST = "ss0 AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS pos, count(*) OVER () AS n FROM st)"
_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@query(f"{_STATES}, {_ST} SELECT CAST(rep AS INTEGER) AS rep, strftime(b.month, '%Y-%m-%d') AS month, a.state FROM ss0 a, range(20) r(rep), ss0 b WHERE b.pos = (a.pos + 1 + {_HASH.format("'12345|' || rep")} % (a.n - 1)) % a.n", macro=True)
def scramble_circular(s, d):
    return I.scramble_states(_states(s, d).select("month", "state"), "circular", 20)


_IID = f"sc2 AS (SELECT rep, b.month, a.state FROM (SELECT rep, state, row_number() OVER (PARTITION BY rep ORDER BY {_HASH.format(chr(39) + '12345|' + chr(39) + ' || rep || ' + chr(39) + '|' + chr(39) + ' || pos')}, pos) - 1 AS p FROM ss0, range(20) r(rep)) a JOIN ss0 b ON b.pos = a.p)"


@query(f"{_STATES}, {_ST}, {_IID} SELECT CAST(rep AS INTEGER) AS rep, strftime(month, '%Y-%m-%d') AS month, state FROM sc2", macro=True)
def scramble_iid(s, d):
    return I.scramble_states(_states(s, d).select("month", "state"), "iid", 20)


#: The covariance's moments of each replicate, a month counting as often as it is drawn.
_DR2 = f""", mm AS (SELECT 'all' AS menu, series, month, ret FROM rc UNION ALL SELECT 'references', series, month, ret FROM rc WHERE factor = 'Reference'),
dm AS (SELECT menu, series, row_number() OVER (PARTITION BY menu, series ORDER BY month) - 1 AS pos, ret - avg(ret) OVER (PARTITION BY menu, series) AS x FROM mm),
dn AS (SELECT 1 AS one, n, greatest(3, CAST(round_even(pow(n, 1 / 3.0), 0) AS BIGINT)) AS b FROM (SELECT count(DISTINCT pos) AS n FROM dm)),
dc AS (SELECT rep, src AS pos, count(*) AS c FROM {_draws("(7)", "dn", "one")} GROUP BY ALL UNION ALL SELECT -1, pos, 1 FROM (SELECT DISTINCT pos FROM dm)),
de AS (SELECT menu, series, rep, sum(c * x) / max(n) AS m FROM dm JOIN dc USING (pos), dn GROUP BY ALL), dv AS (SELECT menu, series, rep, sum(c * pow(x - m, 2)) / max(n) AS v FROM dm JOIN dc USING (pos) JOIN de USING (menu, series, rep), dn GROUP BY ALL),
dz AS (SELECT dm.menu, dm.series, rep, pos, c, x - m AS x FROM dm JOIN dc USING (pos) JOIN de USING (menu, series, rep)),
dp AS (SELECT a.menu, a.rep, a.series AS i, b.series AS j, sum(a.c * a.x * b.x) / max(n) AS s, sum(a.c * a.x * a.x * b.x * b.x) / max(n) AS m22, sum(a.c * a.x * a.x * a.x * b.x) / max(n) AS m31, sum(a.c * a.x * b.x * b.x * b.x) / max(n) AS m13
  FROM dz a JOIN dz b ON a.menu = b.menu AND a.rep = b.rep AND a.pos = b.pos AND a.series < b.series, dn GROUP BY ALL),
dq AS (SELECT dp.*, a.v AS vi, b.v AS vj, sqrt(a.v * b.v) AS root FROM dp JOIN dv a ON a.menu = dp.menu AND a.rep = dp.rep AND a.series = i JOIN dv b ON b.menu = dp.menu AND b.rep = dp.rep AND b.series = j),
dr2 AS (SELECT menu, rep, avg(s / root) AS r, sum(2 * (m22 - s * s)) AS pi, sum(sqrt(vj / vi) * (m31 - vi * s) + sqrt(vi / vj) * (m13 - vj * s)) AS th, 2 * sum(s * s) AS ss, 2 * sum(s * root) AS sr, 2 * sum(root * root) AS rr, 2 * sum(s) AS s, 2 * sum(root) AS root FROM dq GROUP BY ALL),
dd2 AS (SELECT *, least(1, greatest(0, (pi - r * th) / (ss - 2 * r * sr + r * r * rr) / n)) AS delta FROM dr2, dn),
dw AS (SELECT menu, rep, delta, pow(sd, 2) / (v + delta * r * root + (1 - delta) * s) AS dr2 FROM dd2 JOIN (SELECT menu, rep, sum(v) AS v, sum(sqrt(v)) AS sd FROM dv GROUP BY ALL) USING (menu, rep)),
dx3 AS (SELECT rep, max(dr2) FILTER (WHERE menu = 'references') AS a, max(dr2) FILTER (WHERE menu = 'all') AS b FROM dw GROUP BY rep), dy AS (SELECT *, b - a AS d, avg(b - a) FILTER (WHERE rep >= 0) OVER () AS m, max(b - a) FILTER (WHERE rep < 0) OVER () AS o FROM dx3)"""


def _two_menus(s, d) -> DataFrame:
    rows = P.complete_months(panel(s, d), "ret")
    return settled(rows.withColumn("menu", F.lit("all")).unionByName(rows.filter("factor = 'Reference'").withColumn("menu", F.lit("references"))).select("menu", "series", "month", "ret"))


@query(f"{_DR2} SELECT menu, CAST(rep AS INTEGER) AS rep, {_r('dr2', 'delta')} FROM dw")
def dr2_draws(s, d):
    return V.dr2_draws(_two_menus(s, d), ("menu",), REPS)


@query(
    f"""{_DR2} SELECT {_r("max(a) FILTER (WHERE rep < 0) AS dr2_a", "max(b) FILTER (WHERE rep < 0) AS dr2_b", "max(o) AS delta")}, count(*) FILTER (WHERE rep >= 0) AS used, {_r("quantile_cont(a, 0.025) FILTER (WHERE rep >= 0) AS ci_a_lo", "quantile_cont(a, 0.975) FILTER (WHERE rep >= 0) AS ci_a_hi",
  "quantile_cont(d, 0.025) FILTER (WHERE rep >= 0) AS ci_delta_lo", "quantile_cont(d, 0.975) FILTER (WHERE rep >= 0) AS ci_delta_hi",
  "greatest(2 * least(count(*) FILTER (WHERE rep >= 0 AND round(d - m, 12) >= round(abs(o), 12)), count(*) FILTER (WHERE rep >= 0 AND round(d - m, 12) <= -round(abs(o), 12))) / count(*) FILTER (WHERE rep >= 0), 1 / (count(*) FILTER (WHERE rep >= 0) + 1)) AS p")} FROM dy"""
)
def dr2_bootstrap(s, d):
    return V.dr2_bootstrap(_two_menus(s, d), "menu", "references", "all", REPS)


#: Paths of history: what each state's spells are drawn from (wb), and the walk, month by month (wk).
def _walk(months: int, trials: int, seed: int = 42) -> str:
    u = f"(CAST('0x' || substr(md5('{seed}|' || {{}} || '|' || {{}}), {{}}, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
    move, place = u.format("trial", "t + 1", 1), u.format("trial", "t + 1", 9)
    return f"""wp AS (SELECT month, state, row_number() OVER (ORDER BY month) AS pos FROM st),
  wa AS (SELECT state, list(pos ORDER BY pos) AS places, coalesce(max(tm.p), 0) AS stay FROM wp LEFT JOIN tm ON from_state = state AND to_state = state GROUP BY state HAVING count(*) >= 3),
  wm AS (SELECT a.state, b.state AS dest, CASE WHEN a.state = b.state THEN 0 ELSE coalesce(tm.p, 0) END AS w FROM wa a CROSS JOIN wa b LEFT JOIN tm ON from_state = a.state AND to_state = b.state),
  wn AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY state) > 0 THEN w ELSE 1 END AS v FROM wm),
  wb AS (SELECT state, any_value(stay) AS stay, any_value(places) AS places, list(c ORDER BY dest) AS cum, list(dest ORDER BY dest) AS dests FROM (SELECT wn.state, dest, sum(v) OVER (PARTITION BY wn.state ORDER BY dest) / sum(v) OVER (PARTITION BY wn.state) AS c FROM wn) JOIN wa USING (state) GROUP BY state),
  wk AS (WITH RECURSIVE w AS (
    SELECT CAST(i AS BIGINT) AS trial, 1 AS t, s.state, s.places[CAST(floor({u.format("i", "1", 9)} * len(s.places)) AS BIGINT) + 1] AS pos FROM range({trials}) r(i), (SELECT * FROM wb WHERE state = (SELECT arg_max(state, pos) FROM wp)) s
    UNION ALL
    SELECT trial, t, z.state, CASE WHEN stays AND list_contains(z.places, pos + 1) THEN pos + 1 ELSE z.places[CAST(floor(place * len(z.places)) AS BIGINT) + 1] END FROM (
      SELECT trial, t + 1 AS t, pos, {place} AS place, {move} < h.stay AS stays, CASE WHEN {move} < h.stay THEN h.state ELSE h.dests[least(len(list_filter(h.cum, lambda c: c <= ({move} - h.stay) / (1 - h.stay))), len(h.cum) - 1) + 1] END AS ns
      FROM w JOIN wb h USING (state) WHERE t < {months}) n JOIN wb z ON z.state = n.ns)
    SELECT trial, CAST(t AS INTEGER) AS period, CAST(pos AS INTEGER) AS pos FROM w)"""


def _summary(rows: str, key: str = "series", keys: str = "series") -> str:
    """The summary of months on paths (trial, key, period, ret)."""
    return f"""pv AS (SELECT trial, {keys}, period, sum(ln(1 + ret)) OVER (PARTITION BY trial, {keys} ORDER BY period) AS l FROM {rows}),
  pw AS (SELECT *, exp(l - max(l) OVER (PARTITION BY trial, {keys} ORDER BY period)) - 1 AS dd FROM pv),
  px2 AS (SELECT trial, {keys}, arg_max(l, period) AS total, min(dd) AS dd, exp(arg_max(l, period) * 12 / count(*)) - 1 AS cagr FROM pw GROUP BY ALL)
  SELECT {keys}, count(*) AS n_trials, {_r(*(f"quantile_cont(cagr, {q / 100}) AS cagr_p{q}" for q in (5, 25, 50, 75, 95)), *(f"quantile_cont(dd, {q / 100}) AS maxdd_p{q}" for q in (5, 50, 95)), "avg(CASE WHEN round(exp(total), 12) < 1 THEN 1.0 ELSE 0.0 END) AS prob_loss")} FROM px2 GROUP BY {keys}"""


def _paths(s, d, months: int = 120, trials: int = 2000) -> tuple[DataFrame, DataFrame]:
    states = settled(_states(s, d))
    return settled(H.month_positions(states)), settled(H.state_block_arrays(states, M.transition_matrix(states), None, trials, months))


@query(f"{_STATES}, {_walk(120, 2000)} SELECT trial, period, pos FROM wk", macro=True)
def state_block_paths(s, d):
    states = settled(_states(s, d))
    return H.state_block_paths(states, settled(M.transition_matrix(states)))


@query(f"{_STATES}, {_walk(120, 2000)}, pr2 AS (SELECT trial, series, period, ret FROM wk JOIN wp USING (pos) JOIN rt USING (month) WHERE ret IS NOT NULL), {_summary('pr2')}", macro=True)
def path_summary(s, d):
    """Two thousand paths of ten years through every series."""
    months, paths = _paths(s, d)
    return H.path_summary(paths, panel(s, d).filter("ret IS NOT NULL").join(months, "month"))


@query(
    f"""{_STATES}, {_walk(240, 500)}, pr2 AS (SELECT trial, series, y AS years, period, ret FROM wk JOIN wp USING (pos) JOIN rt USING (month), (VALUES (5), (10), (20)) h(y) WHERE ret IS NOT NULL AND region = 'ASIA' AND period <= 12 * y), {_summary("pr2", keys="series, years")}""",
    macro=True,
)
def horizons(s, d):
    """One region's series after five, ten and twenty years of the same paths."""
    months, paths = _paths(s, d, 240, 500)
    return H.path_summary(paths, panel(s, d).filter("ret IS NOT NULL AND region = 'ASIA'").join(months, "month"), (5, 10, 20))


@query(
    f"""{_STATES}, {_walk(240, 2000)}, pb2 AS (SELECT portfolio, month, sum(weight * ret) AS ret FROM (VALUES ('one region', 'ASIA | Reference', 0.5), ('one region', 'ASIA | MACHINERY', 0.5), ('sixty forty', 'AMERICA | Reference', 0.6), ('sixty forty', 'EUROPE | Reference', 0.4)) w(portfolio, series, weight)
    JOIN rt USING (series) WHERE ret IS NOT NULL GROUP BY ALL HAVING count(*) = 2),
  pr2 AS (SELECT trial, portfolio, y AS years, period, ret FROM wk JOIN wp USING (pos) JOIN pb2 USING (month), (VALUES (5), (10), (20)) h(y) WHERE period <= 12 * y), {_summary("pr2", keys="portfolio, years")}""",
    macro=True,
)
def portfolio_cones(s, d):
    months, paths = _paths(s, d, 240)
    valid = X.portfolios(s).filter("portfolio IN ('one region', 'sixty forty')")
    return H.portfolio_cones(paths, valid, panel(s, d).filter("ret IS NOT NULL"), months)


@query(
    f"""{_STATES}, ps2 AS (SELECT month, row_number() OVER (ORDER BY month) AS pos, count(*) OVER () AS n FROM st), pa AS (SELECT trial, period, 1 + (trial * 7 + period * 3) % n AS pos FROM range(40) a(trial), range(1, 61) b(period), (SELECT DISTINCT n FROM ps2)),
  pr2 AS (SELECT trial, series, period, ret FROM pa JOIN ps2 USING (pos) JOIN rt USING (month) WHERE ret IS NOT NULL), {_summary("pr2")}""",
    macro=True,
)
def summary_of_fixed_paths(s, d):
    """The summary alone, on paths given by rows."""
    months = settled(H.month_positions(_states(s, d)))
    n = months.agg(F.count("*").alias("n"))
    paths = s.range(40).select(F.col("id").alias("trial"), F.explode(F.sequence(F.lit(1), F.lit(60))).alias("period")).crossJoin(F.broadcast(n))  # one row
    paths = paths.select("trial", "period", (1 + (F.col("trial") * 7 + F.col("period") * 3) % F.col("n")).cast("int").alias("pos"))
    return H.path_summary(paths, panel(s, d).filter("ret IS NOT NULL").join(months, "month"))
