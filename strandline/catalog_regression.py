"""Queries on factor regressions; SQL for those with one regressor or none."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _d, _r, panel, query
from .catalog_inference import _CN, _draws, contestants
from .catalog_states import _CDF
from .operators import performance as A
from .operators import regression as G
from .plans import fixtures as X
from .plans.scratch import settled

MODELS = {"CAPM": ["mkt_rf"], "Three factors": ["mkt_rf", "hml", "mom"], "Regional": ["reg_AFRICA", "reg_AMERICA", "reg_ASIA", "reg_EUROPE", "reg_MIDDLE_EAST"], "Absent": ["bab"]}

#: Least squares on one regressor x for each key k, with the influence of the intercept and its variance by Bartlett's kernel.
_HAC = """
zs AS (SELECT k, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, avg(y) - regr_slope(y, x) * avg(x) AS a, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, greatest(1, CAST(floor(4 * pow(count(*) / 100.0, 2 / 9.0)) AS BIGINT)) AS lags FROM zd GROUP BY k HAVING count(*) > 2),
zp AS (SELECT zd.k, pos, lags, (sxx - sx * x) / (n * sxx - sx * sx) * (y - a - b * x) AS pa, (n * x - sx) / (n * sxx - sx * sx) * (y - a - b * x) AS pb, y - a - b * x AS u FROM zd JOIN zs USING (k)),
zv AS (SELECT p.k, sum(p.pa * q.pa * w) AS va, sum(p.pb * q.pb * w) AS vb FROM (SELECT *, unnest(range(0, lags + 1)) AS j FROM zp) p JOIN zp q ON q.k = p.k AND q.pos = p.pos - p.j, LATERAL (SELECT CASE WHEN p.j = 0 THEN 1 ELSE 2 * (1 - p.j / (p.lags + 1)) END AS w) GROUP BY p.k),
zu AS (SELECT k, sqrt(sum(u * u) / (count(*) - 2)) AS rv FROM zp GROUP BY k)"""
_CAPM = f"{X.FACTORS_SQL}, {_CN}, zd AS (SELECT series AS k, row_number() OVER (PARTITION BY series ORDER BY month) AS pos, mkt_rf AS x, ret - rf AS y FROM cn JOIN fc USING (month) WHERE series <> '1/N'), {_HAC}"


def frame_of(s, d):
    p = panel(s, d)
    return settled(G.factor_frame(X.research_factors(p), p))


@query(f"{X.FACTORS_SQL} SELECT {_d('month')}, {_r('mkt_rf', 'hml', 'mom', 'rf')}, {_r(*(f'''max(ret) FILTER (WHERE region = '{n}') - max(rf) AS reg_{n.replace(' ', '_')}''' for n in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')))} FROM fc LEFT JOIN (SELECT region, month, ret FROM rt WHERE factor = 'Reference' AND ret IS NOT NULL) USING (month) GROUP BY ALL")
def factor_frame(s, d):
    p = panel(s, d)
    gaps = X.research_factors(p).withColumn("rf", F.when(F.month("month") != 3, F.col("rf")))
    return G.factor_frame(gaps, p, X.research_factors(p).select("month", "rf"))


@query(f"{_CAPM} SELECT k AS series, term, {_r('coef')}, n, {_r('r2')} FROM (SELECT k, 'alpha' AS term, a AS coef, n, r2 FROM zs UNION ALL SELECT k, 'mkt_rf', b, n, r2 FROM zs)")
def ols(s, d):
    rows = contestants(s, d).filter("series <> '1/N'").join(frame_of(s, d), "month").withColumn("y", F.col("ret") - F.col("rf"))
    return G.ols(rows, ("series",), "y", ["mkt_rf"])


_T = f"2 * ({_CDF.format('(-abs(t))')}) AS p"


@query(f"{_CAPM} SELECT series, term, {_r('coef', 'se', 't', _T)}, n, {_r('r2', 'rv AS resid_vol')}, false AS singular FROM (SELECT *, coef / se AS t FROM (SELECT k AS series, 'alpha' AS term, a AS coef, sqrt(va) AS se, n, r2, rv FROM zs JOIN zv USING (k) JOIN zu USING (k) UNION ALL SELECT k, 'mkt_rf', b, sqrt(vb), n, r2, rv FROM zs JOIN zv USING (k) JOIN zu USING (k)))")
def hac_ols(s, d):
    rows = contestants(s, d).filter("series <> '1/N'").join(frame_of(s, d), "month").withColumn("y", F.col("ret") - F.col("rf"))
    return G.hac_ols(rows, ("series",), "y", ["mkt_rf"])


@query(
    f""", zd AS (SELECT 1 AS k, row_number() OVER (ORDER BY month) AS pos, avg(e) AS y FROM (SELECT region, month, avg(a.ret) - max(b.ret) - 0.0015 / 12 AS e FROM (SELECT * FROM rt WHERE factor <> 'Reference' AND ret IS NOT NULL) a
  JOIN (SELECT region, month, ret FROM rt WHERE factor = 'Reference' AND ret IS NOT NULL) b USING (region, month) GROUP BY region, month) GROUP BY month),
  zm AS (SELECT count(*) AS n, avg(y) AS a, greatest(1, CAST(floor(4 * pow(count(*) / 100.0, 2 / 9.0)) AS BIGINT)) AS lags FROM zd), zc AS (SELECT pos, (y - a) / n AS g, lags FROM zd, zm),
  zw AS (SELECT sum(p.g * q.g * CASE WHEN p.j = 0 THEN 1 ELSE 2 * (1 - p.j / (p.lags + 1)) END) AS v FROM (SELECT *, unnest(range(0, lags + 1)) AS j FROM zc) p JOIN zc q ON q.pos = p.pos - p.j)
  SELECT n AS months, {_r("a * 12 AS premium_ann", "a / sqrt(v) AS t", f"2 * ({_CDF.format('(-abs(a / sqrt(v)))')}) AS p")} FROM zm, zw"""
)
def region_neutral_premium_test(s, d):
    """The test of a mean: no regressors."""
    fit = G.hac_ols(A.region_neutral_premium(panel(s, d), 0.0015), ("series",), "ret", [])
    return fit.select(F.col("n").alias("months"), (F.col("coef") * 12).alias("premium_ann"), "t", "p")


@query(f"{_CAPM} SELECT 'CAPM' AS model, k AS series, 'own' AS side, {_r('a * sqrt(12.0) / rv AS appraisal')} FROM zs JOIN zu USING (k)")
def appraisal(s, d):
    return G.appraisal(G.alpha_table(contestants(s, d), frame_of(s, d), {"CAPM": MODELS["CAPM"]})).filter("side = 'own' AND series <> '1/N'")


_GAP = f"{X.FACTORS_SQL}, {_CN}, zd AS (SELECT c.series AS k, row_number() OVER (PARTITION BY c.series ORDER BY c.month) AS pos, mkt_rf AS x, c.ret - b.ret AS y, c.month FROM cn c JOIN cn b ON b.series = '1/N' AND b.month = c.month AND c.series <> '1/N' JOIN fc ON fc.month = c.month), {_HAC}"


@query(
    f"""{_GAP}, zf AS (SELECT k, avg(x) AS mx, avg(y) AS my FROM zd GROUP BY k) SELECT k AS series, component, {_r("loading", "factor_mean_ann", "contribution_ann")} FROM (
  SELECT k, 'alpha' AS component, NULL::DOUBLE AS loading, NULL::DOUBLE AS factor_mean_ann, a * 12 AS contribution_ann FROM zs UNION ALL SELECT k, 'mkt_rf', b, mx * 12, b * mx * 12 FROM zs JOIN zf USING (k) UNION ALL SELECT k, 'raw gap', NULL, NULL, my * 12 FROM zf)"""
)
def alpha_decomposition(s, d):
    return G.alpha_decomposition(contestants(s, d), frame_of(s, d), ["mkt_rf"])


_SPANS = {"all": (None, None), "late": ("1998-06-30", None), "short": ("2001-01-31", None)}


@query(
    f"""{_GAP.replace("c.series AS k", "sn || '#' || c.series AS k").replace("PARTITION BY c.series", "PARTITION BY sn, c.series").replace("JOIN fc ON", "JOIN (VALUES ('all', DATE '1900-01-01'), ('late', DATE '1998-06-30'), ('short', DATE '2001-01-31')) v(sn, since) ON c.month >= since JOIN fc ON")}
  SELECT split_part(k, '#', 1) AS span, split_part(k, '#', 2) AS series, {_r("a * 12 AS alpha_ann", "a / sqrt(va) AS t", f"2 * ({_CDF.format('(-abs(a / sqrt(va)))')}) AS p")}, n FROM zs JOIN zv USING (k) WHERE n >= 36"""
)
def alpha_stability(s, d):
    return G.alpha_stability(contestants(s, d), frame_of(s, d), ["mkt_rf"], _SPANS)


#: Replicates of the gaps' months on one calendar: m0 (months that all have), dr (draws), zr (drawn rows).
def _drawn_sql(block: str) -> str:
    return f"""m0 AS (SELECT month FROM zd GROUP BY month HAVING count(*) = (SELECT count(DISTINCT k) FROM zd)), z0 AS (SELECT k, x, y, row_number() OVER (PARTITION BY k ORDER BY month) - 1 AS pos FROM zd JOIN m0 USING (month)),
  zn AS (SELECT 1 AS one, n, {block} AS b FROM (SELECT count(*) AS n FROM m0)), dr AS (SELECT * FROM {_draws("(7)", "zn", "one")}), zr AS (SELECT k, rep, dr.pos, x, y FROM dr JOIN z0 ON z0.pos = src)"""


@query(
    f"""{_GAP}, {_drawn_sql("greatest(3, CAST(round_even(pow(n, 1 / 3.0), 0) AS BIGINT))")}, ra AS (SELECT k, rep, avg(y) - regr_slope(y, x) * avg(x) AS a FROM zr GROUP BY k, rep),
  rb3 AS (SELECT ra.k, ra.a, zs.a AS a0, avg(ra.a) OVER (PARTITION BY ra.k) AS centre FROM ra JOIN zs USING (k))
  SELECT k AS series, {_r("max(a0) * 12 AS alpha_ann", "(1 + count(*) FILTER (WHERE round(abs(a - centre), 12) >= round(abs(a0), 12))) / (1 + count(*)) AS p_boot")}, count(*) AS used FROM rb3 GROUP BY k"""
)
def alpha_bootstrap(s, d):
    return G.alpha_bootstrap(contestants(s, d), frame_of(s, d), MODELS["CAPM"])


_CELLS = f"""{_GAP}, {_drawn_sql("6")}, lg AS (SELECT n, greatest(1, CAST(floor(4 * pow(n / 100.0, 2 / 9.0)) AS BIGINT)) AS m FROM zn),
  zx AS (SELECT 'CAPM' AS model, k, rep, pos, x, y FROM zr UNION ALL SELECT 'Mean', k, rep, pos, 0.0, y FROM zr UNION ALL SELECT 'CAPM', k, -1, pos, x, y FROM z0 UNION ALL SELECT 'Mean', k, -1, pos, 0.0, y FROM z0),
  zf2 AS (SELECT model, k, rep, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, coalesce(CASE WHEN model = 'CAPM' THEN regr_slope(y, x) END, 0) AS b, avg(y) - coalesce(CASE WHEN model = 'CAPM' THEN regr_slope(y, x) END, 0) * avg(x) AS a FROM zx GROUP BY model, k, rep),
  zg AS (SELECT model, k, rep, pos, a, (y - a - b * x) * CASE WHEN model = 'CAPM' THEN (sxx - sx * x) / (n * sxx - sx * sx) ELSE 1.0 / n END AS g FROM zx JOIN zf2 USING (model, k, rep)),
  ze AS (SELECT model, k, rep, max(a) AS a, sqrt(sum(g * g + {" + ".join(f"CASE WHEN m >= {j} THEN 2 * (1 - {j} / (m + 1)) * g * coalesce(g{j}, 0) ELSE 0 END" for j in range(1, 5))})) AS e
    FROM (SELECT *, {", ".join(f"lag(g, {j}) OVER w AS g{j}" for j in range(1, 5))} FROM zg WINDOW w AS (PARTITION BY model, k, rep ORDER BY pos)), lg GROUP BY model, k, rep),
  ob AS (SELECT model, k, a AS a0, e AS se0, a / e AS t0, row_number() OVER (ORDER BY round(abs(a / e), 12) DESC, k, model) AS rank FROM ze WHERE rep = -1),
  tt AS (SELECT model, k, rep, (ze.a - a0) / ze.e AS t, t0, rank FROM ze JOIN ob USING (model, k) WHERE rep >= 0),
  ms AS (SELECT *, max(abs(t)) OVER (PARTITION BY rep ORDER BY rank DESC) AS most FROM tt),
  ct AS (SELECT model, k, rank, count(*) FILTER (WHERE most >= abs(t0)) AS k0, count(*) FILTER (WHERE abs(t) >= abs(t0)) AS k1, count(*) AS reps, quantile_cont(t, 0.025) AS lo, quantile_cont(t, 0.975) AS hi, quantile_cont(abs(t), 0.95) AS crit, stddev_pop(t) AS sd FROM ms GROUP BY ALL)"""


@query(
    f"""{_CELLS} SELECT k AS series, model, (SELECT n FROM zn) AS months, {_r("a0 * 12 AS alpha_ann", "t0 AS t", f"2 * ({_CDF.format('(-abs(t0))')}) AS p_hac", "(1 + k1) / (1 + reps) AS p_single", "max((1 + k0) / (1 + reps)) OVER (ORDER BY rank) AS p_rw",
  "(a0 - hi * se0) * 12 AS ci_lo_ann", "(a0 - lo * se0) * 12 AS ci_hi_ann", "2.8 * se0 * 12 AS mde80_ann", "(crit + 0.8416 * sd) * se0 * 12 AS mde80_boot_ann")} FROM ob JOIN ct USING (model, k, rank)"""
)
def romano_wolf(s, d):
    return G.romano_wolf(contestants(s, d), frame_of(s, d), {"CAPM": MODELS["CAPM"], "Mean": []})


#: Least squares on two regressors by Cramer's rule, from centred sums, for each key k (zt: k, pos, x, w, y).
_TWO = f"""{X.FACTORS_SQL}, {_CN}, zt AS (SELECT side || '#' || series AS k, row_number() OVER (PARTITION BY side, series ORDER BY month) AS pos, mkt_rf AS x, hml AS w, y FROM (
  SELECT 'own' AS side, series, month, ret - rf AS y FROM cn JOIN fc USING (month) WHERE series <> '1/N' UNION ALL SELECT 'gap', c.series, c.month, c.ret - b.ret FROM cn c JOIN cn b ON b.series = '1/N' AND b.month = c.month AND c.series <> '1/N') JOIN fc USING (month)),
  cz AS (SELECT k, count(*) AS n, avg(x) AS mx, avg(w) AS mw, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(w, w) AS ww, covar_pop(x, w) AS xw, covar_pop(x, y) AS xy, covar_pop(w, y) AS wy, var_pop(y) AS yy, greatest(1, CAST(floor(4 * pow(count(*) / 100.0, 2 / 9.0)) AS BIGINT)) AS m FROM zt GROUP BY k),
  cb2 AS (SELECT *, xx * ww - xw * xw AS det, (xy * ww - wy * xw) / (xx * ww - xw * xw) AS b1, (wy * xx - xy * xw) / (xx * ww - xw * xw) AS b2 FROM cz), cc2 AS (SELECT *, my - b1 * mx - b2 * mw AS a FROM cb2),
  cu AS (SELECT k, pos, n, m, a, b1, b2, yy, y - a - b1 * x - b2 * w AS u, ((x - mx) * ww - (w - mw) * xw) / det / n AS p1, ((w - mw) * xx - (x - mx) * xw) / det / n AS p2, mx, mw FROM zt JOIN cc2 USING (k)),
  cg2 AS (SELECT k, pos, n, m, a, b1, b2, yy, u, (1.0 / n - mx * p1 - mw * p2) * u AS g0, p1 * u AS g1, p2 * u AS g2 FROM cu),
  cv4 AS (SELECT k, max(n) AS n, max(a) AS a, max(b1) AS b1, max(b2) AS b2, 1 - sum(u * u) / max(n) / max(yy) AS r2, {", ".join(f"sqrt(sum(g{i} * (g{i}" + "".join(f" + CASE WHEN m >= {j} THEN 2 * (1 - {j} / (m + 1)) * coalesce(lag_{i}_{j}, 0) ELSE 0 END" for j in range(1, 5)) + f"))) AS e{i}" for i in range(3))}
    FROM (SELECT *, {", ".join(f"lag(g{i}, {j}) OVER o AS lag_{i}_{j}" for i in range(3) for j in range(1, 5))} FROM cg2 WINDOW o AS (PARTITION BY k ORDER BY pos)) GROUP BY k)"""


@query(
    f"""{_TWO} SELECT 'Two factors' AS model, split_part(k, '#', 2) AS series, split_part(k, '#', 1) AS side, term, {_r("c AS coef", "e AS se", "c / e AS t", f"2 * ({_CDF.format('(-abs(c / e))')}) AS p")}, n, {_r("r2")}, false AS singular FROM (
  SELECT k, n, r2, 'alpha' AS term, a AS c, e0 AS e FROM cv4 UNION ALL SELECT k, n, r2, 'mkt_rf', b1, e1 FROM cv4 UNION ALL SELECT k, n, r2, 'hml', b2, e2 FROM cv4)"""
)
def alpha_table_two_factors(s, d):
    """Two regressors: the solve of SQL is Cramer's rule."""
    return G.alpha_table(contestants(s, d), frame_of(s, d), {"Two factors": ["mkt_rf", "hml"]}).drop("resid_vol").filter("series <> '1/N'")


# More regressors need a solve: tested against numpy.


@query(None)
def alpha_table(s, d):
    return G.alpha_table(contestants(s, d), frame_of(s, d), MODELS).drop("resid_vol")


@query(None)
def romano_wolf_of_models(s, d):
    """All contestants on all models whose regressors there are."""
    return G.romano_wolf(contestants(s, d), frame_of(s, d), {m: MODELS[m] for m in ("CAPM", "Three factors", "Regional")})
