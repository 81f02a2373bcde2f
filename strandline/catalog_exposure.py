"""Queries on what portfolios hold, with the same rows in SQL."""

from __future__ import annotations

from .catalog import _d, _r, panel, query
from .operators import covariance as V
from .operators import exposure as E
from .operators import panel as P
from .operators import performance as A
from .plans import fixtures as X
from .plans.scratch import settled

_VALID = ("one region", "sixty forty")
_ROWS = [(p, s, w) for p in _VALID for s, w in X.PORTFOLIOS[p].items()]
_WEIGHTS = f""", wt AS (SELECT portfolio, series, CAST(w AS DOUBLE) AS weight FROM (VALUES {", ".join(f"('{p}', '{s}', {w})" for p, s, w in _ROWS)}) t(portfolio, series, w))"""

_EXPOSURE = f"""{_WEIGHTS}, sl AS (
  SELECT r_name || ' | ' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'Reference' ELSE c_mktsegment END AS series, n_name, p_type, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
tt AS (SELECT series, CAST(sum(amount) AS DOUBLE) AS t FROM sl GROUP BY series),
lt AS (SELECT series, dim, category, v / t * 100 AS weight_pct FROM (SELECT series, 'country' AS dim, n_name AS category, CAST(sum(amount) AS DOUBLE) AS v FROM sl GROUP BY ALL
  UNION ALL SELECT series, 'sector', p_type, CAST(sum(amount) AS DOUBLE) FROM sl GROUP BY ALL) JOIN tt USING (series)),
xp AS (SELECT portfolio, dim, category, sum(weight * weight_pct) AS pct FROM wt JOIN lt USING (series) GROUP BY ALL)
"""

#: Deviations, moments of all ordered pairs (population) and the constant-correlation shrinkage of them.
_MOMENTS = """, dx AS (SELECT series, month, ret, ret - avg(ret) OVER (PARTITION BY series) AS x FROM rc),
mo AS (SELECT a.series AS i, b.series AS j, count(*) AS n, avg(a.x * b.x) AS c, sum(a.x * b.x) / nullif(count(*) - 1, 0) AS cs, avg(a.x * a.x * b.x * b.x) AS m22, avg(a.x * a.x * a.x * b.x) AS m31
  FROM dx a JOIN dx b ON a.month = b.month GROUP BY ALL),
vr AS (SELECT i AS s, c AS v FROM mo WHERE i = j),
p1 AS (SELECT mo.*, a.v AS vi, b.v AS vj, sqrt(a.v * b.v) AS root FROM mo JOIN vr a ON a.s = i JOIN vr b ON b.s = j),
rb AS (SELECT avg(c / root) AS r FROM p1 WHERE i <> j),
p2 AS (SELECT p1.*, CASE WHEN i = j THEN vi ELSE r * root END AS f, m22 - c * c AS pi, CASE WHEN i = j THEN 0 ELSE sqrt(vj / vi) * (m31 - vi * c) END AS th, r FROM p1, rb),
dl AS (SELECT least(1, greatest(0, (sum(pi) - sum(pi) FILTER (WHERE i = j) - max(r) * sum(th)) / sum((c - f) * (c - f)) / max(n))) AS delta FROM p2),
sk AS (SELECT i, j, delta * f + (1 - delta) * c AS cov, delta, n FROM p2, dl)
"""

_COV = f"""{_WEIGHTS}{_MOMENTS}, pc AS (SELECT p.portfolio, p.series, sum(p.weight * cov * q.weight) AS part FROM wt p JOIN sk ON p.series = i JOIN wt q ON q.series = j AND q.portfolio = p.portfolio GROUP BY ALL)
"""


def _weights(s, d):
    return X.portfolios(s).filter(f"portfolio IN {_VALID}")


def _exposure(s, d):
    return E.look_through(_weights(s, d), X.look_through(s, d))


def _covariance(s, d):
    return settled(V.shrink_constant_correlation(settled(V.covariance_pairs(panel(s, d)))))


@query(f"{_EXPOSURE} SELECT portfolio, dim, category, {_r('pct')} FROM xp")
def look_through(s, d):
    return _exposure(s, d)


@query(
    f"""{_EXPOSURE} SELECT portfolio, dim, {_r("sum(pct * pct) / 10000 AS hhi", "10000 / sum(pct * pct) AS effective_n", "max(pct) AS top1", "sum(pct) FILTER (WHERE r <= 3) AS top3")},
  count(*) FILTER (WHERE pct > CASE dim WHEN 'sector' THEN 30 ELSE 35 END) AS n_flagged, coalesce(string_agg(category, ', ' ORDER BY category) FILTER (WHERE pct > CASE dim WHEN 'sector' THEN 30 ELSE 35 END), '') AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY portfolio, dim ORDER BY round(pct, 9) DESC, category) AS r FROM xp) GROUP BY portfolio, dim"""
)
def concentration(s, d):
    return E.concentration(_exposure(s, d))


@query(f"{_EXPOSURE} SELECT portfolio, {_r('exp(avg(-ln(h))) AS effective_bets')}, count(*) AS n_dims FROM (SELECT portfolio, dim, sum(pct * pct) / 10000 AS h FROM xp GROUP BY ALL) GROUP BY portfolio")
def effective_bets(s, d):
    return E.effective_bets(_exposure(s, d))


@query(f"{_MOMENTS} SELECT i, j, n, {_r('cs AS cov', 'c AS cov_pop', 'm22', 'm31', 'CASE WHEN i = j THEN m END AS mean')} FROM mo JOIN (SELECT series AS i, avg(ret) AS m FROM dx GROUP BY series) USING (i)")
def covariance_pairs(s, d):
    return V.covariance_pairs(panel(s, d))


@query(f"{_MOMENTS} SELECT i, j, n, {_r('cov', 'delta')} FROM sk")
def shrink_constant_correlation(s, d):
    return _covariance(s, d)


@query(
    f"""{_MOMENTS}, tr AS (SELECT avg(c) FILTER (WHERE i = j) AS m, count(*) FILTER (WHERE i = j) AS k, sum(c * c) AS sq, sum(m22) AS s22, max(n) AS t FROM mo),
  dd AS (SELECT m, CASE WHEN sq - k * m * m > 0 THEN least((s22 - sq) / (t * k), (sq - k * m * m) / k) / ((sq - k * m * m) / k) ELSE 0 END AS delta FROM tr)
  SELECT i, j, n, {_r("(CASE WHEN i = j THEN delta * m ELSE 0 END + (1 - delta) * c) AS cov", "delta")} FROM mo, dd"""
)
def shrink_identity(s, d):
    return V.shrink_identity(V.covariance_pairs(panel(s, d)))


#: One region's countries are taken away and two country names made variants, to be put right again by the look-through.
_HOME = "ASIA"


@query(
    f"""{_EXPOSURE}, l2 AS (SELECT series, dim, CASE WHEN category = 'NATION_0' THEN 'NATION_A' ELSE category END AS category, weight_pct FROM lt WHERE NOT (dim = 'country' AND series LIKE '{_HOME} |%')
  UNION ALL SELECT DISTINCT series, 'country', 'Home', 100.0 FROM wt WHERE series LIKE '{_HOME} |%')
  SELECT portfolio, dim, category, {_r("sum(weight * weight_pct) AS pct")} FROM wt JOIN l2 USING (series) GROUP BY ALL"""
)
def look_through_with_home(s, d):
    lookup = X.look_through(s, d).filter(f"NOT (dim = 'country' AND series LIKE '{_HOME} |%')")
    return E.look_through(_weights(s, d), lookup, s.createDataFrame([("NATION_0", "NATION_A")], "alias string, name string"), {_HOME: "Home"})


@query(f"{_COV} SELECT portfolio, series, {_r('part / sqrt(sum(part) OVER w) AS contribution', 'part / sum(part) OVER w AS share')} FROM pc WINDOW w AS (PARTITION BY portfolio)")
def risk_contributions(s, d):
    return E.risk_contributions(_weights(s, d), _covariance(s, d))


@query(
    f"""{_COV}, sg AS (SELECT portfolio, sqrt(sum(part)) AS sigma FROM pc GROUP BY portfolio), gr AS (SELECT portfolio, sum(abs(weight) * sqrt(cov)) AS g FROM wt JOIN sk ON series = i AND i = j GROUP BY portfolio)
  SELECT portfolio, {_r("sigma", "g / sigma AS dr", "(g / sigma) * (g / sigma) AS dr2")} FROM sg JOIN gr USING (portfolio)"""
)
def diversification_ratio(s, d):
    return E.diversification_ratio(_weights(s, d), _covariance(s, d))


@query(f"{_WEIGHTS} SELECT portfolio, {_d('month')}, {_r('sum(weight * ret) AS ret')} FROM wt JOIN rt USING (series) WHERE ret IS NOT NULL GROUP BY portfolio, month HAVING count(*) = 2")
def portfolio_returns(s, d):
    return E.portfolio_returns(_weights(s, d), panel(s, d))


@query(f"SELECT 'inverse variance' AS portfolio, series, {_r('v / sum(v) OVER () AS weight')} FROM (SELECT series, 1 / var_samp(ret) AS v FROM rt WHERE ret IS NOT NULL GROUP BY series)")
def inverse_variance_weights(s, d):
    return E.inverse_variance_weights(panel(s, d))
