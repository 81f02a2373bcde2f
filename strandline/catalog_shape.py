"""Queries on shaping, aligning and joining panels, on text and on scalar functions, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import _d, _r, panel, query
from .catalog_exposure import _WEIGHTS, _weights
from .catalog_states import _CDF, _STATES, _states
from .functions import finance, text
from .operators import macro as M
from .operators import panel as P
from .plans import fixtures as X
from .sources.files import FEES_BPS

_DATES = _d("month")


@query("SELECT DISTINCT series, CASE WHEN factor LIKE '%MACH%' THEN 'Momentum' WHEN factor LIKE '%FURN%' THEN 'Enhanced Value' WHEN factor LIKE '%AUTO%' THEN 'Quality' ELSE 'Reference' END AS bucket FROM rt")
def factor_bucket(s, d):
    named = F.when(F.col("factor").contains("MACH"), "Big MOMENTUM and quality").when(F.col("factor").contains("FURN"), "Enhanced Value index").when(F.col("factor").contains("AUTO"), "quality").otherwise("plain value")
    return panel(s, d).select("series", P.factor_bucket(named).alias("bucket")).distinct()


@query(f"SELECT CASE WHEN region IN ('ASIA', 'EUROPE') THEN 'Eurasia' ELSE region END AS region, count(*) AS n, {_r('avg(ret) AS mean_ret')} FROM rt WHERE ret IS NOT NULL GROUP BY 1")
def normalise_category(s, d):
    aliases = s.createDataFrame([("ASIA", "Eurasia"), ("EUROPE", "Eurasia")], "alias string, name string")
    return P.normalise_category(panel(s, d).filter("ret IS NOT NULL"), "region", aliases).groupBy("region").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"))


_REFS = ["AFRICA | Reference", "AMERICA | Reference", "ASIA | Reference"]


@query("SELECT " + _DATES + ", " + _r(*(f"max(level) FILTER (WHERE series = '{n}') AS \"{n}\"" for n in _REFS)) + " FROM rt GROUP BY month")
def to_wide(s, d):
    return P.to_wide(panel(s, d), "level", _REFS)


@query(f"SELECT {_DATES}, series, {_r('level')} FROM rt WHERE series IN ({', '.join(repr(n) for n in _REFS)})")
def to_long(s, d):
    return P.to_long(P.to_wide(panel(s, d), "level", _REFS), "level").select("month", "series", "level")


@query("SELECT * FROM (VALUES ('negative', 'negative'), ('unknown', 'unknown'), ('wrong sum', 'sum')) v(portfolio, problem) WHERE (SELECT count(*) FROM rt) > 0")
def validate_weights(s, d):
    return P.validate_weights(X.portfolios(s), panel(s, d))


@query(
    f"""{_STATES} SELECT * FROM (
  SELECT 'few months' AS "check", count(*) AS violations FROM (SELECT series FROM rt GROUP BY series HAVING count(*) <> 82)
  UNION ALL SELECT 'returns out of range', count(*) FROM rt WHERE ret IS NOT NULL AND NOT ret BETWEEN -0.3 AND 0.3
  UNION ALL SELECT 'probabilities off one', count(*) FROM st WHERE NOT p_goldilocks + p_reflation + p_stagflation + p_deflationary_bust BETWEEN 0.999999 AND 1.000001
  UNION ALL SELECT 'correlations out of range', count(*) FROM mc WHERE corr NOT BETWEEN -1 AND 1
  UNION ALL SELECT 'regions only in the panel', count(DISTINCT region) FROM rt WHERE region NOT IN ('AFRICA', 'AMERICA', 'ASIA')
  UNION ALL SELECT 'shares off 100', count(*) FROM (SELECT month, sum(CASE WHEN ret > 0 THEN 4.0 ELSE 0 END) AS t FROM rt WHERE ret IS NOT NULL GROUP BY month) WHERE NOT t BETWEEN 20 AND 80)""",
    macro=True,
)
def quality_checks(s, d):
    p, states = panel(s, d), _states(s, d)
    known = p.filter("ret IS NOT NULL")
    names = s.createDataFrame([("AFRICA",), ("AMERICA",), ("ASIA",)], "region string")
    total = states.withColumn("p", F.col("p_goldilocks") + F.col("p_reflation") + F.col("p_stagflation") + F.col("p_deflationary_bust"))
    corr = M.macro_correlations(p, X.indicators(s, d)).filter("corr IS NOT NULL")
    return P.quality_checks(
        {
            "few months": P.off_counts(p, ["series"], 82),
            "returns out of range": P.outside(known, "ret", -0.3, 0.3),
            "probabilities off one": P.outside(total, "p", 0.999999, 1.000001),
            "correlations out of range": P.outside(corr, "corr", -1.0, 1.0),
            "regions only in the panel": P.key_symmetric_difference(p, names, "region").filter("side = 'left'"),
            "shares off 100": P.off_sums(known.withColumn("v", F.when(F.col("ret") > 0, 4.0).otherwise(0.0)), ["month"], "v", 20.0, 80.0),
        }
    )


def _business(s, d):
    """The panel stamped with the last day of business that it saw."""
    return X.levels(s, d).select("series", "date", "level")


@query(f"SELECT series, {_DATES}, count(*) AS n FROM lv GROUP BY series, month")
def month_stamp(s, d):
    return P.month_stamp(_business(s, d)).groupBy("series", "month").agg(F.count("*").alias("n"))


@query(
    f"""SELECT series, {_d("date", "month")}, {_r("level")} FROM (SELECT a.series, a.month AS date, a.month, b.level FROM fin a LEFT JOIN
  (SELECT series, month, arg_max(level, date) AS level FROM lv WHERE month(month) <> 2 GROUP BY series, month) b USING (series, month))"""
)
def align_months(s, d):
    """Calendar month-ends take the level of the month's last business day; Februaries are missing."""
    index = panel(s, d).select("series", F.col("month").alias("date"))
    return P.align_months(_business(s, d).filter(F.month("date") != 2), index).select("series", "date", "month", "level")


@query(
    f"""SELECT c.series, strftime(c.month, '%Y-%m-%d') AS month, {_r("value")} FROM (SELECT series, last_day(CAST(unnest(generate_series(date_trunc('month', min(month)), date_trunc('month', max(month)), INTERVAL 1 MONTH)) AS DATE)) AS month
  FROM lv WHERE month(month) NOT IN (3, 4) GROUP BY series) c LEFT JOIN (SELECT series, month, level AS value FROM lv WHERE month(month) NOT IN (3, 4)) v USING (series, month)"""
)
def resample_with_gaps(s, d):
    """Two months of every year are missing and come back as empty months of the calendar."""
    return P.resample_month_end(_business(s, d).filter(~F.month("date").isin(3, 4)), "series", "date", "level")


_NEW = "(SELECT series, month, level * 2 AS level FROM fin WHERE (region = 'ASIA' AND month >= DATE '1998-01-31') OR (region = 'EUROPE' AND month >= DATE '2000-01-31'))"


@query(f"SELECT series, {_DATES}, {_r('level')} FROM (SELECT * FROM {_NEW} UNION ALL SELECT o.series, o.month, o.level FROM fin o LEFT JOIN (SELECT series, min(month) AS f FROM {_NEW} GROUP BY series) n USING (series) WHERE f IS NULL OR month < f)")
def splice(s, d):
    old = panel(s, d).select("series", "region", "month", "level")
    new = old.filter("(region = 'ASIA' AND month >= '1998-01-31') OR (region = 'EUROPE' AND month >= '2000-01-31')").withColumn("level", F.col("level") * 2)
    return P.splice(old, new).drop("region")


@query(f"{_STATES} SELECT {_DATES}, lag(state, 2) OVER (ORDER BY month) AS state, {_r('lag(growth_score, 2) OVER (ORDER BY month) AS growth_score')} FROM st", macro=True)
def lag_labels(s, d):
    return P.lag_labels(_states(s, d).select("month", "state", "growth_score"), 2, ("state", "growth_score"))


@query(f"{_STATES} SELECT series, {_DATES}, {_r('ret')}, state FROM rt JOIN st USING (month) WHERE ret IS NOT NULL", macro=True)
def join_month(s, d):
    return P.join_month(panel(s, d).filter("ret IS NOT NULL").select("series", "month", "ret"), _states(s, d).select("month", "state"))


@query(f"SELECT series, {_DATES}, {_r('ret')} FROM rt WHERE region = 'ASIA' AND month IN (SELECT month FROM rt WHERE region = 'EUROPE' AND year(month) IN (1997, 1999))")
def intersect_months(s, d):
    p = panel(s, d).select("series", "region", "month", "ret")
    return P.intersect_months(p.filter("region = 'ASIA'"), p.filter("region = 'EUROPE' AND year(month) IN (1997, 1999)")).drop("region")


@query(f"{_STATES}, ps AS (SELECT month, state, row_number() OVER (ORDER BY month) AS pos FROM st) SELECT strftime(a.month, '%Y-%m-%d') AS month, a.state = b.state AS same, count(*) AS n, CAST(min(abs(a.pos - b.pos)) AS BIGINT) AS nearest FROM ps a JOIN ps b ON abs(a.pos - b.pos) > 6 WHERE a.pos % 10 = 0 GROUP BY ALL", macro=True)
def exclude_band_join(s, d):
    place = F.row_number().over(W.orderBy("month"))
    states = _states(s, d).select("month", "state", place.alias("pos")).withColumn("is_query", F.col("pos") % 10 == 0)
    pairs = P.exclude_band_join(states, 6, ["state"])
    return pairs.groupBy("month", (F.col("state") == F.col("o_state")).alias("same")).agg(F.count("*").alias("n"), F.min(F.abs(F.col("pos") - F.col("o_pos"))).cast("long").alias("nearest"))


@query("SELECT series, 'missing' AS side FROM (SELECT DISTINCT series FROM rt WHERE region <> 'ASIA') UNION ALL SELECT DISTINCT series, 'common' FROM rt WHERE region = 'ASIA'")
def missing_members(s, d):
    p = panel(s, d).select("series", "region")
    asia = p.filter("region = 'ASIA'")
    return P.missing_members(p, asia, "series").withColumn("side", F.lit("missing")).unionAll(P.common_members(p, asia, "series").withColumn("side", F.lit("common")))


@query("SELECT DISTINCT series, CASE WHEN region = 'ASIA' THEN 'left' ELSE 'right' END AS side FROM rt WHERE region = 'ASIA' AND factor = 'Reference' OR region <> 'ASIA' AND factor = 'MACHINERY'")
def key_symmetric_difference(s, d):
    p = panel(s, d).select("series", "region", "factor")
    return P.key_symmetric_difference(p.filter("region = 'ASIA' AND factor IN ('Reference', 'MACHINERY')"), p.filter("factor = 'MACHINERY'"), "series")


@query("SELECT region FROM (SELECT region FROM rt WHERE factor = 'Reference' AND region <> 'ASIA' INTERSECT SELECT region FROM rt WHERE factor = 'MACHINERY' AND region <> 'EUROPE')")
def shared_keys(s, d):
    p = panel(s, d)
    return P.shared_keys(p.filter("factor = 'Reference' AND region <> 'ASIA'"), p.filter("factor = 'MACHINERY' AND region <> 'EUROPE'"), "region")


#: Proxy series over a longer calendar than the panel's: indicators in place of other assets.
_PROXY = "(SELECT 'Asset | ' || indicator AS series, month, value AS level FROM ind WHERE indicator IN ('unit_price', 'avg_total') UNION ALL SELECT 'Asset | early', DATE '1990-01-31', 1.0)"


@query(f"SELECT series, {_DATES}, {_r('level')} FROM (SELECT series, month, level FROM fin UNION ALL SELECT * FROM {_PROXY} WHERE month IN (SELECT month FROM fin))", macro=True)
def append_proxies(s, d):
    own = X.indicators(s, d).filter("indicator IN ('unit_price', 'avg_total')").select(F.concat(F.lit("Asset | "), F.col("indicator")).alias("series"), "month", F.col("value").alias("level"))
    early = s.sql("SELECT 'Asset | early' AS series, DATE '1990-01-31' AS month, 1.0D AS level")
    return P.append_proxies(panel(s, d).select("series", "month", "level"), own.unionAll(early))


@query(f"SELECT 'short' AS run, region, count(*) AS n, {_r('avg(ret) AS mean_ret')}, NULL AS worst FROM rt WHERE month > DATE '1999-12-31' GROUP BY region UNION ALL SELECT 'long', region, count(*), NULL, round(min(ret), 6) + 0.0 FROM rt GROUP BY region")
def stack_runs(s, d):
    p = panel(s, d).groupBy("region")
    short = panel(s, d).filter("month > '1999-12-31'").groupBy("region").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"))
    return P.stack_runs({"short": short, "long": p.agg(F.count("*").alias("n"), F.min("ret").alias("worst"))})


_HELD = "(SELECT portfolio AS rule, month, series, weight * (1 + month(month) / 100.0) AS w FROM wt CROSS JOIN (SELECT DISTINCT month FROM rt WHERE month(month) IN (3, 9)))"


@query(
    f"""{_WEIGHTS} SELECT rule, strftime(m.month, '%Y-%m-%d') AS month, strftime(h.month, '%Y-%m-%d') AS refit_month, h.series, {_r("h.w AS w")}
  FROM (SELECT DISTINCT month FROM rt) m JOIN {_HELD} h ON h.month = (SELECT max(x.month) FROM (SELECT DISTINCT month FROM rt WHERE month(month) IN (3, 9)) x WHERE x.month <= m.month)"""
)
def hold_forward(s, d):
    months = panel(s, d).select("month").distinct()
    refits = months.filter(F.month("month").isin(3, 9))
    weights = _weights(s, d).crossJoin(refits).select(F.col("portfolio").alias("rule"), "month", "series", (F.col("weight") * (1 + F.month("month") / 100.0)).alias("w"))
    return P.hold_forward(weights, weights.select("rule").distinct().crossJoin(months)).select("rule", "month", "refit_month", "series", "w")


# Text: pages are written from the look-through tables and taken apart again.

_LOOK = """sl AS (
  SELECT r_name || ' | ' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'Reference' ELSE c_mktsegment END AS series, r_name AS region, n_name, p_type, l_partkey, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
tt AS (SELECT series, CAST(sum(amount) AS DOUBLE) AS t FROM sl GROUP BY series)"""
_LETTERS = ("0123456789", "ABCDEFGHIJ")


@query(
    f""", {_LOOK} SELECT series, kind, label, {_r("round(v / t * 100, 2) AS weight_pct")} FROM (SELECT series, 'country' AS kind, 'Nation ' || translate(replace(n_name, 'NATION_', ''), '{_LETTERS[0]}', '{_LETTERS[1]}') AS label, CAST(sum(amount) AS DOUBLE) AS v FROM sl GROUP BY ALL
  UNION ALL SELECT series, 'sector', p_type, CAST(sum(amount) AS DOUBLE) FROM sl GROUP BY ALL) JOIN tt USING (series)"""
)
def extract_weight_pairs(s, d):
    nation = F.concat(F.lit("Nation "), F.translate(F.replace("category", F.lit("NATION_")), *_LETTERS))
    line = F.concat(F.when(F.col("dim") == "country", nation).otherwise(F.col("category")), F.format_string(" %.2f%%", "weight_pct"))
    lines = X.look_through(s, d).groupBy("series").pivot("dim", ["sector", "country"]).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n"))
    page = F.concat(F.col("series"), F.lit(" index 99%\nSECTOR WEIGHTS (%)\n"), F.col("sector"), F.lit("\nCOUNTRY WEIGHTS (%)\n"), F.col("country"), F.lit("\nSince 12%, Dec 31%"))
    found = text.extract_weight_pairs(lines.select("series", page.alias("text")), ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"), "series")
    return found.select("series", "kind", "label", "weight_pct")


_TOP = f"""{_LOOK}, tp AS (SELECT * FROM (SELECT series, region, l_partkey, v, t, row_number() OVER (PARTITION BY series ORDER BY v DESC, l_partkey) AS place FROM (
  SELECT series, region, l_partkey, CAST(sum(amount) AS DOUBLE) AS v FROM sl GROUP BY ALL) JOIN tt USING (series)) WHERE place <= 10)"""
_TWO_WEIGHTS, _WITH_CODE = ("EUROPE",), ("ASIA", "AFRICA")


@query(
    f""", {_TOP} SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY name) AS BIGINT) AS place, name, country, mktcap, weight_pct, sector FROM (
  SELECT series, 'PART' || translate(CAST(l_partkey AS VARCHAR), '{_LETTERS[0]}', '{_LETTERS[1]}') AS name, CASE WHEN region IN {_WITH_CODE} THEN substr(region, 1, 2) ELSE 'US' END AS country,
  CASE WHEN region NOT IN ('EUROPE') THEN round(1000 + v / 1000, 2) + 0.0 END AS mktcap, {_r("round(v / t * 100, 2) AS weight_pct")}, 'Info Tech' AS sector FROM tp)"""
)
def extract_constituents(s, d):
    sums = X.sales(s, d).groupBy("series", "region", "l_partkey").agg(F.sum("amount").cast("double").alias("v"))
    totals = X.sales(s, d).groupBy("series").agg(F.sum("amount").cast("double").alias("t"))
    top = sums.withColumn("place", F.row_number().over(W.partitionBy("series").orderBy(F.desc("v"), "l_partkey"))).filter("place <= 10").join(totals, "series")
    name = F.concat(F.lit("PART"), F.translate(F.col("l_partkey").cast("string"), *_LETTERS))
    cap, pct = F.format_number(1000 + F.col("v") / 1000, 2), F.format_string("%.2f", F.col("v") / F.col("t") * 100)
    noise = F.when(F.col("place") == 1, "Largest 10 Index ").otherwise("")
    line = (
        F.when(F.col("region").isin(*_WITH_CODE), F.concat(noise, name, F.lit(" "), F.substring("region", 1, 2), F.lit(" "), cap, F.lit(" "), pct, F.lit(" Info Tech")))
        .when(F.col("region").isin(*_TWO_WEIGHTS), F.concat(F.lit("Index "), name, F.lit(" "), pct, F.lit(" 1.50 Info Tech")))
        .otherwise(F.concat(F.lit("Index "), name, F.lit(" "), cap, F.lit(" "), pct, F.lit(" Info Tech")))
    )
    pages = top.groupBy("series").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name.alias("name"), line.alias("line")))), lambda x: x["line"]), "\n").alias("page"))
    page = F.concat(F.lit("Top constituents\n"), F.col("page"), F.lit("\nTOTAL XX 1.00 1.00 All\n"))
    return text.extract_constituents(pages.select("series", page.alias("text")), id_col="series").withColumn("place", F.col("place").cast("long"))


@query("SELECT p_partkey, p_name AS clean FROM part")
def clean_name(s, d):
    noisy = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Largest 1,234.5  of ").when(F.col("p_partkey") % 3 == 1, "Index ").otherwise(""), F.col("p_name"))
    return X.table(s, d, "part").select("p_partkey", text.clean_name(noisy).alias("clean"))


_BOND = """SELECT *, lag(y) OVER (ORDER BY month) AS p, (1 - pow(1 + y, -10.0)) / y AS dur, 2 / (y * y) * (1 - pow(1 + y, -10.0)) - 20 / (y * pow(1 + y, 11.0)) AS conv FROM (SELECT month, value AS y FROM ind WHERE indicator = 'avg_discount')"""


@query(f"SELECT {_DATES}, {_r('p / 12 - dur * (y - p) + 0.5 * conv * (y - p) * (y - p) AS ret')} FROM ({_BOND})", macro=True)
def bond_return(s, d):
    yields = X.indicators(s, d).filter("indicator = 'avg_discount'").withColumn("value", F.col("value") * 100)
    return finance.bond_return(yields).select("month", "ret")


@query(f"SELECT {_DATES}, {_r('avg(ret) AS value')} FROM rt WHERE series IN ('ASIA | MACHINERY', 'ASIA | FURNITURE') AND ret IS NOT NULL GROUP BY month")
def hi_mean(s, d):
    rows = panel(s, d).filter("region = 'ASIA' AND ret IS NOT NULL")
    name = F.when(F.col("factor") == "MACHINERY", "SMALL HiBM").when(F.col("factor") == "FURNITURE", "BIG HiBM").otherwise("ME1 BM2")
    return finance.hi_mean(rows.select("month", name.alias("name"), F.col("ret").alias("value")))


@query(f"{X.FACTORS_SQL} SELECT series, {_DATES}, {_r('ret - rf AS excess', 'mkt_rf + rf AS mkt')} FROM rt JOIN fc USING (month) WHERE ret IS NOT NULL")
def total_return(s, d):
    p = panel(s, d).filter("ret IS NOT NULL").select("series", "factor", "month", "ret")
    factors = X.research_factors(p)
    return finance.excess_return(p, factors).join(finance.total_return(factors).select("month", "mkt"), "month").select("series", "month", "excess", "mkt")


_FEE = "(CASE WHEN series = 'ASIA | MACHINERY' THEN 10.0 ELSE CASE WHEN factor = 'Reference' THEN 15.0 ELSE 30.0 END + CASE WHEN region = 'AFRICA' THEN 10.0 ELSE 0 END END / 10000)"


@query(f"SELECT DISTINCT series, {_r(f'{_FEE} * 100 AS fee_pct')} FROM rt")
def series_fee(s, d):
    bps = {k: v for k, v in FEES_BPS.items() if not k.startswith("Asset")} | {"ASIA | MACHINERY": 10.0}
    return panel(s, d).select("series").distinct().select("series", (finance.series_fee(F.col("series"), bps, ("AFRICA",)) * 100).alias("fee_pct"))


@query(f"{X.FACTORS_SQL} SELECT series, {_DATES}, {_r('(1 + ret) * (1 + hml) - 1 AS unhedged', 'ret + 0.003 - rf AS hedged')} FROM rt JOIN fc USING (month) WHERE ret IS NOT NULL")
def restate_currency(s, d):
    p = panel(s, d)
    fx = X.research_factors(p).select("month", F.col("hml").alias("fx"), F.lit(0.003).alias("rf_foreign"), F.col("rf").alias("rf_home"))
    return finance.restate_currency(p, fx).select("series", "month", "unhedged", "hedged")


_Z = (finance.Z_975, finance.Z_80)


@query(
    f"""SELECT series, {_r("delta", "se", *(f"{_CDF.format(f'({lam} - {_Z[0]})')} + {_CDF.format(f'(-{lam} - {_Z[0]})')} AS {n}" for lam, n in (("abs(delta) / se", "power_observed"), ("0.2 / sqrt(12.0) / se", "power_fixed"))),
  f"{_Z[0] + _Z[1]} * se AS mdes", f"{_Z[0] + _Z[1]} * se * sqrt(12.0) AS mdes_ann", f"abs(delta) / ({_Z[0] + _Z[1]} * se) AS observed_over_mdes")}
  FROM (SELECT series, avg(ret) / stddev_pop(ret) - 0.1 AS delta, 1 / sqrt(count(*)) AS se FROM rt WHERE ret IS NOT NULL GROUP BY series)"""
)
def power_mdes(s, d):
    known = panel(s, d).filter("ret IS NOT NULL").groupBy("series")
    return finance.power_mdes(known.agg((F.avg("ret") / F.stddev_pop("ret") - 0.1).alias("delta"), (1 / F.sqrt(F.count("*"))).alias("se")))
