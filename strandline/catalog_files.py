"""Queries that write the given tables in the inputs' file forms, read them back and compare: the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import _d, _r, panel, query
from .operators import exposure as E
from .operators import panel as P
from .operators import performance as A
from .plans import fixtures as X
from .plans.scratch import scratch_path
from .sources import files

_DATES = _d("month")


@query("SELECT DISTINCT replace(series, ' | ', '_') AS index_id, series AS display_name, region, factor AS factor_type, 'local' AS source, region || '/' || factor || '.csv' AS returns_file, CASE WHEN factor = 'Reference' THEN region || '.pdf' END AS weights_file FROM rt")
def read_registry(s, d):
    path = scratch_path(s, "registry")
    weights = F.when(F.col("factor") == "Reference", F.concat("region", F.lit(".pdf")))
    one = panel(s, d).select("series", "region", "factor").distinct()
    named = one.select(
        F.replace("series", F.lit(" | "), F.lit("_")).alias("index_id"), F.col("series").alias("display_name"), "region", F.col("factor").alias("factor_type"),
        F.lit("local").alias("source"), F.concat("region", F.lit("/"), "factor", F.lit(".csv")).alias("returns_file"), weights.alias("weights_file"),
    )
    files.write_table(named, path, fmt="csv")
    return files.read_registry(s, path)


@query(f"SELECT series, {_d('date')}, {_r('level')} FROM lv WHERE month(month) <> 5")
def read_levels(s, d):
    """Levels as CSV with preamble and footer rows and with blank levels in every May."""
    path = scratch_path(s, "levels")
    rows = X.levels(s, d).select("series", F.date_format("date", "yyyy-MM-dd").alias("date"), F.when(F.month("month") != 5, F.format_string("%.4f", "level")).alias("level"))
    extra = s.sql("SELECT '' AS series, 'Index levels' AS date, 'as of 2001' AS level UNION ALL SELECT 'x', 'Copyright 2001', '1.0' UNION ALL SELECT 'x', '2001-13-01', '1.0'")
    files.write_table(rows.unionAll(extra), path, fmt="csv")
    files.write_table(rows.unionAll(extra), path, "append", fmt="csv")
    again = files.read_levels(s, path)
    return again.groupBy("series", "date").agg(F.max("level").alias("level"), F.count("*").alias("n")).filter("n = 2").drop("n")


@query(f"SELECT series, strftime(month, '%Y-%m-%d') AS date, {_r('level')} FROM fin")
def read_level_json(s, d):
    """One payload of nested rows for each series, in a folder of its own."""
    path = scratch_path(s, "payload")
    row = F.struct(F.date_format("month", "yyyyMMdd").cast("int").alias("calc_date"), F.col("level").alias("level_eod"))
    payload = F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(row)).alias("INDEX_LEVELS")).alias("indexes")))
    panel(s, d).groupBy("series").agg(payload.alias("value")).write.partitionBy("series").text(path)
    return files.read_level_json(s, path)


@query(f"SELECT series, strftime(month, '%Y-%m-%d') AS date, {_r('level AS price')} FROM fin WHERE month(month) <> 7")
def read_chart_json(s, d):
    """Parallel arrays of seconds and prices, null in every July."""
    path = scratch_path(s, "chart")
    cell = F.struct(F.unix_timestamp(F.col("month").cast("timestamp")).alias("t"), F.when(F.month("month") != 7, F.col("level")).alias("p"))
    cells = panel(s, d).groupBy("series").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    prices = F.array(F.struct(F.transform("c", lambda x: x["p"]).alias("adjclose")))
    result = F.struct(F.transform("c", lambda x: x["t"]).alias("timestamp"), F.struct(prices.alias("adjclose")).alias("indicators"))
    payload = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    cells.select("series", payload.alias("value")).write.partitionBy("series").text(path)
    return files.read_chart_json(s, path)


@query(f"SELECT region, {_DATES}, factor AS name, {_r('CASE WHEN month(month) <> 9 THEN round(ret * 100, 4) / 100 END AS value')} FROM rt WHERE ret IS NOT NULL AND month IN (SELECT month FROM rc)")
def read_monthly_block(s, d):
    """A text file for each region: preamble, a row of percentages for each month (sentinels in September), an annual table."""
    path = scratch_path(s, "block")
    p = P.complete_months(panel(s, d), "ret")
    cell = F.when(F.month("month") == 9, F.when(F.col("factor") == "Reference", " -99.99").otherwise("-999")).otherwise(F.format_string("%9.4f", F.col("ret") * 100))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("factor", cell.alias("v")))), lambda x: x["v"])
    rows = p.groupBy("region", "month").agg(F.concat(F.date_format("month", "yyyyMM"), F.lit(", "), F.array_join(ordered, ", ")).alias("line"))
    names = F.array_join(F.array_sort(F.collect_set("factor")), " , ")
    body = rows.groupBy("region").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body")).join(p.groupBy("region").agg(names.alias("names")), "region")
    text = F.concat(F.lit("Monthly returns\nin percent, 2001\n\n,"), F.col("names"), F.lit("\n"), F.col("body"), F.lit("\n\n Annual\n,x\n1999, 1.0\n199901, 5.0, 5.0\n"))
    body.select("region", text.alias("value")).write.partitionBy("region").text(path)
    return files.read_monthly_block(s, path)


@query(f"SELECT event_type, count(*) AS n, {_r('round(sum(CAST(round(value, 2) AS DECIMAL(18,2))), 2) AS total')} FROM events WHERE value IS NOT NULL AND user_id % 7 <> 0 GROUP BY event_type")
def read_observations(s, d):
    """A feed in which every seventh user's value is a dot."""
    path = scratch_path(s, "feed")
    rows = X.table(s, d, "events").filter("value IS NOT NULL")
    value = F.when(F.col("user_id") % 7 == 0, ".").otherwise(F.format_string("%.2f", F.round("value", 2)))
    files.write_table(rows.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("date"), value.alias("value")), path, partition_by=("event_type",), fmt="csv")
    return files.read_observations(s, path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT regime, 2 * count(*) AS n FROM rt JOIN rg ON month BETWEEN s AND e WHERE ret IS NOT NULL GROUP BY regime")
def write_table(s, d):
    """A folder for each regime, written over what was there and then extended."""
    path = scratch_path(s, "regimes")
    rows = A.join_regimes(panel(s, d).filter("ret IS NOT NULL"), X.regimes(s)).select("regime", "series", "month", "ret")
    for mode in ("overwrite", "overwrite", "append"):
        files.write_table(rows, path, mode, ("regime",))
    return s.read.parquet(path).groupBy("regime").agg(F.count("*").alias("n"))


_EPISODES = ", ".join(f"('{r}', DATE '{a}', DATE '{b}')" for r, a, b in files.REGIMES)


@query(f"SELECT regime, count(*) AS n, {_r('avg(ret) AS mean_ret')} FROM rt JOIN (VALUES {_EPISODES}) v(regime, s, e) ON month BETWEEN s AND e WHERE ret IS NOT NULL GROUP BY regime")
def literal_regimes(s, d):
    """The fixed regimes on the panel: those that its months reach."""
    rows = A.join_regimes(panel(s, d).filter("ret IS NOT NULL"), files.literal_table(s, "regimes"))
    return rows.groupBy("regime").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"))


def _months(ranges: list[tuple[str, str, str]]) -> str:
    return ", ".join(f"('{r}', DATE '{a}', DATE '{b}')" for r, a, b in ranges)


@query(
    f"""SELECT u AS universe, regime, count(DISTINCT month) AS n_months, count(*) AS n, {_r("avg(ret) AS mean_ret")} FROM rt JOIN (SELECT 'modern' AS u, * FROM (VALUES {_months(files.EPISODES_MODERN)}) UNION ALL SELECT 'historic', * FROM (VALUES {_months(files.EPISODES_HISTORIC)})) v(u, regime, s, e)
  ON CASE WHEN u = 'modern' THEN month ELSE last_day(month - INTERVAL 240 MONTH) END BETWEEN s AND e WHERE ret IS NOT NULL GROUP BY ALL"""
)
def literal_episodes(s, d):
    """The two universes of episodes, apart: the modern ones on the panel's months, the historic ones on months twenty years before."""
    rows = panel(s, d).filter("ret IS NOT NULL").select("series", "month", "ret")
    early = rows.withColumn("month", F.last_day(F.add_months("month", -240)))
    both = [A.join_regimes(r, files.literal_table(s, f"episodes_{u}")).withColumn("universe", F.lit(u)) for u, r in (("modern", rows), ("historic", early))]
    return both[0].unionByName(both[1]).groupBy("universe", "regime").agg(F.countDistinct("month").alias("n_months"), F.count("*").alias("n"), F.avg("ret").alias("mean_ret"))


_TRANSCRIBED = ", ".join(f"('{x}', '{dim}', '{c}', {w})" for x, dims in files.TRANSCRIBED.items() for dim, rows in dims.items() for c, w in rows)


@query(
    f"""SELECT dim, category, {_r("sum(w * pct) AS pct")} FROM (VALUES {_TRANSCRIBED}) t(series, dim, category, pct) JOIN (
  SELECT 'AC_Asia_ex_Japan | ' || CASE factor WHEN 'MACHINERY' THEN 'Momentum' ELSE 'Enhanced Value' END AS series, sum(level) / sum(sum(level)) OVER () AS w FROM rt WHERE region = 'ASIA' AND factor IN ('MACHINERY', 'FURNITURE') GROUP BY factor) USING (series) GROUP BY dim, category"""
)
def transcribed_exposure(s, d):
    """What a portfolio of the two transcribed indices holds; its weights are two series' shares of their levels."""
    own = panel(s, d).filter("region = 'ASIA' AND factor IN ('MACHINERY', 'FURNITURE')")
    name = F.concat(F.lit("AC_Asia_ex_Japan | "), F.when(F.col("factor") == "MACHINERY", "Momentum").otherwise("Enhanced Value"))
    levels = own.groupBy(name.alias("series")).agg(F.sum("level").alias("l"))
    weights = levels.select(F.lit("two").alias("portfolio"), "series", (F.col("l") / F.sum("l").over(W.partitionBy())).alias("weight"))
    return E.look_through(weights, files.literal_table(s, "transcribed")).select("dim", "category", "pct")
