"""Readers of the inputs' file forms and the writer of result tables: Spark's own sources and column functions only.

A malformed value is null and a row without a value or a proper date is left out, as each reader says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the registry, one row for each tracked series: fixed values.
REGISTRY = "index_id string, display_name string, region string, factor_type string, source string, returns_file string, weights_file string"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_MONTH_ROW = r"^\s*\d{6}\s*,"
#: Percentages that stand for "no observation": fixed values.
SENTINELS = (-99.99, -999.0)


def _double(value: Column) -> Column:
    return value.try_cast("double")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of series: CSV with a header, all text."""
    return spark.read.csv(path, header=True, schema=REGISTRY)


def read_levels(spark: SparkSession, path: str, fmt: str = "csv", date: str = "date", value: str = "level") -> DataFrame:
    """All columns of CSV or Parquet levels, ``date`` a date and ``value`` a double.

    Preamble, footers and blank levels are skipped: a row stays if its date reads yyyy-MM-dd and its level is a number.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt!r}: csv or parquet")
    rows = spark.read.csv(path, header=True) if fmt == "csv" else spark.read.parquet(path)
    text, level = F.substring(F.trim(F.col(date).cast("string")), 1, 10), _double(F.trim(F.col(value).cast("string")))
    others = [c for c in rows.columns if c not in (date, value)]
    named = rows.select(*others, F.when(text.rlike(_DATE), text.try_cast("date")).alias(date), level.alias(value))
    return named.filter(F.col(date).isNotNull() & F.col(value).isNotNull())


def read_level_json(spark: SparkSession, path: str) -> DataFrame:
    """date, level of a service's payload {"indexes": {"INDEX_LEVELS": [{"calc_date": yyyyMMdd, "level_eod": x}, ...]}}, and the path's partition columns."""
    rows = spark.read.json(path, schema="indexes struct<INDEX_LEVELS: array<struct<calc_date: bigint, level_eod: double>>>", multiLine=True)
    one = rows.select(*_partitions(rows, "indexes"), F.explode("indexes.INDEX_LEVELS").alias("row"))
    return one.select(*_partitions(one, "row"), F.to_date(F.col("row.calc_date").cast("string"), "yyyyMMdd").alias("date"), F.col("row.level_eod").alias("level"))


def read_chart_json(spark: SparkSession, path: str) -> DataFrame:
    """date, price of a chart payload: parallel arrays of epoch seconds and prices; null prices are dropped."""
    inner = "array<struct<timestamp: array<bigint>, indicators: struct<adjclose: array<struct<adjclose: array<double>>>>>>"
    rows = spark.read.json(path, schema=f"chart struct<result: {inner}>", multiLine=True)
    result = rows.select(*_partitions(rows, "chart"), F.col("chart.result").getItem(0).alias("result"))
    pairs = F.arrays_zip(F.col("result.timestamp").alias("t"), F.col("result.indicators.adjclose").getItem(0)["adjclose"].alias("p"))
    one = result.select(*_partitions(result, "result"), F.explode(pairs).alias("row"))
    return one.filter(F.col("row.p").isNotNull()).select(*_partitions(one, "row"), F.timestamp_seconds("row.t").cast("date").alias("date"), F.col("row.p").alias("price"))


def _partitions(rows: DataFrame, but: str) -> list[str]:
    return [c for c in rows.columns if c != but]


def read_monthly_block(spark: SparkSession, path: str) -> DataFrame:
    """month, name, value (a fraction) of text files with one block of rows "YYYYMM, v1, v2, ..." and the path's partition columns.

    The line before the first such row names the columns; the block ends at the first line of another form and the
    rest, an annual table, is left out. Percentages become fractions; sentinels and what is no number are null.
    A file without such a row gives none. Each file is one row until its lines are taken apart, so no shuffle is needed.
    """
    files = spark.read.text(path, wholetext=True)
    keys = _partitions(files, "value")
    lines = F.split("value", r"\r?\n")
    first = F.array_position(F.transform(lines, lambda x: x.rlike(_MONTH_ROW)), F.lit(True))
    found = files.select(*keys, lines.alias("lines"), first.cast("int").alias("first")).filter("first > 1")
    rest = found.withColumn("rest", F.slice("lines", F.col("first"), F.size("lines"))).withColumn("end", F.array_position(F.transform("rest", lambda x: x.rlike(_MONTH_ROW)), F.lit(False)).cast("int"))
    n = F.when(F.col("end") == 0, F.size("rest")).otherwise(F.col("end") - 1)
    head = F.split(F.element_at("lines", F.col("first") - 1), ",")
    names = F.slice(head, F.lit(2), F.size(head))
    rows = rest.select(*keys, names.alias("names"), F.explode(F.slice("rest", F.lit(1), n)).alias("line")).withColumn("cells", F.split("line", ","))
    cells = F.arrays_zip(F.col("names").alias("name"), F.slice("cells", F.lit(2), F.size("cells")).alias("text"))
    flat = rows.select(*keys, F.last_day(F.to_date(F.trim(F.col("cells")[0]), "yyyyMM")).alias("month"), F.explode(cells).alias("cell"))
    percent = _double(F.trim("cell.text"))
    return flat.select(*keys, "month", F.trim("cell.name").alias("name"), F.when(~percent.isin(*SENTINELS), percent / 100).alias("value")).filter("name IS NOT NULL")


def read_observations(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """date, value of a feed of observations (and the path's partition columns); rows whose value is no number are dropped."""
    rows = spark.read.csv(path, header=True) if fmt == "csv" else spark.read.json(path)
    keys = [c for c in rows.columns if c not in ("date", "value")]
    return rows.select(*keys, F.col("date").try_cast("date").alias("date"), _double(F.trim(F.col("value").cast("string"))).alias("value")).filter("date IS NOT NULL AND value IS NOT NULL")


#: Market regimes (both ends included), stress episodes, zones of countries, fees in basis points, archetypes.
REGIMES = [
    ("dotcom_peak", "1999-01-31", "2000-03-31"), ("dotcom_bust", "2000-04-30", "2002-09-30"), ("em_supercycle", "2002-10-31", "2007-10-31"), ("gfc", "2007-11-30", "2009-02-28"),
    ("post_gfc_rebound", "2009-03-31", "2011-06-30"), ("eurocrisis_us_turn", "2011-07-31", "2015-12-31"), ("us_megacap", "2016-01-31", "2020-01-31"),
    ("covid", "2020-02-29", "2021-12-31"), ("rate_shock", "2022-01-31", "2022-10-31"), ("ai_boom", "2022-11-30", "2026-06-30"),
]
EPISODES_MODERN = [
    ("Dot-com bust", "2000-09-30", "2002-09-30"), ("Global Financial Crisis", "2007-11-30", "2009-02-28"), ("COVID crash", "2020-01-31", "2020-03-31"), ("2022 rate shock", "2022-01-31", "2022-09-30"),
]
EPISODES_HISTORIC = [
    ("OPEC stagflation", "1973-01-31", "1974-09-30"), ("Volcker squeeze", "1981-01-31", "1982-07-31"), ("Black Monday era", "1987-09-30", "1987-11-30"), ("Dot-com bust", "2000-09-30", "2002-09-30"),
    ("Global Financial Crisis", "2007-11-30", "2009-02-28"), ("2022 rate shock", "2022-01-31", "2022-09-30"),
]
#: Weights in percent of two indices that have no sheet, as published on a page with one decimal.
TRANSCRIBED = {
    "AC_Asia_ex_Japan | Enhanced Value": {
        "sector": [
            ("Information Technology", 53.1), ("Financials", 14.3), ("Industrials", 8.6), ("Consumer Discretionary", 7.9), ("Communication Services", 5.0), ("Materials", 2.4),
            ("Health Care", 2.1), ("Consumer Staples", 1.8), ("Energy", 1.8), ("Utilities", 1.3), ("Real Estate", 1.1),
        ],
        "country": [("Korea", 65.1), ("China", 25.4), ("Taiwan", 4.2), ("Hong Kong", 3.4), ("Thailand", 0.7), ("Other", 1.2)],
        "stock": [
            ("SAMSUNG ELECTRONICS CO", 23.25), ("SK HYNIX", 22.44), ("CHINA CONSTRUCTION BK H", 4.94), ("SK SQUARE CO", 3.88), ("SAMSUNG ELECTRONICS PREF", 2.94), ("ICBC H", 2.76),
            ("KIA CORP", 2.47), ("BANK OF CHINA H", 2.34), ("CHINA TOWER CORP H", 2.08), ("HYUNDAI MOBIS", 2.00),
        ],
    },
    "AC_Asia_ex_Japan | Momentum": {
        "sector": [
            ("Information Technology", 78.4), ("Industrials", 10.3), ("Financials", 5.1), ("Materials", 2.1), ("Consumer Discretionary", 1.7), ("Energy", 1.0), ("Real Estate", 0.5),
            ("Consumer Staples", 0.2), ("Utilities", 0.2), ("Communication Services", 0.1),
        ],
        "country": [("Korea", 51.6), ("Taiwan", 38.9), ("China", 4.6), ("Singapore", 2.2), ("Hong Kong", 1.3), ("Other", 1.4)],
        "stock": [
            ("SK HYNIX", 20.09), ("TAIWAN SEMICONDUCTOR MFG", 14.77), ("SAMSUNG ELECTRONICS CO", 14.50), ("DELTA ELECTRONICS", 4.63), ("SK SQUARE CO", 4.31), ("SAMSUNG ELECTRO-MECH. CO", 3.08),
            ("ASE TECHNOLOGY HOLDING", 2.33), ("MEDIATEK INC", 2.24), ("ELITE MATERIAL CO", 2.08), ("UNIMICRON TECHNOLOGY", 1.69),
        ],
    },
}
ZONES = {
    "North America": ["United States", "Canada"],
    "Europe": ["France", "Germany", "Italy", "Netherlands", "Spain", "Switzerland", "United Kingdom"],
    "Asia-Pacific": ["China", "Hong Kong", "India", "Japan", "Korea", "Singapore", "Taiwan", "Thailand"],
}
FEES_BPS = {"Reference": 15.0, "factor": 30.0, "em_asia_extra": 10.0, "Asset | US Treasury 10y": 10.0, "Asset | Gold": 15.0, "Asset | Cash (T-bill)": 10.0}
ARCHETYPES = {
    "Pure equity (1/N of 6)": {"equity_equal": 1.0},
    "60/40 stocks/bonds": {"equity_equal": 0.60, "Asset | US Treasury 10y": 0.40},
    "All-weather static": {"equity_equal": 0.30, "Asset | US Treasury 10y": 0.30, "Asset | Gold": 0.25, "Asset | Cash (T-bill)": 0.15},
}


def literal_table(spark: SparkSession, kind: str) -> DataFrame:
    """regimes, episodes_modern or episodes_historic (regime, start, end), zones (zone, country), fees (key, bps), archetypes (portfolio, key, weight) or transcribed (series, dim, category, weight_pct)."""
    ranges = {"regimes": REGIMES, "episodes_modern": EPISODES_MODERN, "episodes_historic": EPISODES_HISTORIC}
    if kind in ranges:
        rows = spark.createDataFrame(ranges[kind], "regime string, start string, end string")
        return rows.select("regime", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    if kind == "zones":
        return spark.createDataFrame([(z, c) for z, cs in ZONES.items() for c in cs], "zone string, country string")
    if kind == "fees":
        return spark.createDataFrame(list(FEES_BPS.items()), "key string, bps double")
    if kind == "archetypes":
        return spark.createDataFrame([(p, k, w) for p, spec in ARCHETYPES.items() for k, w in spec.items()], "portfolio string, key string, weight double")
    if kind == "transcribed":
        return spark.createDataFrame([(s, dim, c, w) for s, dims in TRANSCRIBED.items() for dim, rows in dims.items() for c, w in rows], "series string, dim string, category string, weight_pct double")
    raise ValueError(f"unknown table {kind!r}: {', '.join(ranges)}, zones, fees, archetypes or transcribed")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """Write a result, replacing (overwrite) or extending (append) what is there; a folder for each value of ``partition_by``."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode {mode!r}: overwrite or append")
    writer = df.write.mode(mode).format(fmt)
    writer = writer.option("header", True) if fmt == "csv" else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
