"""The driver's tables in the roles of the panel's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import SEPARATOR, literal_ranges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with month, price and the columns of their order, customer and place that panels use.

    An order's customer and place are found first, so that line items, the largest table, are shuffled once.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_shipdate")
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name", "n_name", "c_mktsegment")
    factor = F.when(F.col("c_mktsegment") == "BUILDING", "Reference").otherwise(F.col("c_mktsegment"))
    amount = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    date = F.col("l_shipdate").cast("date")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("r_name").alias("region"), factor.alias("factor"), F.concat_ws(SEPARATOR, "r_name", factor).alias("series"),
        F.last_day(date).alias("month"), date.alias("date"), "n_name", "l_partkey", amount.alias("amount"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, region, factor, month, date, level; decimal sums are the same in any order of addition."""
    return sales(spark, sf_dir).groupBy("series", "region", "factor", "month").agg(F.max("date").alias("date"), F.sum("amount").cast("double").alias("level"))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """indicator, month, value: counts, shares and prices by month, from orders and line items."""
    dec = "decimal(18,4)"
    order = table(spark, sf_dir, "orders").withColumn("month", F.last_day(F.col("o_orderdate").cast("date"))).groupBy("month")
    line = table(spark, sf_dir, "lineitem").withColumn("month", F.last_day(F.col("l_shipdate").cast("date"))).groupBy("month")
    share = lambda c: F.sum(c.cast("int")).cast("double") / F.count("*")
    total = lambda c: F.sum(F.col(c).cast(dec)).cast("double")
    o = order.agg(F.count("*").cast("double").alias("order_count"), share(F.col("o_orderpriority") == "1-URGENT").alias("urgent_share"), (total("o_totalprice") / F.count("*")).alias("avg_total"))
    x = line.agg((total("l_extendedprice") / total("l_quantity")).alias("unit_price"), (total("l_discount") / F.count("*")).alias("avg_discount"), share(F.col("l_returnflag") == "R").alias("return_share"))
    return o.unpivot("month", ["order_count", "urgent_share", "avg_total"], "indicator", "value").unionByName(x.unpivot("month", ["unit_price", "avg_discount", "return_share"], "indicator", "value"))


#: Literal month ranges, one pair of them overlapping.
REGIMES = [("early", "1995-06-30", "1996-12-31"), ("boom", "1996-07-31", "1998-06-30"), ("stress", "1998-07-31", "1998-12-31"), ("late", "1999-01-31", "2000-12-31"), ("end", "2001-01-31", "2001-10-31")]
#: axis, indicator, sign, is_primary
COMPONENTS = [("growth", "order_count", 1, True), ("growth", "urgent_share", -1, False), ("growth", "avg_total", 1, False), ("inflation", "unit_price", 1, True), ("inflation", "avg_discount", -1, False)]
#: Portfolios as series -> weight.
PORTFOLIOS = {
    "one region": {"ASIA | Reference": 0.5, "ASIA | MACHINERY": 0.5},
    "sixty forty": {"AMERICA | Reference": 0.6, "EUROPE | Reference": 0.4},
    "wrong sum": {"ASIA | Reference": 3.4},
    "negative": {"ASIA | Reference": 1.2, "EUROPE | Reference": -0.2},
    "unknown": {"Mars | Reference": 1.0},
}


def regimes(spark: SparkSession) -> DataFrame:
    return literal_ranges(spark, REGIMES)


def components(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPONENTS, "axis string, indicator string, sign int, is_primary boolean")


def portfolios(spark: SparkSession) -> DataFrame:
    rows = [(p, s, w) for p, ws in PORTFOLIOS.items() for s, w in ws.items()]
    return spark.createDataFrame(rows, "portfolio string, series string, weight double")


def look_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, dim, category, weight_pct: shares of each series by country and part type."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    rows = sales(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    both = F.explode(F.array(F.struct(F.lit("country").alias("dim"), F.col("n_name").alias("category")), F.struct(F.lit("sector").alias("dim"), F.col("p_type").alias("category"))))
    sums = rows.select("series", both.alias("d"), "amount").groupBy("series", "d.dim", "d.category").agg(F.sum("amount").cast("double").alias("v"))
    totals = rows.groupBy("series").agg(F.sum("amount").cast("double").alias("t"))
    return sums.join(totals, "series").select("series", "dim", "category", (F.col("v") / F.col("t") * 100).alias("weight_pct"))


#: Long-short differences of segments' mean returns, by the name of the research factor.
FACTORS = {"hml": ("MACHINERY", "FURNITURE"), "mom": ("AUTOMOBILE", "HOUSEHOLD")}
#: Monthly return of cash.
RF = 0.002


def research_factors(panel: DataFrame) -> DataFrame:
    """month, mkt_rf, hml, mom, rf from the panel's returns; a month without one of the segments lacks its factor."""
    segment = lambda name: F.avg(F.when(F.col("factor") == name, F.col("ret")))
    sides = [(segment(a) - segment(b)).alias(name) for name, (a, b) in FACTORS.items()]
    return panel.filter(F.col("ret").isNotNull()).groupBy("month").agg((F.avg("ret") - RF).alias("mkt_rf"), *sides, F.lit(RF).alias("rf"))


#: The same factors in SQL, after the panel's tables.
FACTORS_SQL = ", fc AS (SELECT month, avg(ret) - {rf} AS mkt_rf, {sides}, CAST({rf} AS DOUBLE) AS rf FROM rt WHERE ret IS NOT NULL GROUP BY month)".format(
    rf=RF, sides=", ".join(f"avg(ret) FILTER (WHERE factor = '{a}') - avg(ret) FILTER (WHERE factor = '{b}') AS {n}" for n, (a, b) in FACTORS.items())
)
