"""Shaping and aligning the long panel: one row for each series and month.

Columns of a panel: series ("region | factor"), region, factor, month (a calendar month-end), level,
and ret where :func:`returns` has added it. Every join and slice is on the month, never on a date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEPARATOR = " | "


def series_key(df: DataFrame) -> DataFrame:
    """Add series from region and factor."""
    return df.withColumn("series", F.concat_ws(SEPARATOR, "region", "factor"))


def split_key(df: DataFrame) -> DataFrame:
    """Add region and factor from series."""
    parts = F.split("series", r" \| ", 2)
    return df.withColumn("region", parts[0]).withColumn("factor", parts[1])


def factor_bucket(name: Column) -> Column:
    """Factor type named in an index's name; the first match counts, else Reference."""
    lower = F.lower(name)
    return F.when(lower.contains("momentum"), "Momentum").when(lower.contains("enhanced value"), "Enhanced Value").when(lower.contains("quality"), "Quality").otherwise("Reference")


def normalise_category(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace the aliases of a category by the names that ``aliases`` (alias, name) has for them."""
    names = aliases.select(F.col("alias").alias(column), F.col("name").alias("_name"))
    return df.join(names, column, "left").withColumn(column, F.coalesce("_name", column)).drop("_name")


def month_stamp(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumn("month", F.last_day(date))


def returns(panel: DataFrame, by: tuple[str, ...] = (), require_adjacent: bool = False) -> DataFrame:
    """Add ret, the change from the series' previous observed row; with ``require_adjacent`` only over one month."""
    w = W.partitionBy(*by, "series").orderBy("month")
    ret = F.col("level") / F.lag("level").over(w) - 1
    if require_adjacent:
        ret = F.when(F.lag("month").over(w) == F.last_day(F.add_months("month", -1)), ret)
    return panel.withColumn("ret", ret)


def growth_path(panel: DataFrame, base: float = 100.0) -> DataFrame:
    """Cumulative level of ret, from ``base``."""
    w = W.partitionBy("series").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return panel.filter(F.col("ret").isNotNull()).withColumn("path", base * F.exp(F.sum(F.log1p("ret")).over(w)))


def drawdown(panel: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Level over its running maximum, less 1; the base point counts."""
    w = W.partitionBy(*by, "series").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return panel.withColumn("dd", F.col("level") / F.max("level").over(w) - 1)


def complete_months(panel: DataFrame, value: str = "level", by: tuple[str, ...] = ()) -> DataFrame:
    """Months in which every series (of each ``by``) has a value."""
    known = panel.filter(F.col(value).isNotNull())
    n_series = known.groupBy(*by).agg(F.countDistinct("series").alias("_n"))
    months = known.groupBy(*by, "month").agg(F.count("*").alias("_k"))
    full = months.join(n_series, list(by)) if by else months.crossJoin(F.broadcast(n_series))  # one row
    return known.join(full.filter("_k = _n").select(*by, "month"), [*by, "month"], "left_semi")


def common_window(panel: DataFrame) -> DataFrame:
    """From the first month that all series have."""
    first = complete_months(panel).agg(F.min("month").alias("_first"))
    return panel.join(F.broadcast(first), F.col("month") >= F.col("_first")).drop("_first")


def window_slice(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Months from start to end, both included; None is open."""
    keep = [F.col("month") >= F.lit(start).cast("date")] * bool(start) + [F.col("month") <= F.lit(end).cast("date")] * bool(end)
    return panel.filter(reduce(lambda a, b: a & b, keep)) if keep else panel


def drop_window(panel: DataFrame, start: str, end: str) -> DataFrame:
    return panel.filter(~F.col("month").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drop_region(panel: DataFrame, region: str) -> DataFrame:
    """Leave one region out; it is an error if there is none of that name."""
    if panel.filter(F.col("region") == region).isEmpty():
        raise ValueError(f"no series of region {region!r}")
    return panel.filter(F.col("region") != region)


def menus(panel: DataFrame, specs: dict[str, Column]) -> DataFrame:
    """The panel once for each named subset of its series, under the key ``menu``."""
    names = F.array(*(F.when(condition, F.lit(name)) for name, condition in specs.items()))
    return panel.withColumn("menu", F.explode(F.array_compact(names)))


def to_wide(panel: DataFrame, value: str, series: list[str]) -> DataFrame:
    """A column for each named series, the mean of duplicates."""
    return panel.groupBy("month").pivot("series", series).agg(F.avg(value))


def to_long(wide: DataFrame, value: str) -> DataFrame:
    columns = [c for c in wide.columns if c != "month"]
    return wide.unpivot("month", columns, "series", value).filter(F.col(value).isNotNull())


def rebase(panel: DataFrame, start: str | None = None, end: str | None = None, base: float = 100.0) -> DataFrame:
    """Every series at ``base`` at its own first level in the range."""
    w = W.partitionBy("series").orderBy("month").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return window_slice(panel, start, end).withColumn("rebased", F.col("level") / F.first("level", ignorenulls=True).over(w) * base)


def align_months(df: DataFrame, index: DataFrame, key: str = "series") -> DataFrame:
    """Rows of ``df`` for the months and dates of ``index`` (key, date): the last row of each month."""
    w = W.partitionBy(key, "month").orderBy(F.desc("date"))
    last = month_stamp(df).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "date")
    return month_stamp(index.select(key, "date")).join(last, [key, "month"], "left")


def resample_month_end(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The last value of each month, on a calendar without gaps from each key's first to last month."""
    known = df.filter(F.col(value).isNotNull()).withColumn("month", F.last_day(time))
    last = known.groupBy(key, "month").agg(F.max_by(value, F.struct(time, value)).alias("value"))
    span = last.groupBy(key).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))
    calendar = span.select(key, F.explode(F.transform(months, F.last_day)).alias("month"))
    return calendar.join(last, [key, "month"], "left")


def yoy(df: DataFrame, key: str = "indicator", value: str = "value", n: int = 12) -> DataFrame:
    """Change from the row ``n`` months before, in percent; on a calendar without gaps."""
    before = F.lag(value, n).over(W.partitionBy(key).orderBy("month"))
    return df.withColumn("yoy", (F.col(value) / F.nullif(before, F.lit(0.0)) - 1) * 100)


def drop_unfinished(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(F.col("month") < F.last_day(F.lit(as_of).cast("date")))


def splice(old: DataFrame, new: DataFrame, key: str = "series") -> DataFrame:
    """Each series' old rows before the first month of its new ones, and the new ones."""
    first = new.groupBy(key).agg(F.min("month").alias("_first"))
    before = old.join(first, key, "left").filter(F.col("_first").isNull() | (F.col("month") < F.col("_first"))).drop("_first")
    return before.unionByName(new)


def lag_labels(states: DataFrame, k: int, columns: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """What is known at t of ``columns`` is what held at t - k."""
    w = W.partitionBy(*by).orderBy("month")
    return states.withColumns({c: F.lag(c, k).over(w) for c in columns})


def compound_blocks(panel: DataFrame, m: int = 3) -> DataFrame:
    """Returns compounded over every ``m`` consecutive months of a series, by position."""
    place = F.row_number().over(W.partitionBy("series").orderBy("month"))
    blocks = panel.filter(F.col("ret").isNotNull()).withColumn("block", F.floor((place - 1) / m))
    return blocks.groupBy("series", "block").agg(F.count("*").alias("n"), F.max("month").alias("month"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret"))


def indicator_meta(macro: DataFrame) -> DataFrame:
    known = macro.filter(F.col("value").isNotNull())
    return known.groupBy("indicator").agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count("*").alias("n"))


def period_average_check(panel: DataFrame) -> DataFrame:
    """Annual volatility and first-order autocorrelation of each series: averaged prices show in both."""
    before = panel.withColumn("before", F.lag("ret").over(W.partitionBy("series").orderBy("month")))
    return before.groupBy("series").agg((F.stddev_samp("ret") * F.sqrt(F.lit(12.0))).alias("ann_vol"), F.corr("ret", "before").alias("autocorr"))


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``left`` with the values of the latest row of ``right`` up to its month; one sort, no inequality join."""
    rows = left.withColumn("_left", F.lit(True)).unionByName(right.select(*by, "month", F.struct(*values).alias("_v")).withColumn("_left", F.lit(False)), allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy("month", "_left").rowsBetween(W.unboundedPreceding, 0)
    held = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_left")
    return held.select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def validate_weights(weights: DataFrame, known: DataFrame) -> DataFrame:
    """portfolio, problem: unknown or negative weights and sums off 100 % by over 0.01 points; none if valid."""
    unknown = weights.join(known.select("series").distinct(), "series", "left_anti").select("portfolio", F.lit("unknown").alias("problem"))
    negative = weights.filter("weight < 0").select("portfolio", F.lit("negative").alias("problem"))
    sums = weights.groupBy("portfolio").agg(F.sum("weight").alias("s")).filter(F.abs(F.col("s") - 1) > 0.0001).select("portfolio", F.lit("sum").alias("problem"))
    return unknown.unionAll(negative).unionAll(sums).distinct()


def checked_weights(weights: DataFrame, known: DataFrame) -> DataFrame:
    """``weights``, or an error that names what is wrong; nothing is ever rescaled."""
    wrong = validate_weights(weights, known).limit(20).collect()
    if wrong:
        raise ValueError(f"invalid weights: {[(r.portfolio, r.problem) for r in wrong]}")
    return weights


def join_month(a: DataFrame, b: DataFrame, how: str = "inner", by: tuple[str, ...] = ()) -> DataFrame:
    """Two tables side by side on the month (and ``by``), whatever day of it each is stamped with."""
    return a.join(b, [*by, "month"], how)


def intersect_months(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``a`` in months that ``b`` has too."""
    return a.join(b.select(*by, "month").distinct(), [*by, "month"], "left_semi")


def exclude_band_join(states: DataFrame, band: int, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Every row beside every earlier or later one of its key that is more than ``band`` months away.

    ``pos`` numbers the months of a key; the other row's columns have the prefix ``o_``. The query months (``is_query``
    where that column is given) are the left side, so the size is queries times months and no square of the rows.
    """
    left = states.filter("is_query") if "is_query" in states.columns else states
    right = states.select(*by, *(F.col(c).alias(f"o_{c}") for c in ("pos", *columns)))
    apart = F.abs(F.col("pos") - F.col("o_pos")) > band
    return left.join(right, list(by)).filter(apart) if by else left.join(right, apart)


def missing_members(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` has not."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def common_members(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` has too."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that stand in both tables."""
    return a.select(key).intersect(b.select(key))


def key_symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and the side."""
    only = lambda x, y, side: x.select(key).distinct().exceptAll(y.select(key).distinct()).withColumn("side", F.lit(side))
    return only(a, b, "left").unionAll(only(b, a, "right"))


def append_proxies(panel: DataFrame, proxies: DataFrame) -> DataFrame:
    """The panel and the rows of ``proxies`` on the panel's own months only."""
    return panel.unionByName(intersect_months(proxies, panel).select(*panel.columns))


def stack_runs(runs: dict[str, DataFrame], label: str = "run") -> DataFrame:
    """Runs one below the other, named in the column ``label``; columns that a run lacks are null."""
    named = [df.withColumn(label, F.lit(name)) for name, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def hold_forward(weights: DataFrame, months: DataFrame, key: str = "rule") -> DataFrame:
    """``months`` (key, month) with the weights of the latest refit before or in them: one row for each series held.

    The refit is found by the as-of sort on (key, month) alone; its weights are then joined by refit.
    """
    refits = weights.select(key, "month").distinct().withColumn("refit_month", F.col("month"))
    held = asof_backward(months.select(key, "month").distinct(), refits, [key], ["refit_month"])
    return held.join(weights.withColumnRenamed("month", "refit_month"), [key, "refit_month"])


def quality_checks(rules: dict[str, DataFrame]) -> DataFrame:
    """check, violations: how many rows break each rule; a rule is the table of its violations."""
    counts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in rules.items()]
    return reduce(DataFrame.unionAll, counts)


def outside(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows whose value is out of a plausible range."""
    return df.filter(~F.col(value).between(low, high))


def off_sums(df: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    """Groups whose values do not sum into a range."""
    return df.groupBy(*by).agg(F.sum(value).alias("total")).filter(~F.col("total").between(low, high))


def off_counts(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """Groups that have not exactly ``n`` rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") != n)


def key_uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(*keys).alias("n_keys")).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def literal_ranges(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A small table of named month ranges: regime, start, end."""
    df = spark.createDataFrame(rows, "regime string, start string, end string")
    return df.select("regime", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
