"""Returns, fees and power as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .normal import norm_cdf

#: Years of the par bond.
MATURITY = 10
#: The normal distribution's points at 0.975 and 0.80.
Z_975, Z_80 = 1.959963984540054, 0.8416212335729143
#: Regions whose series cost more: fixed values.
DEAR_REGIONS = ("EM", "AC_Asia_ex_Japan")


def bond_return(yields: DataFrame, key: str = "indicator") -> DataFrame:
    """Add ret to yields (``key``, month, value in percent): carry, less duration times the change, plus half the convexity times its square.

    A par bond of MATURITY years at this month's yield; the carry is last month's yield over twelve. The first month is null.
    """
    y = F.col("value") / 100
    before = F.lag(y).over(W.partitionBy(key).orderBy("month"))
    left = F.pow(1 + y, F.lit(-float(MATURITY)))
    duration = (1 - left) / y
    convexity = 2 / (y * y) * (1 - left) - 2 * MATURITY / (y * F.pow(1 + y, F.lit(MATURITY + 1.0)))
    change = y - before
    return yields.filter(F.col("value").isNotNull()).withColumn("ret", before / 12 - duration * change + 0.5 * convexity * change * change)


def hi_mean(rows: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """month and the mean of the two columns whose name contains "hi"; it is an error if there are not exactly two."""
    high = rows.filter(F.lower(name).contains("hi"))
    names = sorted(r[0] for r in high.select(name).distinct().limit(20).collect())
    if len(names) != 2:
        raise ValueError(f"expected two columns with 'hi' in their name, got {names}")
    return high.groupBy("month").agg(F.avg(value).alias(value))


def total_return(factors: DataFrame) -> DataFrame:
    """Add mkt, the market's excess return plus that of cash."""
    return factors.withColumn("mkt", F.col("mkt_rf") + F.col("rf"))


def excess_return(panel: DataFrame, factors: DataFrame) -> DataFrame:
    """Add excess, each series' return less that of cash in the month; null where cash is unknown."""
    return panel.join(factors.select("month", F.col("rf").alias("_rf")), "month", "left").withColumn("excess", F.col("ret") - F.col("_rf")).drop("_rf")


def series_fee(series: Column, bps: dict[str, float], dear: tuple[str, ...] = DEAR_REGIONS) -> Column:
    """Yearly fee of a series as a fraction: its own entry of ``bps``, else that of its factor, with a surcharge in dear regions."""
    parts = F.split(series, r" \| ", 2)
    by_factor = F.when(parts[1] == "Reference", bps["Reference"]).otherwise(bps["factor"]) + F.when(parts[0].isin(*dear), bps["em_asia_extra"]).otherwise(0.0)
    own = F.lit(None).cast("double")
    for name in (k for k in bps if k not in ("Reference", "factor", "em_asia_extra")):
        own = F.when(series == name, bps[name]).otherwise(own)
    return F.coalesce(own, by_factor) / 1e4


def restate_currency(returns_: DataFrame, fx: DataFrame) -> DataFrame:
    """unhedged (1 + r)(1 + fx) - 1 and hedged r + (rf_foreign - rf_home), by month from fx (month, fx, rf_foreign, rf_home)."""
    rows = returns_.filter(F.col("ret").isNotNull()).join(fx, "month")
    return rows.withColumn("unhedged", (1 + F.col("ret")) * (1 + F.col("fx")) - 1).withColumn("hedged", F.col("ret") + F.col("rf_foreign") - F.col("rf_home"))


def power_mdes(tests: DataFrame, gap: float = 0.2) -> DataFrame:
    """Add to tests (delta, se; by month) the power at the observed gap and at a yearly gap of ``gap``, the least detectable gap and its yearly value.

    Level 5 %, two-sided; the least detectable gap has a power of 80 %. Null without a positive standard error.
    """
    se = F.when(F.col("se") > 0, F.col("se"))
    power = lambda delta: norm_cdf(F.abs(delta) / se - Z_975) + norm_cdf(-F.abs(delta) / se - Z_975)
    fixed = F.lit(gap) / F.sqrt(F.lit(12.0))
    mdes = (Z_975 + Z_80) * se
    return tests.withColumns({"power_observed": power(F.col("delta")), "power_fixed": power(fixed), "mdes": mdes, "mdes_ann": mdes * F.sqrt(F.lit(12.0)), "observed_over_mdes": F.abs("delta") / mdes})
