"""What portfolios hold and how they are spread: look-through, concentration, covariance, diversification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .panel import normalise_category
from .performance import join_regimes

#: Shares above which a category is flagged, in percent, by dimension: fixed values.
THRESHOLDS = {"sector": 30.0, "country": 35.0, "stock": 5.0}


def look_through(weights: DataFrame, lookup: DataFrame, aliases: DataFrame | None = None, home: dict[str, str] | None = None) -> DataFrame:
    """portfolio, dim, category, pct: weights (portfolio, series, weight) through lookup (series, dim, category, weight_pct).

    ``aliases`` (alias, name) makes variants of a category one. ``home`` names, by region, the country that a series
    of the region is wholly in where the lookup has no countries for it.
    """
    rows = weights.join(full_lookup(weights.select("series").distinct(), lookup, aliases, home), "series")
    return rows.groupBy("portfolio", "dim", "category").agg(F.sum(F.col("weight") * F.col("weight_pct")).alias("pct"))


def full_lookup(series: DataFrame, lookup: DataFrame, aliases: DataFrame | None = None, home: dict[str, str] | None = None) -> DataFrame:
    """The lookup with a whole country for each of ``series`` that has none and stands in a region of ``home``, and aliases made one."""
    found = lookup.select("series", "dim", "category", "weight_pct")
    for region, country in (home or {}).items():
        bare = series.filter(F.split("series", r" \| ", 2)[0] == region).join(lookup.filter("dim = 'country'").select("series"), "series", "left_anti")
        found = found.unionByName(bare.select("series", F.lit("country").alias("dim"), F.lit(country).alias("category"), F.lit(100.0).alias("weight_pct")))
    return found if aliases is None else normalise_category(found, "category", aliases)


def concentration(exposure: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """hhi, its inverse, largest and three largest shares and which, and how many, are above the dimension's threshold."""
    limit = F.lit(None).cast("double")
    for dim, most in (THRESHOLDS if thresholds is None else thresholds).items():
        limit = F.when(F.col("dim") == dim, F.lit(most)).otherwise(limit)
    w = W.partitionBy("portfolio", "dim").orderBy(F.desc(F.round("pct", 9)), "category")
    ranked = exposure.withColumn("_r", F.row_number().over(w)).withColumn("_over", F.coalesce(F.col("pct") > limit, F.lit(False)))
    hhi = F.sum(F.pow(F.col("pct") / 100, 2))
    return ranked.groupBy("portfolio", "dim").agg(
        hhi.alias("hhi"), (1 / hhi).alias("effective_n"), F.max("pct").alias("top1"), F.sum(F.when(F.col("_r") <= 3, F.col("pct"))).alias("top3"), F.count_if("_over").alias("n_flagged"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_over"), F.col("category")))), ", ").alias("flagged"),
    )


def effective_bets(exposure: DataFrame) -> DataFrame:
    """Geometric mean over the dimensions of the effective number of categories."""
    by_dim = exposure.groupBy("portfolio", "dim").agg(F.sum(F.pow(F.col("pct") / 100, 2)).alias("hhi"))
    return by_dim.groupBy("portfolio").agg(F.exp(F.avg(-F.log("hhi"))).alias("effective_bets"), F.count("*").alias("n_dims"))


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """portfolio, series, contribution w_i (Sw)_i / s and its share; they add up to the portfolio's volatility s."""
    left = weights.select("portfolio", F.col("series").alias("i"), F.col("weight").alias("wi"))
    right = weights.select("portfolio", F.col("series").alias("j"), F.col("weight").alias("wj"))
    moved = left.join(cov.select("i", "j", "cov"), "i").join(right, ["portfolio", "j"]).groupBy("portfolio", F.col("i").alias("series")).agg(F.sum(F.col("wi") * F.col("cov") * F.col("wj")).alias("part"))
    variance = F.sum("part").over(W.partitionBy("portfolio"))
    return moved.select("portfolio", "series", (F.col("part") / F.sqrt(variance)).alias("contribution"), (F.col("part") / variance).alias("share"))


def diversification_ratio(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """sigma, dr (weighted volatilities over the portfolio's) and dr2 of each portfolio."""
    sigma = risk_contributions(weights, cov).groupBy("portfolio").agg(F.sum("contribution").alias("sigma"))
    own = cov.filter(F.col("i") == F.col("j")).select(F.col("i").alias("series"), F.sqrt("cov").alias("s"))
    gross = weights.join(own, "series").groupBy("portfolio").agg(F.sum(F.abs("weight") * F.col("s")).alias("gross"))
    ratio = F.col("gross") / F.nullif(F.col("sigma"), F.lit(0.0))
    return gross.join(sigma, "portfolio").select("portfolio", "sigma", ratio.alias("dr"), (ratio * ratio).alias("dr2"))


def portfolio_returns(weights: DataFrame, panel: DataFrame) -> DataFrame:
    """portfolio, month, ret of a constant mix on the months that all its series have."""
    held = weights.withColumn("_n", F.count("*").over(W.partitionBy("portfolio")))
    rows = panel.filter(F.col("ret").isNotNull()).select("series", "month", "ret").join(held, "series")
    months = rows.groupBy("portfolio", "month").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.count("*").alias("k"), F.max("_n").alias("n"))
    return months.filter("k = n").select("portfolio", "month", "ret")


def inverse_variance_weights(panel: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """portfolio, series, weight in proportion to the inverse variance of the series' returns."""
    own = panel.filter(F.col("ret").isNotNull()).groupBy(*by, "series").agg((1 / F.nullif(F.var_samp("ret"), F.lit(0.0))).alias("inv")).filter(F.col("inv").isNotNull())
    return own.select(*by, F.lit("inverse variance").alias("portfolio"), "series", (F.col("inv") / F.sum("inv").over(W.partitionBy(*by))).alias("weight"))


def episode_replay(returns_: DataFrame, episodes: DataFrame) -> DataFrame:
    """Cumulative return, drawdown and worst month of portfolio returns inside each episode (regime, start, end).

    The drawdown is of the compounded returns, without a base. Left out are episodes of fewer than two
    months and those whose data begin after the second month-end from the episode's start.
    """
    rows = join_regimes(returns_, episodes)
    path = W.partitionBy("regime", "portfolio").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("lvl", F.exp(F.sum(F.log1p("ret")).over(path))).withColumn("dd", F.col("lvl") / F.max("lvl").over(path) - 1)
    months = F.when(F.col("start") == F.last_day("start"), 2).otherwise(1)
    stats = rows.groupBy(F.col("regime").alias("episode"), "start", "portfolio").agg(
        F.count("*").alias("n_months"), F.min("month").alias("_first"), (F.max_by("lvl", "month") - 1).alias("cum_return"), F.min("dd").alias("max_drawdown"), F.min("ret").alias("worst_month")
    )
    return stats.filter((F.col("n_months") >= 2) & (F.col("_first") <= F.last_day(F.add_months("start", months)))).drop("_first", "start")


def portfolio_state_means(weights: DataFrame, state_means: DataFrame) -> DataFrame:
    """portfolio, state, mean_ret and whether it is the portfolio's worst, for states in which all its series have a mean."""
    held = weights.withColumn("_n", F.count("*").over(W.partitionBy("portfolio")))
    means = held.join(state_means.select("state", "series", F.col("mean_ret").alias("_m")), "series").groupBy("portfolio", "state")
    rows = means.agg(F.sum(F.col("weight") * F.col("_m")).alias("mean_ret"), F.count("*").alias("_k"), F.max("_n").alias("_n")).filter("_k = _n")
    return rows.select("portfolio", "state", "mean_ret", (F.col("mean_ret") == F.min("mean_ret").over(W.partitionBy("portfolio"))).alias("is_worst"))


def zone_exposure(weights: DataFrame, lookup: DataFrame, zones: DataFrame) -> DataFrame:
    """portfolio, zone, share: what portfolios hold in zones (zone, country) through the countries of their series.

    A series without countries takes those of its region's Reference; unmapped countries are "Rest of world"; proxies
    (region Asset) and series that even so have none add nothing.
    """
    countries = lookup.filter("dim = 'country'").select(F.col("series").alias("sheet"), "category", "weight_pct")
    sheets = countries.select("sheet").distinct()
    region = F.split("series", r" \| ", 2)[0]
    held = weights.filter(region != "Asset").join(sheets.withColumn("series", F.col("sheet")), "series", "left").withColumn("sheet", F.coalesce("sheet", F.concat(region, F.lit(" | Reference"))))
    rows = held.join(countries, "sheet").join(zones.select("zone", F.col("country").alias("category")), "category", "left")
    return rows.groupBy("portfolio", F.coalesce("zone", F.lit("Rest of world")).alias("zone")).agg((F.sum(F.col("weight") * F.col("weight_pct")) / 100).alias("share"))


def bucket_exposure(weights: DataFrame) -> DataFrame:
    """portfolio, bucket, share: what portfolios hold by the factor in their series' names."""
    return weights.groupBy("portfolio", F.split("series", r" \| ", 2)[1].alias("bucket")).agg(F.sum("weight").alias("share"))


def archetype_weights(spec: DataFrame, series: DataFrame, prefix: str = "Proxy | ") -> DataFrame:
    """portfolio, series, weight of archetypes (portfolio, key, weight) on the series that there are.

    The key "equity_equal" is spread over all series of the prefix; other keys name a series. Archetypes that do not add up
    to one within 0.01, since a series is missing, are left out.
    """
    names = series.select("series").distinct()
    equity = names.filter(F.col("series").startswith(prefix))
    n = equity.agg(F.count("*").alias("_n"))
    spread = spec.filter("key = 'equity_equal'").crossJoin(F.broadcast(n)).crossJoin(equity).select("portfolio", "series", (F.col("weight") / F.col("_n")).alias("weight"))  # archetypes times series
    named = spec.filter("key <> 'equity_equal'").withColumnRenamed("key", "series").join(names, "series").select("portfolio", "series", "weight")
    rows = spread.unionAll(named).groupBy("portfolio", "series").agg(F.sum("weight").alias("weight"))
    good = rows.groupBy("portfolio").agg(F.sum("weight").alias("s")).filter(F.abs(F.col("s") - 1) < 0.01).select("portfolio")
    return rows.join(good, "portfolio", "left_semi")


def benchmark_table(stats: DataFrame, weights: DataFrame, ratios: DataFrame) -> DataFrame:
    """Performance (of the portfolios' returns, by series) beside the number of holdings above 1 % and the independent bets DR squared."""
    holdings = weights.groupBy("portfolio").agg(F.count_if(F.col("weight") > 0.01).alias("n_holdings"))
    return stats.withColumnRenamed("series", "portfolio").join(holdings, "portfolio").join(ratios.select("portfolio", "dr2"), "portfolio")
