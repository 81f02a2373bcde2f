"""Long history beside the modern sample: statistics by state, priors from it, and the blend of both.

A state's long evidence counts only where the two samples agree on the sign of the mean, and by its months.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panel import window_slice
from .performance import REFERENCE, pair_with_reference

#: Months that a state must have in the long and in the modern sample, and that a slope must rest on.
LEAST_LONG, LEAST_MODERN, LEAST_BETA = 24, 6, 36
#: Bounds of a view's confidence.
CONFIDENCE = (0.05, 0.95)


def long_factors(wide: DataFrame, names: list[str]) -> DataFrame:
    """factor, month, value of research factors with a column each; what is null is left out."""
    return wide.unpivot("month", names, "factor", "value").filter("value IS NOT NULL")


def long_vs_modern(factors: DataFrame, states: DataFrame, modern_start: str, least: int = 6) -> DataFrame:
    """sample (long or modern), state, factor, n, mean, ann_return, ann_vol, hit_rate of ``least`` months at least.

    The long sample is all that is classified, the modern one the part from ``modern_start``: they overlap.
    """
    sample = F.explode(F.array_compact(F.array(F.lit("long"), F.when(F.col("month") >= F.lit(modern_start).cast("date"), "modern"))))
    rows = factors.join(states.select("month", "state"), "month").withColumn("sample", sample)
    m = F.avg("value")
    stats = rows.groupBy("sample", "state", "factor").agg(
        F.count("*").alias("n"), m.alias("mean"), (F.pow(1 + m, 12.0) - 1).alias("ann_return"), (F.stddev_samp("value") * F.sqrt(F.lit(12.0))).alias("ann_vol"), F.avg((F.col("value") > 0).cast("double")).alias("hit_rate")
    )
    return stats.filter(F.col("n") >= least)


def sign_agreement(stats: DataFrame) -> DataFrame:
    """state, factor, long, modern and whether the two means have one sign; a sample that lacks the cell agrees with nothing."""
    wide = stats.groupBy("state", "factor").pivot("sample", ["long", "modern"]).agg(F.first("mean"))
    return wide.withColumn("signs_agree", F.coalesce(F.signum("long") == F.signum("modern"), F.lit(False)))


def _eras(values: DataFrame, by: list[str], modern_start: Column, least_long: int, least_modern: int) -> DataFrame:
    """``by``, state, long_mean, n_long and agree, from rows (month, value): states with enough months in both eras."""
    modern = F.when(F.col("month") >= modern_start, F.col("value"))
    stats = values.groupBy(*by, "state").agg(F.avg("value").alias("long_mean"), F.count("value").alias("n_long"), F.avg(modern).alias("_modern"), F.count(modern).alias("_n"))
    good = stats.filter((F.col("n_long") >= least_long) & (F.col("_n") >= least_modern))
    return good.select(*by, "state", "long_mean", "n_long", (F.signum("long_mean") == F.signum("_modern")).alias("agree"))


def _span(panel: DataFrame) -> DataFrame:
    """first, last: the months that the panel's returns reach from and to, in one row."""
    return panel.filter("ret IS NOT NULL").agg(F.min("month").alias("first"), F.max("month").alias("last"))


def factor_prior(
    panel: DataFrame, factors: DataFrame, states: DataFrame, counterpart: dict[str, str], least_long: int = LEAST_LONG, least_modern: int = LEAST_MODERN, least_beta: int = LEAST_BETA
) -> DataFrame:
    """factor, state, beta, long_diff, n_long, agree: what a research factor says about each factor's excess over the Reference.

    beta is the slope of the regions' mean excess on the ``counterpart`` of the factor; long_diff is beta times the
    counterpart's mean in the state, over all months up to the panel's last.
    """
    names = reduce(lambda out, kv: F.when(F.col("factor") == kv[0], kv[1]).otherwise(out), counterpart.items(), F.lit(None).cast("string"))
    excess = pair_with_reference(panel).groupBy("factor", "month").agg(F.avg(F.col("ret") - F.col("ref")).alias("e")).withColumn("name", names).filter("name IS NOT NULL")
    research = factors.select(F.col("factor").alias("name"), "month", "value")
    betas = excess.join(research, ["name", "month"]).groupBy("factor", "name").agg(F.regr_slope("e", "value").alias("beta"), F.count("*").alias("n")).filter(F.col("n") >= least_beta)
    past = research.join(states.select("month", "state"), "month").crossJoin(F.broadcast(_span(panel))).filter("month <= last")  # one row
    eras = _eras(past, ["name"], F.col("first"), least_long, least_modern)
    return betas.join(eras, "name").select("factor", "state", "beta", (F.col("beta") * F.col("long_mean")).alias("long_diff"), "n_long", "agree")


def market_prior(panel: DataFrame, market: DataFrame, states: DataFrame, least_long: int = LEAST_LONG, least_modern: int = LEAST_MODERN, least_beta: int = LEAST_BETA) -> DataFrame:
    """region, state, beta, long_mean, n_long, agree: each region's Reference from the market's total return (month, mkt)."""
    refs = panel.filter((F.col("factor") == REFERENCE) & F.col("ret").isNotNull()).select("region", "month", "ret")
    betas = refs.join(market.select("month", "mkt"), "month").groupBy("region").agg(F.regr_slope("ret", "mkt").alias("beta"), F.count("*").alias("n")).filter(F.col("n") >= least_beta)
    past = market.select("month", F.col("mkt").alias("value")).join(states.select("month", "state"), "month").crossJoin(F.broadcast(_span(panel))).filter("month <= last AND value IS NOT NULL")  # one row
    eras = _eras(past, [], F.col("first"), least_long, least_modern)
    return betas.crossJoin(F.broadcast(eras)).select("region", "state", "beta", (F.col("beta") * F.col("long_mean")).alias("long_mean"), "n_long", "agree")  # a row for each state


def own_prior(proxies: DataFrame, panel: DataFrame, states: DataFrame, least_long: int = LEAST_LONG, least_modern: int = LEAST_MODERN) -> DataFrame:
    """series, state, long_mean, n_long, agree of proxies' own returns; those with "Cash" in their name are left out."""
    rows = proxies.filter(F.col("ret").isNotNull() & ~F.col("series").contains("Cash")).select("series", "month", F.col("ret").alias("value"))
    past = rows.join(states.select("month", "state"), "month").crossJoin(F.broadcast(_span(panel))).filter("month <= last")  # one row
    return _eras(past, ["series"], F.col("first"), least_long, least_modern)


def state_means(panel: DataFrame, states: DataFrame, least: int = 3, start: str | None = None, end: str | None = None) -> DataFrame:
    """state, series, mean_ret, n on the months from ``start`` to ``end``; states of fewer than ``least`` months of a series drop out."""
    rows = window_slice(panel.filter("ret IS NOT NULL"), start, end).join(states.select("month", "state"), "month")
    return rows.groupBy("state", "series").agg(F.avg("ret").alias("mean_ret"), F.count("*").alias("n")).filter(F.col("n") >= least)


def blend_report(means: DataFrame, factors: DataFrame | None = None, proxies: DataFrame | None = None, markets: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, state, series, n, n_long, gate, modern, mapped_long, weight_on_long, final for every cell of the state means.

    With ``markets`` (of :func:`market_prior`) each region's Reference is drawn to its long mean first, where the eras agree. A
    factor's series is its Reference, so drawn or not, plus its excess, drawn to ``factors``' long_diff where the eras
    agree; without a Reference it stays as it is. Proxies (region Asset) are drawn to their own long mean. A draw weighs by
    months: (n * modern + n_long * long) / (n + n_long). ``keys`` (replicates, refits) name means that are blended side by side.
    """
    parts = F.split("series", r" \| ", 2)
    cells = means.select(*keys, "state", "series", "n", F.col("mean_ret").alias("m"), parts[0].alias("region"), parts[1].alias("factor"))
    none = {"n_long": "bigint", "agree": "boolean"}

    def joined(df: DataFrame, prior: DataFrame | None, on: list[str], value: str, prefix: str) -> DataFrame:
        names = {value: f"{prefix}_long", "n_long": f"{prefix}_n", "agree": f"{prefix}_agree"}
        if prior is None:
            return df.withColumns({names[value]: F.lit(None).cast("double")} | {names[c]: F.lit(None).cast(t) for c, t in none.items()})
        return df.join(prior.select(*on, *(F.col(c).alias(a) for c, a in names.items())), on, "left")

    drawn = lambda m, n, long, n_long: (n * m + n_long * long) / (n + n_long)
    refs = joined(cells.filter(F.col("factor") == REFERENCE), markets, ["region", "state"], "long_mean", "k")
    anchored = F.when(F.col("k_agree"), drawn(F.col("m"), F.col("n"), F.col("k_long"), F.col("k_n"))).otherwise(F.col("m"))
    refs = refs.select(*keys, "region", "state", F.col("m").alias("ref"), anchored.alias("ref_anchored"), "k_long", "k_n", "k_agree")
    rows = joined(joined(cells.join(refs, [*keys, "region", "state"], "left"), factors, ["factor", "state"], "long_diff", "f"), proxies, ["series", "state"], "long_mean", "p")
    proxy, reference, own = F.col("region") == "Asset", F.col("factor") == REFERENCE, F.col("ref").isNotNull()
    gate = F.coalesce(F.when(proxy, F.col("p_agree")).when(reference, F.col("k_agree")).otherwise(F.col("f_agree") & own), F.lit(False))
    modern = F.when(~proxy & ~reference & own, F.col("m") - F.col("ref")).otherwise(F.col("m"))
    pick = lambda c: F.when(proxy, F.col(f"p_{c}")).when(reference, F.col(f"k_{c}")).otherwise(F.col(f"f_{c}"))
    rows = rows.withColumns({"gate": gate, "modern": modern, "mapped_long": pick("long"), "n_long": pick("n")})
    value = F.when(F.col("gate"), drawn(F.col("modern"), F.col("n"), F.col("mapped_long"), F.col("n_long"))).otherwise(F.col("modern"))
    base = F.when(~proxy & ~reference, F.coalesce("ref_anchored", F.lit(0.0))).otherwise(0.0)
    weight = F.when(F.col("gate"), F.col("n_long") / (F.col("n") + F.col("n_long"))).otherwise(0.0)
    return rows.select(*keys, "state", "series", "n", "n_long", "gate", "modern", "mapped_long", weight.alias("weight_on_long"), (base + value).alias("final"))


def blend_means(means: DataFrame, factors: DataFrame | None = None, proxies: DataFrame | None = None, markets: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, state, series, mean_ret, n: the state means after :func:`blend_report`."""
    return blend_report(means, factors, proxies, markets, keys).select(*keys, "state", "series", F.col("final").alias("mean_ret"), "n")


def view_loadings(series: DataFrame) -> DataFrame:
    """factor, series, loading of the view "factor over Reference": 1/k on each of its k series with a Reference, -1/k on that."""
    parts = F.split("series", r" \| ", 2)
    named = series.select("series", parts[0].alias("region"), parts[1].alias("factor")).distinct()
    refs = named.filter(F.col("factor") == REFERENCE).select("region", F.col("series").alias("ref"))
    own = named.filter(F.col("factor") != REFERENCE).join(refs, "region")
    k = own.groupBy("factor").agg((1.0 / F.count("*")).alias("share"))
    both = F.explode(F.array(F.struct("series", F.lit(1.0).alias("sign")), F.struct(F.col("ref").alias("series"), F.lit(-1.0).alias("sign"))))
    flat = own.join(k, "factor").select("factor", "share", both.alias("x")).select("factor", "x.series", (F.col("x.sign") * F.col("share")).alias("loading"))
    return flat.groupBy("factor", "series").agg(F.sum("loading").alias("loading"))


def rule_views(means: DataFrame, outlook: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """factor, q, confidence, anchored_states: the monthly excess over the Reference that the outlook (state, p) expects.

    In each state the excess is the mean over the regions that have both, drawn to ``prior`` (of :func:`factor_prior`) where
    the eras agree; states without one do not count. The confidence is the outlook's largest probability, within bounds.
    """
    parts = F.split("series", r" \| ", 2)
    cells = means.select("state", "mean_ret", "n", parts[0].alias("region"), parts[1].alias("factor"))
    refs = cells.filter(F.col("factor") == REFERENCE).select("state", "region", F.col("mean_ret").alias("ref"))
    excess = cells.filter(F.col("factor") != REFERENCE).join(refs, ["state", "region"]).groupBy("state", "factor").agg(F.avg(F.col("mean_ret") - F.col("ref")).alias("d"), F.max("n").alias("n"))
    if prior is None:
        rows = excess.withColumns({"gate": F.lit(False), "used": F.col("d")})
    else:
        rows = excess.join(prior.select("factor", "state", "long_diff", "n_long", "agree"), ["factor", "state"], "left").withColumn("gate", F.coalesce("agree", F.lit(False)))
        rows = rows.withColumn("used", F.when(F.col("gate"), (F.col("n") * F.col("d") + F.col("n_long") * F.col("long_diff")) / (F.col("n") + F.col("n_long"))).otherwise(F.col("d")))
    top = outlook.agg(F.least(F.lit(CONFIDENCE[1]), F.greatest(F.lit(CONFIDENCE[0]), F.max("p"))).alias("confidence"))
    views = rows.join(outlook, "state").groupBy("factor").agg((F.sum(F.col("p") * F.col("used")) / F.nullif(F.sum("p"), F.lit(0.0))).alias("q"), F.count_if("gate").alias("anchored_states"))
    return views.filter("q IS NOT NULL").crossJoin(F.broadcast(top)).select("factor", "q", "confidence", "anchored_states")  # one row
