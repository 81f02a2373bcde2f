"""Indicators, growth and inflation states, and statistics conditional on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normal import norm_cdf
from .performance import join_regimes, pair_with_reference

LAGS = (0, 1, 3, 6, 12)
LEAST_MONTHS, LEAST_REGIME_MONTHS = 36, 6
STATES = ("Reflation", "Stagflation", "Deflationary bust", "Goldilocks")
PROBABILITIES = {"Reflation": "p_reflation", "Stagflation": "p_stagflation", "Deflationary bust": "p_deflationary_bust", "Goldilocks": "p_goldilocks"}


def changes(macro: DataFrame) -> DataFrame:
    """Add chg, the month-over-month difference of each indicator."""
    return macro.withColumn("chg", F.col("value") - F.lag("value").over(W.partitionBy("indicator").orderBy("month")))


def features(macro: DataFrame) -> DataFrame:
    """indicator, basis (level or chg), month, f; small: indicators times months."""
    both = F.array(F.struct(F.lit("level").alias("basis"), F.col("value").alias("f")), F.struct(F.lit("chg").alias("basis"), F.col("chg").alias("f")))
    return changes(macro).select("indicator", "month", F.explode(both).alias("b")).select("indicator", "month", "b.basis", "b.f").filter(F.col("f").isNotNull())


def cross_features(panel: DataFrame, macro: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """Every series' return beside every indicator and basis as it was ``lag`` months before.

    The lag is put on the features' side, so the panel is joined where it stands and not shuffled.
    """
    lagged = features(macro).withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
    shifted = lagged.withColumn("month", F.last_day(F.add_months("month", F.col("lag"))))
    return panel.filter(F.col("ret").isNotNull()).join(shifted, "month")


def macro_correlations(panel: DataFrame, macro: DataFrame, lags: tuple[int, ...] = LAGS, least: int = LEAST_MONTHS) -> DataFrame:
    """corr, n and insufficient by series, indicator, basis and lag; corr is null below ``least`` months."""
    stats = cross_features(panel, macro, lags).groupBy("series", "indicator", "basis", "lag").agg(F.corr("ret", "f").alias("corr"), F.count("*").alias("n"))
    return stats.withColumn("insufficient", F.col("n") < least).withColumn("corr", F.when(~F.col("insufficient"), F.col("corr")))


def macro_beta(panel: DataFrame, macro: DataFrame, least: int = LEAST_MONTHS) -> DataFrame:
    """Slope and r2 of returns on an indicator's changes; null below ``least`` months or without variance."""
    pairs = cross_features(panel, macro, (0,)).filter(F.col("basis") == "chg")
    stats = pairs.groupBy("series", "indicator").agg(F.regr_slope("ret", "f").alias("beta"), F.regr_r2("ret", "f").alias("r2"), F.count("*").alias("n"), F.var_pop("f").alias("_v"))
    good = (F.col("n") >= least) & (F.col("_v") > 0)
    return stats.select("series", "indicator", F.when(good, F.col("beta")).alias("beta"), F.when(good, F.col("r2")).alias("r2"), "n")


def macro_corr_by_regime(panel: DataFrame, macro: DataFrame, regimes: DataFrame, least: int = LEAST_REGIME_MONTHS) -> DataFrame:
    """Correlation with changes inside each regime, on the months that both have, ``least`` at least."""
    pairs = join_regimes(cross_features(panel, macro, (0,)).filter(F.col("basis") == "chg"), regimes)
    return pairs.groupBy("regime", "series", "indicator").agg(F.corr("ret", "f").alias("corr"), F.count("*").alias("n")).filter(F.col("n") >= least)


def strongest_by_regime(corr: DataFrame) -> DataFrame:
    """The single largest correlation by size of each regime; ties go to the series and indicator by name."""
    w = W.partitionBy("regime").orderBy(F.desc(F.round(F.abs("corr"), 9)), "series", "indicator")
    return corr.filter(F.col("corr").isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _now(corr: DataFrame) -> DataFrame:
    return corr.filter((F.col("basis") == "chg") & (F.col("lag") == 0) & F.col("corr").isNotNull())


def top_drivers(corr: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most positive and most negative indicators of each factor, by the mean correlation of its series.

    On changes at lag 0; the factor is the part of the series' name after the separator. Ties go to the indicator's name.
    """
    mean = _now(corr).withColumn("factor", F.split("series", r" \| ", 2)[1]).groupBy("factor", "indicator").agg(F.avg("corr").alias("mean_corr"))
    key = F.round("mean_corr", 12)
    place = lambda order: F.row_number().over(W.partitionBy("factor").orderBy(order, "indicator"))
    ranked = mean.withColumn("positive", place(key.desc())).withColumn("negative", place(key.asc()))
    side = F.explode(F.array(F.struct(F.lit("positive").alias("side"), F.col("positive").alias("rank")), F.struct(F.lit("negative").alias("side"), F.col("negative").alias("rank"))))
    return ranked.withColumn("s", side).filter(F.col("s.rank") <= n).select("factor", "s.side", "s.rank", "indicator", "mean_corr")


def most_sensitive(corr: DataFrame) -> DataFrame:
    """The series with the largest absolute correlation with each indicator, on changes at lag 0; ties go to the first by name."""
    w = W.partitionBy("indicator").orderBy(F.desc(F.round(F.abs("corr"), 12)), "series")
    return _now(corr).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("indicator", "series", "corr")


def top_betas(betas: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` pairs of largest r2; ties go to the names."""
    return betas.filter(F.col("beta").isNotNull()).orderBy(F.desc(F.round("r2", 12)), "series", "indicator").limit(n)


def lead_improvement(corr: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Series and indicators whose best lag beats lag 0 by more than ``threshold`` in absolute correlation."""
    known = corr.filter(F.col("corr").isNotNull() & (F.col("basis") == "chg"))
    best = known.groupBy("series", "indicator").agg(
        F.max_by("lag", F.struct(F.round(F.abs("corr"), 12), -F.col("lag"))).alias("best_lag"), F.max(F.abs("corr")).alias("best"), F.max(F.when(F.col("lag") == 0, F.abs("corr"))).alias("now")
    )
    return best.filter(F.col("best") - F.col("now") > threshold)


def trend(macro: DataFrame, smooth: int = 3, lag: int = 6) -> DataFrame:
    """Mean of ``smooth`` months (full windows only) less its value ``lag`` months before."""
    w = W.partitionBy("indicator").orderBy("month")
    window = w.rowsBetween(1 - smooth, 0)
    smoothed = macro.withColumn("smooth", F.when(F.count("value").over(window) == smooth, F.avg("value").over(window)))
    return smoothed.withColumn("trend", F.col("smooth") - F.lag("smooth", lag).over(w))


def composite_score(trends: DataFrame, components: DataFrame) -> DataFrame:
    """axis, month, score: mean of the available signed trends over their volatility, made to have volatility 1.

    ``components`` has axis, indicator, sign, is_primary; months without the primary are null.
    """
    sd = F.stddev_samp("trend").over(W.partitionBy("indicator"))
    z = trends.withColumn("z", F.col("trend") / F.nullif(sd, F.lit(0.0))).join(components, "indicator")
    scores = z.groupBy("axis", "month").agg(F.avg(F.col("sign") * F.col("z")).alias("s"), F.max(F.when(F.col("is_primary"), F.col("z"))).alias("p"))
    masked = scores.withColumn("s", F.when(F.col("p").isNotNull(), F.col("s")))
    return masked.select("axis", "month", (F.col("s") / F.nullif(F.stddev_samp("s").over(W.partitionBy("axis")), F.lit(0.0))).alias("score"))


def state_label(up: Column, hot: Column) -> Column:
    """The state's name from the directions of growth and inflation."""
    return F.when(up & hot, STATES[0]).when(~up & hot, STATES[1]).when(~up & ~hot, STATES[2]).otherwise(STATES[3])


def quadrant(scores: DataFrame) -> DataFrame:
    """Scores by month as probabilities of four states, directions and the label; 0 counts as down."""
    wide = scores.groupBy("month").pivot("axis", ["growth", "inflation"]).agg(F.max("score"))
    known = wide.toDF("month", "growth_score", "inflation_score").dropna()
    g, i = norm_cdf(F.col("growth_score")), norm_cdf(F.col("inflation_score"))
    up, hot = F.col("growth_score") > 0, F.col("inflation_score") > 0
    label = state_label(up, hot)
    return known.select(
        "month", "growth_score", "inflation_score",
        (g * (1 - i)).alias("p_goldilocks"), (g * i).alias("p_reflation"), ((1 - g) * i).alias("p_stagflation"), ((1 - g) * (1 - i)).alias("p_deflationary_bust"),
        up.alias("growth_up"), hot.alias("inflation_up"), label.alias("state"),
    )


def classify_states(macro: DataFrame, components: DataFrame, start: str | None = None) -> DataFrame:
    """Scores, probabilities and labels by month, with the value and smoothed value of each axis' primary indicator.

    Everything is scored on the full history; ``start`` cuts the result afterwards.
    """
    trends = trend(macro)
    primary = components.filter("is_primary").join(trends, "indicator").groupBy("month")
    of = lambda axis, c: F.max(F.when(F.col("axis") == axis, F.col(c))).alias(f"{axis}_{c}")
    values = primary.agg(*(of(axis, c) for axis in ("growth", "inflation") for c in ("value", "smooth")))
    states = quadrant(composite_score(trends, components)).join(values, "month")
    return states.filter(F.col("month") >= F.lit(start).cast("date")) if start else states


def transition_matrix(states: DataFrame) -> DataFrame:
    """from_state, to_state, n, p over all pairs of states; p is null for a state never left."""
    moved = states.select(F.col("state").alias("from_state"), F.lead("state").over(W.orderBy("month")).alias("to_state")).filter(F.col("to_state").isNotNull())
    counts = moved.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    names = F.array(*map(F.lit, STATES))
    grid = states.sparkSession.range(1).select(F.explode(names).alias("from_state")).withColumn("to_state", F.explode(names))
    full = grid.join(counts, ["from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("p", F.col("n") / F.nullif(F.sum("n").over(W.partitionBy("from_state")), F.lit(0)))


def state_frequency(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def state_spells(states: DataFrame) -> DataFrame:
    """Runs of months in one state: state, start, end, months."""
    w = W.orderBy("month")
    turned = states.withColumn("turn", F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1)))
    runs = turned.withColumn("run", F.sum("turn").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("run", "state").agg(F.min("month").alias("start"), F.max("month").alias("end"), F.count("*").alias("months")).drop("run")


def outlook(states: DataFrame, transitions: DataFrame, h: int = 3) -> DataFrame:
    """Probability of each state ``h`` months on: the latest soft vector through the transition matrix."""
    last = states.orderBy(F.desc("month")).limit(1)
    pairs = F.array(*(F.struct(F.lit(s).alias("state"), F.col(p).alias("p")) for s, p in PROBABILITIES.items()))
    now = last.select(F.explode(pairs).alias("x")).select("x.state", "x.p")
    for _ in range(h):
        step = now.join(transitions.select("from_state", "to_state", F.col("p").alias("t")), F.col("state") == F.col("from_state"))
        now = step.groupBy("to_state").agg(F.sum(F.col("p") * F.coalesce("t", F.lit(0.0))).alias("p")).withColumnRenamed("to_state", "state")
    return now


def state_performance(panel: DataFrame, states: DataFrame, least: int = 3) -> DataFrame:
    """Months, mean return, (1 + mean)^12 - 1 and volatility by state and series; months pool, so nothing is compounded."""
    rows = panel.filter(F.col("ret").isNotNull()).join(states.select("month", "state"), "month")
    m = F.avg("ret")
    stats = rows.groupBy("state", "series").agg(F.count("*").alias("n"), m.alias("mean_ret"), (F.pow(1 + m, 12.0) - 1).alias("annualised"), (F.stddev_samp("ret") * F.sqrt(F.lit(12.0))).alias("ann_vol"))
    return stats.filter(F.col("n") >= least)


def state_leaders(perf: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best and worst series of each state."""
    by = lambda order: F.row_number().over(W.partitionBy("state").orderBy(order, "series"))
    key = F.round("mean_ret", 12)
    ranked = perf.withColumn("best", by(key.desc())).withColumn("worst", by(key.asc()))
    return ranked.filter((F.col("best") <= n) | (F.col("worst") <= n)).select("state", "series", "mean_ret", "best", "worst")


def factor_attribution(panel: DataFrame, states: DataFrame, least: int = 3) -> DataFrame:
    """Mean excess over the Reference and hit rate by state and factor: regions' means weighted by their months."""
    rows = pair_with_reference(panel).withColumn("e", F.col("ret") - F.col("ref")).join(states.select("month", "state"), "month")
    regions = rows.groupBy("state", "region", "factor").agg(F.count("*").alias("n"), F.avg("e").alias("m"), F.avg((F.col("e") > 0).cast("double")).alias("h")).filter(F.col("n") >= least)
    weighted = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return regions.groupBy("state", "factor").agg(F.sum("n").alias("n_obs"), weighted("m").alias("mean_excess"), weighted("h").alias("hit_rate"), F.count("*").alias("n_regions"))


def flag_share_by_state(states: DataFrame, flags: DataFrame) -> DataFrame:
    """Share of each state's months in which flag (month, flag) is set."""
    return states.join(flags, "month").groupBy("state").agg(F.avg(F.col("flag").cast("double")).alias("share"), F.count("*").alias("n"))


def momentum_signs(states: DataFrame, m: int = 6, h: int = 6) -> DataFrame:
    """Monthly velocity of both scores over ``m`` months and where it leads in ``h`` more."""
    w = W.orderBy("month")
    out = states.select("month", "growth_score", "inflation_score")
    for axis in ("growth", "inflation"):
        out = out.withColumn(f"{axis}_velocity", (F.col(f"{axis}_score") - F.lag(f"{axis}_score", m).over(w)) / m)
        out = out.withColumn(f"{axis}_ahead", F.col(f"{axis}_score") + h * F.col(f"{axis}_velocity"))
    return out


def state_card(states: DataFrame, transitions: DataFrame, lag: int = 6) -> DataFrame:
    """One row on the latest month: its state and spell, the state ``lag`` months before, and where it tends to go.

    The expected duration is 1 / (1 - p) of the probability p of staying, infinite for p = 1. Of equally
    frequent next states the first in the order of STATES is named; none if no other ever followed.
    """
    w = W.orderBy("month")  # one row for each month, so one partition holds them
    seen = states.withColumn("prior_state", F.lag("state", lag).over(w)).withColumn("_from", F.when(~F.col("state").eqNullSafe(F.lag("state").over(w)), F.col("month")))
    spell = seen.withColumn("_place", F.row_number().over(w)).withColumn("_start", F.when(F.col("_from").isNotNull(), F.col("_place")))
    last = F.max_by(F.struct("month", "state", "growth_score", "inflation_score", "prior_state", "_place"), "month")
    now = spell.agg(last.alias("l"), F.max("_start").alias("_s")).filter(F.col("l").isNotNull())
    stays, other = F.col("from_state") == F.col("to_state"), (F.col("from_state") != F.col("to_state")) & (F.col("n") > 0)
    order = -F.array_position(F.array(*map(F.lit, STATES)), F.col("to_state"))
    moves = transitions.groupBy(F.col("from_state").alias("state")).agg(F.max(F.when(stays, F.col("p"))).alias("stay_prob"), F.max_by("to_state", F.when(other, F.struct(F.col("n"), order))).alias("likely_next"))
    p = F.col("stay_prob")
    card = now.select(F.col("l.month").alias("as_of"), "l.state", "l.growth_score", "l.inflation_score", "l.prior_state", (F.col("l._place") - F.col("_s") + 1).cast("long").alias("months_in_state"))
    return card.join(moves, "state", "left").withColumn("expected_duration", F.when(p < 1, 1 / (1 - p)).when(p == 1, F.lit(float("inf"))))


def empirical_cone(states: DataFrame, h: int = 3, least: int = 15) -> DataFrame:
    """Percentiles 10, 25, 75 and 90 of the moves of both scores over ``h`` months, by state, of ``least`` moves at least."""
    w = W.orderBy("month")
    moved = states.select("state", *((F.lead(f"{a}_score", h).over(w) - F.col(f"{a}_score")).alias(a) for a in ("growth", "inflation"))).filter(F.col("growth").isNotNull())
    cells = [F.percentile(a, F.lit(p / 100)).alias(f"{a}_p{p}") for a in ("growth", "inflation") for p in (10, 25, 75, 90)]
    return moved.groupBy("state").agg(F.count("*").alias("n"), *cells).filter(F.col("n") >= least)
