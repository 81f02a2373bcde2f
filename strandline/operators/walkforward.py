"""Races of weight rules: refits, training rows, weights, holding, costs, fees and what they say.

Everything is keyed by ``by`` (menus, protocols, replicates), so that any number of races is one job. A race's panel
has complete months; positions number them from 1.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dense
from ..functions.normal import correlation_p
from .covariance import ESTIMATORS, covariance_pairs, dr2_draws, estimate
from .inference import sharpe_diff_test
from .panel import asof_backward, complete_months
from .performance import REFERENCE, average_rank, corr_pairs, half_split_sharpe, momentum_score, perf_stats, rolling_beats

BPS = 10.0


def positions(panel: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Complete months of the returns with pos, the number of the month."""
    place = F.row_number().over(W.partitionBy(*by, "series").orderBy("month"))
    return complete_months(panel, "ret", by).withColumn("pos", place)


def refit_schedule(placed: DataFrame, warmup: int = 120, refit: int = 12, window: int | None = None, by: tuple[str, ...] = (), short: str = "raise") -> DataFrame:
    """``by``, refit, train_lo, train_hi, hold_lo, hold_hi, hold_month: a refit after ``warmup`` months and every ``refit`` after that.

    Training reaches from the first month, or over the last ``window``, to the month before the hold. A race of
    warmup + refit months or fewer is an error, or with ``short="skip"`` left out.
    """
    size = placed.groupBy(*by).agg(F.max("pos").alias("t"))
    if short == "raise" and (bad := size.filter(F.coalesce("t", F.lit(0)) <= warmup + refit).limit(5).collect()):
        raise ValueError(f"not enough months for warmup {warmup} and refit {refit}: {[r.asDict() for r in bad]}")
    rows = size.filter(F.col("t") > warmup + refit).select(*by, "t", F.posexplode(F.sequence(F.lit(warmup), F.col("t") - 1, F.lit(refit))).alias("refit", "hi"))
    low = F.lit(1) if window is None else F.greatest(F.lit(1), F.col("hi") - window + 1)
    spans = rows.select(*by, "refit", low.alias("train_lo"), F.col("hi").alias("train_hi"), (F.col("hi") + 1).alias("hold_lo"), F.least(F.col("hi") + refit, F.col("t")).alias("hold_hi"))
    months = placed.select(*by, F.col("pos").alias("hold_lo"), F.col("month").alias("hold_month")).distinct()
    return spans.join(months, [*by, "hold_lo"])


def _spread(schedule: DataFrame, low: str, high: str, by: tuple[str, ...]) -> DataFrame:
    """A row for each refit and position of its range: range joins become equi-joins."""
    return schedule.select(*by, "refit", F.explode(F.sequence(low, high)).alias("pos"))


def train_slices(placed: DataFrame, schedule: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every refit's training rows."""
    return placed.join(_spread(schedule, "train_lo", "train_hi", by), [*by, "pos"])


def equal_weights(placed: DataFrame, schedule: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """rule 1/N: ``by``, refit, series, w."""
    names = placed.select(*by, "series").distinct()
    rows = schedule.select(*by, "refit").join(names, list(by)) if by else schedule.select("refit").crossJoin(names)  # refits times series
    return rows.select(*by, F.lit("1/N").alias("rule"), "refit", "series", (1.0 / F.count("*").over(W.partitionBy(*by, "refit"))).alias("w"))


def momentum_at_refits(placed: DataFrame, schedule: DataFrame, k: int = 6, lookback: int = 12, skip: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """rule Momentum: equal weights on the ``k`` best scores at each refit's last training month; ties go to the first series by name."""
    scored = momentum_score(placed, lookback, skip, by).filter("score IS NOT NULL").select(*by, "series", "score", F.col("pos").alias("train_hi"))
    place = F.row_number().over(W.partitionBy(*by, "refit").orderBy(F.desc(F.round("score", 12)), "series"))
    top = schedule.select(*by, "refit", "train_hi").join(scored, [*by, "train_hi"]).withColumn("_r", place).filter(F.col("_r") <= k)
    return top.select(*by, F.lit("Momentum").alias("rule"), "refit", "series", (1.0 / F.count("*").over(W.partitionBy(*by, "refit"))).alias("w"))


def naive_tilts(placed: DataFrame, schedule: DataFrame, factor: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rules "1/N <factor>" over one factor's series, and "Inverse variance" over all by their training variance."""
    tilt = equal_weights(placed.filter(F.split("series", r" \| ", 2)[1] == factor), schedule, by).withColumn("rule", F.lit(f"1/N {factor}"))
    own = train_slices(placed, schedule, by).groupBy(*by, "refit", "series").agg((1 / F.nullif(F.var_samp("ret"), F.lit(0.0))).alias("inv"))
    share = F.col("inv") / F.sum("inv").over(W.partitionBy(*by, "refit"))
    return tilt.unionByName(own.filter("inv IS NOT NULL").select(*by, F.lit("Inverse variance").alias("rule"), "refit", "series", share.alias("w")))


def by_matrix(rows: DataFrame, keys: tuple[str, ...], fit: Callable[[list[str], np.ndarray, np.ndarray], pd.DataFrame], schema: str, estimator: str = "constant_correlation") -> DataFrame:
    """``keys`` and what ``fit(series, returns, covariance)`` finds (``schema``: its columns) for each group of rows (``keys``, series, pos, month, ret) without gaps.

    Covariances are estimated from all pairs of all groups at once; a group's matrix and months meet in one task, the unit that a dense rule needs.
    """
    pairs = covariance_pairs(rows, keys, complete=False)
    cov = estimate(pairs, "sample" if estimator == "nonlinear" else estimator, keys)
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(key: tuple, months: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        wide = months.pivot(index="pos", columns="series", values="ret").sort_index(axis=1)
        matrix = cells.pivot(index="i", columns="j", values="cov").loc[wide.columns, wide.columns].to_numpy()
        found = fit(list(wide.columns), wide.to_numpy(), dense.spectral(matrix, len(wide)) if estimator == "nonlinear" else matrix)
        return found.assign(**dict(zip(keys, key, strict=True)))[[*keys, *found.columns]]

    cells = cov.select(*(F.col(k).alias(f"_{k}") for k in keys), "i", "j", "cov").groupBy(*(f"_{k}" for k in keys))
    return rows.select(*keys, "series", "pos", "ret").groupBy(*keys).cogroup(cells).applyInPandas(run, f"{own}, {schema}")


def fit_weights(placed: DataFrame, schedule: DataFrame, rules: tuple[str, ...], by: tuple[str, ...] = (), estimator: str = "constant_correlation") -> DataFrame:
    """``by``, rule, refit, series, w of the dense rules for each refit, on the covariance by ``estimator``: one of `covariance.ESTIMATORS`, or nonlinear.

    The rules' names are those of ``functions.dense.RULES``.
    """
    unknown = set(rules) - set(dense.RULES)
    if unknown or estimator not in (*ESTIMATORS, "nonlinear"):
        raise ValueError(f"unknown rules {sorted(unknown)} or estimator {estimator!r}")
    rows = train_slices(placed, schedule, by).select(*by, "refit", "series", "pos", "month", "ret")

    def fit(series: list[str], x: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"rule": rule, "series": series, "w": dense.RULES[rule](x, cov)}) for rule in rules])

    return by_matrix(rows, (*by, "refit"), fit, "rule string, series string, w double", estimator).select(*by, "rule", "refit", "series", "w")


def turnover(weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, rule, refit, turnover: half the sum of absolute changes since the rule's last refit, 0 at its first.

    Each weight counts at its refit and, negated, at the rule's next one, so series that come or go need no grid.
    """
    keys = [*by, "rule"]
    refits = weights.select(*keys, "refit").distinct()
    chained = refits.withColumn("next", F.lead("refit").over(W.partitionBy(*keys).orderBy("refit"))).withColumn("first", F.col("refit") == F.min("refit").over(W.partitionBy(*keys)))
    linked = weights.join(chained, [*keys, "refit"])
    gone = linked.filter("next IS NOT NULL").select(*keys, F.col("next").alias("refit"), "series", (-F.col("w")).alias("w"))
    moved = weights.select(*keys, "refit", "series", "w").unionByName(gone).groupBy(*keys, "refit", "series").agg(F.sum("w").alias("d"))
    sums = moved.groupBy(*keys, "refit").agg((F.sum(F.abs("d")) / 2).alias("t"))
    return sums.join(chained, [*keys, "refit"]).select(*keys, "refit", F.when(F.col("first"), 0.0).otherwise(F.col("t")).alias("turnover"))


def held_rows(weights: DataFrame, placed: DataFrame, schedule: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, rule, refit, series, w, pos, month, ret: each refit's weights on the months that it holds."""
    months = placed.join(_spread(schedule, "hold_lo", "hold_hi", by), [*by, "pos"])
    return weights.join(months.select(*by, "refit", "series", "pos", "month", "ret"), [*by, "refit", "series"])


def walk_forward(weights: DataFrame, placed: DataFrame, schedule: DataFrame, by: tuple[str, ...] = (), bps: float = BPS, arm: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``arm``, rule, month, refit, gross, turnover, net: the rules' monthly returns out of sample.

    Weights are held constant between refits; a refit's turnover is traded, at ``bps``, in its first month.
    A rule that skips a refit has no returns for the months of that refit. ``arm`` names further keys of the weights, which
    share their race's panel and schedule.
    """
    keys = (*by, *arm)
    gross = held_rows(weights, placed, schedule, by).groupBy(*keys, "rule", "refit", "pos", "month").agg(F.sum(F.col("w") * F.col("ret")).alias("gross"))
    starts = schedule.select(*by, "refit", "hold_lo")
    rows = gross.join(turnover(weights, keys), [*keys, "rule", "refit"]).join(starts, [*by, "refit"])
    paid = F.when(F.col("pos") == F.col("hold_lo"), F.col("turnover")).otherwise(0.0)
    return rows.select(*keys, "rule", "month", "refit", "gross", paid.alias("turnover"), (F.col("gross") - bps / 1e4 * paid).alias("net"))


def levels_of(returns_: DataFrame, by: tuple[str, ...] = (), value: str = "ret") -> DataFrame:
    """``by``, series, month, level: returns compounded from 100 in the month before the first."""
    w = W.partitionBy(*by, "series").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    rows = returns_.filter(F.col(value).isNotNull()).select(*by, "series", "month", (100 * F.exp(F.sum(F.log1p(value)).over(w))).alias("level"))
    base = rows.groupBy(*by, "series").agg(F.last_day(F.add_months(F.min("month"), -1)).alias("month")).withColumn("level", F.lit(100.0))
    return rows.unionByName(base)


def race_summary(race: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Performance net of costs of each rule, its gross Sharpe ratio and mean turnover by refit."""
    named = race.withColumnRenamed("rule", "series")
    net = perf_stats(levels_of(named, by, "net"), by)
    gross = perf_stats(levels_of(named, by, "gross"), by).select(*by, "series", F.col("sharpe").alias("sharpe_gross"))
    traded = named.groupBy(*by, "series").agg((F.sum("turnover") / F.countDistinct("refit")).alias("mean_turnover"))
    return net.join(gross, [*by, "series"]).join(traded, [*by, "series"]).withColumnRenamed("series", "rule")


def sharpe_of(race: DataFrame, by: tuple[str, ...] = (), value: str = "net") -> DataFrame:
    return race.groupBy(*by, "rule").agg((F.avg(value) / F.nullif(F.stddev_samp(value), F.lit(0.0)) * F.sqrt(F.lit(12.0))).alias("sharpe"))


def net_of_costs(race: DataFrame, grid: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, bps, rule, sharpe: the same gross returns and turnovers at many levels of cost."""
    rows = race.withColumn("bps", F.explode(F.array(*(F.lit(float(b)) for b in grid)))).withColumn("net", F.col("gross") - F.col("bps") / 1e4 * F.col("turnover"))
    return sharpe_of(rows, (*by, "bps"))


def net_of_fees(race: DataFrame, weights: DataFrame, fees: DataFrame, overlays: DataFrame | None = None, bench: str = "1/N") -> DataFrame:
    """rule, months, fee_ann, sharpe, active_ann, information_ratio: returns after the yearly fees (series, fee) of what is held.

    ``overlays`` (rule, base, month, exposure, ret) pay their base's fee on their exposure. Active figures are against ``bench``.
    """
    rate = weights.join(fees, "series").groupBy("rule", "refit").agg((F.sum(F.col("w") * F.col("fee")) / 12).alias("fee"))
    rows = race.join(rate, ["rule", "refit"]).select("rule", "month", "fee", (F.col("net") - F.col("fee")).alias("ret"))
    if overlays is not None:
        base = rows.select(F.col("rule").alias("base"), "month", F.col("fee").alias("_f"))
        paid = F.col("exposure") * F.col("_f")
        rows = rows.unionByName(overlays.join(base, ["base", "month"]).select("rule", "month", paid.alias("fee"), (F.col("ret") - paid).alias("ret")))
    rows = rows.join(rows.filter(F.col("rule") == bench).select("month", F.col("ret").alias("b")), "month", "left").withColumn("a", F.when(F.col("rule") != bench, F.col("ret") - F.col("b")))
    ratio = lambda c: F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * F.sqrt(F.lit(12.0))
    return rows.groupBy("rule").agg(F.count("*").alias("months"), (F.avg("fee") * 12).alias("fee_ann"), ratio("ret").alias("sharpe"), (F.avg("a") * 12).alias("active_ann"), ratio("a").alias("information_ratio"))


def rebalance_drift(weights: DataFrame, placed: DataFrame, schedule: DataFrame, by: tuple[str, ...] = (), bps: float = BPS) -> DataFrame:
    """``by``, rule, month, constant_mix, monthly_trades, buy_and_hold, drift: three ways to hold a refit's weights, net of cost.

    The constant mix pays only at refits; monthly trades also pay, a month later, for trading each month's drift back; buy
    and hold lets weights drift and pays at a refit for the way from where they ended. Nothing is paid at a rule's first refit.
    """
    keys, cost = [*by, "rule", "refit"], bps / 1e4
    rows = held_rows(weights, placed, schedule, by)
    path = W.partitionBy(*keys, "series").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("value", F.col("w") * F.exp(F.sum(F.log1p("ret")).over(path)))
    months = rows.groupBy(*keys, "pos", "month").agg(F.sum(F.col("w") * F.col("ret")).alias("r"), F.sum("value").alias("v"))
    drifted = rows.join(months.select(*keys, "pos", "r", "v"), [*keys, "pos"])
    gap = F.abs(F.col("w") * (1 + F.col("ret")) / (1 + F.col("r")) - F.col("w"))
    months = months.join(drifted.groupBy(*keys, "pos").agg((F.sum(gap) / 2).alias("drift")), [*keys, "pos"])
    last = drifted.join(schedule.select(*by, "refit", F.col("hold_hi").alias("pos")), [*by, "refit", "pos"])
    ended = last.select(*keys, "series", (F.col("value") / F.col("v")).alias("w"))
    chain = weights.select(*by, "rule", "refit").distinct().withColumn("next", F.lead("refit").over(W.partitionBy(*by, "rule").orderBy("refit"))).filter("next IS NOT NULL")
    gone = ended.join(chain, keys).select(*by, "rule", F.col("next").alias("refit"), "series", (-F.col("w")).alias("w"))
    arrived = weights.join(chain.select(*by, "rule", F.col("next").alias("refit")), keys, "left_semi").select(*keys, "series", "w")
    trade = arrived.unionByName(gone).groupBy(*keys, "series").agg(F.sum("w").alias("d")).groupBy(*keys).agg((F.sum(F.abs("d")) / 2).alias("hold_trade"))
    w = W.partitionBy(*keys).orderBy("pos")
    months = months.join(turnover(weights, by), keys).join(trade, keys, "left")
    first = F.row_number().over(w) == 1
    paid = F.when(first, cost * F.col("turnover")).otherwise(0.0)
    return months.select(
        *by, "rule", "month",
        (F.col("r") - paid).alias("constant_mix"),
        (F.col("r") - paid - cost * F.coalesce(F.lag("drift").over(w), F.lit(0.0))).alias("monthly_trades"),
        (F.col("v") / F.coalesce(F.lag("v").over(w), F.lit(1.0)) - 1 - F.when(first, cost * F.coalesce("hold_trade", F.lit(0.0))).otherwise(0.0)).alias("buy_and_hold"),
        "drift",
    )


def sleeve_attribution(weights: DataFrame, placed: DataFrame, schedule: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, rule, series, contribution (the sum of weight times return) and its share of the rule's total."""
    parts = held_rows(weights, placed, schedule, by).groupBy(*by, "rule", "series").agg(F.sum(F.col("w") * F.col("ret")).alias("contribution"))
    total = F.sum("contribution").over(W.partitionBy(*by, "rule"))
    return parts.withColumn("share", F.col("contribution") / F.nullif(total, F.lit(0.0))).filter(F.abs("contribution") > 1e-12)


def top_attribution(attribution: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` largest shares of each rule; ties go to the series' name."""
    w = W.partitionBy("rule").orderBy(F.desc(F.round("share", 12)), "series")
    return attribution.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("rule", "rank", "series", "contribution", "share")


def rank_slip(runs: DataFrame, base: str = "none") -> DataFrame:
    """rule, base_rank, worst_rank, best_rank over runs (run, rule, sharpe): ties share the lower place, by name."""
    w = W.partitionBy("run").orderBy(F.desc(F.round("sharpe", 12)), "rule")
    ranked = runs.filter("sharpe IS NOT NULL").withColumn("rank", F.row_number().over(w))
    return ranked.groupBy("rule").agg(F.max(F.when(F.col("run") == base, F.col("rank"))).alias("base_rank"), F.max("rank").alias("worst_rank"), F.min("rank").alias("best_rank"), F.count("*").alias("n_runs"))


def dispersion(runs: DataFrame, bench: str = "1/N") -> DataFrame:
    """rule, median, lowest and highest Sharpe ratio over runs (run, rule, sharpe), shares of runs ahead of ``bench`` and first of all."""
    known = runs.filter("sharpe IS NOT NULL")
    even = known.filter(F.col("rule") == bench).select("run", F.col("sharpe").alias("b"))
    first = known.groupBy("run").agg(F.max_by("rule", F.struct(F.round("sharpe", 12), F.col("rule"))).alias("top"))
    rows = known.join(even, "run", "left").join(first, "run")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return rows.groupBy("rule").agg(
        F.percentile("sharpe", F.lit(0.5)).alias("median"), F.min("sharpe").alias("lowest"), F.max("sharpe").alias("highest"), share(F.col("sharpe") > F.col("b")).alias("ahead"), share(F.col("rule") == F.col("top")).alias("first")
    )


def sensitivity_flips(cells: DataFrame, leader: str, capped: str, uncapped: str, base: str) -> DataFrame:
    """cell, check, value, holds, verdict for two conclusions over cells (cell, rule, sharpe): ``leader`` ranks first; ``capped`` does not trail ``uncapped``.

    A conclusion that is false in the base cell is stale everywhere; else a cell that contradicts it flips.
    """
    w = W.partitionBy("cell").orderBy(F.desc(F.round("sharpe", 12)), "rule")
    of = lambda rule, c: F.max(F.when(F.col("rule") == rule, F.col(c)))
    wide = cells.withColumn("rank", F.row_number().over(w)).groupBy("cell").agg(of(leader, "rank").cast("double").alias("rank"), (of(capped, "sharpe") - of(uncapped, "sharpe")).alias("gap"))
    checks = F.explode(F.array(F.struct(F.lit("leader").alias("check"), F.col("rank").alias("value"), (F.col("rank") == 1).alias("holds")), F.struct(F.lit("capped").alias("check"), F.col("gap").alias("value"), (F.col("gap") >= 0).alias("holds"))))
    rows = wide.withColumn("c", checks).select("cell", "c.*")
    told = rows.join(rows.filter(F.col("cell") == base).select("check", F.col("holds").alias("_b")), "check")
    return told.withColumn("verdict", F.when(~F.col("_b"), "stale").when(~F.col("holds"), "flips").otherwise("holds")).drop("_b")


def region_correlations(returns_: DataFrame, panel: DataFrame) -> DataFrame:
    """series, region, n, corr of returns with every region's Reference on the months that both have."""
    refs = panel.filter((F.col("factor") == REFERENCE) & F.col("ret").isNotNull()).select("region", "month", F.col("ret").alias("ref"))
    return returns_.filter("ret IS NOT NULL").join(refs, "month").groupBy("series", "region").agg(F.count("*").alias("n"), F.corr("ret", "ref").alias("corr"))


def exposure_diagnostics(returns_: DataFrame, panel: DataFrame, bench: DataFrame, window: int = 36) -> DataFrame:
    """series, first and second half's Sharpe, share of windows ahead of ``bench`` (month, bench) and region, the Reference it moves with most, and corr; all regions: :func:`region_correlations`."""
    corr = region_correlations(returns_, panel)
    nearest = corr.groupBy("series").agg(F.max_by(F.struct("region", "corr"), F.struct(F.round("corr", 9), "region")).alias("n")).select("series", F.col("n.region").alias("region"), F.col("n.corr").alias("corr"))
    return half_split_sharpe(returns_).join(rolling_beats(returns_, bench, window).drop("ahead"), "series", "left").join(nearest, "series", "left")


def drop_groups(panel: DataFrame, groups: list[str]) -> DataFrame:
    """The panel once whole (menu "none") and once without each region, under the key ``menu``: leave-one-out races are one job."""
    whole = panel.withColumn("menu", F.explode(F.array(*(F.lit(m) for m in ("none", *groups)))))
    return whole.filter(F.col("menu") != F.col("region"))


def shifted_windows(panel: DataFrame, offsets: tuple[int, ...], least: int) -> DataFrame:
    """The panel without its first k months, under the key ``menu``, for each offset k that leaves ``least`` months."""
    months = panel.filter("ret IS NOT NULL").select("month").distinct().withColumn("_p", F.row_number().over(W.orderBy("month")))  # a row for each month
    placed = months.crossJoin(F.broadcast(months.agg(F.max("_p").alias("_n")))).withColumn("menu", F.explode(F.array(*(F.lit(k) for k in offsets))))
    keep = placed.filter((F.col("_p") > F.col("menu")) & (F.col("_n") - F.col("menu") >= least)).select("month", "menu")
    return panel.join(keep, "month")


def protocol_grid(placed: DataFrame, protocols: list[tuple[str, int, int, int | None]]) -> tuple[DataFrame, DataFrame]:
    """(panel, schedule) under the key ``menu`` for protocols (name, warmup, refit, window); those that the months do not suffice for are left out."""
    rows = placed.withColumn("menu", F.explode(F.array(*(F.lit(name) for name, *_ in protocols))))
    parts = [refit_schedule(rows.filter(F.col("menu") == name), warmup, refit, window, ("menu",), "skip") for name, warmup, refit, window in protocols]
    return rows, reduce(DataFrame.unionByName, parts)


def menu_study(menus: DataFrame, gaps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, rule, measure, n, spearman, p: rank correlation over menus of a measure (``by``, menu, measure, value) with the rule's gap (``by``, menu, rule, gap).

    ``by`` are eras and scopes; p is two-sided by Student's distribution, null for fewer than three menus.
    """
    rows = menus.join(gaps.filter("gap IS NOT NULL"), [*by, "menu"])
    keys = [*by, "rule", "measure"]
    ranked = rows.withColumn("rx", average_rank(F.round("value", 12), keys)).withColumn("ry", average_rank(F.round("gap", 12), keys))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman"))
    return out.withColumn("p", correlation_p(F.col("spearman"), F.col("n")))


def menu_measures(placed: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by``, measure, value of each menu: n_series, mean_corr, min_corr, inv_mean_corr, and dr2, the independent bets of equal weights on the shrunk covariance."""
    pairs = corr_pairs(placed, by, complete=False).groupBy(*by).agg(F.avg("corr").alias("mean_corr"), F.min("corr").alias("min_corr"))
    bets = dr2_draws(placed, by, 0).select(*by, "dr2")
    sizes = placed.groupBy(*by).agg(F.countDistinct("series").cast("double").alias("n_series"))
    rows = sizes.join(pairs, list(by)).join(bets, list(by)).withColumn("inv_mean_corr", 1 / F.nullif(F.col("mean_corr"), F.lit(0.0)))
    return rows.unpivot(list(by), ["n_series", "mean_corr", "min_corr", "inv_mean_corr", "dr2"], "measure", "value")


def menu_gaps(race: DataFrame, by: tuple[str, ...], bench: str = "1/N", replicates: int = 4999) -> DataFrame:
    """``by``, rule, gap (yearly Sharpe ratio, monthly population figures, less the bench's) and p_boot of each rule in each race."""
    name = lambda rule: F.to_json(F.struct(*by, rule.alias("rule")))
    net = race.select(name(F.col("rule")).alias("series"), "month", F.col("net").alias("ret"))
    rules = race.filter(F.col("rule") != bench).select(*by, "rule").distinct()
    pairs = rules.withColumns({"x_name": name(F.col("rule")), "y_name": name(F.lit(bench))})
    tests = sharpe_diff_test(net, pairs, replicates).select("x_name", (F.col("delta") * F.sqrt(F.lit(12.0))).alias("gap"), "p_boot")
    return pairs.join(tests, "x_name").select(*by, "rule", "gap", "p_boot")


def held_at(weights: DataFrame, schedule: DataFrame, months: DataFrame) -> DataFrame:
    """rule, month, series, w: the weights held in each month, from the last refit that began up to it."""
    starts = weights.select("rule", "refit").distinct().join(schedule.select("refit", F.col("hold_month").alias("month")), "refit")
    grid = weights.select("rule").distinct().crossJoin(months.select("month").distinct())  # rules times months
    return asof_backward(grid, starts, ["rule"], ["refit"]).filter("refit IS NOT NULL").join(weights, ["rule", "refit"]).select("rule", "month", "series", "w")
