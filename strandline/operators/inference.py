"""Tests of races: block bootstraps, family-wise p-values, overfitting, ranks, permutations and simulated paths.

Replicates are rows: draws come from md5 of (seed, replicate, block), so they are the same whatever the partitioning
and in any engine. A variance of a smooth statistic is that of its influence, one number for each month, so no matrix is needed.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normal import norm_cdf
from .panel import complete_months
from .performance import block_ranks, psr
from .replicates import block_sums, over_replicates

#: Longest lag that the kernels know; enough for some 14 000 months.
MOST_LAGS = 12
EULER = 0.5772156649015329


def draw(*parts: Column) -> Column:
    """An integer from 0 to 2^32 - 1 that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def block_length(n: Column) -> Column:
    """max(3, n^(1/3) rounded half to even)."""
    return F.greatest(F.lit(3), F.bround(F.pow(n.cast("double"), F.lit(1 / 3)), 0).cast("int"))


def lags_of(n: Column) -> Column:
    """max(1, int(4 (n / 100)^(2/9)))."""
    return F.greatest(F.lit(1), F.floor(4 * F.pow(n / 100.0, F.lit(2 / 9))).cast("int"))


def parzen(z: Column) -> Column:
    return F.when(z <= 0.5, 1 - 6 * z * z + 6 * z * z * z).when(z <= 1, 2 * F.pow(1 - z, 3)).otherwise(0.0)


def block_index(sizes: DataFrame, replicates: int, by: tuple[str, ...] = (), seed: int = 7, block: int | None = None) -> DataFrame:
    """``by``, rep, block, pos, src: circular block draws of the positions 0 to n - 1 for every row of sizes (``by``, n), and a column seed if it has one.

    All series of a key share the draws of their key's length. A row of sizes is spread to n rows for each replicate.
    """
    length = block_length(F.col("n")) if block is None else F.lit(block)
    seeded = sizes if "seed" in sizes.columns else sizes.withColumn("seed", F.lit(seed))
    rows = seeded.withColumn("b", length).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("b")).cast("int") - 1)))
    start = F.pmod(draw(F.col("seed"), F.col("rep"), F.col("block")), F.col("n"))
    offset = F.explode(F.sequence(F.lit(0), F.least(F.col("b"), F.col("n") - F.col("block") * F.col("b")).cast("int") - 1)).alias("o")
    spread = blocks.select(*by, "seed", "rep", "n", "b", "block", start.alias("start"), offset)
    return spread.select(*by, "seed", "rep", "n", "b", "block", (F.col("block") * F.col("b") + F.col("o")).cast("int").alias("pos"), F.pmod(F.col("start") + F.col("o"), F.col("n")).cast("int").alias("src"))


def resample(rows: DataFrame, index: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows (``by``, pos) that each replicate draws, at their new positions."""
    return index.join(rows.withColumnRenamed("pos", "src"), [*by, "src"])


def pair_rows(returns_: DataFrame, pairs: DataFrame) -> DataFrame:
    """x_name, y_name, month, pos, x, y: pairs (x_name, y_name) of series on their common months, numbered from 0."""
    known = returns_.filter("ret IS NOT NULL").select("series", "month", "ret")
    x, y = known.toDF("x_name", "month", "x"), known.toDF("y_name", "month", "y")
    rows = pairs.select("x_name", "y_name").distinct().join(x, "x_name").join(y, ["y_name", "month"])
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("x_name", "y_name").orderBy("month")) - 1)


_PAIR = ("x_name", "y_name")


def _sharpe_moments(prefix: str = "") -> dict[str, Column]:
    """delta and the weights of (x, y, x^2, y^2) in its influence, from the means mx, my, mxx, myy."""
    mx, my, gx, gy = (F.col(f"{prefix}{c}") for c in ("mx", "my", "mxx", "myy"))
    vx, vy = gx - mx * mx, gy - my * my
    sx, sy = F.when(vx > 1e-18, F.sqrt(vx)), F.when(vy > 1e-18, F.sqrt(vy))
    cube = lambda s: s * s * s
    return {"delta": mx / sx - my / sy, "wx": gx / cube(sx), "wy": -gy / cube(sy), "wxx": -mx / (2 * cube(sx)), "wyy": my / (2 * cube(sy))}


def _means() -> list[Column]:
    x, y = F.col("x"), F.col("y")
    return [F.avg(v).alias(n) for n, v in (("mx", x), ("my", y), ("mxx", x * x), ("myy", y * y))]


def sharpe_gaps(rows: DataFrame) -> DataFrame:
    """x_name, y_name, n, sharpe_x, sharpe_y, delta, se (Parzen kernel), p_hac of pair rows: monthly Sharpe ratios with population volatility.

    delta, se and p are null for fewer than 24 months or without volatility; se and p also where the variance is not positive.
    """
    packed = F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("m")  # the pair's months
    stats = rows.groupBy(*_PAIR).agg(F.count("*").alias("n"), *_means(), packed).withColumns(_sharpe_moments())
    v = lambda c, m, w: F.col(w) * (c - F.col(m))
    influence = F.transform("m", lambda e: v(e["x"], "mx", "wx") + v(e["y"], "my", "wy") + v(e["x"] * e["x"], "mxx", "wxx") + v(e["y"] * e["y"], "myy", "wyy"))
    most = lags_of(F.col("n"))

    def lagged(j: Column) -> Column:
        rest = F.col("n").cast("int") - j
        products = F.zip_with(F.slice("u", j + 1, rest), F.slice("u", F.lit(1), rest), lambda a, b: a * b)
        return F.when(j == 0, 1.0).otherwise(2 * parzen(j / most)) * F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)

    root = lambda m, g: F.col(m) / F.when(F.col(g) - F.col(m) * F.col(m) > 1e-18, F.sqrt(F.col(g) - F.col(m) * F.col(m)))
    known = F.col("n") >= 24
    g = F.aggregate(F.transform(F.sequence(F.lit(0), F.least(most, F.col("n").cast("int") - 1)), lagged), F.lit(0.0), lambda acc, p: acc + p)
    out = stats.withColumn("u", influence).withColumn("g", F.when(known, g)).select(
        *_PAIR, "n", root("mx", "mxx").alias("sharpe_x"), root("my", "myy").alias("sharpe_y"), F.when(known, F.col("delta")).alias("delta"), F.when(F.col("g") > 0, F.sqrt("g") / F.col("n")).alias("se"),
    )
    return out.withColumn("p_hac", 2 * norm_cdf(-F.abs(F.col("delta") / F.col("se"))))


def _studentised(values: np.ndarray, first: np.ndarray, block: int) -> dict[str, np.ndarray]:
    """d, the gap in Sharpe ratios of each replicate, and v, the variance of it from the sums of its influence over whole blocks."""
    n, whole = len(values), len(values) // block
    x, y = values.T
    sums = block_sums(np.column_stack([x, y, x * x, y * y]), first, block)
    mx, my, gx, gy = sums.sum(axis=1).T / n
    sx, sy = (np.sqrt(np.where(g - m * m > 1e-18, g - m * m, np.nan)) for m, g in ((mx, gx), (my, gy)))
    weights = np.column_stack([gx / sx**3, -gy / sy**3, -mx / (2 * sx**3), my / (2 * sy**3)])
    middle = block * np.column_stack([mx, my, gx, gy])
    z = np.einsum("rbc,rc->rb", sums[:, :whole] - middle[:, None, :], weights)
    var = (z * z).sum(axis=1) / block / whole / n if whole else np.full(len(first), np.nan)
    return {"d": mx / sx - my / sy, "v": np.where(var > 0, var, np.nan)}


def sharpe_draws(rows: DataFrame, gaps: DataFrame, replicates: int, seeds: tuple[int, ...] = (7,), block: int | None = None) -> DataFrame:
    """x_name, y_name, seed, rep, t: the studentised gap of every replicate, centred on the pair's own.

    A replicate's error comes from the sums of its influence over whole blocks; one without volatility or error is left out.
    """
    known = gaps.filter("delta IS NOT NULL").select(*_PAIR, "delta")
    drawn = over_replicates(rows, _PAIR, "pos", ["x", "y"], replicates, _studentised, "d double, v double", seeds, block, 24)
    return drawn.join(known, list(_PAIR)).select(*_PAIR, "seed", "rep", ((F.col("d") - F.col("delta")) / F.sqrt("v")).alias("t"))


def sharpe_diff_test(returns_: DataFrame, pairs: DataFrame, replicates: int = 4999, seeds: tuple[int, ...] = (7,), block: int | None = None) -> DataFrame:
    """One row for each pair and seed: the gap, its error and p by kernel, and p_boot, the share of replicates at least as far out.

    p_boot is (1 + extreme) / (1 + used), null where the gap or its error is.
    """
    rows = pair_rows(returns_, pairs)
    gaps = sharpe_gaps(rows)
    drawn = sharpe_draws(rows, gaps, replicates, seeds, block).join(gaps.select(*_PAIR, (F.col("delta") / F.col("se")).alias("d")), list(_PAIR))
    p = drawn.filter("d IS NOT NULL").groupBy(*_PAIR, "seed").agg(((1 + F.count_if(F.abs("t") >= F.abs("d"))) / (1 + F.count("*"))).alias("p_boot"), F.count("*").alias("used"))
    every = gaps.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds))))
    return every.join(p, [*_PAIR, "seed"], "left")


def seed_stability(tests: DataFrame) -> DataFrame:
    """Spread of the bootstrap p over seeds, by pair."""
    return tests.groupBy(*_PAIR).agg(F.count("p_boot").alias("n_seeds"), F.min("p_boot").alias("p_min"), F.max("p_boot").alias("p_max"), F.avg("p_boot").alias("p_mean"), F.stddev_samp("p_boot").alias("p_sd"))


def ratio_diff_test(returns_: DataFrame, pairs: DataFrame, factors: DataFrame, stat: str, replicates: int = 4999, seed: int = 7) -> DataFrame:
    """x_name, y_name, delta, p_boot, ci_lo, ci_hi, used of the gap in a ratio of returns in excess of cash (factors: month, rf, mkt_rf).

    ``stat`` is sortino, treynor or cer followed by the risk aversion. p counts replicates at least as far from their mean as
    the gap from zero; the interval holds 95 % of the replicates; those without a ratio are left out.
    """
    f = factors.select("month", "rf", F.col("mkt_rf").alias("m"))
    rows = pair_rows(returns_, pairs).join(f, "month").withColumns({"x": F.col("x") - F.col("rf"), "y": F.col("y") - F.col("rf")})
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy(*_PAIR).orderBy("month")) - 1).select(*_PAIR, "pos", "x", "y", "m")

    def ratio(c: str) -> Column:
        if stat == "sortino":
            return F.avg(c) * F.sqrt(F.lit(12.0)) / F.nullif(F.sqrt(F.avg(F.pow(F.least(F.col(c), F.lit(0.0)), 2))), F.lit(0.0))
        if stat == "treynor":
            beta = F.covar_pop(c, "m") / F.nullif(F.var_pop("m"), F.lit(0.0))
            return F.when(beta > 0, F.avg(c) * 12 / beta)
        if stat.startswith("cer"):
            return (F.avg(c) - float(stat[3:]) / 2 * F.var_samp(c)) * 12
        raise ValueError(f"unknown ratio {stat!r}: sortino, treynor or cer<gamma>")

    def replicated(values: np.ndarray, first: np.ndarray, length: int) -> dict[str, np.ndarray]:
        n, (x, y, m) = len(values), values.T
        down = lambda v: np.minimum(v, 0) ** 2
        means = block_sums(np.column_stack([x, y, x * x, y * y, down(x), down(y), x * m, y * m, m, m * m]), first, length).sum(axis=1).T / n

        def one(v: np.ndarray, vv: np.ndarray, low: np.ndarray, vm: np.ndarray) -> np.ndarray:
            if stat == "sortino":
                return v * math.sqrt(12) / np.sqrt(np.where(low > 0, low, np.nan))
            if stat == "treynor":
                beta = (vm - v * means[8]) / np.where(means[9] - means[8] ** 2 > 0, means[9] - means[8] ** 2, np.nan)
                return np.where(beta > 0, v * 12 / beta, np.nan)
            return (v - float(stat[3:]) / 2 * (vv - v * v) * n / (n - 1)) * 12

        return {"d": one(means[0], means[2], means[4], means[6]) - one(means[1], means[3], means[5], means[7])}

    seen = rows.groupBy(*_PAIR).agg((ratio("x") - ratio("y")).alias("delta"))
    reps = over_replicates(rows, _PAIR, "pos", ["x", "y", "m"], replicates, replicated, "d double", (seed,))
    centre = reps.groupBy(*_PAIR).agg(F.avg("d").alias("centre"), F.percentile("d", F.lit(0.025)).alias("ci_lo"), F.percentile("d", F.lit(0.975)).alias("ci_hi"))
    both = reps.join(centre.join(seen, list(_PAIR)), list(_PAIR))
    far = F.count_if(F.abs(F.round(F.col("d") - F.col("centre"), 12)) >= F.round(F.abs("delta"), 12))
    return both.groupBy(*_PAIR, "delta", "ci_lo", "ci_hi").agg(((1 + far) / (1 + F.count("*"))).alias("p_boot"), F.count("*").alias("used"))


def step_down(observed: DataFrame, drawn: DataFrame, cell: tuple[str, ...]) -> DataFrame:
    """``cell``, t, p_single, p_one_sided, p_rw from t of each cell and of each replicate (``cell``, rep, t), by the step-down of the largest statistic.

    Cells in order of |t|: a cell's p counts the replicates whose largest |t| among it and all smaller cells reaches its own; p never falls
    on the way down. Replicates that lack a cell count for the others.
    """
    order = W.orderBy(F.desc(F.round(F.abs("t"), 12)), *cell)  # a row for each cell
    ranked = observed.select(*cell, F.col("t").alias("t_obs"), "t").withColumn("rank", F.row_number().over(order)).drop("t")
    total = drawn.select("rep").distinct().agg(F.count("*").alias("reps"))
    rows = drawn.join(ranked, list(cell))
    least = W.partitionBy("rep").orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("most", F.max(F.abs("t")).over(least))
    counted = rows.groupBy(*cell, "t_obs", "rank").agg(F.count_if(F.col("most") >= F.abs("t_obs")).alias("k"), F.count_if(F.abs("t") >= F.abs("t_obs")).alias("k1"), F.count_if(F.col("t") >= F.col("t_obs")).alias("k2"))
    p = lambda c: (1 + F.col(c)) / (1 + F.col("reps"))
    raw = counted.crossJoin(F.broadcast(total)).select(*cell, F.col("t_obs").alias("t"), "rank", p("k").alias("p"), p("k1").alias("p_single"), p("k2").alias("p_one_sided"))  # one row
    return raw.withColumn("p_rw", F.max("p").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))).drop("p", "rank")


def sharpe_romano_wolf(returns_: DataFrame, bench: str, replicates: int = 4999, seed: int = 7) -> DataFrame:
    """x_name, t, p_single, p_one_sided, p_rw of every series' Sharpe gap to ``bench``; the same draws drive all series, on their common months."""
    names = returns_.select(F.col("series").alias("x_name")).distinct().filter(F.col("x_name") != bench).withColumn("y_name", F.lit(bench))
    rows = pair_rows(returns_, names)
    gaps = sharpe_gaps(rows)
    drawn = sharpe_draws(rows, gaps, replicates, (seed,))
    return step_down(gaps.filter("se IS NOT NULL").select("x_name", (F.col("delta") / F.col("se")).alias("t")), drawn.select("x_name", "rep", "t"), ("x_name",))


def expected_best(sharpes: DataFrame) -> DataFrame:
    """sr0: the Sharpe ratio that the best of N series without skill is expected to show, from the spread of sr; null for fewer than two."""
    n, var = sharpes.agg(F.count("sr"), F.var_samp("sr")).first()  # two numbers
    sr0 = None
    if n and n >= 2:
        ppf = NormalDist().inv_cdf
        sr0 = math.sqrt(var) * ((1 - EULER) * ppf(1 - 1 / n) + EULER * ppf(1 - 1 / (n * math.e)))
    return sharpes.sparkSession.createDataFrame([(sr0,)], "sr0 double")


def deflated_sharpe(returns_: DataFrame) -> DataFrame:
    """series, months, sr, sr0, dsr: the probability that a series' Sharpe ratio exceeds the best that luck would show among all of them."""
    known = psr(returns_).select("series", "months", "sr")
    sr0 = expected_best(known).first()["sr0"]
    if sr0 is None:
        return known.withColumns({"sr0": F.lit(None).cast("double"), "dsr": F.lit(None).cast("double")})
    return psr(returns_, sr0).withColumnRenamed("psr", "dsr").withColumn("sr0", F.lit(sr0))


def inference_table(returns_: DataFrame, benches: tuple[str, ...], replicates: int = 4999) -> DataFrame:
    """series, sharpe_ann, dsr, bench, delta_ann, p_boot, p_hac: each series against each benchmark but itself."""
    dsr = deflated_sharpe(returns_).select("series", (F.col("sr") * F.sqrt(F.lit(12.0))).alias("sharpe_ann"), "dsr")
    pairs = returns_.select(F.col("series").alias("x_name")).distinct().withColumn("y_name", F.explode(F.array(*(F.lit(b) for b in benches)))).filter("x_name <> y_name")
    tests = sharpe_diff_test(returns_, pairs, replicates)
    return dsr.join(tests.select(F.col("x_name").alias("series"), F.col("y_name").alias("bench"), (F.col("delta") * F.sqrt(F.lit(12.0))).alias("delta_ann"), "p_boot", "p_hac"), "series")


def race_table(stats: DataFrame, excess: DataFrame, bench: str, replicates: int = 4999) -> DataFrame:
    """Growth, volatility and drawdown (``stats``, by series) beside the deflated Sharpe ratio and the gap to ``bench`` of returns in excess of cash."""
    table = inference_table(excess, (bench,), replicates).drop("bench", "p_hac")
    alone = deflated_sharpe(excess).select("series", (F.col("sr") * F.sqrt(F.lit(12.0))).alias("sharpe_ann"), "dsr")
    return stats.select("series", "cagr", "ann_vol", "max_drawdown").join(alone, "series").join(table.drop("sharpe_ann", "dsr"), "series", "left")


def pbo_cscv(returns_: DataFrame, blocks: int = 16) -> DataFrame:
    """n_trials, n_combos, pbo: how often the best series of one half of the blocks is no better than the median of the other half.

    Months that all series have are cut into ``blocks`` runs, the first ones a month longer where they don't divide; every choice of
    half of them is tried. pbo is null for fewer than two series or two months a block. Ties go to the first series by name.
    """
    w = W.partitionBy("series").orderBy("month")
    rows = complete_months(returns_, "ret").withColumn("pos", F.row_number().over(w) - 1).withColumn("t", F.count("*").over(W.partitionBy("series")))
    size, longer = F.floor(F.col("t") / blocks), F.col("t") % blocks
    cut = longer * (size + 1)
    block = F.when(F.col("pos") < cut, F.floor(F.col("pos") / (size + 1))).otherwise(longer + F.floor((F.col("pos") - cut) / F.greatest(size, F.lit(1))))
    sums = rows.filter(F.col("t") >= 2 * blocks).groupBy("series", block.cast("int").alias("block")).agg(F.count("*").alias("n"), F.sum("ret").alias("s1"), F.sum(F.col("ret") * F.col("ret")).alias("s2"))
    splits = returns_.sparkSession.range(1 << blocks).filter(F.bit_count("id") == blocks // 2)  # as many as blocks allow, whatever the data
    packed = sums.groupBy("series").agg(F.collect_list(F.struct("block", "n", "s1", "s2")).alias("sums"))
    halves = packed.repartition("series").crossJoin(F.broadcast(splits))

    def sharpe(side: int) -> Column:
        inside = lambda s: F.getbit("id", s["block"]) == side
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))
        add = lambda acc, s: F.when(inside(s), F.struct((acc["n"] + s["n"]).alias("n"), (acc["s1"] + s["s1"]).alias("s1"), (acc["s2"] + s["s2"]).alias("s2"))).otherwise(acc)
        t = F.aggregate("sums", zero, add)
        return F.struct(t["n"].alias("n"), t["s1"].alias("s1"), t["s2"].alias("s2"))

    ratio = lambda c: F.col(f"{c}.s1") / F.col(f"{c}.n") / F.sqrt(F.nullif((F.col(f"{c}.s2") - F.col(f"{c}.s1") * F.col(f"{c}.s1") / F.col(f"{c}.n")) / (F.col(f"{c}.n") - 1), F.lit(0.0)))
    folded = halves.select("id", "series", sharpe(1).alias("a"), sharpe(0).alias("b"))
    scored = folded.select("id", "series", ratio("a").alias("own"), ratio("b").alias("other"))
    w = W.partitionBy("id")
    best = F.row_number().over(w.orderBy(F.desc(F.round("own", 12)), "series"))
    star = scored.withColumn("b", best).withColumn("star", F.max(F.when(F.col("b") == 1, F.col("other"))).over(w))
    omega = star.groupBy("id").agg((F.count_if(F.round("other", 12) < F.round("star", 12)) / F.nullif(F.count("*") - 1, F.lit(0))).alias("omega"), F.count("*").alias("k"))
    return omega.agg(F.coalesce(F.max("k"), F.lit(0)).alias("n_trials"), F.count("*").alias("n_combos"), F.avg((F.col("omega") <= 0.5).cast("double")).alias("pbo"))


def average_ranks(returns_: DataFrame, block: int = 12, metric: str = "sharpe") -> DataFrame:
    """series, avg_rank, n_blocks, n_series over the blocks' ranks."""
    ranks = block_ranks(returns_, block, metric)
    n = ranks.groupBy("series").agg(F.avg("rank").alias("avg_rank"), F.count("*").alias("n_blocks"))
    return n.crossJoin(F.broadcast(ranks.agg(F.countDistinct("series").alias("n_series"))))  # one row


def _gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by its series below a + 1 and by Lentz' fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 2000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for k in range(1, 2000):
        an, b = -k * (k - a), b + 2
        d, c = 1 / (an * d + b), b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def _f_tail(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution: the density of the beta variable integrated on a fine grid of angles."""
    if not np.isfinite(f):
        return 0.0
    a, b = d1 / 2, d2 / 2
    z = (np.arange(40_000) + 0.5) / 40_000 * math.pi / 2
    density = np.sin(z) ** (2 * a - 1) * np.cos(z) ** (2 * b - 1)
    return float(density[np.sin(z) ** 2 > d1 * f / (d1 * f + d2)].sum() / density.sum())


def _range_point(p: float, k: int) -> float:
    """The p point of the range of k standard normal variables."""
    z = np.linspace(-8, 8, 4001)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.concatenate([[0.0], np.cumsum((phi[1:] + phi[:-1]) / 2)]) * (z[1] - z[0])
    low, high = 0.0, 20.0
    for _ in range(60):
        q = (low + high) / 2
        share = k * np.sum(phi * (cdf - np.interp(z - q, z, cdf, left=0.0)) ** (k - 1)) * (z[1] - z[0])
        low, high = (q, high) if share < p else (low, q)
    return (low + high) / 2


def friedman_nemenyi(returns_: DataFrame, block: int = 12, metric: str = "sharpe", alpha: float = 0.05) -> DataFrame:
    """series, avg_rank, gap_to_best, differs_from_best, chi2, p_chi2, f, p_f, critical_difference, n_blocks, n_series.

    No rows for fewer than three blocks or series. The tails are worked out once, on the table of average ranks.
    """
    schema = "series string, avg_rank double, gap_to_best double, differs_from_best boolean, chi2 double, p_chi2 double, f double, p_f double, critical_difference double, n_blocks bigint, n_series bigint"

    def test(_: tuple, t: pd.DataFrame) -> pd.DataFrame:
        n, k = int(t["n_blocks"].iloc[0]), len(t)
        if n < 3 or k < 3:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        chi = 12 * n / (k * (k + 1)) * ((t["avg_rank"] ** 2).sum() - k * (k + 1) ** 2 / 4)
        rest = n * (k - 1) - chi
        f = (n - 1) * chi / rest if rest > 0 else math.inf
        critical = _range_point(1 - alpha, k) / math.sqrt(2) * math.sqrt(k * (k + 1) / (6 * n))
        gap = t["avg_rank"] - t["avg_rank"].min()
        return pd.DataFrame(
            {
                "series": t["series"], "avg_rank": t["avg_rank"], "gap_to_best": gap, "differs_from_best": gap > critical, "chi2": chi, "p_chi2": _gamma_tail((k - 1) / 2, chi / 2),
                "f": f, "p_f": _f_tail(f, k - 1, (k - 1) * (n - 1)), "critical_difference": critical, "n_blocks": n, "n_series": k,
            }
        )

    return average_ranks(returns_, block, metric).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(test, schema)  # a row for each series


def scramble_states(states: DataFrame, mode: str, replicates: int, seed: int = 12345) -> DataFrame:
    """rep, month and all columns of states but the month, given to other months: turned round by a random step (never 0), or shuffled.

    Whole rows travel; a turn keeps the lengths of the states' spells, a shuffle does not.
    """
    columns = [c for c in states.columns if c != "month"]
    w = W.orderBy("month")  # a row for each month
    placed = states.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    rows = placed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    if mode == "circular":
        to = F.pmod(F.col("pos") + 1 + F.pmod(draw(F.lit(seed), F.col("rep")), F.col("n") - 1), F.col("n"))
    elif mode == "iid":
        to = F.row_number().over(W.partitionBy("rep").orderBy(draw(F.lit(seed), F.col("rep"), F.col("pos")), "pos")) - 1
    else:
        raise ValueError(f"unknown mode {mode!r}: circular or iid")
    moved = rows.select("rep", to.cast("int").alias("pos"), *columns)
    return moved.join(placed.select("pos", "month"), "pos").select("rep", "month", *columns)


def realised_floor(returns_: DataFrame, states: DataFrame, by: tuple[str, ...], least: int = 3) -> DataFrame:
    """``by``, floor: the worst mean return over states, of those with ``least`` months."""
    means = returns_.join(states.select("month", "state"), "month").groupBy(*by, "state").agg(F.avg("ret").alias("m"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return means.groupBy(*by).agg(F.min("m").alias("floor"))


def permutation_verdict(arms: DataFrame) -> DataFrame:
    """rule, metric, mode: the real value beside the mean, spread and 5 and 95 % points of the placebo ones, and p = (1 + at least as good) / (1 + n).

    ``arms`` has arm (real or placebo), mode (of placebos), rule, metric, value.
    """
    real = arms.filter("arm = 'real' AND value IS NOT NULL").select("rule", "metric", F.col("value").alias("real"))
    null = arms.filter("arm = 'placebo' AND value IS NOT NULL").join(real, ["rule", "metric"])
    v = F.col("value")
    return null.groupBy("rule", "metric", "mode", "real").agg(
        F.avg(v).alias("null_mean"), F.stddev_samp(v).alias("null_sd"), F.percentile(v, F.lit(0.05)).alias("null_p05"), F.percentile(v, F.lit(0.95)).alias("null_p95"), F.count("*").alias("n"),
        ((1 + F.count_if(F.round(v, 12) >= F.round(F.col("real"), 12))) / (1 + F.count("*"))).alias("p"),
    )


def paired_ab(arms: DataFrame) -> DataFrame:
    """rule, metric: the real gap between the switch on and off, the placebos' mean, spread and share above 0, and p of the real one.

    ``arms`` has arm, rep, switch (on or off), rule, metric, value; a replicate without one of the two is left out.
    """
    wide = arms.groupBy("arm", "rep", "rule", "metric").pivot("switch", ["on", "off"]).agg(F.first("value")).withColumn("d", F.col("on") - F.col("off")).filter("d IS NOT NULL")
    real = wide.filter("arm = 'real'").select("rule", "metric", F.col("d").alias("delta_real"))
    null = wide.filter("arm = 'placebo'").join(real, ["rule", "metric"])
    return null.groupBy("rule", "metric", "delta_real").agg(
        F.avg("d").alias("null_mean"), F.stddev_samp("d").alias("null_sd"), F.avg((F.round("d", 12) > 0).cast("double")).alias("share_positive"), F.count("*").alias("n"),
        ((1 + F.count_if(F.round("d", 12) >= F.round("delta_real", 12))) / (1 + F.count("*"))).alias("p"),
    )
