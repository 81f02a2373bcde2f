"""Performance, correlation and regime statistics of a long panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normal import norm_cdf
from .panel import complete_months, drawdown, returns

REFERENCE = "Reference"


def annualised(total: Column, months: Column) -> Column:
    """Growth factor over so many months as a yearly rate."""
    return F.pow(total, 12.0 / F.nullif(months, F.lit(0))) - 1


def _volatility(ret: str = "ret") -> Column:
    return F.stddev_samp(ret) * F.sqrt(F.lit(12.0))


def perf_stats(panel: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """months, start, end, cagr, ann_vol, sharpe (risk-free rate 0) and max_drawdown of each series.

    Volatility is the sample one; Sharpe is twelve mean returns over it, null where it is 0.
    """
    rows = drawdown(returns(panel.filter(F.col("level").isNotNull()), by), by)
    total = F.max_by("level", "month") / F.min_by("level", "month")
    n = F.count("ret")
    return rows.groupBy(*by, "series").agg(
        n.alias("months"),
        F.min("month").alias("start"),
        F.max("month").alias("end"),
        annualised(total, n).alias("cagr"),
        _volatility().alias("ann_vol"),
        (F.avg("ret") * 12 / F.nullif(_volatility(), F.lit(0.0))).alias("sharpe"),
        F.min("dd").alias("max_drawdown"),
    )


def pair_with_reference(panel: DataFrame, value: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    """Each series beside its own region's Reference, on the months that both have; ``ref`` is its value."""
    keys = [*by, "region", "month"]
    ref = panel.filter((F.col("factor") == REFERENCE) & F.col(value).isNotNull()).select(*keys, F.col(value).alias("ref"))
    return panel.filter((F.col("factor") != REFERENCE) & F.col(value).isNotNull()).join(ref, keys)


def factor_vs_reference(panel: DataFrame) -> DataFrame:
    """Both growth rates, the excess, the monthly hit rate and the start of the overlap, by region and factor."""
    pair = pair_with_reference(panel, "level")
    w = W.partitionBy("series").orderBy("month")
    moved = pair.withColumn("r", F.col("level") / F.lag("level").over(w) - 1).withColumn("rr", F.col("ref") / F.lag("ref").over(w) - 1)
    n = F.count("*") - 1
    rate = lambda c: annualised(F.max_by(c, "month") / F.min_by(c, "month"), n)
    stats = moved.groupBy("region", "factor").agg(
        rate("ref").alias("ref_cagr"), rate("level").alias("factor_cagr"), F.avg((F.col("r") > F.col("rr")).cast("double")).alias("hit_rate"), F.min("month").alias("overlap_start")
    )
    return stats.withColumn("excess_cagr", F.col("factor_cagr") - F.col("ref_cagr"))


def join_regimes(panel: DataFrame, regimes: DataFrame) -> DataFrame:
    """The panel once for each regime (regime, start, end) that holds the month, ends included; regimes may overlap.

    Regimes are written out by month, so that the range join is an equi-join of any size.
    """
    months = F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))
    spread = regimes.withColumn("month", F.explode(F.transform(months, F.last_day))).filter(F.col("month").between(F.col("start"), F.col("end")))
    return panel.join(spread, "month")


def regime_performance(panel: DataFrame, regimes: DataFrame) -> DataFrame:
    """months, total and yearly return, volatility and excess over the Reference, by regime and series.

    Returns start from the first level inside the regime; series of fewer than two rows drop out.
    """
    rows = join_regimes(panel.filter(F.col("level").isNotNull()), regimes)
    w = W.partitionBy("regime", "series").orderBy("month")
    moved = rows.withColumn("ret", F.col("level") / F.lag("level").over(w) - 1)
    total, n = F.max_by("level", "month") / F.min_by("level", "month"), F.count("ret")
    stats = (
        moved.groupBy("regime", "region", "factor", "series")
        .agg(n.alias("months"), (total - 1).alias("total_return"), annualised(total, n).alias("annualised"), _volatility().alias("ann_vol"))
        .filter("months >= 1")
    )
    refs = stats.filter(F.col("factor") == REFERENCE).select("regime", "region", F.col("annualised").alias("_ref"))
    excess = F.when(F.col("factor") != REFERENCE, F.col("annualised") - F.col("_ref"))
    return stats.join(refs, ["regime", "region"], "left").withColumn("excess_vs_ref", excess).drop("_ref")


def regime_leaders(perf: DataFrame) -> DataFrame:
    """Best and worst series of each regime by yearly return; ties go to the name."""
    best = F.max_by("series", F.struct("annualised", "series"))
    worst = F.min_by("series", F.struct("annualised", "series"))
    return perf.groupBy("regime").agg(best.alias("best"), worst.alias("worst"), F.max("annualised").alias("best_return"), F.min("annualised").alias("worst_return"))


def excess_by_factor(perf: DataFrame) -> DataFrame:
    return perf.filter(F.col("excess_vs_ref").isNotNull()).groupBy("regime", "factor").agg(F.avg("excess_vs_ref").alias("mean_excess"), F.count("*").alias("n_regions"))


#: Series of a chunk: a cell of two chunks makes some four thousand pairs in one task.
CHUNK = 64


def series_arrays(panel: DataFrame, value: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, series, x, first, n_series: each series' values as one array over the months of its group (null where it has none), the number of its first month, and the group's series.

    Months are numbered 12 * year + month; a series' row has as many entries as the calendar has months.
    """
    number = F.year("month") * 12 + F.month("month")
    known = panel.filter(F.col(value).isNotNull()).select(*by, "series", number.alias("m"), F.col(value).alias("v"))
    packed = known.groupBy(*by, "series").agg(F.array_sort(F.collect_list(F.struct("m", "v"))).alias("e"))
    group = packed.groupBy(*by).agg(F.min(F.col("e")[0]["m"]).alias("first"), F.max(F.element_at("e", -1)["m"]).alias("last"), F.count("*").alias("n_series"))
    rows = packed.join(group, list(by)) if by else packed.crossJoin(F.broadcast(group))  # one row
    return rows.select(*by, "series", dense("e", F.col("first"), F.col("last")).alias("x"), "first", "n_series")


def dense(entries: str, first: Column, last: Column) -> Column:
    """An array over the numbers first to last from sorted entries (m, v), null where there is none."""
    none = F.lit(None).cast("double")
    before = F.concat(F.array(first - 1), F.transform(F.slice(entries, 1, F.size(entries) - 1), lambda e: e["m"]))
    filled = F.flatten(F.zip_with(entries, before, lambda e, p: F.concat(F.array_repeat(none, e["m"] - p - 1), F.array(e["v"]))))
    return F.concat(filled, F.array_repeat(none, last - F.element_at(entries, -1)["m"]))


def pair_arrays(panel: DataFrame, value: str = "ret", by: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """``by``, i, j, x, y, first: all unordered pairs of series (i < j) with both arrays of values over the group's months.

    Series are dealt into chunks; a task makes the pairs of two chunks from whole series, so the shuffle carries each series once for each
    chunk and no pair is put together after it. The number of chunks follows the number of series.
    """
    rows = series_arrays(panel, value, by).withColumn("_c", F.ceil(F.col("n_series") / chunk).cast("int")).withColumn("_k", F.pmod(F.hash("series"), F.col("_c")))
    left = rows.select(*by, "first", F.col("series").alias("p"), F.col("x").alias("px"), F.col("_k").alias("_a"), F.explode(F.sequence(F.col("_k"), F.col("_c") - 1)).alias("_b"))
    right = rows.select(*by, F.col("series").alias("q"), F.col("x").alias("qx"), F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("_a"), F.col("_k").alias("_b"))
    pairs = left.join(right, [*by, "_a", "_b"]).filter("_a < _b OR p < q")
    ahead = F.col("p") < F.col("q")
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    return pairs.select(*by, pick("p", "q").alias("i"), pick("q", "p").alias("j"), pick("px", "qx").alias("x"), pick("qx", "px").alias("y"), "first")


def pair_self_join(panel: DataFrame, value: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    """All unordered pairs of series (i < j) on the same month, values x and y: a row for each pair and month."""
    both = pair_arrays(panel, value, by).select(*by, "i", "j", "first", F.posexplode(F.arrays_zip("x", "y")).alias("at", "v"))
    number = F.col("first") + F.col("at") - 1
    month = F.last_day(F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1)))
    return both.filter("v.x IS NOT NULL AND v.y IS NOT NULL").select(*by, month.alias("month"), "i", "j", "v.x", "v.y")


def sums_over(both: Column, sums: dict[str, Callable[[Column, Column], Column]]) -> Column:
    """A struct of n and of the sums of functions of x and y over an array of pairs x, y."""
    zero = F.struct(F.lit(0).alias("n"), *(F.lit(0.0).alias(c) for c in sums))
    return F.aggregate(both, zero, lambda acc, p: F.struct((acc["n"] + 1).alias("n"), *((acc[c] + f(p["x"], p["y"])).alias(c) for c, f in sums.items())))


def known_pairs(x: str = "x", y: str = "y") -> Column:
    """The months of two arrays where both have a value, as an array of x, y."""
    return F.filter(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def correlated(df: DataFrame, both: str) -> DataFrame:
    """``df`` with n and corr of an array of pairs x, y; corr is null without variation."""
    means = df.withColumn("_s", sums_over(F.col(both), {"x": lambda x, y: x, "y": lambda x, y: y}))
    mx, my = F.col("_s.x") / F.col("_s.n"), F.col("_s.y") / F.col("_s.n")
    moments = means.withColumn("_m", sums_over(F.col(both), {"xy": lambda x, y: (x - mx) * (y - my), "xx": lambda x, y: (x - mx) * (x - mx), "yy": lambda x, y: (y - my) * (y - my)}))
    corr = F.col("_m.xy") / F.nullif(F.sqrt(F.col("_m.xx") * F.col("_m.yy")), F.lit(0.0))
    return moments.withColumn("corr", corr).withColumn("n", F.col("_s.n").cast("long")).drop("_s", "_m")


def corr_pairs(panel: DataFrame, by: tuple[str, ...] = (), complete: bool = True) -> DataFrame:
    """Correlation of each pair i < j, on complete months (or on those that the pair has)."""
    rows = complete_months(panel, "ret", by) if complete else panel
    pairs = pair_arrays(rows, by=by).withColumn("both", known_pairs()).filter(F.size("both") > 0)
    return correlated(pairs, "both").select(*by, "i", "j", "corr", "n")


def corr_matrix(pairs: DataFrame, by: tuple[str, ...] = (), names: DataFrame | None = None) -> DataFrame:
    """The whole matrix in long form, with the diagonal; ``names`` (``by``, series) are the pairs' series, found from the pairs if not given."""
    cell = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"), "corr")
    both = pairs.select(*by, F.explode(F.array(cell("i", "j"), cell("j", "i"))).alias("c")).select(*by, "c.i", "c.j", "c.corr")
    own = both.select(*by, F.col("i").alias("series")).distinct() if names is None else names.select(*by, "series").distinct()
    return both.unionByName(own.select(*by, F.col("series").alias("i"), F.col("series").alias("j"), F.lit(1.0).alias("corr")))


def corr_by_regime(panel: DataFrame, regimes: DataFrame, least: int = 4) -> DataFrame:
    """Pairs' correlations inside each regime, on the regime's complete months, where there are ``least`` at least."""
    rows = join_regimes(panel.filter(F.col("ret").isNotNull()), regimes)
    return corr_pairs(rows, by=("regime",)).filter(F.col("n") >= least)


def avg_pairwise_corr(pairs: DataFrame) -> DataFrame:
    """Mean and least correlation over all pairs and by how the two series are related."""
    region, factor = (lambda c: F.split(c, r" \| ")[0]), (lambda c: F.split(c, r" \| ")[1])
    relation = (
        F.when((factor("i") == REFERENCE) & (factor("j") == REFERENCE), "references")
        .when(region("i") == region("j"), "same region")
        .when(factor("i") == factor("j"), "same factor")
        .otherwise("other")
    )
    named = pairs.withColumn("relation", F.explode(F.array(F.lit("all"), relation)))
    return named.groupBy("relation").agg(F.count("*").alias("n_pairs"), F.avg("corr").alias("mean_corr"), F.min("corr").alias("min_corr"))


def rolling_avg_pairwise_corr(panel: DataFrame, window: int = 36) -> DataFrame:
    """Mean correlation of all pairs of References in each trailing window of complete months."""
    refs = complete_months(panel.filter((F.col("factor") == REFERENCE) & F.col("ret").isNotNull()), "ret")
    pairs = pair_arrays(refs).withColumn("both", known_pairs())
    ends = pairs.filter(F.size("both") >= window).select("i", "j", F.explode(F.sequence(F.lit(window), F.size("both"))).alias("end"), "both")
    rolled = correlated(ends.withColumn("part", F.slice("both", F.col("end") - window + 1, F.lit(window))), "part")
    means = rolled.groupBy("end").agg(F.avg("corr").alias("avg_corr"))
    order = refs.select("month").distinct().withColumn("end", F.row_number().over(W.orderBy("month")))  # a row for each month
    return means.join(order, "end").select("month", "avg_corr")


def cube_summary(panel: DataFrame) -> DataFrame:
    """Mean return and count over region, factor, both and all, in one pass; null is a total."""
    return panel.filter(F.col("ret").isNotNull()).cube("region", "factor").agg(F.avg("ret").alias("mean_ret"), F.count("*").alias("n"))


def sleeve_table(panel: DataFrame, market: DataFrame, rf: float = 0.0) -> DataFrame:
    """Excess mean, volatility, Sharpe, Sortino, skew, excess kurtosis, worst month, drawdown and beta.

    ``market`` (month, mkt) is the market's return. Skew and kurtosis are the population's; the
    drawdown is of the compounded returns, whose first month is not measured against a base.
    """
    path = W.partitionBy("series").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    rows = (
        panel.filter(F.col("ret").isNotNull())
        .join(market, "month")
        .withColumn("e", F.col("ret") - rf)
        .withColumn("lvl", F.exp(F.sum(F.log1p("ret")).over(path)))
        .withColumn("dd", F.col("lvl") / F.max("lvl").over(path) - 1)
    )
    downside = F.sqrt(F.avg(F.pow(F.least("e", F.lit(0.0)), 2)))
    return rows.groupBy("series").agg(
        F.count("*").alias("months"),
        (F.avg("e") * 12).alias("mean_excess"),
        _volatility().alias("ann_vol"),
        (F.avg("e") / F.nullif(F.stddev_samp("e"), F.lit(0.0)) * F.sqrt(F.lit(12.0))).alias("sharpe"),
        (F.avg("e") / F.nullif(downside, F.lit(0.0)) * F.sqrt(F.lit(12.0))).alias("sortino"),
        F.skewness("ret").alias("skew"),
        F.kurtosis("ret").alias("exkurt"),
        F.min("ret").alias("worst_month"),
        F.min("dd").alias("max_drawdown"),
        F.regr_slope("e", "mkt").alias("beta"),
    )


def psr(returns_: DataFrame, sr0: float = 0.0) -> DataFrame:
    """Monthly Sharpe (population volatility) and the probability that the true one exceeds ``sr0``.

    Skew and kurtosis widen the error; null for fewer than three months or where the error has no root.
    """
    known = returns_.filter(F.col("ret").isNotNull())
    sr = F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0))
    stats = known.groupBy("series").agg(F.count("*").alias("months"), sr.alias("sr"), F.skewness("ret").alias("g3"), F.kurtosis("ret").alias("k"))
    spread = 1 - F.col("g3") * F.col("sr") + (F.col("k") + 2) / 4 * F.col("sr") * F.col("sr")
    z = F.when((F.col("months") >= 3) & (spread > 0), (F.col("sr") - sr0) * F.sqrt(F.col("months") - 1) / F.sqrt(spread))
    return stats.select("series", "months", "sr", norm_cdf(z).alias("psr"))


def active_stats(returns_: DataFrame, bench: DataFrame) -> DataFrame:
    """Active return, tracking error and information ratio against bench (month, bench)."""
    rows = returns_.filter(F.col("ret").isNotNull()).join(bench, "month").withColumn("a", F.col("ret") - F.col("bench"))
    return rows.groupBy("series").agg(
        (F.avg("a") * 12).alias("active"), _volatility("a").alias("tracking_error"), (F.avg("a") * F.sqrt(F.lit(12.0)) / F.nullif(F.stddev_samp("a"), F.lit(0.0))).alias("information_ratio")
    )


def rolling_beats(returns_: DataFrame, bench: DataFrame, window: int = 36) -> DataFrame:
    """Share of full windows in which mean over volatility beats the benchmark's, and in which the summed log return does."""
    w = W.partitionBy("series").orderBy("month").rowsBetween(1 - window, 0)
    ratio = lambda c: F.avg(c).over(w) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))
    logs = lambda c: F.sum(F.log1p(c)).over(w)
    rows = returns_.filter(F.col("ret").isNotNull()).join(bench, "month")
    rolled = rows.select("series", F.count("*").over(w).alias("k"), (ratio("ret") > ratio("bench")).alias("beats"), (logs("ret") > logs("bench")).alias("ahead"))
    full = rolled.filter(F.col("k") == window)
    return full.groupBy("series").agg(F.count("*").alias("n_windows"), F.avg(F.col("beats").cast("double")).alias("beats"), F.avg(F.col("ahead").cast("double")).alias("ahead"))


def half_split_sharpe(returns_: DataFrame) -> DataFrame:
    """Sharpe of the first and of the second half of each series' months."""
    place, n = F.row_number().over(W.partitionBy("series").orderBy("month")), F.count("*").over(W.partitionBy("series"))
    rows = returns_.filter(F.col("ret").isNotNull()).withColumn("first", place <= F.floor(n / 2))
    ratio = lambda keep: F.avg(F.when(keep, F.col("ret"))) / F.nullif(F.stddev_samp(F.when(keep, F.col("ret"))), F.lit(0.0)) * F.sqrt(F.lit(12.0))
    return rows.groupBy("series").agg(ratio(F.col("first")).alias("first_half"), ratio(~F.col("first")).alias("second_half"))


def _with_history(returns_: DataFrame, history: DataFrame | None, cash: DataFrame | None) -> DataFrame:
    """series, month, ret, _own (not of the history) and cash: what the uninvested part earns, 0 where it is unknown."""
    rows = returns_.filter(F.col("ret").isNotNull()).withColumn("_own", F.lit(True))
    if history is not None:
        rows = rows.unionByName(history.filter(F.col("ret").isNotNull()).select("series", "month", "ret", F.lit(False).alias("_own")), allowMissingColumns=True)
    if cash is None:
        return rows.withColumn("cash", F.lit(0.0))
    return rows.join(cash.select("month", F.col("cash").alias("_cash")), "month", "left").withColumn("cash", F.coalesce("_cash", F.lit(0.0))).drop("_cash")


def _managed(rows: DataFrame) -> DataFrame:
    """The own months of ``rows`` (exposure) with the managed return and the turnover of the exposure's changes."""
    w = W.partitionBy("series").orderBy("month")
    own = rows.filter("_own").withColumn("managed", F.col("exposure") * F.col("ret") + (1 - F.col("exposure")) * F.col("cash"))
    return own.withColumn("turnover", F.coalesce(F.abs(F.col("exposure") - F.lag("exposure").over(w)), F.lit(0.0))).drop("_own", "cash")


def vol_target(returns_: DataFrame, target: float = 0.10, window: int = 12, most: float = 1.0, cash: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Exposure min(most, target over trailing volatility), the managed return and its turnover.

    The volatility is that of the ``window`` months before; with fewer than max(3, window // 2) of
    them, or no movement, the exposure is full. The rest earns cash (month, cash), nothing where that is
    unknown; ``history`` (series, month, ret) before the first month only feeds the volatility.
    """
    before = W.partitionBy("series").orderBy("month").rowsBetween(-window, -1)
    vol = F.stddev_samp("ret").over(before) * F.sqrt(F.lit(12.0))
    known = F.count("ret").over(before) >= max(3, window // 2)
    rows = _with_history(returns_, history, cash)
    return _managed(rows.withColumn("exposure", F.when(known & (vol > 0), F.least(F.lit(most), target / vol)).otherwise(F.lit(most))))


def trend_overlay(
    returns_: DataFrame, mode: str = "sma", window: int | None = None, threshold: float | DataFrame = 0.0, cash: DataFrame | None = None, history: DataFrame | None = None
) -> DataFrame:
    """Invested while last month's signal holds, else in cash (month, cash); invested until there is a signal.

    ``sma``: the compounded level is above its mean of ``window`` (10) months. ``absmom``: the return of ``window`` (12)
    months is above ``threshold``, a number or a table (month, threshold); where it is unknown there is no signal.
    """
    if mode not in ("sma", "absmom"):
        raise ValueError(f"unknown trend mode {mode!r}: sma or absmom")
    n = window or (10 if mode == "sma" else 12)
    w = W.partitionBy("series").orderBy("month")
    trailing = w.rowsBetween(1 - n, 0)
    rows = _with_history(returns_, history, cash)
    if mode == "sma":
        rows = rows.withColumn("_l", F.exp(F.sum(F.log1p("ret")).over(w.rowsBetween(W.unboundedPreceding, 0))))
        above = F.col("_l") > F.avg("_l").over(trailing)
    else:
        given = isinstance(threshold, DataFrame)
        rows = rows.join(threshold.select("month", F.col("threshold").alias("_l")), "month", "left") if given else rows.withColumn("_l", F.lit(float(threshold)))
        above = F.exp(F.sum(F.log1p("ret")).over(trailing)) - 1 > F.col("_l")
    signal = F.when(F.count("*").over(trailing) == n, above.cast("double"))
    return _managed(rows.withColumn("_s", signal).withColumn("exposure", F.coalesce(F.lag("_s").over(w), F.lit(1.0))).drop("_s", "_l"))


def tbill_gate(returns_: DataFrame, cash: DataFrame, window: int = 12, history: DataFrame | None = None) -> DataFrame:
    """The overlay whose threshold is what cash (month, cash) earned over the same ``window`` months; unknown cash earned nothing."""
    months = returns_.select("month").distinct() if history is None else returns_.select("month").unionAll(history.select("month")).distinct()
    w = W.orderBy("month").rowsBetween(1 - window, 0)  # one row for each month
    known = months.join(cash, "month", "left").withColumn("cash", F.coalesce("cash", F.lit(0.0)))
    earned = F.when(F.count("*").over(w) == window, F.exp(F.sum(F.log1p("cash")).over(w)) - 1)
    return trend_overlay(returns_, "absmom", window, known.select("month", earned.alias("threshold")), cash, history)


def momentum_score(returns_: DataFrame, lookback: int = 12, skip: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Compounded return over ``lookback`` months, the last ``skip`` left out, known at the end of each month."""
    w = W.partitionBy(*by, "series").orderBy("month").rowsBetween(1 - lookback - skip, -skip)
    score = F.when(F.count("ret").over(w) == lookback, F.exp(F.sum(F.log1p("ret")).over(w)) - 1)
    return returns_.filter(F.col("ret").isNotNull()).withColumn("score", score)


def momentum_weights(returns_: DataFrame, k: int = 6, lookback: int = 12, skip: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal weights on the ``k`` best scores of each month; ties go to the first series by name."""
    scored = momentum_score(returns_, lookback, skip, by).filter(F.col("score").isNotNull())
    place = F.row_number().over(W.partitionBy(*by, "month").orderBy(F.desc("score"), "series"))
    top = scored.withColumn("_r", place).filter(F.col("_r") <= k)
    return top.withColumn("w", 1.0 / F.count("*").over(W.partitionBy(*by, "month"))).select(*by, "month", "series", "score", "w")


def average_rank(value: Column, over: list[str], *, best_first: bool = True) -> Column:
    """Rank within a group, ties sharing the mean of their places."""
    w = W.partitionBy(*over)
    ties = F.count("*").over(W.partitionBy(*over, value))
    return F.rank().over(w.orderBy(value.desc() if best_first else value.asc())) + (ties - 1) / 2.0


def block_ranks(returns_: DataFrame, block: int = 12, metric: str = "sharpe") -> DataFrame:
    """Sharpe or compounded return of each series in each block of complete months and its average-tie rank, best 1.

    A last block of fewer than max(2, block // 2) months is left out, and a block in which a series has no score.
    """
    score = {"sharpe": F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)), "return": F.exp(F.sum(F.log1p("ret"))) - 1}
    if metric not in score:
        raise ValueError(f"unknown metric {metric!r}: sharpe or return")
    rows = complete_months(returns_, "ret")
    place = F.row_number().over(W.partitionBy("series").orderBy("month"))
    scores = rows.withColumn("block", F.floor((place - 1) / block)).groupBy("series", "block").agg(score[metric].alias("score"), F.count("*").alias("n")).filter(F.col("n") >= max(2, block // 2))
    whole = scores.withColumn("_k", F.count("score").over(W.partitionBy("block"))).withColumn("_n", F.count("*").over(W.partitionBy("block"))).filter("_k = _n")
    return whole.withColumn("rank", average_rank(F.col("score"), ["block"])).select("series", "block", "score", "rank")


def factor_table(factors: DataFrame) -> DataFrame:
    """months, yearly mean and volatility, t of the mean, population skew and excess kurtosis and worst month of each factor (factor, month, value)."""
    mean, sd = F.avg("value"), F.stddev_samp("value")
    return factors.filter("value IS NOT NULL").groupBy("factor").agg(
        F.count("*").alias("months"), (mean * 12).alias("mean_ann"), _volatility("value").alias("ann_vol"), (mean / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.count("*"))).alias("t_mean"),
        F.skewness("value").alias("skew"), F.kurtosis("value").alias("exkurt"), F.min("value").alias("worst_month"),
    )


def downside(e: str) -> Column:
    """Root mean square of the months below zero."""
    return F.sqrt(F.avg(F.pow(F.least(F.col(e), F.lit(0.0)), 2)))


def certainty_equivalent(e: str, gamma: float) -> Column:
    """Yearly mean less half of gamma times the variance."""
    return (F.avg(e) - gamma / 2.0 * F.var_samp(e)) * 12


def ratios(returns_: DataFrame, factors: DataFrame, gammas: tuple[int, ...] = (1, 3, 5, 10), by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Sharpe, downside deviation, Sortino, beta, Treynor and certainty equivalents of returns in excess of cash (factors: month, rf, mkt_rf).

    Sortino is null without a month below zero, Treynor where beta is not positive.
    """
    rows = returns_.filter("ret IS NOT NULL").join(factors.select("month", "rf", "mkt_rf"), "month").withColumn("e", F.col("ret") - F.col("rf"))
    beta, mean = F.covar_samp("e", "mkt_rf") / F.nullif(F.var_samp("mkt_rf"), F.lit(0.0)), F.avg("e") * 12
    stats = rows.groupBy(*by).agg(
        F.count("*").alias("months"), mean.alias("mean_excess"), (F.avg("e") / F.nullif(F.stddev_samp("e"), F.lit(0.0)) * F.sqrt(F.lit(12.0))).alias("sharpe"),
        (downside("e") * F.sqrt(F.lit(12.0))).alias("downside_dev"), beta.alias("beta"), *(certainty_equivalent("e", g).alias(f"cer_{g}") for g in gammas),
    )
    return stats.withColumn("sortino", F.col("mean_excess") / F.nullif(F.col("downside_dev"), F.lit(0.0))).withColumn("treynor", F.when(F.col("beta") > 0, F.col("mean_excess") / F.col("beta")))


def subperiods(returns_: DataFrame, spans: DataFrame, rf: float = 0.0, least_sharpe: int = 12, least_return: int = 15) -> DataFrame:
    """span, series, months, sharpe of the excess over ``rf`` and cumulative return inside each span (regime, start, end).

    The Sharpe is null for fewer than ``least_sharpe`` months, the return for fewer than ``least_return``.
    """
    rows = join_regimes(returns_.filter("ret IS NOT NULL"), spans).withColumn("e", F.col("ret") - rf)
    n = F.count("*")
    sharpe = F.avg("e") / F.nullif(F.stddev_samp("e"), F.lit(0.0)) * F.sqrt(F.lit(12.0))
    return rows.groupBy(F.col("regime").alias("span"), "series").agg(
        n.alias("months"), F.when(n >= least_sharpe, sharpe).alias("sharpe"), F.when(n >= least_return, F.exp(F.sum(F.log1p("ret"))) - 1).alias("cum_return")
    )


def menu_facts(panel: DataFrame, since: str) -> DataFrame:
    """sample (full or since), factor, mean_gap of yearly growth to the Reference, wins, n_regions, spread between the best and worst series."""
    sample = F.explode(F.array_compact(F.array(F.lit("full"), F.when(F.col("month") >= F.lit(since).cast("date"), "since"))))
    growth = panel.filter("ret IS NOT NULL").withColumn("sample", sample).groupBy("sample", "region", "factor").agg((F.exp(F.sum(F.log1p("ret")) * 12 / F.count("*")) - 1).alias("g"))
    refs = growth.filter(F.col("factor") == REFERENCE).select("sample", "region", F.col("g").alias("r"))
    gaps = growth.filter(F.col("factor") != REFERENCE).join(refs, ["sample", "region"]).groupBy("sample", "factor")
    spread = growth.groupBy("sample").agg((F.max("g") - F.min("g")).alias("spread"))
    return gaps.agg(F.avg(F.col("g") - F.col("r")).alias("mean_gap"), F.count_if(F.col("g") > F.col("r")).alias("wins"), F.count("*").alias("n_regions")).join(spread, "sample")


def factor_pair_corr(panel: DataFrame, a: str, b: str) -> DataFrame:
    """n_regions and the mean over regions of the correlation of factors ``a`` and ``b``, raw and in excess of the Reference."""
    pair = pair_with_reference(panel.filter(F.col("factor").isin(a, b, REFERENCE)))
    side = lambda name: pair.filter(F.col("factor") == name).select("region", "month", F.col("ret").alias(name), "ref")
    rows = side(a).join(side(b).drop("ref"), ["region", "month"])
    by = rows.groupBy("region").agg(F.corr(a, b).alias("raw"), F.corr(F.col(a) - F.col("ref"), F.col(b) - F.col("ref")).alias("excess"))
    return by.agg(F.count("*").alias("n_regions"), F.avg("raw").alias("raw"), F.avg("excess").alias("excess"))


def region_neutral_premium(panel: DataFrame, fee_gap: float = 0.0) -> DataFrame:
    """series "premium", month, ret: mean over regions of (mean factor less Reference less the yearly fee gap over twelve)."""
    region = pair_with_reference(panel).groupBy("region", "month").agg((F.avg("ret") - F.first("ref") - fee_gap / 12).alias("e"))
    return region.groupBy("month").agg(F.avg("e").alias("ret")).withColumn("series", F.lit("premium"))
