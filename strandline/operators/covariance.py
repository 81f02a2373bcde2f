"""Covariances of all pairs of series and their shrinkage, as sums over pairs; no dense matrix anywhere."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .panel import complete_months
from .performance import known_pairs, pair_arrays, series_arrays, sums_over
from .replicates import length_of, month_counts


def with_totals(df: DataFrame, by: tuple[str, ...], *totals: Column) -> DataFrame:
    """``df`` with aggregates of its group beside each row, without a window over the group."""
    sums = df.groupBy(*by).agg(*totals)
    return df.join(sums, list(by)) if by else df.crossJoin(F.broadcast(sums))  # one row


def covariance_pairs(panel: DataFrame, by: tuple[str, ...] = (), complete: bool = True) -> DataFrame:
    """i, j, n, cov (sample), cov_pop, m22 and m31 (mean of x^2 y^2 and of x^3 y) of all ordered pairs, and the mean of i where i = j.

    x and y are deviations from the series' means over complete months (``complete=False`` takes the panel as it is,
    without a gap). Each unordered pair is made once and turned round after it has been summed.
    """
    rows = (complete_months(panel, "ret", by) if complete else panel.filter(F.col("ret").isNotNull())).select(*by, "series", "month", "ret")
    mean = F.avg("ret").over(W.partitionBy(*by, "series"))
    centred = rows.withColumn("mean", mean).withColumn("x", F.col("ret") - F.col("mean"))
    x = F.col("x")
    sums = {"s11": lambda x, y: x * y, "s22": lambda x, y: x * x * y * y, "s31": lambda x, y: x * x * x * y, "s13": lambda x, y: x * y * y * y}
    found = pair_arrays(centred, "x", by).select(*by, "i", "j", sums_over(known_pairs(), sums).alias("s")).filter("s.n > 0")
    pairs = found.select(*by, "i", "j", F.col("s.n").cast("long").alias("n"), *(f"s.{c}" for c in sums))
    turned = pairs.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "n", "s11", "s22", F.col("s13").alias("s31"))
    own = centred.groupBy(*by, F.col("series").alias("i")).agg(
        F.count("*").alias("n"), F.sum(x * x).alias("s11"), F.sum(x * x * x * x).alias("s22"), F.sum(x * x * x * x).alias("s31"), F.first("mean").alias("mean")
    )
    every = pairs.drop("s13").unionByName(turned).unionByName(own.withColumn("j", F.col("i")), allowMissingColumns=True)
    n = F.col("n")
    return every.select(*by, "i", "j", "n", (F.col("s11") / F.nullif(n - 1, F.lit(0))).alias("cov"), (F.col("s11") / n).alias("cov_pop"), (F.col("s22") / n).alias("m22"), (F.col("s31") / n).alias("m31"), "mean")


def _with_variances(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    own = pairs.filter("i = j").select(*by, F.col("i").alias("_s"), F.col("cov_pop").alias("_v"))
    vi, vj = own.withColumnsRenamed({"_s": "i", "_v": "vi"}), own.withColumnsRenamed({"_s": "j", "_v": "vj"})
    return pairs.join(vi, [*by, "i"]).join(vj, [*by, "j"])


def shrink_constant_correlation(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """i, j, cov, delta, n: covariances drawn towards own variances and one mean correlation, by the intensity that the pairs' moments give.

    ``pairs`` are those of :func:`covariance_pairs`; covariances are the population's.
    """
    p = _with_variances(pairs, by)
    root = F.sqrt(F.col("vi") * F.col("vj"))
    off = F.col("i") != F.col("j")
    p = with_totals(p.withColumn("root", root), by, F.avg(F.when(off, F.col("cov_pop") / F.nullif(F.col("root"), F.lit(0.0)))).alias("r_bar"))
    target = F.when(off, F.coalesce("r_bar", F.lit(0.0)) * F.col("root")).otherwise(F.col("vi"))
    pi = F.col("m22") - F.col("cov_pop") * F.col("cov_pop")
    theta = F.when(off, F.sqrt(F.col("vj") / F.nullif(F.col("vi"), F.lit(0.0))) * (F.col("m31") - F.col("vi") * F.col("cov_pop"))).otherwise(0.0)
    terms = p.withColumn("f", target).withColumn("pi", pi).withColumn("theta", theta)
    rho = F.sum(F.when(off, 0.0).otherwise(F.col("pi"))) + F.coalesce(F.max("r_bar"), F.lit(0.0)) * F.sum("theta")
    gamma = F.sum(F.pow(F.col("cov_pop") - F.col("f"), 2))
    kappa = F.coalesce((F.sum("pi") - rho) / F.nullif(gamma, F.lit(0.0)), F.lit(0.0)) / F.max("n")
    shrunk = with_totals(terms, by, F.least(F.lit(1.0), F.greatest(F.lit(0.0), kappa)).alias("delta"))
    return shrunk.select(*by, "i", "j", (F.col("delta") * F.col("f") + (1 - F.col("delta")) * F.col("cov_pop")).alias("cov"), "delta", "n")


def shrink_identity(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """i, j, cov, delta, n: covariances drawn towards the mean variance on the diagonal and nothing beside it.

    The noise of the sample, the sum over months of |x x' - S|^2, is T times the sum over pairs of m22 less S^2.
    """
    same = F.when(F.col("i") == F.col("j"), F.col("cov_pop"))
    square = F.sum(F.col("cov_pop") * F.col("cov_pop"))
    k = F.count(same)
    p = with_totals(pairs, by, F.avg(same).alias("m"), ((square - k * F.pow(F.avg(same), 2)) / k).alias("d2"), ((F.sum("m22") - square) / (F.max("n") * k)).alias("b2"))
    delta = F.when(F.col("d2") > 0, F.least("b2", "d2") / F.col("d2")).otherwise(0.0)
    target = F.when(F.col("i") == F.col("j"), F.col("m")).otherwise(0.0)
    return p.withColumn("delta", delta).select(*by, "i", "j", (F.col("delta") * target + (1 - F.col("delta")) * F.col("cov_pop")).alias("cov"), "delta", "n")


def no_shrinkage(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """i, j, cov, delta, n: the sample's covariances as they are."""
    return pairs.select(*by, "i", "j", "cov", F.lit(0.0).alias("delta"), "n")


#: Estimators by name, over the pairs of :func:`covariance_pairs`.
ESTIMATORS = {"constant_correlation": shrink_constant_correlation, "identity": shrink_identity, "sample": no_shrinkage}


def estimate(pairs: DataFrame, estimator: str = "constant_correlation", by: tuple[str, ...] = ()) -> DataFrame:
    """i, j, cov, delta, n by the estimator of that name; an unknown name is an error that lists the known ones."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}: {', '.join(ESTIMATORS)}")
    return ESTIMATORS[estimator](pairs, by)


_MOMENTS = ("corr", "ss", "s_root", "root2", "s", "root", "pi", "theta", "n_pairs", "var", "sd")


def _moments_of(x: np.ndarray, y: np.ndarray, counts: np.ndarray, same: bool) -> np.ndarray:
    """(moment, replicate): what a pair adds to the sums of ``_MOMENTS`` when month t counts ``counts[replicate, t]`` times."""
    n = counts.shape[1]
    x, y = x - x.mean(), y - y.mean()
    columns = np.column_stack([x, y, x * x, y * y, x * y, x * x * y, x * y * y, x**3, y**3, x * x * y * y, x**3 * y, x * y**3])
    a, b, xx, yy, xy, xxy, xyy, xxx, yyy, xxyy, xxxy, xyyy = (counts @ columns).T / n
    s, vx, vy = xy - a * b, xx - a * a, yy - b * b
    pi = xxyy - 2 * b * xxy - 2 * a * xyy + b * b * xx + a * a * yy + 4 * a * b * xy - 3 * a * a * b * b - s * s
    out = np.zeros((len(_MOMENTS), len(counts)))
    if same:
        out[-2:] = vx, np.sqrt(np.maximum(vx, 0))
        return out
    root = np.sqrt(np.maximum(vx * vy, 0))
    flat = root <= 0
    safe = np.where(flat, 1.0, root)
    m31 = xxxy - b * xxx - 3 * a * xxy + 3 * a * b * xx + 3 * a * a * xy - 3 * a**3 * b
    m13 = xyyy - a * yyy - 3 * b * xyy + 3 * a * b * yy + 3 * b * b * xy - 3 * b**3 * a
    theta = np.where(flat, 0.0, vy / safe * (m31 - vx * s) + vx / safe * (m13 - vy * s))
    out[:9] = np.where(flat, 0.0, 2 * s / safe), 2 * s * s, 2 * s * root, 2 * root * root, 2 * s, 2 * root, 2 * pi, theta, np.where(flat, 0.0, 2.0)
    return out


def dr2_draws(panel: DataFrame, by: tuple[str, ...], replicates: int = 4999, seed: int = 7, block: int | None = None) -> DataFrame:
    """``by``, rep, dr2, delta: independent bets of equal weights on the covariance shrunk again in each replicate; rep -1 is the data itself.

    ``panel`` (``by``, series, month, ret) has complete months, the same for all groups, so that replicates of groups are paired. A replicate is a vector of
    counts of the months; every moment of a pair is a product with it. A task adds what its pairs say of all replicates, so a row for
    each replicate, group and task is shuffled, and none for a pair.
    """
    pairs = pair_arrays(panel, by=by).select(*by, "x", "y", F.lit(False).alias("same"))
    own = series_arrays(panel, by=by).select(*by, "x", F.col("x").alias("y"), F.lit(True).alias("same"))
    keys = len(by)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            values = [[v.values.to_numpy(zero_copy_only=False) for v in batch.column(keys + c)] for c in range(2)]
            for at, (x, y, same) in enumerate(zip(*values, batch.column(keys + 2).to_pylist(), strict=True)):
                n = int((~np.isnan(x)).sum())
                key = tuple(batch.column(k)[at].as_py() for k in range(keys))
                known = ~np.isnan(x)
                part = _moments_of(x[known], y[known], month_counts(seed, replicates, n, block or length_of(n)), same)
                found[key] = found[key] + part if key in found else part
        for key, total in found.items():
            reps = total.shape[1]
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * reps) for k in key), pa.array(np.arange(-1, reps - 1, dtype=np.int32)), *map(pa.array, total)], names=[*by, "rep", *_MOMENTS])

    key = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in panel.select(*by).schema)
    parts = pairs.unionByName(own).mapInArrow(run, f"{key}rep int, " + ", ".join(f"{c} double" for c in _MOMENTS))
    sums = parts.groupBy(*by, "rep").agg(*(F.sum(c).alias(c) for c in _MOMENTS))
    months = panel.groupBy(*by).agg(F.countDistinct("month").alias("n"))
    rows = sums.join(months, list(by)) if by else sums.crossJoin(F.broadcast(months))  # one row
    r = F.coalesce(F.col("corr") / F.nullif(F.col("n_pairs"), F.lit(0.0)), F.lit(0.0))
    gamma = F.col("ss") - 2 * r * F.col("s_root") + r * r * F.col("root2")
    kappa = F.when(gamma > 1e-12 * F.col("ss"), (F.col("pi") - r * F.col("theta")) / gamma / F.col("n")).otherwise(0.0)
    rows = rows.withColumn("delta", F.least(F.lit(1.0), F.greatest(F.lit(0.0), kappa)))
    var = F.col("var") + F.col("delta") * r * F.col("root") + (1 - F.col("delta")) * F.col("s")
    return rows.select(*by, "rep", (F.pow("sd", 2) / F.nullif(var, F.lit(0.0))).alias("dr2"), "delta")


def dr2_bootstrap(panel: DataFrame, menu: str, a: str, b: str, replicates: int = 4999, seed: int = 7, block: int | None = None) -> DataFrame:
    """dr2_a, dr2_b, delta (b less a), used, ci_a_lo, ci_a_hi, ci_delta_lo, ci_delta_hi, p: independent bets of equal weights of two menus on the same draws.

    ``panel`` has the column ``menu`` with both names, on the same complete months. Intervals hold 95 % of the replicates; p is twice the smaller
    tail of the centred differences beyond the observed one, 1 / (used + 1) at least.
    """
    wide = dr2_draws(panel.filter(F.col(menu).isin(a, b)), (menu,), replicates, seed, block).groupBy("rep").pivot(menu, [a, b]).agg(F.first("dr2")).toDF("rep", "a", "b").withColumn("d", F.col("b") - F.col("a"))
    side = F.when(F.col("rep") < 0, "seen").otherwise("drawn")
    drawn = lambda c: F.when(side == "drawn", F.col(c))
    seen = lambda c: F.max(F.when(side == "seen", F.col(c)))
    points = [F.percentile(drawn(c), F.lit(q)).alias(f"{n}_{e}") for c, n in (("a", "ci_a"), ("d", "ci_delta")) for q, e in ((0.025, "lo"), (0.975, "hi"))]
    ends = wide.filter("d IS NOT NULL").agg(seen("a").alias("dr2_a"), seen("b").alias("dr2_b"), seen("d").alias("delta"), F.count(drawn("d")).alias("used"), F.avg(drawn("d")).alias("_m"), F.collect_list(drawn("d")).alias("_d"), *points)
    far = lambda f: F.size(F.filter("_d", f)) / F.col("used")
    reach = F.round(F.abs("delta"), 12)
    tail = F.least(far(lambda d: F.round(d - F.col("_m"), 12) >= reach), far(lambda d: F.round(d - F.col("_m"), 12) <= -reach))
    return ends.filter("delta IS NOT NULL").withColumn("p", F.greatest(2 * tail, 1.0 / (F.col("used") + 1))).drop("_m", "_d")
