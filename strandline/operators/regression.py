"""Factor regressions by group: sums in Spark, one small solve for each group, errors robust to autocorrelation.

The error of a coefficient is that of the mean of its influence: (inverse of Z'Z times Z_t) times the residual.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normal import norm_cdf
from .inference import MOST_LAGS, lags_of, step_down
from .panel import complete_months, window_slice
from .performance import REFERENCE
from .replicates import block_sums, over_replicates, places


#: Regressors are columns; a frame of more regions than this is an error.
MOST_REGIONS = 1000


def factor_frame(factors: DataFrame, panel: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Regressors by month: the research factors (month, rf, ...) and reg_<region>, each region's Reference less cash.

    Cash is ``factors``' rf, and where that is null that of ``fallback`` (month, rf).
    """
    base = factors
    if fallback is not None:
        base = factors.join(fallback.select("month", F.col("rf").alias("_rf")), "month", "left").withColumn("rf", F.coalesce("rf", "_rf")).drop("_rf")
    refs = panel.filter((F.col("factor") == REFERENCE) & F.col("ret").isNotNull())
    names = sorted(r["region"] for r in refs.select("region").distinct().limit(MOST_REGIONS + 1).collect())
    if len(names) > MOST_REGIONS:
        raise ValueError(f"more than {MOST_REGIONS} regions: a regressor for each would be a column")
    wide = refs.groupBy("month").pivot("region", names).agg(F.first("ret"))
    joined = base.join(wide, "month", "left")
    return joined.select(*base.columns, *((F.col(f"`{n}`") - F.col("rf")).alias(f"reg_{n.replace(' ', '_')}") for n in names))


def hac_ols(rows: DataFrame, by: tuple[str, ...], y: str, names: list[str], lags: int | None = None, order: str = "month") -> DataFrame:
    """``by``, term, coef, se, t, p, n, r2, resid_vol, singular: least squares with an intercept (term alpha) for every group.

    Errors are Newey and West's with max(1, int(4 (n / 100)^(2/9))) lags, or ``lags``; p is two-sided and normal. Rows that lack y or a
    regressor are left out; groups with no more rows than terms too. Collinear regressors get the least-norm solution and
    are marked ``singular``; a perfect fit has no errors. ``names=[]`` is the test of a mean.
    """
    if lags is not None and lags > MOST_LAGS:
        raise ValueError(f"at most {MOST_LAGS} lags")
    known = reduce(lambda a, c: a & F.col(c).isNotNull(), [y, *names], F.lit(True))
    z = ["_one", *(f"_z{i}" for i in range(len(names)))]
    k = len(z)
    data = rows.filter(known).select(*by, F.col(order).alias("_o"), F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_one"), *(F.col(c).cast("double").alias(a) for c, a in zip(names, z[1:], strict=True)))
    cross = [F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(z) for j, b in enumerate(z) if i <= j]
    sums = data.groupBy(*by).agg(*cross, *(F.sum(F.col(a) * F.col("_y")).alias(f"y{i}") for i, a in enumerate(z)), F.count("*").alias("_n"), F.avg("_y").alias("_m")).filter(F.col("_n") > k)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            zz = np.zeros((len(t), k, k))
            for i in range(k):
                for j in range(i, k):
                    zz[:, i, j] = zz[:, j, i] = t[f"s{i}_{j}"]
            inverse = np.linalg.pinv(zz, hermitian=True)
            coef = np.einsum("gij,gj->gi", inverse, t[[f"y{i}" for i in range(k)]].to_numpy())
            out = t[[*by, "_n", "_m"]].copy()
            out["_b"], out["_v"], out["singular"] = list(coef), list(inverse.reshape(len(t), k * k)), np.linalg.matrix_rank(zz, hermitian=True) < k
            yield out

    key = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in sums.select(*by).schema)
    solved = sums.mapInPandas(solve, f"{key}_n bigint, _m double, _b array<double>, _v array<double>, singular boolean")
    joined = data.join(solved, list(by)) if by else data.crossJoin(F.broadcast(solved))  # one row
    u = F.col("_y") - reduce(lambda a, b: a + b, [F.col("_b")[i] * F.col(c) for i, c in enumerate(z)])
    psi = F.array(*(reduce(lambda a, b: a + b, [F.col("_v")[c * k + j] * F.col(name) for j, name in enumerate(z)]) for c in range(k)))
    terms = joined.withColumn("_u", u).select(*by, "_o", "_n", "_u", (F.col("_y") - F.col("_m")).alias("_d"), "singular", "_b", F.posexplode(psi).alias("_c", "_h")).withColumn("_g", F.col("_h") * F.col("_u"))
    w = W.partitionBy(*by, "_c").orderBy("_o")
    most = lags_of(F.col("_n")) if lags is None else F.lit(lags)
    most = F.when(most > MOST_LAGS, F.raise_error(F.lit(f"a group needs more than {MOST_LAGS} lags"))).otherwise(most)
    lagged = [2 * F.greatest(F.lit(0.0), 1 - F.lit(j) / (most + 1)) * F.col("_g") * F.coalesce(F.lag("_g", j).over(w), F.lit(0.0)) for j in range(1, MOST_LAGS + 1)]
    stats = terms.withColumn("_s", sum(lagged, F.col("_g") * F.col("_g"))).groupBy(*by, "_c", "_n", "singular", "_b").agg(F.sum("_s").alias("_s"), F.sum(F.col("_u") * F.col("_u")).alias("_uu"), F.sum(F.col("_d") * F.col("_d")).alias("_dd"))
    name = F.array(F.lit("alpha"), *(F.lit(c) for c in names))[F.col("_c")]
    noisy = F.col("_uu") > 1e-20 * F.col("_dd")  # else the fit is perfect but for rounding
    coef, se = F.get(F.col("_b"), F.col("_c")), F.when(noisy & (F.col("_s") > 0), F.sqrt("_s"))
    out = stats.select(*by, name.alias("term"), coef.alias("coef"), se.alias("se"), F.col("_n").alias("n"), (1 - F.col("_uu") / F.nullif(F.col("_dd"), F.lit(0.0))).alias("r2"), F.when(noisy, F.sqrt(F.col("_uu") / (F.col("_n") - k))).otherwise(0.0).alias("resid_vol"), "singular")
    return out.withColumn("t", F.col("coef") / F.col("se")).withColumn("p", 2 * norm_cdf(-F.abs("t")))


def ols(rows: DataFrame, by: tuple[str, ...], y: str, names: list[str]) -> DataFrame:
    """``by``, term, coef, n, r2 of plain least squares."""
    return hac_ols(rows, by, y, names, 0).select(*by, "term", "coef", "n", "r2")


def _sides(returns_: DataFrame, frame: DataFrame, bench: str) -> DataFrame:
    """series, side (own: in excess of cash; gap: over the bench), month, y and the regressors."""
    known = returns_.filter("ret IS NOT NULL").select("series", "month", "ret")
    even = known.filter(F.col("series") == bench).select("month", F.col("ret").alias("_b"))
    both = F.explode(F.array(F.struct(F.lit("own").alias("side"), (F.col("ret") - F.col("rf")).alias("y")), F.struct(F.lit("gap").alias("side"), F.when(F.col("series") != bench, F.col("ret") - F.col("_b")).alias("y"))))
    rows = known.join(frame, "month").join(even, "month", "left").withColumn("_s", both)
    return rows.select("series", "month", "_s.side", "_s.y", *frame.drop("month").columns).filter("y IS NOT NULL")


def alpha_table(returns_: DataFrame, frame: DataFrame, models: dict[str, list[str]], bench: str = "1/N") -> DataFrame:
    """model, series, side, term, coef, se, t, p, n, r2 of every contestant in every model whose regressors ``frame`` has.

    side is own (returns in excess of cash) or gap (returns over ``bench``); the term alpha is monthly.
    """
    rows = _sides(returns_, frame, bench)
    there = {m: names for m, names in models.items() if set(names) <= set(frame.columns)}
    parts = [hac_ols(rows, ("series", "side"), "y", names).withColumn("model", F.lit(m)) for m, names in there.items()]
    return reduce(DataFrame.unionByName, parts)


def appraisal(alphas: DataFrame) -> DataFrame:
    """model, series, side, appraisal: yearly alpha over yearly residual volatility."""
    return alphas.filter("term = 'alpha'").select("model", "series", "side", (F.col("coef") * F.sqrt(F.lit(12.0)) / F.nullif(F.col("resid_vol"), F.lit(0.0))).alias("appraisal"))


def alpha_decomposition(returns_: DataFrame, frame: DataFrame, names: list[str], bench: str = "1/N") -> DataFrame:
    """series, component, loading, factor_mean_ann, contribution_ann of the gap to ``bench``: alpha and loading times mean add up to the component raw gap."""
    rows = _sides(returns_, frame, bench).filter("side = 'gap'").dropna(subset=names)
    fit = hac_ols(rows, ("series",), "y", names)
    means = rows.groupBy("series").agg(F.avg("y").alias("raw gap"), *(F.avg(c).alias(c) for c in names)).unpivot("series", ["raw gap", *names], "component", "mean")
    both = means.join(fit.select("series", F.col("term").alias("component"), "coef"), ["series", "component"], "full")
    loading = F.when(~F.col("component").isin("alpha", "raw gap"), F.col("coef"))
    value = F.when(F.col("component") == "alpha", F.col("coef")).when(F.col("component") == "raw gap", F.col("mean")).otherwise(F.col("coef") * F.col("mean"))
    return both.select("series", "component", loading.alias("loading"), F.when(loading.isNotNull(), F.col("mean") * 12).alias("factor_mean_ann"), (value * 12).alias("contribution_ann"))


def alpha_stability(returns_: DataFrame, frame: DataFrame, names: list[str], spans: dict[str, tuple[str | None, str | None]], bench: str = "1/N", least: int = 36) -> DataFrame:
    """span, series, alpha_ann, t, p, n of the gap to ``bench`` inside each span of months, of ``least`` months at least."""
    rows = _sides(returns_, frame, bench).filter("side = 'gap'")
    spread = reduce(DataFrame.unionByName, [window_slice(rows, a, b).withColumn("span", F.lit(name)) for name, (a, b) in spans.items()])
    fit = hac_ols(spread, ("span", "series"), "y", names).filter("term = 'alpha'")
    return fit.filter(F.col("n") >= least).select("span", "series", (F.col("coef") * 12).alias("alpha_ann"), "t", "p", "n")


def _refitted(values: np.ndarray, first: np.ndarray, block: int) -> dict[str, np.ndarray]:
    """a, the intercept of each replicate: its normal equations are sums over blocks of the months' products."""
    y, z = values[:, 0], np.column_stack([np.ones(len(values)), values[:, 1:]])
    k = z.shape[1]
    products = np.column_stack([(z[:, :, None] * z[:, None, :]).reshape(len(z), k * k), z * y[:, None]])
    sums = block_sums(products, first, block).sum(axis=1)
    return {"a": np.einsum("rj,rj->r", np.linalg.pinv(sums[:, : k * k].reshape(-1, k, k), hermitian=True)[:, 0], sums[:, k * k :])}


def _refitted_with_errors(values: np.ndarray, first: np.ndarray, block: int) -> dict[str, np.ndarray]:
    """a, the intercept of each replicate, and e, its error by Newey and West's kernel over the drawn months in their new order."""
    n = len(values)
    drawn = values[places(first, n, block)]
    y, z = drawn[:, :, 0], np.concatenate([np.ones((*drawn.shape[:2], 1)), drawn[:, :, 1:]], axis=2)
    inverse = np.linalg.pinv(np.einsum("rti,rtj->rij", z, z), hermitian=True)
    coef = np.einsum("rij,rtj,rt->ri", inverse, z, y, optimize=True)
    u = y - np.einsum("rti,ri->rt", z, coef)
    g = np.einsum("rj,rtj->rt", inverse[:, 0], z) * u
    lags = max(1, int(4 * (n / 100) ** (2 / 9)))
    var = (g * g).sum(axis=1)
    for j in range(1, lags + 1):
        var = var + 2 * (1 - j / (lags + 1)) * (g[:, j:] * g[:, :-j]).sum(axis=1)
    spread = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    return {"a": coef[:, 0], "e": np.sqrt(np.where((var > 0) & ((u * u).sum(axis=1) > 1e-20 * spread), var, np.nan))}


def _common(returns_: DataFrame, frame: DataFrame, names: list[str], bench: str) -> DataFrame:
    """series, month, y and regressors of the gaps to ``bench``, on the months that have all of them, so that all series share their draws."""
    rows = _sides(returns_, frame, bench).filter("side = 'gap'").dropna(subset=names) if names else _sides(returns_, frame, bench).filter("side = 'gap'")
    return complete_months(rows, "y").select("series", "month", "y", *names)


def alpha_bootstrap(returns_: DataFrame, frame: DataFrame, names: list[str], bench: str = "1/N", replicates: int = 4999, seed: int = 7, block: int | None = None) -> DataFrame:
    """series, alpha_ann, p_boot, used of the gap to ``bench``: replicates whose alpha is at least as far from their mean as the estimate from zero.

    Whole months are drawn, those that all series and regressors have. A group's row holds its months; fits are batches of small solves.
    """
    rows = _common(returns_, frame, names, bench)
    seen = hac_ols(rows, ("series",), "y", names, 0).filter("term = 'alpha'").select("series", F.col("coef").alias("a0"))
    reps = over_replicates(rows, ("series",), "month", ["y", *names], replicates, _refitted, "a double", (seed,), block, len(names) + 2)
    centre = reps.groupBy("series").agg(F.avg("a").alias("centre"))
    both = reps.join(centre, "series").join(seen, "series").groupBy("series", "a0")
    far = F.count_if(F.round(F.abs(F.col("a") - F.col("centre")), 12) >= F.round(F.abs("a0"), 12))
    return both.agg(((1 + far) / (1 + F.count("*"))).alias("p_boot"), F.count("*").alias("used")).select("series", (F.col("a0") * 12).alias("alpha_ann"), "p_boot", "used")


def romano_wolf(returns_: DataFrame, frame: DataFrame, models: dict[str, list[str]], bench: str = "1/N", replicates: int = 4999, seed: int = 7, block: int = 6) -> DataFrame:
    """series, model, months, alpha_ann, t, p_hac, p_single, p_rw, ci_lo_ann, ci_hi_ann, mde80_ann, mde80_boot_ann of the gaps' alphas, family-wise over all series and models.

    Months that have all regressors of all models are drawn in blocks; each replicate's t is centred on the alpha of the data. The interval
    turns round the 2.5 and 97.5 % points of t. The least detectable alpha is 2.8 errors, or from the replicates the 95 % point
    of |t| plus 0.8416 deviations of t, in errors.
    """
    every = sorted({c for names in models.values() for c in names})
    rows = _common(returns_, frame, every, bench)
    cell = ("series", "model")
    fits = [hac_ols(rows, ("series",), "y", names).filter("term = 'alpha'").withColumn("model", F.lit(m)) for m, names in models.items()]
    seen = reduce(DataFrame.unionByName, fits).filter("se IS NOT NULL").select(*cell, "n", F.col("coef").alias("a0"), F.col("se").alias("se0"), "t", "p")
    drawn = [over_replicates(rows, ("series",), "month", ["y", *names], replicates, _refitted_with_errors, "a double, e double", (seed,), block, len(names) + 2).withColumn("model", F.lit(m)) for m, names in models.items()]
    reps = reduce(DataFrame.unionByName, drawn).join(seen.select(*cell, "a0"), list(cell)).select(*cell, "rep", ((F.col("a") - F.col("a0")) / F.col("e")).alias("t"))
    p = step_down(seen.select(*cell, "t"), reps, cell).drop("p_one_sided", "t")
    spread = reps.groupBy(*cell).agg(F.percentile("t", F.lit(0.025)).alias("lo"), F.percentile("t", F.lit(0.975)).alias("hi"), F.percentile(F.abs("t"), F.lit(0.95)).alias("crit"), F.stddev_pop("t").alias("sd"))
    joined = seen.join(p, list(cell)).join(spread, list(cell))
    year = lambda c: c * 12
    return joined.select(
        *cell, F.col("n").alias("months"), year(F.col("a0")).alias("alpha_ann"), "t", F.col("p").alias("p_hac"), "p_single", "p_rw", year(F.col("a0") - F.col("hi") * F.col("se0")).alias("ci_lo_ann"), year(F.col("a0") - F.col("lo") * F.col("se0")).alias("ci_hi_ann"),
        year(2.8 * F.col("se0")).alias("mde80_ann"), year((F.col("crit") + 0.8416 * F.col("sd")) * F.col("se0")).alias("mde80_boot_ann"),
    )
