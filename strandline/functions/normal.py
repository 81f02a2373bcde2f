"""The normal distribution and the test of a rank correlation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution by formula 7.1.26 of Abramowitz and Stegun (error below 1.5e-7); null stays null."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-x * x)
    return 0.5 * (1.0 + F.when(z < 0, -erf).otherwise(erf))


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by Student's distribution with n - 2 degrees of freedom; null for fewer than 3 pairs.

    For whole degrees of freedom the distribution is a finite sum in the angle whose sine is |rho|.
    """
    sine, square, df = F.least(F.abs(rho), F.lit(1.0)), F.greatest(1 - rho * rho, F.lit(0.0)), n - 2
    odd = df % 2 == 1

    def total(first: Column, terms: Column, ratio) -> Column:
        start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))
        added = lambda acc, k: F.struct((acc["term"] * ratio(k) * square).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))
        return F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms.cast("int"))).otherwise(F.array().cast("array<int>")), start, added)["sum"]

    even_sum = total(F.lit(1.0), df / 2, lambda k: (2 * k - 1) / (2 * k))
    odd_sum = total(F.sqrt(square), (df - 1) / 2, lambda k: 2 * k / (2 * k + 1))
    inside = F.when(odd, 2 / F.pi() * (F.asin(sine) + sine * odd_sum)).otherwise(sine * even_sum)
    return F.when((n >= 3) & rho.isNotNull(), F.greatest(1 - inside, F.lit(0.0)))
