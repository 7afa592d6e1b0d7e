"""Rounding, safe ratios and p-values in plain column arithmetic."""

import math

from pyspark.sql import Column, functions as F


def r6(c: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def ratio(a: Column, b: Column, when_empty: float | None = None) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if when_empty is None else F.coalesce(out, F.lit(when_empty))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def drawn(*parts: Column) -> Column:
    """A whole number below 2**52 hashed from the parts: a seeded draw that any engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("bigint")


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows for which the condition holds."""
    return F.avg(condition.cast("double"))


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Limit law of the two-sample statistic, 2*sum (-1)^(k-1) exp(-2 k^2 lambda^2)."""
    lam = d * F.sqrt(n.cast("double") * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, 1.0).otherwise(clip(series, 0.0, 1.0))


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z >= 1: Stirling's series eight above z, brought down by the product."""
    far = z + 8
    product = z
    for i in range(1, 8):
        product = product * (z + i)
    series = 1 / (12.0 * far) - 1 / (360.0 * F.pow(far, F.lit(3))) + 1 / (1260.0 * F.pow(far, F.lit(5))) - 1 / (1680.0 * F.pow(far, F.lit(7)))
    return (far - 0.5) * F.log(far) - far + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def chi2_sf(stat: Column, dof: Column) -> Column:
    """Upper tail of chi-square: 1 - series of the lower incomplete gamma function.

    An infinite statistic or one far in the tail gives 0, no degree of freedom gives 1.
    """
    a = dof / F.lit(2.0)
    x = stat / F.lit(2.0)
    # terms die out some widths (sqrt a) past the mode
    lower = F.aggregate(
        F.sequence(F.lit(1), (F.lit(800) + 40 * F.sqrt(a)).cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, k: F.struct(
            (s["term"] * x / (a + k)).alias("term"), (s["sum"] + s["term"] * x / (a + k)).alias("sum")
        ),
        lambda s: s["sum"],
    )
    # Chernoff bound of the tail: below exp(-60) it is 0, which also keeps the series from overflowing
    far = (x > a) & (a - x + a * F.log(x / a) < -60)
    return (
        F.when(dof < 1, 1.0)
        .when(stat <= 0, 1.0)
        .when(stat == float("inf"), 0.0)
        .when(far, 0.0)
        .otherwise(clip(1 - F.exp(-x + a * F.log(x) - log_gamma(a + 1)) * lower, 0.0, 1.0))
    )
