"""Statistics as columns: chi-square tests, p and z values, the false discovery rate, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: |z| of the smallest p that is told apart, 1e-240.
Z_MAX = 33.11195190498638
P_MIN = 1e-240

#: Coefficients of a rational approximation of erfc, relative error 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(z: Column) -> Column:
    """The complementary error function of z >= 0."""
    t = F.lit(1.0) / (1.0 + 0.5 * z)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = F.lit(c) + t * poly
    return t * F.exp(poly - z * z)


def chi2_p(chi2: Column) -> Column:
    """p of a chi-square of one degree of freedom, at least 1e-240."""
    return F.greatest(erfc(F.sqrt(chi2 / 2)), F.lit(P_MIN))


def signed_z(chi2: Column, sign: Column) -> Column:
    """z of the two-sided p of a chi-square of one degree of freedom: its root, with a sign."""
    return F.signum(sign) * F.least(F.sqrt(chi2), F.lit(Z_MAX))


def p_to_z(p: Column, sign: Column) -> Column:
    """z of a two-sided p with a sign, by a rational start and two Newton steps on erfc."""
    q = F.greatest(p, F.lit(P_MIN)) / 2
    t = F.sqrt(-2 * F.log(q))
    # The classical rational approximation of the normal quantile
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    z = F.greatest(z, F.lit(0.0))
    for _ in range(2):
        tail = erfc(z / 2**0.5) / 2
        z = z + (tail - q) / F.greatest(F.exp(-z * z / 2) / 2.5066282746310002, F.lit(1e-300))
    return F.signum(sign) * F.abs(z)


def one_way(n_active: Column, n: Column, expected: Column) -> Column:
    """Chi-square of a count against the expected one, of n trials; null where that is 0 or n."""
    return F.try_divide((n_active - expected) * (n_active - expected), expected) + F.try_divide((n_active - expected) * (n_active - expected), n - expected)


def two_way(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of the table [[a, b], [c, d]] without continuity correction; a cell of expectation 0 counts 1."""
    total = a + b + c + d
    out = F.lit(0.0)
    for cell, row, column in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        expected = F.try_divide((row * column).cast("double"), total)
        out = out + F.when(expected == 0, F.lit(1.0)).otherwise((cell - expected) * (cell - expected) / expected)
    return out


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of doubles, the same in any order of the rows, so that limits are met or not by the values alone.

    Each value is split at 2**-30; both parts are sums of multiples of one power of two, which are exact until they need
    53 bits.  That holds for sums under 2**23 of at least 4096 values, each 0 or over 2**-20; beyond, the last bits round.
    """
    large = F.abs(value) >= 2.0**23  # NaN and infinities too
    high = F.when(large, value).otherwise(F.rint(value * 2.0**30) / 2.0**30)
    low = F.when(large, F.lit(0.0)).otherwise(value - high)
    return F.sum(high) + F.sum(low)


def fdr(p_values: DataFrame, q: float, p: str = "p", weight: str | None = None) -> DataFrame:
    """One row, ``threshold``: the largest p with p <= its rank * q / count, or -1.  ``weight``: how often each row counts.

    Equal p are summed first.  Their ranks are sums over buckets of neighbouring p, at most 64 for each power of two from
    1 to 1e-300, plus the rank within the bucket, so no task holds more than a bucket of distinct values.  Nulls don't count.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    groups = p_values.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(n.alias("n"))
    groups = groups.withColumn("bucket", F.floor(F.log2(F.greatest(F.col("p"), F.lit(1e-300))) * 64))
    sums = groups.groupBy("bucket").agg(F.sum("n").alias("n"))
    over = Window.orderBy("bucket")
    sums = sums.select("bucket", (F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    ranked = groups.select("bucket", "p", inside.alias("inside")).join(F.broadcast(sums), "bucket")
    fits = F.col("p") <= (F.col("before") + F.col("inside")) * q / F.col("total")
    return ranked.agg(F.coalesce(F.max(F.when(fits, F.col("p"))), F.lit(-1.0)).alias("threshold"))


def correlation(sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, n: Column) -> Column:
    """Pearson's r from sums over n pairs, of which the pairs of zeros need no row; null if a side is constant."""
    up = n * sxy - sx * sy
    return F.try_divide(up, F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0))) * F.sqrt(F.greatest(n * syy - sy * sy, F.lit(0.0))))


def fisher_z(r: Column, n: Column) -> Column:
    """arctanh(r) * sqrt(n - 3)."""
    return F.atanh(r) * F.sqrt(n - 3)


def binarize(y: Column, over: float) -> Column:
    """1 where y > over, 0 where it then is under 1; weights of 1 or more that aren't over it stay."""
    return F.when(y > over, F.lit(1.0)).when(y < 1, F.lit(0.0)).otherwise(y)


def threshold(value: Column, limit: float, mask: Column | None = None, mask_out: str = "below") -> Column:
    """0 where the value, or the mask if given, lies below (or above) the limit, or the mask is 0."""
    if mask_out[:1] not in ("a", "b"):
        raise ValueError("mask_out: 'above' or 'below'")
    tested = value if mask is None else mask
    out = tested < limit if mask_out.startswith("b") else tested > limit
    out = out if mask is None else out | (mask == 0)
    return F.when(out, F.lit(0.0)).otherwise(value)


def clean(value: Column) -> Column:
    """NaN and null as 0, infinities as the largest doubles."""
    big = 1.7976931348623157e308
    v = F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(v, F.lit(-big)), F.lit(big))
