"""Distribution functions as column expressions, for the few rows that aggregates leave."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 400


def _simpson(lo: Column, hi: Column, f) -> Column:
    h = (hi - lo) / STEPS
    w = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + w(i) * f(lo + i * h)) * h / 3


def normal_cdf(z: Column) -> Column:
    x = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    area = _simpson(F.lit(0.0), x, lambda t: F.exp(-t * t / 2) / math.sqrt(2 * math.pi))
    return F.when(z.isNotNull(), 0.5 + area)


def t_cdf(t: Column, df: Column) -> Column:
    """Student's t by the angle atan(t / sqrt(df)): its density is a power of the cosine."""
    f = lambda a: F.pow(F.greatest(F.cos(a), F.lit(0.0)), df - 1)
    half = F.lit(math.pi / 2)
    part = _simpson(F.lit(0.0), F.atan(t / F.sqrt(df)), f)
    return F.when(t.isNotNull() & (df > 0), 0.5 + part / (2 * _simpson(F.lit(0.0), half, f)))


def t_two_sided(t: Column, df: Column) -> Column:
    return 2 * (1 - t_cdf(F.abs(t), df))


def t_quantile(p: float, df: Column) -> Column:
    """By bisection over the angle, a fixed number of halvings."""
    lo_hi = F.struct(F.lit(0.0).alias("lo"), F.lit(math.pi / 2 - 1e-9).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = t_cdf(F.tan(mid) * F.sqrt(df), df) < max(p, 1 - p)
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    q = F.aggregate(F.sequence(F.lit(1), F.lit(40)), lo_hi, halve, lambda s: F.tan((s["lo"] + s["hi"]) / 2)) * F.sqrt(df)
    return q if p >= 0.5 else -q


def binomial_two_sided(wins: Column, n: Column) -> Column:
    """Probability under a fair coin of a count at most as likely as `wins`: twice the smaller tail, 1 at most."""
    k = F.least(wins, n - wins)
    # terms of the tail by the ratio of neighbours, in logarithms
    first = F.struct((-n * math.log(2)).alias("l"), F.lit(0.0).alias("s"))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k.cast("long")), first,
        lambda s, i: F.struct((s["l"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("l"), (s["s"] + F.exp(s["l"])).alias("s")),
        lambda s: s["s"],
    )
    return F.when(n > 0, F.least(2 * tail, F.lit(1.0)))
