"""Tail probabilities as pure column expressions (no Python on the row path).

Spark has neither ``erf`` nor ``lgamma``.  The chi-square upper tail is the
regularised incomplete gamma function Q(a, x), a = dof / 2, x = stat / 2:

- below x = a + 1 one minus the power series of P(a, x);
- above it the continued fraction of Q(a, x) (modified Lentz steps).

Both run for a length that follows from a (their terms decay over a few
sqrt(a) steps around x = a), and ln Gamma comes from Stirling's series after
a shift, so any number of degrees of freedom works.

``chi2_sf_sql`` is an independent DuckDB formula: the finite sum of Poisson
terms that Q(a, x) is for whole and half a, on top of erfc for odd dof,
which is integrated numerically (Craig's form).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Steps beyond the scale of sqrt(a), and per unit of it, that bring the remainder below 1e-16.
STEPS, STEPS_PER_ROOT = 100, 14
_TINY = 1e-300


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def ln_gamma(z: Column) -> Column:
    """ln Gamma(z), z > 0: Stirling's series at z + 10, taken back by the recurrence."""
    y = z + 10.0
    series = 1 / (12.0 * y) - 1 / (360.0 * F.pow(y, 3)) + 1 / (1260.0 * F.pow(y, 5)) - 1 / (1680.0 * F.pow(y, 7))
    back = sum((F.log(z + float(k)) for k in range(1, 10)), F.log(z))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def chi2_sf(stat, dof) -> Column:
    """Upper tail P(X >= stat) of a chi-square with ``dof`` degrees of freedom."""
    stat, dof = _c(stat).cast("double"), _c(dof).cast("double")
    a, x = dof / 2.0, stat / 2.0
    scale = F.exp(a * F.log(x) - x - ln_gamma(a + 1.0))
    steps = F.sequence(F.lit(1), (F.ceil(F.sqrt(a) * STEPS_PER_ROOT) + STEPS).cast("int"))

    def term(acc: Column, n: Column) -> Column:
        t = acc["t"] * x / (a + n)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))
    series = scale * F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), term, lambda acc: acc["s"])

    def away(v: Column) -> Column:
        return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def lentz(acc: Column, n: Column) -> Column:
        an, b = -n * (n - a), x + 1.0 - a + 2.0 * n
        d, c = 1.0 / away(an * acc["d"] + b), away(b + an / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))
    first = 1.0 / away(x + 1.0 - a)
    start = F.struct(F.lit(1 / _TINY).alias("c"), first.alias("d"), first.alias("h"))
    # x^a e^-x / Gamma(a) = scale * a
    fraction = scale * a * F.aggregate(steps, start, lentz, lambda acc: acc["h"])
    p = F.when(x < a + 1.0, 1.0 - series).otherwise(fraction)
    return (F.when(stat.isNull() | dof.isNull(), F.lit(None).cast("double")).when(stat <= 0, F.lit(1.0))
            .otherwise(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))))


def normal_two_sided(z) -> Column:
    """Two-sided normal p-value of ``z`` (= chi-square(1) tail of z^2)."""
    z = _c(z).cast("double")
    return chi2_sf(z * z, F.lit(1.0))


def chi2_sf_sql(stat: str, dof: str) -> str:
    """DuckDB text of the same upper-tail probability, by another formula."""
    x, odd = f"(({stat})/2.0)", f"(CAST({dof} AS BIGINT) % 2)"
    # Poisson terms k + odd/2 for k below dof // 2, each by the logarithm
    poisson = (f"coalesce(list_sum(list_transform(range(0, CAST({dof} AS BIGINT) // 2), "
               f"lambda k: exp((k + {odd}/2.0)*ln({x}) - {x} - lgamma(k + 1 + {odd}/2.0)))), 0)")
    # erfc(z) = 2/pi * integral of exp(-z^2 / sin^2 t) over 0..pi/2, by the trapezoid rule
    erfc = (f"((exp(-{x})/2 + list_sum(list_transform(range(1, 2000), lambda k: exp(-{x}/power(sin(k*pi()/4000), 2))))) / 2000)")
    return (f"(CASE WHEN ({stat}) IS NULL OR ({dof}) IS NULL THEN NULL WHEN ({stat}) <= 0 THEN 1.0::DOUBLE "
            f"ELSE greatest(least({poisson} + CASE WHEN {odd} = 1 THEN {erfc} ELSE 0 END, 1.0), 0.0) END)")


def normal_two_sided_sql(z: str) -> str:
    return chi2_sf_sql(f"(({z})*({z}))", "1")
