"""Two-sided p value of a correlation, as a Column expression.

With t = r*sqrt((n-2)/(1-r^2)) and n-2 degrees of freedom the p value is the regularised incomplete beta
function I_x(df/2, 1/2) at x = df/(df+t^2) = 1-r^2. Its continued fraction is evaluated by a fold over a
fixed number of steps, so no Python worker is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 300
TINY = 1e-300


def _log_gamma_half_ratio(a: Column) -> Column:
    """log(Gamma(a + 1/2) / Gamma(a)), by its asymptotic series after shifting ``a`` up by 16."""
    shift = 16
    b = a + shift
    series = (
        F.log(b) / 2
        - 1 / (8 * b)
        + 1 / (192 * F.pow(b, F.lit(3)))
        - 1 / (640 * F.pow(b, F.lit(5)))
        + 17 / (14336 * F.pow(b, F.lit(7)))
    )
    lowered = F.lit(0.0)
    for i in range(shift):
        lowered = lowered + F.log1p(0.5 / (a + i))
    return series - lowered


def _guard(value: Column) -> Column:
    return F.when(F.abs(value) < TINY, F.lit(TINY)).otherwise(value)


def _continued_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, by the modified Lentz recurrence."""
    first = 1 / _guard(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def half_step(state: Column, term: Column) -> Column:
        d = 1 / _guard(1 + term * state["d"])
        c = _guard(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    def term(i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(F.pmod(i, F.lit(2)) == 0, even).otherwise(odd)

    return F.aggregate(
        F.sequence(F.lit(2), F.lit(2 * STEPS)), start, lambda state, i: half_step(state, term(i)), lambda s: s["h"]
    )


def correlation_p_value(r: Column, n: Column) -> Column:
    """p value of a correlation ``r`` over ``n`` pairs under Student's t with n-2 degrees of freedom."""
    df = n.cast("double") - 2
    a, b = df / 2, F.lit(0.5)
    x = (1 - r) * (1 + r)
    log_front = _log_gamma_half_ratio(a) - F.log(F.lit(3.141592653589793)) / 2 + a * F.log(x) + b * F.log(1 - x)
    front = F.exp(log_front)
    direct = front * _continued_fraction(a, b, x) / a
    mirrored = 1 - front * _continued_fraction(b, a, 1 - x) / b
    p = F.when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored)
    return (
        F.when(r.isNull() | F.isnan(r) | (df <= 0), F.lit(None).cast("double"))
        .when(F.abs(r) >= 1, F.lit(0.0))
        .when(r == 0, F.lit(1.0))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
    )
