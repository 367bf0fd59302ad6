"""Normal distribution and rounding as expressions that stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Hart's rational approximation of the normal tail (double precision).
NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once: for long expressions, which generated code could not hold if repeated."""
    return F.element_at(F.transform(F.array(x), f), 1)


def norm_cdf_sql(x: str) -> str:
    """The text of the same function for DuckDB; ``x`` must be a double."""
    a = f"least(abs({x}), 37e0)"
    near = f"exp(-{a} * {a} / 2) * {_horner(a, NUMERATOR)} / {_horner(a, DENOMINATOR)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / 2.506628274631"
    upper = f"(CASE WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END)"


def norm_cdf(x: Column) -> Column:
    """The normal distribution function, within 1e-15 of the exact one."""
    a = F.least(F.abs(x), F.lit(37.0))

    def poly(c: tuple[float, ...]) -> Column:
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * a + F.lit(k)
        return out

    bell = F.exp(-a * a / 2)
    near = bell * poly(NUMERATOR) / poly(DENOMINATOR)
    far = bell / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    upper = F.when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.sqrt(2 * F.pi())


def expected_abs_normal(mu: Column, sd: Column) -> Column:
    """Mean absolute value of a normal variable."""
    z = F.try_divide(mu, sd)
    erf = 2 * norm_cdf(z) - 1  # of z / sqrt(2)
    return F.when(sd <= 0, F.abs(mu)).otherwise(sd * F.sqrt(2 / F.pi()) * F.exp(-z * z / 2) + mu * erf)


def half_even(x: Column, digits: int = 0) -> Column:
    """Round half to even, as numpy and Python do."""
    return F.bround(x, digits)
