"""Quantiles of the normal, Student's t, and repeatable uniform draws, as expressions and as the same text for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelight.functions.maths import bound, norm_cdf, norm_cdf_sql

# Coefficients of Acklam's rational approximation of the normal quantile.
CENTRE_TOP = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
CENTRE_BELOW = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_TOP = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BELOW = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _poly_sql(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"({coefficients[0]!r}e0)" if "e" not in repr(coefficients[0]) else f"({coefficients[0]!r})"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}e0))"
    return out


def norm_ppf(p: Column) -> Column:
    """The normal quantile of a probability, by a rational approximation and one step of Halley's method; null outside (0, 1)."""
    return bound(p, lambda x: F.when((x > 0) & (x < 1), F.when(x <= 0.5, bound(x, _lower_ppf)).otherwise(-bound(1 - x, _lower_ppf))))


def _lower_ppf(low: Column) -> Column:
    """The same for probabilities up to a half."""

    def refined(x: Column) -> Column:
        u = (norm_cdf(x) - low) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
        return bound(u, lambda e: x - e / (1 + x * e / 2))

    tail = bound(F.sqrt(-2 * F.ln(low)), lambda r: _poly(r, TAIL_TOP) / _poly(r, TAIL_BELOW))
    centre = bound(low - 0.5, lambda q: _poly(q * q, CENTRE_TOP) * q / _poly(q * q, CENTRE_BELOW))
    return bound(F.when(low < TAIL, tail).otherwise(centre), refined)


def norm_ppf_sql(p: str) -> str:
    """The text of the same function for DuckDB."""
    low = f"least({p}, 1 - {p})"
    r = f"sqrt(-2 * ln({low}))"
    q = f"({low} - 0.5)"
    about = f"CASE WHEN {low} < {TAIL} THEN {_poly_sql(r, TAIL_TOP)} / {_poly_sql(r, TAIL_BELOW)} ELSE {_poly_sql(f'({q} * {q})', CENTRE_TOP)} * {q} / {_poly_sql(f'({q} * {q})', CENTRE_BELOW)} END"
    u = f"(({norm_cdf_sql('x')} - {low}) * sqrt(2 * pi()) * exp(x * x / 2))"
    return f"(CASE WHEN {p} <= 0.5 THEN 1 ELSE -1 END * list_transform([{about}], lambda x: x - {u} / (1 + x * {u} / 2))[1])"


def t_cdf(t: Column, df: Column) -> Column:
    """Student's distribution function for whole degrees of freedom, by its finite series."""
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    sine, cosine = F.sin(angle), F.cos(angle)
    odd = df % 2 == 1
    last = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    ratio = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    start = F.when(odd, cosine).otherwise(F.lit(1.0))
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    zero = F.struct(start.alias("term"), start.alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * ratio(k.cast("double")) * cosine * cosine
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = sine * F.aggregate(steps, zero, add, lambda acc: acc["sum"])
    inside = F.when(odd, 2 / F.pi() * (angle + F.when(df > 1, series).otherwise(0.0))).otherwise(series)
    return 0.5 + F.signum(t) * inside / 2


def t_cdf_sql(t: str, df: str) -> str:
    """The text of the same function for DuckDB."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, (({df} - 2) // 2 + 1)::BIGINT), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1e0)) / sqrt(pi()) * pow(cos({angle}), 2 * k)))"
    odd = f"2 / pi() * ({angle} + CASE WHEN {df} > 1 THEN sin({angle}) * list_sum(list_transform(range(0, (({df} - 3) // 2 + 1)::BIGINT), lambda k: exp(lgamma(k + 1e0) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos({angle}), 2 * k + 1))) ELSE 0 END)"
    return f"(0.5 + sign({t}) * (CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END) / 2)"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone: any executor and any engine draws the same."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def uniform_sql(*parts: str) -> str:
    """The text of the same function for DuckDB."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::UBIGINT::DOUBLE / 4294967296)"
