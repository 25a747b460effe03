"""Numeric expressions: NULL-safe ratios, rounding, the normal quantile."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


# Coefficients of the rational approximation of the normal quantile
# (P. J. Acklam), numerator and denominator, centre then tails.
CENTRE_NUM = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
              1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
CENTRE_DEN = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
              6.680131188771972e+01, -1.328068155288572e+01, 1.0]
TAIL_NUM = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
TAIL_DEN = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00, 1.0]
TAIL_FROM = 0.02425


def _horner(coefficients, x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_quantile(p: Column) -> Column:
    q = p - 0.5
    r = q * q
    centre = _horner(CENTRE_NUM, r) * q / _horner(CENTRE_DEN, r)
    low = F.sqrt(-2.0 * F.ln(p))
    high = F.sqrt(-2.0 * F.ln(1.0 - p))
    return (F.when(p < TAIL_FROM, _horner(TAIL_NUM, low) / _horner(TAIL_DEN, low))
            .when(p > 1.0 - TAIL_FROM, -_horner(TAIL_NUM, high) / _horner(TAIL_DEN, high))
            .otherwise(centre))
