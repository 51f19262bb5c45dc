"""Tail probabilities as columns: folds over the terms of series and continued fractions, from the innermost term outwards.

Use them in a withColumn of their own: in a select that gives a new column the name of an argument, Spark takes the new
column inside of the fold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms that are taken; enough for 1e-12 at up to some thousand degrees of freedom.
TERMS = 400
#: Coefficients of Stirling's series for the logarithm of the gamma function: Bernoulli numbers B(2k) / (2k (2k - 1)). Fixed values.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series ten places on."""
    y, product = x + 10, x
    for k in range(1, 10):
        product = product * (x + k)
    series, power = F.lit(0.0), 1 / y
    for c in STIRLING:
        series = series + c * power
        power = power / (y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _fold(step) -> Column:
    """step(value, m) for m from TERMS down to 1, from 0."""
    return F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(0.0), lambda v, m: step(v, m.cast("double")))


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function."""

    def part(a: Column, b: Column, x: Column, y: Column) -> Column:
        """By its continued fraction, for x below its mean; y = 1 - x."""
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(y)) / a
        even = lambda m: m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = lambda m: -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = _fold(lambda v, m: even(m) / (1 + odd(m) / (1 + v)))
        return front / (1 - (a + b) * x / (a + 1) / (1 + value))

    inside = F.when(x <= (a + 1) / (a + b + 2), part(a, b, x, 1 - x)).otherwise(1 - part(b, a, 1 - x, x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function: 1 less the series below a + 1, the continued fraction beyond."""
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    series = front / a * (1 + _fold(lambda v, m: x / (a + m) * (1 + v)))
    fraction = front / (x + 1 - a - _fold(lambda v, m: m * (m - a) / (x + 2 * m + 1 - a - v)))
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - series).otherwise(fraction)


def chi2_tail(stat: Column, freedom: Column) -> Column:
    """Chance of a larger chi-squared value."""
    return upper_gamma(freedom / 2.0, stat / 2.0)


def f_tail(stat: Column, top: Column, bottom: Column) -> Column:
    """Chance of a larger F value."""
    return incomplete_beta(bottom / 2.0, top / 2.0, bottom / (bottom + top * stat))


def t_two_sided(stat: Column, freedom: Column) -> Column:
    """Chance of a t value farther from 0."""
    return incomplete_beta(freedom / 2.0, F.lit(0.5), freedom / (freedom + stat * stat))


def normal_two_sided(stat: Column) -> Column:
    """Chance of a standard normal value farther from 0."""
    return upper_gamma(F.lit(0.5), stat * stat / 2)


def normal_upper(stat: Column) -> Column:
    """Chance of a larger standard normal value."""
    half = normal_two_sided(stat) / 2
    return F.when(stat >= 0, half).otherwise(1 - half)
