"""Aggregate columns for forecast errors. Rows with a null actual or forecast don't count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def _both(y: Column, p: Column, value: Column) -> Column:
    return F.when(y.isNotNull() & p.isNotNull(), value)


def pairs(y: Column, p: Column) -> Column:
    return F.count(_both(y, p, F.lit(1)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(p - y))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((p - y) * (p - y)))


def mape(y: Column, p: Column) -> Column:
    """A fraction; the denominator is at least EPS."""
    return F.avg(F.abs(p - y) / F.greatest(F.abs(y), F.lit(EPS)))


def bias(y: Column, p: Column) -> Column:
    return F.avg(p - y)


def r2(y: Column, p: Column) -> Column:
    """1 - SSE / SST; null for fewer than two pairs or a constant actual."""
    own = _both(y, p, y)
    sst = F.sum(own * own) - F.sum(own) * F.sum(own) / F.count(own)
    return F.when(pairs(y, p) > 1, 1 - F.try_divide(F.sum((p - y) * (p - y)), sst))


def coverage(y: Column, low: Column, high: Column) -> Column:
    return F.avg(y.between(low, high).cast("int"))


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs, from sums; null where a side is constant."""
    a, b = _both(x, y, x), _both(x, y, y)
    n = F.count(a)
    cov = n * F.sum(a * b) - F.sum(a) * F.sum(b)
    var = (n * F.sum(a * a) - F.sum(a) * F.sum(a)) * (n * F.sum(b * b) - F.sum(b) * F.sum(b))
    return F.try_divide(cov, F.sqrt(F.when(var > 1e-9, var)))


def point_metrics(y: Column, p: Column) -> dict[str, Column]:
    return {"n": pairs(y, p), "mae": mae(y, p), "rmse": rmse(y, p), "mape": mape(y, p), "r2": r2(y, p), "bias": bias(y, p)}
