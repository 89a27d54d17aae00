"""Distances between two vector columns of one row. Lower is nearer for every metric."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def l2_squared(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null when either vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    if metric == "l2sq":
        return l2_squared(a, b)
    if metric == "cosine":
        return F.lit(1.0) - cosine_similarity(a, b)
    if metric == "ip":
        return F.lit(1.0) - dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")
