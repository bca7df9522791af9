"""Distances as column expressions. All Euclidean ones are squared; elements are widened before they are subtracted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column, kind: str) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), "double")


def ip(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), "double")


def neg_ip(a: Column, b: Column) -> Column:
    return -ip(a, b)


def one_minus_ip(a: Column, b: Column) -> Column:
    return F.lit(1.0) - ip(a, b)


def code_l2sq(a: Column, b: Column) -> Column:
    """Between integer codes, exact."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), "long")


def mixed_l2sq(query: Column, code: Column, low: Column, width: Column) -> Column:
    """Float query against per-dimension codes 0..255, scaled by 255 squared: each code stands for the middle of its step."""
    both = F.zip_with(F.arrays_zip(query.alias("x"), code.alias("y")), F.arrays_zip(low.alias("m"), width.alias("w")), lambda p, q: 255.0 * p["x"].cast("double") - ((p["y"].cast("double") + 0.5) * q["w"] + 255.0 * q["m"]))
    return _sum(F.transform(both, lambda d: d * d), "double")


def mixed_neg_ip(query: Column, code: Column, low: Column, width: Column) -> Column:
    """The negated inner product with the vector that the codes stand for."""
    both = F.zip_with(F.arrays_zip(query.alias("x"), code.alias("y")), F.arrays_zip(low.alias("m"), width.alias("w")), lambda p, q: p["x"].cast("double") * ((p["y"].cast("double") + 0.5) * q["w"] / 255.0 + q["m"]))
    return -_sum(both, "double")


#: Metrics by name: smaller is nearer.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"L2": l2sq, "IP": neg_ip}


def metric(name: str) -> Callable[[Column, Column], Column]:
    if name.upper() not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name.upper()]


def hash_vector(vec: Column) -> Column:
    return F.xxhash64(vec)
