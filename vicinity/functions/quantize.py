"""Scalar quantizers: training is one aggregate over all rows, encoding a projection.

sq8sym  one scale for all dimensions, codes -127..127
sq8     a range for each dimension, codes 0..255
sq4     one range for all dimensions, codes 0..15
fp32    the vector itself
A range of width 0, or a scale of 0, gives code 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train_sq8sym(nodes: DataFrame) -> DataFrame:
    """One row: alpha, the largest absolute element."""
    return nodes.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).alias("alpha"))


def encode_sq8sym(vec: Column, alpha: Column) -> Column:
    one = lambda x: F.when(alpha > 0, F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") / alpha)) * 127)).otherwise(0)
    return F.transform(vec, lambda x: one(x).cast("int"))


def train_sq8(nodes: DataFrame) -> DataFrame:
    """A row per dimension: pos, low, width."""
    each = nodes.select(F.posexplode("vec").alias("pos", "x"))
    ends = each.groupBy("pos").agg(F.min(F.col("x").cast("double")).alias("low"), F.max(F.col("x").cast("double")).alias("high"))
    return ends.select("pos", "low", (F.col("high") - F.col("low")).alias("width"))


def sq8_row(trained: DataFrame) -> DataFrame:
    """The ranges as one row of arrays: as many entries as the vectors have dimensions."""
    listed = trained.agg(F.array_sort(F.collect_list(F.struct("pos", "low", "width"))).alias("d"))
    return listed.select(F.transform("d", lambda x: x["low"]).alias("low"), F.transform("d", lambda x: x["width"]).alias("width"))


def encode_sq8(vec: Column, low: Column, width: Column) -> Column:
    share = F.zip_with(F.zip_with(vec, low, lambda x, m: x.cast("double") - m), width, lambda x, w: F.when(w > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / w))).otherwise(0.0))
    return F.transform(share, lambda s: F.floor(s * 255).cast("int"))


def train_sq4(nodes: DataFrame) -> DataFrame:
    """One row: low and width over all dimensions."""
    ends = nodes.agg(F.min(F.array_min("vec")).cast("double").alias("low"), F.max(F.array_max("vec")).cast("double").alias("high"))
    return ends.select("low", (F.col("high") - F.col("low")).alias("width"))


def encode_sq4(vec: Column, low: Column, width: Column) -> Column:
    share = lambda x: F.when(width > 0, F.least(F.lit(0.999), F.greatest(F.lit(0.0), (x.cast("double") - low) / width))).otherwise(0.0)
    return F.transform(vec, lambda x: F.floor(share(x) * 16).cast("int"))


def pack_sq4(codes: Column) -> Column:
    """Two codes a byte, the first in the low half, as hexadecimal pairs joined to binary."""
    pairs = F.transform(F.filter(codes, lambda _, i: i % 2 == 0), lambda a, i: F.lpad(F.lower(F.hex((a + 16 * F.coalesce(F.get(codes, 2 * i + 1), F.lit(0))).cast("long"))), 2, "0"))
    return F.unhex(F.array_join(pairs, ""))


#: Quantizer of each level of precision.
LEVELS = {0: "fp32", 1: "sq8", 2: "sq8", 3: "sq8sym"}


def quantizer(level: int) -> str:
    """The quantizer's name of a level of precision."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}; known: {sorted(LEVELS)}")
    return LEVELS[level]


def trained(nodes: DataFrame, name: str) -> tuple:
    """A quantizer's parameters, in one pass over the nodes: as many numbers as a vector has, at most twice."""
    if name == "fp32":
        return ()
    return tuple({"sq8sym": train_sq8sym, "sq8": lambda n: sq8_row(train_sq8(n)), "sq4": train_sq4}[name](nodes).first())


def encoded(nodes: DataFrame, name: str, vec: str = "vec", known: tuple | None = None) -> DataFrame:
    """The rows with `code`. The quantizer is trained on the rows themselves unless its parameters are known."""
    if name == "fp32":
        return nodes.withColumn("code", F.col(vec))
    code = {"sq8sym": encode_sq8sym, "sq8": encode_sq8, "sq4": encode_sq4}[name]
    one = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x).cast("double")
    return nodes.withColumn("code", code(F.col(vec), *map(one, trained(nodes, name) if known is None else known)))
