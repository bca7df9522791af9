"""Selectivity and the choice of a strategy for each query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.operators.predicates import ALL, category_counts, ranks


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the chooser; selectivities are shares of the actual number of nodes."""

    scan: float = 0.045
    scan_both: float = 0.08  # for queries with both predicates
    index: float = 0.045  # share of all nodes that a category needs to have an index
    ef_none: int = 425
    ef_category: int = 1800
    ef_category_span: int = 700
    ef_both_span: int = 1000
    full_low: float = 0.3
    full_high: float = 0.6
    ef_full: tuple[int, int, int] = (780, 630, 480)
    ef_part: tuple[int, int, int] = (1180, 780, 680)
    split: float = 0.2
    split_narrow: float = 0.5
    narrow: float = 0.2


def selectivity(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, qtype, hits, selectivity), also of queries that match nothing.

    Categories are counted once; what lies in a range is the difference of its
    ends' ranks among all nodes or those of the category.
    """
    n = nodes.agg(F.count(F.lit(1)).alias("_n"))
    by_category = category_counts(nodes).withColumnRenamed("n", "_c")
    base = queries.select("qid", "qtype", "v", "l", "r")
    key = F.when(F.col("qtype") == 2, F.lit(ALL)).otherwise(F.col("v").cast("string"))
    counted = ranks(nodes, base.where("qtype = 2 OR (qtype = 3 AND v IS NOT NULL)").select("qid", key.alias("key"), "l", "r")).select("qid", (F.col("upto") - F.col("below")).alias("_h"))
    all_ = base.join(F.broadcast(n), F.lit(True)).join(by_category, F.col("v") == F.col("c"), "left").join(counted, "qid", "left")
    hits = F.when(F.col("qtype") == 0, F.col("_n")).when(F.col("qtype") == 1, F.coalesce("_c", F.lit(0))).otherwise(F.coalesce("_h", F.lit(0))).cast("long")
    return all_.select("qid", "qtype", hits.alias("hits"), F.when(F.col("_n") > 0, hits / F.col("_n")).otherwise(0.0).alias("selectivity"))


def _by_width(sel: Column, values: tuple[int, int, int], low: float, high: float) -> Column:
    return F.when(sel < low, values[0]).when(sel < high, values[1]).otherwise(values[2])


def strategies(nodes: DataFrame, queries: DataFrame, at: Thresholds = Thresholds()) -> DataFrame:
    """(qid, qtype, hits, selectivity, strategy, ef): scan, category_graph, category_range_graph, slice_graphs or split_slices.

    ef of the category graphs grows with the category's size from the smallest
    category's to the largest one's; with one size only it is the least.
    Categories too small for an index are scanned.
    """
    sel = selectivity(nodes, queries)
    counts = category_counts(nodes)
    ends = counts.agg(F.min("n").alias("_min"), F.max("n").alias("_max"), F.sum("n").alias("_all"))
    with_size = sel.join(queries.select("qid", "v"), "qid").join(counts, F.col("v") == F.col("c"), "left").join(F.broadcast(ends), F.lit(True))
    share = F.when(F.col("_max") > F.col("_min"), (F.col("n") - F.col("_min")) / (F.col("_max") - F.col("_min"))).otherwise(0.0)
    s, kind = F.col("selectivity"), F.col("qtype")
    scanned = (kind != 0) & ((s < at.scan) | ((kind == 3) & (s < at.scan_both)) | (kind.isin(1, 3) & (F.coalesce("n", F.lit(0)) < at.index * F.col("_all"))))
    strategy = F.when(scanned, "scan").when(kind == 0, "slice_graphs").when(kind == 1, "category_graph").when(kind == 3, "category_range_graph").otherwise("split_slices")
    ef = F.when(scanned, None).when(kind == 0, at.ef_none).when(kind == 1, F.floor(at.ef_category + at.ef_category_span * share)).when(kind == 3, F.floor(at.ef_category + at.ef_both_span * share)).otherwise(_by_width(s, at.ef_full, at.full_low, at.full_high))
    return with_size.select("qid", "qtype", "hits", F.round(s, 9).alias("selectivity"), strategy.alias("strategy"), ef.cast("int").alias("ef"))
