"""Recall against the truth, and statistics over queries.

eval rows are (qid, qtype, selectivity, hits), hits being how many of the truth's
ids a result has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.operators.knn import search, top

BINS = 10


def hits(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, hits, expected) for every query of the truth."""
    found = truth.select("qid", "id").join(result.select("qid", "id").distinct().withColumn("_hit", F.lit(1)), ["qid", "id"], "left")
    return found.groupBy("qid").agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("expected"))


def recall(per_query: DataFrame) -> DataFrame:
    return per_query.agg((F.sum("hits") / F.sum("expected")).alias("recall"))


def by_type(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("qtype").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hits"), 9).alias("mean_hits"), F.round(F.avg("selectivity"), 9).alias("mean_selectivity"))


def bin_of(selectivity: Column) -> Column:
    """Ten bins; the last one is closed."""
    return F.least(F.floor(selectivity * BINS), F.lit(BINS - 1)).cast("int")


def selectivity_histogram(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("qtype", bin_of(F.col("selectivity")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def hits_frequency(evaluated: DataFrame, threshold: float) -> DataFrame:
    """How often each number of hits occurs, per type and side of a selectivity threshold."""
    return evaluated.groupBy("qtype", side(threshold), "hits").agg(F.count(F.lit(1)).alias("n"))


def good_share(evaluated: DataFrame, good: int, least: float, qtype: int = 2) -> DataFrame:
    """Per bin of selectivity the share of a type's queries with at least `good` hits."""
    rows = evaluated.where((F.col("qtype") == qtype) & (F.col("selectivity") >= least))
    return rows.groupBy(bin_of(F.col("selectivity")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("hits") >= good).cast("double")), 9).alias("share"))


def by_ceiling(evaluated: DataFrame) -> DataFrame:
    """Per tenth of selectivity, rounded up."""
    return evaluated.groupBy(tenth()).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hits"), 9).alias("mean_hits"))


def sides(evaluated: DataFrame, threshold: float) -> DataFrame:
    """Queries under and from a threshold: how many, and their mean hits."""
    return evaluated.groupBy(side(threshold)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hits"), 9).alias("mean_hits"))


def times(timed: DataFrame, *keys: Column) -> DataFrame:
    """Of rows with `us`, a query's time in microseconds: how many, their total and mean time, by type, side, tenth or whatever the keys are."""
    return timed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("us").alias("total_us"), F.avg("us").alias("mean_us"))


def side(threshold: float) -> Column:
    return F.when(F.col("selectivity") < threshold, "scan").otherwise("graph").alias("side")


def tenth() -> Column:
    """The tenth of selectivity, rounded up."""
    return F.ceil(F.col("selectivity") * BINS).cast("int").alias("tenth")


def scatter(timed: DataFrame) -> DataFrame:
    """What a plot of selectivity against time and hits needs, of each query."""
    return timed.select("qid", "qtype", "selectivity", "us", "hits")


def graph_recall(edges: DataFrame, nodes: DataFrame, k: int, every: int = 20) -> DataFrame:
    """The share of the k nearest others that a neighbour graph has, of the nodes whose id `every` divides, against all nodes."""
    asked = nodes.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.lit(0).alias("qtype"), F.lit(None).cast("int").alias("v"), F.lit(None).cast("double").alias("l"), F.lit(None).cast("double").alias("r"), F.col("vec").alias("qvec"))
    truth = top(search(nodes, asked, k + 1).where("qid != id").drop("rank"), k)
    return recall(hits(edges.select(F.col("src").alias("qid"), F.col("dst").alias("id")), truth))


def product_bound(coded: DataFrame, limit: int = (1 << 15) - 1) -> DataFrame:
    """One row: the largest square sum of codes, and whether every product of two rows' codes fits the limit.

    No product of two rows exceeds the larger square sum, so one aggregate says
    for all pairs that they fit; where it does not, some row's with itself does not.
    """
    return code_overflow(coded, -1).agg(F.max("square_sum").alias("most")).withColumn("fits", F.coalesce(F.col("most") <= limit, F.lit(True)))


def code_overflow(coded: DataFrame, limit: int = 1 << 16) -> DataFrame:
    """Rows whose codes' square sum exceeds a limit."""
    square = F.aggregate(F.transform("code", lambda x: (x * x).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return coded.select("id", square.alias("square_sum")).where(F.col("square_sum") > limit)


def centroid(nodes: DataFrame) -> DataFrame:
    """(pos, mean) of each dimension."""
    return nodes.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("mean"))
