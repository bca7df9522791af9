"""The four query predicates, time slices, and how a range falls onto slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.schema import SLICES

#: The key of all nodes, beside the categories' own.
ALL = ""
#: Cells of about equally many nodes in which ranks are counted.
CELLS = 200


def matches(qtype: int) -> Column:
    """The predicate of a type between node columns (c, t) and query columns (v, l, r)."""
    category, during = F.col("c") == F.col("v"), F.col("t").between(F.col("l"), F.col("r"))
    return {0: F.lit(True), 1: category, 2: during, 3: category & during}[qtype]


def any_match() -> Column:
    """The predicate of whatever type the query has."""
    out = F.lit(False)
    for qtype in (3, 2, 1, 0):
        out = F.when(F.col("qtype") == qtype, matches(qtype)).otherwise(out)
    return out


def slice_of(t: Column) -> Column:
    """Each time is in one slice; those outside [0, 1] are in the first or last."""
    return F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor(t * SLICES))).cast("int")


def slices_between(low: Column, high: Column) -> Column:
    """The slices that a range can touch; none if it is empty."""
    return F.when(low <= high, F.sequence(slice_of(low), slice_of(high))).otherwise(F.array().cast("array<int>"))


def category_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def category_extremes(nodes: DataFrame) -> DataFrame:
    """One row: the largest category (of equals the smallest c), the most and the fewest rows of one."""
    return category_counts(nodes).agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("largest"), F.max("n").alias("most"), F.min("n").alias("fewest"))


def category_map(nodes: DataFrame, share: float) -> DataFrame:
    """Categories that hold at least a share of all rows, with where they would start in (c, t) order of those kept."""
    from pyspark.sql.window import Window as W

    counts = category_counts(nodes)
    total = counts.agg(F.sum("n").alias("_all"))
    kept = counts.join(F.broadcast(total), F.lit(True)).where(F.col("n") >= share * F.col("_all")).drop("_all")
    before = W.orderBy("c").rowsBetween(W.unboundedPreceding, -1)  # over categories, not rows
    return kept.select("c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n")


def slice_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(slice_of(F.col("t")).alias("slice")).agg(F.count(F.lit(1)).alias("n"))


def ranks(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, key, below, upto) for asked (qid, key, l, r): how many nodes have t < l, and how many t <= r; key is a category as text, or ALL.

    Nodes and the ends of ranges are put in order of time together and counted
    in passing, so the work is a sort of nodes + queries and no pair is formed.
    The order is cut into cells by quantiles of t, each summed on its own; equal
    times are one row before that, so neither a category nor a moment is one task.
    A null or empty range counts nothing between its ends.
    """
    from pyspark.sql.window import Window as W

    # a node counts once among all and once in its category; one without a category only among all
    points = nodes.where("t IS NOT NULL").select(F.explode(F.array_distinct(F.array(F.lit(ALL), F.coalesce(F.col("c").cast("string"), F.lit(ALL))))).alias("key"), "t").groupBy("key", "t").agg(F.count(F.lit(1)).alias("n"))
    ends = asked.where("l <= r").select("qid", "key", F.explode(F.array(F.struct(F.col("l").alias("t"), F.lit(0).alias("kind")), F.struct(F.col("r").alias("t"), F.lit(2).alias("kind")))).alias("e"))
    events = ends.select("key", "e.t", "e.kind", "qid", F.lit(0).cast("long").alias("n")).unionByName(points.select("key", "t", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("qid"), "n"))
    cuts = nodes.agg(F.percentile_approx("t", F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)]), F.lit(10 * CELLS)).alias("_cuts"))
    celled = events.join(F.broadcast(cuts), F.lit(True)).withColumn("cell", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda x: x < F.col("t")))).drop("_cuts")
    inside = F.sum("n").over(W.partitionBy("key", "cell").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    within = celled.withColumn("_in", inside).where("kind != 1")
    sums = celled.groupBy("key", "cell").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    full = within.join(sums.select("key", "cell", before.alias("_before")), ["key", "cell"]).withColumn("at", F.col("_before") + F.col("_in"))
    return full.groupBy("qid", "key").agg(F.max(F.when(F.col("kind") == 0, F.col("at"))).alias("below"), F.max(F.when(F.col("kind") == 2, F.col("at"))).alias("upto"))


def interval_split(nodes: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(qid, slice, class, local): FULL, MEDIUM or SMALL for each slice that a query's range touches.

    local is the share of the slice's rows in the range; SMALL is a share under
    the threshold. Slices follow each other in time, so the rows of a slice have
    neighbouring ranks, and what a range has of them follows from its ends' ranks.
    """
    from pyspark.sql.window import Window as W

    counts = slice_counts(nodes.where("t IS NOT NULL"))
    upto = F.sum("n").over(W.orderBy("slice"))  # over SLICES rows
    bounds = counts.select("slice", "n", (upto - F.col("n")).alias("_from"), upto.alias("_to"))
    asked = queries.select("qid", "l", "r", F.explode(slices_between(F.col("l"), F.col("r"))).alias("slice"))
    at = ranks(nodes, queries.select("qid", F.lit(ALL).alias("key"), "l", "r")).drop("key")
    joined = asked.join(F.broadcast(bounds), "slice").join(at, "qid")
    hits = F.greatest(F.lit(0), F.least("upto", "_to") - F.greatest("below", "_from"))
    local = hits / F.col("n")
    first, last = F.col("slice") / SLICES, (F.col("slice") + 1) / SLICES
    kind = F.when((F.col("l") <= first) & (F.col("r") >= last), "FULL").when(local < threshold, "SMALL").otherwise("MEDIUM")
    return joined.select("qid", "slice", kind.alias("class"), F.round(local, 9).alias("local"))


def sorted_base(nodes: DataFrame) -> DataFrame:
    """The nodes in (c, t, id) order, with their place within the category."""
    from pyspark.sql.window import Window as W

    return nodes.select("id", "c", "t", F.row_number().over(W.partitionBy("c").orderBy("t", "id")).alias("place"))


def _largest(nodes: DataFrame) -> Column:
    """Whether a node is of the largest category (of equals the smallest c): one number that is known before the sort."""
    row = category_extremes(nodes).first()
    return F.coalesce(F.col("c") == F.lit(row["largest"]).cast("int"), F.lit(False))


def sorted_by_time(nodes: DataFrame) -> DataFrame:
    """The nodes in (t, id) order, with their slice and their place in it: slices follow each other, so no task sorts all."""
    from pyspark.sql.window import Window as W

    sliced = nodes.select("id", "t", slice_of(F.col("t")).alias("slice"))
    return sliced.withColumn("place", F.row_number().over(W.partitionBy("slice").orderBy("t", "id")))


def sorted_largest_first(nodes: DataFrame) -> DataFrame:
    """The largest category before all others, each of both in (t, id) order by slices."""
    from pyspark.sql.window import Window as W

    sliced = nodes.select("id", "t", _largest(nodes).alias("largest"), slice_of(F.col("t")).alias("slice"))
    return sliced.withColumn("place", F.row_number().over(W.partitionBy("largest", "slice").orderBy("t", "id")))


def clustered(nodes: DataFrame, how: str, parts: int) -> DataFrame:
    """All columns, dealt into `parts` ranges and sorted in them, for a table that is to be written: by `category` and time, `time`, or `largest` category first and then time."""
    orders = {"category": ["c", "t", "id"], "time": ["t", "id"], "largest": ["_rest", "t", "id"]}
    if how not in orders:
        raise ValueError(f"unknown order {how!r}; known: {', '.join(orders)}")
    keyed = nodes.withColumn("_rest", ~_largest(nodes)) if how == "largest" else nodes
    return keyed.repartitionByRange(parts, *orders[how]).sortWithinPartitions(*orders[how]).drop("_rest")


def sorted_queries(queries: DataFrame) -> DataFrame:
    """The queries by type, category and range, with their place among those of their type: like ones stand together."""
    from pyspark.sql.window import Window as W

    order = W.partitionBy("qtype").orderBy("v", "l", "r", "qid")
    return queries.select("qid", "qtype", "v", "l", "r", F.row_number().over(order).alias("place"))


def without_deleted(nodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    return nodes.join(tombstones.select("id"), "id", "left_anti")


def allowed(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id"), "id", "left_semi")
