"""Nodes and queries from the embeddings and events tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.sources.tables import table

#: Every row whose id this divides is a query.
QUERY_EVERY = 20


def nodes(spark: SparkSession, root: str) -> DataFrame:
    """Embeddings with their event's time, scaled to [0, 1] over the joined rows."""
    events = table(spark, root, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    joined = table(spark, root, "embeddings").join(events, F.col("vec_id") == F.col("event_id"))
    ends = joined.agg(F.min("us").alias("first"), F.max("us").alias("last"))
    at = joined.join(F.broadcast(ends), F.lit(True))  # one row
    t = (F.col("us") - F.col("first")).cast("double") / (F.col("last") - F.col("first")).cast("double")
    return at.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("c"), t.alias("t"), F.col("embedding").alias("vec"))


def queries(base: DataFrame) -> DataFrame:
    """Every twentieth node as a query; the types alternate."""
    qtype = F.pmod(F.floor(F.col("id") / QUERY_EVERY), F.lit(4)).cast("int")
    return base.where(F.col("id") % QUERY_EVERY == 0).select(F.col("id").alias("qid"), qtype.alias("qtype"), F.col("c").alias("v"), (F.col("t") * 0.5).alias("l"), (F.col("t") * 0.5 + 0.4).alias("r"), F.col("vec").alias("qvec"))


#: The same as common table expressions for DuckDB.
SQL = f"""WITH n0 AS (SELECT vec_id AS id, label AS c, epoch_us(ts) AS us, embedding AS vec FROM embeddings JOIN events ON vec_id = event_id),
ends AS (SELECT min(us) AS a, max(us) AS z FROM n0),
nodes AS (SELECT id, c, CAST(us - a AS DOUBLE) / CAST(z - a AS DOUBLE) AS t, vec FROM n0, ends),
queries AS (SELECT id AS qid, CAST((id // {QUERY_EVERY}) % 4 AS INTEGER) AS qtype, c AS v, t * 0.5 AS l, t * 0.5 + 0.4 AS r, vec AS qvec FROM nodes WHERE id % {QUERY_EVERY} = 0)"""
