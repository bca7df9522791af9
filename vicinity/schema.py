"""The tables of the engine and the checks on them.

nodes    id, c (category), t (time in [0, 1]), vec
queries  qid, qtype, v (category), l, r (time range, both ends inclusive), qvec
result   qid, rank (from 1), id, d2 (squared Euclidean distance), by (d2, id)

Query types: 0 none, 1 category, 2 time range, 3 both. Attributes that a type
does not use are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("c", T.IntegerType()), T.StructField("t", T.DoubleType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
QUERIES = T.StructType(
    [
        T.StructField("qid", T.LongType()),
        T.StructField("qtype", T.IntegerType()),
        T.StructField("v", T.IntegerType()),
        T.StructField("l", T.DoubleType()),
        T.StructField("r", T.DoubleType()),
        T.StructField("qvec", T.ArrayType(T.FloatType())),
    ]
)
TYPES = (0, 1, 2, 3)
SLICES = 10


def as_nodes(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in NODES])


def as_queries(df: DataFrame) -> DataFrame:
    """The query columns; a type outside 0..3 fails the job, as it has no meaning."""
    known = F.when(F.col("qtype").isin(*TYPES), F.col("qtype")).otherwise(F.raise_error(F.concat(F.lit("unknown query type "), F.coalesce(F.col("qtype").cast("string"), F.lit("null")))).cast("int"))
    return df.withColumn("qtype", known).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in QUERIES])
