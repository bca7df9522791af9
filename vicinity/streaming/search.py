"""A stream of queries against static nodes: each micro-batch is answered by the exact search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vicinity.operators.knn import search


def answer_stream(queries: DataFrame, nodes: DataFrame, out: str, checkpoint: str, k: int) -> StreamingQuery:
    """Write (qid, rank, id, d2) below `out`, a folder per batch; a batch that is run again replaces its folder."""

    def batch(asked: DataFrame, number: int) -> None:
        search(nodes, asked, k).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
