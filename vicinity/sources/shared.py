"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, and only in local mode, a temporary folder is made and set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    own = getattr(spark.sparkContext, "_vicinity_dir", None)
    if own is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="vicinity-")
        spark.sparkContext.setCheckpointDir(own)
        spark.sparkContext._vicinity_dir = own
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_dir(spark)}/vicinity/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a new table in the shared folder, where the lineage ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstored(df: DataFrame) -> None:
    """Delete a table that `stored` has written and that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
