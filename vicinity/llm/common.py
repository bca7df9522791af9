"""What the operators share: tables in the shared folder, and small column helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.sources.shared import new_path

#: The characters that separate words: space and \x09-\x0D. Python's bytes.split() splits at the same six.
WORD_GAP = r"[\x20\x09-\x0D]+"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders this process has written and not yet deleted, by their owner.
_written: dict[str, list[str]] = {"": []}
_owner = ""


@contextmanager
def owned_by(owner: str) -> Iterator[None]:
    """Tables written meanwhile belong to `owner`, who can release() them."""
    global _owner
    before, _owner = _owner, owner
    try:
        yield
    finally:
        _owner = before


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    path = new_path(spark, name)
    _written.setdefault(_owner, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: the lineage ends there, so a lost executor costs no recomputation.

    The shuffle files that made the table go as soon as it is written.
    """
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: About the rows of a file of a table of numbers.
FILE_ROWS = 500_000


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """At most `rows` short rows, in as few partitions as their number asks for: small tables are few files, large ones many."""
    return df.coalesce(ceil_div(rows, FILE_ROWS) or 1)


def release(spark: SparkSession, owner: str) -> int:
    """Delete the tables of an owner; returns how many. Call it when every result that reads them has been stored."""
    gone = _written.pop(owner, [])
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
    return len(gone)


#: Bits of a bit table: 64 or more for each hash in it, up to the most, which are 32 MB.
LEAST_BITS, MOST_BITS = 16, 28


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Of a table of different longs, its only column, a table with the bits set that they select: at most 2 ** MOST_BITS, however many they are.

    It never denies a hash that is there; the fuller it is, the more others it lets through.
    """
    name = hashes.columns[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * hashes.count()).bit_length()))
    slot = F.shiftrightunsigned(name, 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (slot.bitwiseAND(F.lit(63))).cast("int"))
    cells = hashes.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return table


def has_bit(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of these hashes (unsigned) select a set bit."""
    slot = hashes >> np.uint64(64 - (len(table) * 64).bit_length() + 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def forget(owner: str) -> None:
    """Leave the tables of an owner where they are, for good."""
    _written.pop(owner, None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written meanwhile are deleted at the end, but for those written by the function that this gives."""
    outer, owner = _owner, uuid.uuid4().hex

    def lasting(df: DataFrame, name: str) -> DataFrame:
        with owned_by(outer):
            return written(df, name)

    with owned_by(owner):
        try:
            yield lasting
        finally:
            release(spark, owner)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def ceil_div(n: int, by: int) -> int:
    return -(-n // by)


_BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows, after a setting of their session, unless it has one of its own: Arrow batches of at most about BATCH_BYTES or one row, where Spark would send 64 MB at once.

    Every table that goes through Python goes through this first, so that what an
    executor holds does not follow the rows' number and length.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df


def in_slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text, or of one row, so that Python holds little at once."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and (total + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
