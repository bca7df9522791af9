"""The raw binary formats: little-endian records of float32, with or without a leading uint32 count.

Files are read with Spark's binary reader, so from any store it reaches. One file
is one record there; large inputs are meant to come as several files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Rows of a file that go through Python at once.
CHUNK = 1 << 14


@dataclass(frozen=True)
class Layout:
    """Names of the leading float columns, then the vector's."""

    heads: tuple[str, ...]
    vector: str
    id: str


BASE = Layout(("c", "t"), "vec", "id")
QUERY = Layout(("qtype", "v", "l", "r"), "qvec", "qid")
_WHOLE = {"c", "qtype", "v"}


def _first_positions(files: DataFrame, header: int, record: int) -> dict[str, int]:
    """Of each file the number of records in the files before it, by name: one row per file comes to the driver."""
    first, total = {}, 0
    for name, length in sorted((r[0], r[1]) for r in files.select("path", "length").collect()):
        first[name] = total
        total += max(0, length - header) // record
    return first


def read(spark: SparkSession, path: str, layout: Layout, dim: int) -> DataFrame:
    """Records of one file, or of several in the order of their names; ids are positions in that order.

    A last record that is cut off is dropped; the count in the header is not trusted beyond the file's end.
    """
    files = spark.read.format("binaryFile").load(path)
    width = len(layout.heads) + dim
    first = _first_positions(files, 4, 4 * width)

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                (n,) = struct.unpack_from("<I", content)
                n = min(n, (len(content) - 4) // (4 * width))
                flat = np.frombuffer(content, "<f4", n * width, 4).reshape(n, width)
                for a in range(0, n, CHUNK):
                    part = flat[a : a + CHUNK]
                    out = {layout.id: np.arange(first[name] + a, first[name] + a + len(part))}
                    out |= {h: part[:, i].astype(np.int32 if h in _WHOLE else np.float64) for i, h in enumerate(layout.heads)}
                    yield pd.DataFrame(out | {layout.vector: list(part[:, len(layout.heads) :])})

    kinds = ", ".join([f"{layout.id} long", *(f"{h} {'int' if h in _WHOLE else 'double'}" for h in layout.heads), f"{layout.vector} array<float>"])
    return files.select("path", "content").mapInPandas(records, kinds)


def encode(df: DataFrame, layout: Layout) -> Iterator[bytes]:
    """The file's bytes from rows in the order of their ids, row by row: what a caller writes where it likes."""
    ordered = df.orderBy(layout.id).select(*layout.heads, layout.vector)
    yield struct.pack("<I", df.count())
    for row in ordered.toLocalIterator():
        yield np.array([*row[:-1], *row[-1]], "<f4").tobytes()


def encode_ids(result: DataFrame, k: int, header: bool) -> Iterator[bytes]:
    """Result (no header) or ground truth (with the number of rows first): k ids a query, by rank; a short list ends in the id 2^32 - 1."""
    from pyspark.sql import functions as F

    lists = result.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids")).orderBy("qid")
    if header:
        yield struct.pack("<I", lists.count())
    for row in lists.toLocalIterator():
        ids = [*row["ids"][:k], *[0xFFFFFFFF] * (k - len(row["ids"]))]
        yield np.array(ids, "<u4").tobytes()


def read_ids(spark: SparkSession, path: str, k: int, header: bool) -> DataFrame:
    """(qid, rank, id) from one file of encode_ids(), or several in the order of their names; qid is the position, the filler is left out."""
    files = spark.read.format("binaryFile").load(path)
    first = _first_positions(files, 4 * header, 4 * k)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                flat = np.frombuffer(content[4 * header : len(content) // 4 * 4], "<u4")
                ids = flat[: len(flat) // k * k].astype(np.int64)
                at = np.arange(len(ids))
                real = ids != 0xFFFFFFFF
                yield pd.DataFrame({"qid": first[name] + (at // k)[real], "rank": (at % k + 1)[real], "id": ids[real]})

    return files.select("path", "content").mapInPandas(rows, "qid long, rank int, id long")


def encode_floats(df: DataFrame, names: tuple[str, ...]) -> Iterator[bytes]:
    """Records of float32 without a header, in the order of qid: types and selectivities, or other statistics of queries."""
    for row in df.orderBy("qid").select(*names).toLocalIterator():
        yield np.array(tuple(row), "<f4").tobytes()


def read_floats(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """A file of records of float32 without a header (query statistics, types, selectivities), with their position as qid."""
    return _read_numbers(spark, path, names, "<f4")


def read_ints(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """The same of int32: hits of each query, categories."""
    return _read_numbers(spark, path, names, "<i4")


def _read_numbers(spark: SparkSession, path: str, names: tuple[str, ...], kind: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    first = _first_positions(files, 0, 4 * len(names))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                flat = np.frombuffer(content[: len(content) // 4 * 4], kind)
                flat = flat[: len(flat) // len(names) * len(names)].reshape(-1, len(names))
                flat = flat.astype(np.float64 if kind == "<f4" else np.int64)
                yield pd.DataFrame({"qid": first[name] + np.arange(len(flat))} | {n: flat[:, i] for i, n in enumerate(names)})

    as_sql = "double" if kind == "<f4" else "long"
    return files.select("path", "content").mapInPandas(rows, ", ".join(["qid long", *(f"{n} {as_sql}" for n in names)]))
