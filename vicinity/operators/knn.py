"""Exact filtered nearest neighbours: for every query the k nearest nodes that satisfy its predicate.

`search` is the fast path. Queries go to the executors in blocks of about
BLOCK_ROWS rows; the nodes are scanned once a block, a batch of nodes meets the
block in matrix products, category by category where the queries ask for one, and
each task sends on only its own k best per query. So what is shuffled is tasks x
queries x k rows, no pair of all others. Shuffling nodes or queries to each other
instead would move nodes x blocks or queries x parts vectors, while a scan for
each block reads the same nodes and moves none.

`joined` is the same in plain joins, for small inputs and as a check: types 1 and
3 join on the category, type 2 on time slices, type 0 on nothing.

Results are (qid, rank, id, d2) by (d2, id); fewer than k matches give fewer rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinity.functions.vector import l2sq
from vicinity.functions.vector import metric as known_metric
from vicinity.operators.predicates import matches, slice_of, slices_between
from vicinity.sources.shared import stored

K = 100
#: Rows of queries that are sent at once: with 100 dimensions about 4 MB.
BLOCK_ROWS = 10_000
#: Nodes that meet a block at once, bounding the distance matrix.
BATCH_ROWS = 2048
#: Pairs of a query and a node whose distances are taken exactly at once.
EXACT_PAIRS = 1 << 20


def top(pairs: DataFrame, k: int, by: str = "d2") -> DataFrame:
    """The k best rows of each query by (distance, id), with rank from 1; Spark cuts to k before the shuffle too."""
    rank = F.row_number().over(W.partitionBy("qid").orderBy(by, "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def joined(nodes: DataFrame, queries: DataFrame, k: int = K, distance: Callable[[Column, Column], Column] = l2sq, types: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    parts = []
    for qtype in types:
        asked = queries.where(F.col("qtype") == qtype)
        if qtype == 2:
            asked = asked.withColumn("slice", F.explode(slices_between(F.col("l"), F.col("r"))))
            pairs = nodes.withColumn("slice", slice_of(F.col("t"))).join(asked, "slice").where(matches(2))
        else:
            pairs = nodes.join(asked, matches(qtype))
        parts.append(pairs.select("qid", "id", distance(F.col("vec"), F.col("qvec")).alias("d2")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top(out, k).select("qid", "rank", "id", "d2")


class Block:
    """Queries as arrays, ready to be met by batches of nodes."""

    def __init__(self, rows: pa.Table):
        number = lambda name: rows.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.qid = rows.column("qid").to_numpy()
        qtype = rows.column("qtype").to_numpy()
        # an attribute that is null satisfies nothing
        self.l, self.r = number("l"), number("r")
        self.vec = matrix(rows.column("qvec").combine_chunks())
        self.square = (self.vec * self.vec).sum(1)
        self.ranged = np.isin(qtype, (2, 3))
        v, bound = number("v"), np.isin(qtype, (1, 3))
        self.free = np.flatnonzero(~bound)
        #: the queries of each category
        self.of = {c: np.flatnonzero(bound & (v == c)) for c in np.unique(v[bound & np.isfinite(v)])}

    def groups(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of nodes that the category lets meet."""
        if len(self.free):
            yield self.free, np.arange(len(c))
        if self.of:
            kinds, kind = np.unique(c, return_inverse=True)
            for i, x in enumerate(kinds.tolist()):
                if x in self.of:
                    yield self.of[x], np.flatnonzero(kind == i)

    def during(self, own: np.ndarray, t: np.ndarray) -> np.ndarray:
        return ((t[None, :] >= self.l[own, None]) & (t[None, :] <= self.r[own, None])) | ~self.ranged[own, None]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def search(nodes: DataFrame, queries: DataFrame, k: int = K, metric: str = "L2", predicate: Column | None = None) -> DataFrame:
    """The fast path. Nodes or queries without a vector are left out, and nodes for which `predicate` does not hold.

    With metric IP, d2 is the negated inner product. Of several blocks each one's
    result is stored before the next is sent, so that the driver and the executors
    hold one block at a time.
    """
    known_metric(metric)
    nodes = nodes if predicate is None else nodes.where(predicate)
    asked = queries.where(F.col("qvec").isNotNull()).select("qid", "qtype", "v", "l", "r", "qvec")
    n = max(1, -(-asked.count() // BLOCK_ROWS))
    out = None
    for b in range(n):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b) if n > 1 else asked
        sent = nodes.sparkSession.sparkContext.broadcast(part.toArrow())
        found = _scan(nodes, sent, k, metric.upper() == "IP")
        if n > 1:
            found = stored(found, "block")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _scan(nodes: DataFrame, sent, k: int, inner: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sent.value.num_rows:
            return
        block = Block(sent.value)
        best_d, best_id = np.full((len(block.qid), k), np.inf), np.zeros((len(block.qid), k), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                every, ids = matrix(part.column("vec")), part.column("id").to_numpy()
                c, t = (part.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False) for x in ("c", "t"))
                for q, n in block.groups(c):
                    vec = every[n]
                    step = max(1, EXACT_PAIRS // len(n))
                    for own in (q[a : a + step] for a in range(0, len(q), step)):
                        d = -(block.vec[own] @ vec.T) if inner else block.square[own, None] + (vec * vec).sum(1)[None, :] - 2 * block.vec[own] @ vec.T
                        d[~block.during(own, t[n]) | ~np.isfinite(d)] = np.inf
                        near_d, near_id = _nearest(block.vec[own], block.square[own], vec, ids[n], d, k, inner)
                        best_d[own], best_id[own] = _merge(np.concatenate([best_d[own], near_d], 1), np.concatenate([best_id[own], near_id], 1), k)
        q, j = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(block.qid[q]), pa.array(best_id[q, j]), pa.array(best_d[q, j])], names=["qid", "id", "d2"])

    scanned = nodes.where(F.col("vec").isNotNull()).select("id", "c", "t", "vec").mapInArrow(run, "qid long, id long, d2 double")
    return top(scanned, k).select("qid", "rank", "id", "d2")


def _nearest(asked: np.ndarray, square: np.ndarray, vec: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k best nodes by (exact distance, id), from distances d that the matrix product has rounded; inf where there are fewer.

    All nodes not farther than the k-th are taken exactly, with a margin for the
    rounding, so that of many equally far ones the smallest ids stay.
    """
    k = min(k, d.shape[1])
    out_d, out_id = np.full((len(d), k), np.inf), np.zeros((len(d), k), np.int64)
    if not k:
        return out_d, out_id
    far = np.partition(d, k - 1, axis=1)[:, k - 1]
    margin = 1e-12 * (square + (vec * vec).sum(1).max())
    q, j = np.nonzero(np.isfinite(d) & (d <= (far + margin)[:, None]))
    exact = np.empty(len(q))
    for a in range(0, len(q), 1 << 15):
        s = slice(a, a + (1 << 15))
        x, y = asked[q[s]], vec[j[s]]
        exact[s] = -(x * y).sum(1) if inner else ((x - y) * (x - y)).sum(1)
    order = np.lexsort((ids[j], exact, q))
    q, j, exact = q[order], j[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    best = place < k
    out_d[q[best], place[best]], out_id[q[best], place[best]] = exact[best], ids[j[best]]
    return out_d, out_id


def _merge(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k best by (distance, id)."""
    order = np.lexsort((ids, d), axis=1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)
