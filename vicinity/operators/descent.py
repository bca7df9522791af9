"""Neighbour descent: an approximate k-nearest graph by local joins.

Nodes are dealt by their ids to shards of a bounded number of nodes; one row holds a
shard's ids, vectors and lists of neighbours as flat arrays. In a round each shard
learns which nodes link to its own (`links`), asks the members of its nodes' local
joins for their vectors (`met`, `given`), compares the members of a node with each
other (`joined`), and sends what is nearer than the last of a list to the list's
owner (`kept`). A task holds one shard and what it asked for. Pairs never meet in a join of
Spark's; rows (MAIL) carry arrays between shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from vicinity.operators.hashing import unit
from vicinity.operators.knn import matrix, search, top
from vicinity.sources.shared import stored, unstored

#: The share of new edges at which descent ends.
SETTLED = 0.001
#: The share of new edges below which lists that lack recall are widened.
SLOW = 0.1
#: The least recall, against brute force for SAMPLE nodes, that ends the descent.
RECALL = 0.92
SAMPLE = 256
#: Nodes of a shard, about, with up to 64 dimensions; fewer with more. Twice as many where all vectors have at most
#: ALL elements, for a shard may ask for any vector.
CENTERS, ALL = 6144, 1 << 24
#: The start: so many times the nodes are put in another order of space, and about LEAF that follow each other meet.
DRAWS, LEAF, BITS = 6, 1536, 24
#: The most cells of the distances that are held at once, and of pairs not yet cut to the best.
_CELLS, _PAIRS = 1 << 18, 1 << 22
#: Messages to shards. Kinds: nodes (a ids, v vectors), lists (a ids, b and d their neighbours, f which are new, last
#: the last distance of each), last (a ids, d those), links (a node, b who links to it, d, f), members (a place of the node, b member, f new), asked (a ids, b the asking shard), given (a ids,
#: d the last distance of their lists, v vectors), found (a node, b neighbour, d).
MAIL = "shard int, kind string, a binary, b binary, d binary, f binary, v binary, last binary, edges long, new long"
_MAIL = pa.schema([("shard", pa.int32()), ("kind", pa.string()), *((x, pa.binary()) for x in ("a", "b", "d", "f", "v", "last")), ("edges", pa.int64()), ("new", pa.int64())])
_TYPES = {"a": np.int64, "b": np.int64, "d": np.float64, "f": np.bool_}


def _row(shard: int, kind: str, edges: int | None = None, new: int | None = None, **arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"shard": int(shard), "kind": kind, "edges": edges, "new": new, **{x: np.ascontiguousarray(y).tobytes() for x, y in arrays.items()}}], schema=_MAIL)


class _Mail:
    """The arrays of the messages to one shard."""

    def __init__(self, shard: int, real: str):
        self.real, self.shard = np.dtype(real), shard
        self.rows: dict[tuple[str, str], list] = {}

    def get(self, kind: str, name: str) -> np.ndarray:
        """The array of all messages of a kind, which are then forgotten."""
        parts = self.rows.pop((kind, name), [])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, _TYPES.get(name, self.real))

    def vectors(self, kind: str, n: int) -> np.ndarray:
        flat = self.get(kind, "v")
        return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _read(batches: Iterator[pa.RecordBatch], real: str) -> dict[int, _Mail]:
    """The messages by shard."""
    mail: dict[int, _Mail] = {}
    for batch in batches:
        shards, kinds = batch.column("shard").to_pylist(), batch.column("kind").to_pylist()
        for x in ("a", "b", "d", "f", "v"):
            for shard, kind, value in zip(shards, kinds, batch.column(x), strict=True):
                if value.is_valid:
                    own = mail.setdefault(shard, _Mail(shard, real))
                    own.rows.setdefault((kind, x), []).append(np.frombuffer(value.as_buffer(), _TYPES.get(x, own.real)))
    return mail


def _shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    return np.minimum((unit(ids) * shards).astype(np.int64), shards - 1)


def _sent(kind: str, to: np.ndarray, **arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A message to each shard in `to`, with its part of the arrays."""
    order = np.argsort(to, kind="stable")
    known, first = np.unique(to[order], return_index=True)
    for shard, own in zip(known.tolist(), np.split(order, first[1:]) if len(known) else [], strict=True):
        yield _row(shard, kind, **{x: y[own] for x, y in arrays.items()})


def _exact(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (x[a], y[b])."""
    out = np.empty(len(a))
    for i in range(0, len(a), 1 << 11):
        s = slice(i, i + (1 << 11))
        gap = x[a[s]].astype(np.float64) - y[b[s]]
        out[s] = (gap * gap).sum(1)
    return out


def _ranks(sorted_keys: np.ndarray) -> np.ndarray:
    """Each row's place among those of its key."""
    return np.arange(len(sorted_keys)) - np.searchsorted(sorted_keys, sorted_keys)


def _first(*keys: np.ndarray) -> np.ndarray:
    """Which of sorted rows are the first of their keys."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _best(a: np.ndarray, b: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """The places of each a's `most` nearest, in order."""
    order = np.lexsort((b, d, a))
    return order[_ranks(a[order]) < most]


def _coded(own: DataFrame, planes: list[np.ndarray], element: str) -> DataFrame:
    """The nodes once a draw, with a code whose bits tell the sides of planes midway between two nodes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = matrix(batch.column("vec"))
            for draw, ends in enumerate(planes):
                p, q = ends[0::2], ends[1::2]
                with np.errstate(all="ignore"):
                    side = vec @ (p - q).T > ((p * p).sum(1) - (q * q).sum(1)) / 2
                code = side.astype(np.int64) @ (1 << np.arange(len(p), dtype=np.int64)[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), draw, np.int32)), pa.array(code), batch.column("id"), batch.column("vec")], names=["draw", "code", "id", "vec"])

    return own.select("id", "vec").mapInArrow(run, f"draw int, code long, id long, vec array<{element}>")


def _start(own: DataFrame, shards: int, width: int, seed: int, element: str) -> DataFrame:
    """Each node's nearest among those that the codes put beside it, as messages."""
    ends = own.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(2 * BITS * DRAWS).select("vec").toArrow()
    some = matrix(ends.column("vec").combine_chunks()) if ends.num_rows else np.empty((0, 0))
    chance = np.random.default_rng(seed)
    planes = [some[chance.integers(len(some), size=2 * BITS)] for _ in range(DRAWS)] if len(some) else []
    leaf = max(LEAF, 4 * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("draw", pa.int32()), ("id", pa.int64()), ("vec", pa.list_(pa.float64()))]))])
        draw, ids, vec = table.column("draw").to_numpy(), table.column("id").to_numpy(), matrix(table.column("vec").combine_chunks())
        parts: list[tuple] = [(np.empty(0, np.int64),) * 2 + (np.empty(0),)]
        for of in np.unique(draw):
            rows = np.flatnonzero(draw == of)
            for own in np.array_split(rows, -(-len(rows) // leaf)):
                if len(own) > 1:
                    x = vec[own] - vec[own].mean(0)
                    square = (x * x).sum(1)
                    d = square[:, None] + square[None, :] - 2 * x @ x.T
                    np.fill_diagonal(d, np.inf)
                    most = width if of == 0 else width // 3 + 1  # the first draw fills the lists
                    k = min(most, len(own) - 1)
                    far = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero(d <= far + 1e-12 * (square[:, None] + square.max()))
                    d = _exact(vec, vec, own[i], own[j])
                    i, j, d = i[np.isfinite(d)], j[np.isfinite(d)], d[np.isfinite(d)]
                    near = _best(i, ids[own[j]], d, most)
                    parts.append((ids[own[i[near]]], ids[own[j[near]]], d[near]))
        a, b, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield from _sent("found", _shard_of(a, shards), a=a, b=b, d=d)

    coded = _coded(own, planes, element)
    return coded.repartitionByRange(max(1, DRAWS * shards), "draw", "code", "id").sortWithinPartitions("draw", "code", "id").select("draw", "id", "vec").mapInArrow(run, MAIL)


def _dealt(own: DataFrame, shards: int, real: str) -> DataFrame:
    """The nodes as messages to their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, vec = batch.column("id").to_numpy(), matrix(batch.column("vec")).astype(real)
                yield from _sent("nodes", _shard_of(ids, shards), a=ids, v=vec)

    def one(mail: _Mail) -> Iterator[pa.RecordBatch]:
        ids = mail.get("nodes", "a")
        order = np.argsort(ids, kind="stable")
        yield _row(mail.shard, "nodes", a=ids[order], v=mail.vectors("nodes", len(ids))[order])

    return _by_shard(own.select("id", "vec").mapInArrow(run, MAIL), shards, one, real)


def _by_shard(mail: DataFrame, shards: int, run: Callable[[_Mail], Iterator[pa.RecordBatch]], real: str) -> DataFrame:
    """What each shard makes of its messages: one task for each."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _read(batches, real).values():
            yield from run(own)

    return mail.repartitionById(shards, "shard").mapInArrow(one, MAIL)


def _without(lists: DataFrame, *names: str) -> DataFrame:
    return lists.withColumns({x: F.lit(None).cast("binary") for x in names})


def _kept(base: DataFrame, lists: DataFrame | None, found: DataFrame, shards: int, width: int, real: str, met: bool = True) -> DataFrame:
    """Lists of the `width` nearest of what they held and what was found; new is what they did not hold, or what they held if it has not been `met`."""

    def run(mail: _Mail) -> Iterator[pa.RecordBatch]:
        ids = mail.get("nodes", "a")
        old_b, old_d = (x.reshape(len(ids), len(x) // max(1, len(ids))) for x in (mail.get("lists", "b"), mail.get("lists", "d")))
        old_f = np.zeros(old_b.shape, bool) if met else mail.get("lists", "f").reshape(old_b.shape)
        row, place = np.nonzero(np.isfinite(old_d))
        a = np.concatenate([row, np.searchsorted(ids, mail.get("found", "a"))])
        b, d = np.concatenate([old_b[row, place], mail.get("found", "b")]), np.concatenate([old_d[row, place], mail.get("found", "d")])
        new = np.arange(len(a)) >= len(row)
        f = np.concatenate([old_f[row, place], new[len(row) :]])
        order = np.lexsort((b, d, a))  # equal pairs have equal distances, so they follow each other, old ones first
        order = order[_first(a[order], b[order])]
        order = order[_ranks(a[order]) < width]
        a, b, d, f, new = a[order], b[order], d[order], f[order], new[order]
        out_b, out_d, out_f = np.full((len(ids), width), -1, np.int64), np.full((len(ids), width), np.inf), np.zeros((len(ids), width), bool)
        place = _ranks(a)
        out_b[a, place], out_d[a, place], out_f[a, place] = b, d, f
        yield _row(mail.shard, "lists", len(a), int(new.sum()), a=ids, b=out_b, d=out_d, f=out_f, last=out_d[:, -1])

    known = _without(base, "v") if lists is None else _without(base, "v").unionByName(_without(lists, "a", "last", *(["f"] if met else [])))
    return _by_shard(known.unionByName(found), shards, run, real)


def _links(lists: DataFrame, shards: int, real: str) -> DataFrame:
    """To each node's shard, who links to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mail in _read(iter([batch]), real).values():
                ids, d = mail.get("lists", "a"), mail.get("lists", "d")
                there = np.flatnonzero(np.isfinite(d))
                b = mail.get("lists", "b")[there]
                yield from _sent("links", _shard_of(b, shards), a=b, b=ids[there // (len(d) // max(1, len(ids)))], d=d[there], f=mail.get("lists", "f")[there])

    return _without(lists, "last").mapInArrow(run, MAIL)


def _met(lists: DataFrame, links: DataFrame, shards: int, width: int, was: int, real: str) -> DataFrame:
    """The members of each node's join, and requests for their vectors: its list and as many at most of those that link to it, so that a node many point to does not meet them all. Nodes without new members are left out. `was` is the width of the round before."""

    def run(mail: _Mail) -> Iterator[pa.RecordBatch]:
        ids, d = mail.get("lists", "a"), mail.get("lists", "d")
        there = np.flatnonzero(np.isfinite(d))
        own, b, f = there // max(1, len(d) // max(1, len(ids))), mail.get("lists", "b")[there], mail.get("lists", "f")[there]
        c, back, far, new = np.searchsorted(ids, mail.get("links", "a")), mail.get("links", "b"), mail.get("links", "d"), mail.get("links", "f")
        if was < width:  # some that link to a node have a place now that was none before
            some = _best(c, back, far, width)
            c, back, far = c[some], back[some], far[some]
            new = new[some] | (_ranks(c) >= was)
        live = np.zeros(len(ids), bool)
        live[own[f]] = live[c[new]] = True
        some = np.flatnonzero(live[c])
        some = some[_best(c[some], back[some], far[some], width)]
        c, b, f = np.concatenate([own[live[own]], c[some]]), np.concatenate([b[live[own]], back[some]]), np.concatenate([f[live[own]], new[some]])
        order = np.lexsort((f, b, c))
        order = order[_first(c[order], b[order])]
        fresh = np.bincount(c[order], weights=f[order], minlength=len(ids))
        order = order[fresh[c[order]] > 0]
        c, b, f = c[order], b[order], f[order]
        yield _row(mail.shard, "members", a=c, b=b, f=f)
        known = np.unique(b)
        for part in _sent("asked", _shard_of(known, shards), a=known):
            yield part.set_column(3, "b", pa.array([np.array([mail.shard], np.int64).tobytes()], pa.binary()))

    return _by_shard(_without(lists, "last").unionByName(links), shards, run, real)


def _given(base: DataFrame, lists: DataFrame, asked: DataFrame, shards: int, real: str) -> DataFrame:
    """The vectors that shards asked for, with the distances that a neighbour has to beat."""

    def run(mail: _Mail) -> Iterator[pa.RecordBatch]:
        ids, last = mail.get("nodes", "a"), mail.get("last", "d")
        vec = mail.vectors("nodes", len(ids))
        for which, by in zip(mail.rows.get(("asked", "a"), []), mail.rows.get(("asked", "b"), []), strict=True):
            at = np.searchsorted(ids, which)
            yield _row(by[0], "given", a=which, d=last[at], v=vec[at])

    last = _without(lists, "a", "b", "f").withColumns({"kind": F.lit("last"), "d": F.col("last"), "last": F.lit(None).cast("binary")})
    return _by_shard(base.unionByName(last).unionByName(asked), shards, run, real)


def _joined(members: DataFrame, given: DataFrame, shards: int, width: int, real: str) -> DataFrame:
    """Pairs of members of one join, one of them new at least, that are nearer than the last of the first one's list."""

    def run(mail: _Mail) -> Iterator[pa.RecordBatch]:
        ids = mail.get("given", "a")
        order = np.argsort(ids, kind="stable")
        b = order[np.searchsorted(ids[order], mail.get("members", "b"))]
        a, b, d = local_join(mail.get("members", "a"), b, mail.get("members", "f"), mail.vectors("given", len(ids)), mail.get("given", "d"), ids, width)
        yield from _sent("found", _shard_of(ids[a], shards), a=ids[a], b=ids[b], d=d)

    return _by_shard(members.unionByName(given), shards, run, real)


def local_join(c: np.ndarray, b: np.ndarray, f: np.ndarray, vec: np.ndarray, last: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the joins c with members b (places, f tells the new ones): (place, neighbour's place, d2), each once, the `width` nearest for each place that `last` does not rule out."""
    order = np.lexsort((b, ~f, c))  # new members first
    c, b, f = c[order], b[order], f[order]
    _, first, degree = np.unique(c, return_index=True, return_counts=True)
    fresh = np.add.reduceat(f, first, dtype=np.int64) if len(first) else first
    dims, last = vec.shape[1], last.copy()
    kernel = np.float64 if vec.dtype == np.float64 or (len(vec) and np.abs(vec).max() > 1e15) else np.float32
    nothing = kernel(np.finfo(kernel).max / 16)  # a distance that is none
    held, n = np.empty(0, np.int64), max(1, len(ids))
    parts: list[np.ndarray] = []
    order, at = np.lexsort((fresh, degree)), 0

    def cut(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = np.unique(np.concatenate([np.empty(0, np.int64), *parts]))
        x, y = pairs // n, pairs % n
        d = _exact(vec, vec, x, y)
        near = np.isfinite(d) & (d <= last[x])
        x, y, d = x[near], y[near], d[near]
        near = _best(x, ids[y], d, width)
        return x[near], y[near], d[near]

    while at < len(order):  # joins of like sizes together
        size = int(degree[order[min(len(order) - 1, at + 63)]])
        some = order[at : at + max(1, min(64, _CELLS // (size * size)))]
        at += len(some)
        g, h = int(degree[some].max()), int(fresh[some].max())
        if g < 2:
            continue
        there, old = np.arange(g) < degree[some, None], np.arange(g) >= fresh[some, None]
        who = b[first[some, None] + np.where(there, np.arange(g), 0)]
        x = vec[who].astype(kernel, copy=False)
        x -= x.mean(1, keepdims=True)  # what is near keeps its digits
        square = (x * x).sum(2)
        margin = 4 * (dims + 2) * np.finfo(kernel).eps * square.max(1)[:, None]
        left, right = (np.ones((len(some), m, dims + 2), kernel) for m in (h, g))
        np.multiply(x[:, :h], -2, out=left[:, :, :dims])
        left[:, :, dims + 1] = np.where(old[:, :h], nothing, square[:, :h])
        right[:, :, :dims], right[:, :, dims] = x, np.where(there, square, nothing)
        d = left @ right.transpose(0, 2, 1)  # the squared distances of new members from all
        d[:, np.arange(h), np.arange(h)] = nothing
        most = (np.minimum(last[who], nothing / 4) + margin).astype(kernel)
        for back in (False, True):  # new members among themselves meet both ways the first time
            near = d <= (np.where(old, most, -1)[:, None, :] if back else most[:, :h, None])
            at_cell = np.flatnonzero(near)
            join, cell = np.divmod(at_cell, h * g)
            i, j = who[join, cell // g], who[join, cell % g]
            parts.append(j * n + i if back else i * n + j)
        if sum(map(len, parts)) - len(held) > _PAIRS:
            x, y, d = cut(parts)
            full = np.flatnonzero(_ranks(x) == width - 1)
            last[x[full]] = np.minimum(last[x[full]], d[full])
            held = x * n + y
            parts = [held]
    return cut(parts)


def _edges(lists: DataFrame, k: int, real: str, only: np.ndarray | None = None) -> DataFrame:
    """(src, pos, dst, d2): the first k of each list, or of those of some nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mail in _read(iter([batch]), real).values():
                ids = mail.get("lists", "a")
                b, d = (mail.get("lists", x).reshape(len(ids), -1)[:, :k] for x in "bd")
                there = np.isfinite(d)
                if only is not None:
                    there &= np.isin(ids, only)[:, None]
                row, place = np.nonzero(there)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(place.astype(np.int32) + 1), pa.array(b[row, place]), pa.array(d[row, place])], names=["src", "pos", "dst", "d2"])

    return _without(lists, "f", "last").mapInArrow(run, "src long, pos int, dst long, d2 double")


def _sampled(own: DataFrame, k: int, seed: int) -> set[tuple[int, int]]:
    """The true edges of SAMPLE nodes, by a scan."""
    asked = own.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE)
    none = {x: F.lit(None).cast("double") for x in "lr"}
    asked = asked.select(F.col("id").alias("qid"), F.lit(0).alias("qtype"), F.lit(None).cast("int").alias("v"), F.col("vec").alias("qvec")).withColumns(none)
    nodes = own.select("id", "vec", F.lit(None).cast("int").alias("c"), F.lit(None).cast("double").alias("t"))
    return {(r.qid, r.id) for r in top(search(nodes, asked, k + 1).where("qid != id").drop("rank"), k).collect()}


def nn_descent(nodes: DataFrame, k: int, rounds: int | None = None, width: int = 32, seed: int = 7, store: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """An approximate k-nearest graph (src, pos, dst, d2) by local joins, for inputs too large for exact ones.

    Starts from the nearest among nodes that lie on the same sides of chance planes;
    in each round neighbours of a node are joined with each other, and each node keeps
    its `width` best, of which k are returned: short lists get stuck. Rounds go on
    until at most a share SETTLED of the edges is new, or for `rounds` at most where
    that is given. Without `rounds`, lists that hardly get better while fewer than
    RECALL of the true edges of SAMPLE nodes are found are made twice as long. Equal
    vectors are one node of the descent and take each other's places at the end.
    Nodes without a vector are left out. `store` writes a round's table and reads it
    again, to end the lineage; tables of earlier rounds are deleted if it is `stored`.
    """
    gone = unstored if store is stored else lambda _: None
    double = isinstance(nodes.schema["vec"].dataType.elementType, T.DoubleType)
    real, element = ("<f8", "double") if double else ("<f4", "float")
    same = W.partitionBy(F.xxhash64("vec"), "vec")
    each = nodes.where("vec IS NOT NULL").groupBy("id").agg(F.min(F.col("vec").cast(f"array<{element}>")).alias("vec"))
    known = store(each.select("id", "vec", F.min("id").over(same).alias("rep"), F.row_number().over(same.orderBy("id")).alias("place")), "nn_nodes")
    own = known.where("id = rep").select("id", "vec")
    count = known.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("id") == F.col("rep")).alias("own"), F.max(F.size("vec")).alias("dims")).first()
    n, keep = count.own, max(k, width)
    dims, tasks = max(1, count.dims or 1), nodes.sparkSession.sparkContext.defaultParallelism
    shards = -(-n // (max(64, min(CENTERS, 64 * CENTERS // dims)) * (2 if n * dims <= ALL else 1)))
    shards = -(-shards // tasks) * tasks if shards > 1 else 1  # as many as run at once, or so many times that
    base = store(_dealt(own, shards, real), "nn_shards")
    lists = store(_kept(base, None, _start(own, shards, keep, seed, element), shards, keep, real), "nn_start")
    was, turn, truth, enough = 0, 0, None, rounds is not None
    while n > 1 and turn != rounds:
        met = store(_met(lists, _links(lists, shards, real), shards, keep, was, real), "nn_met")
        given = _given(base, lists, met.where("kind = 'asked'"), shards, real)
        found = _joined(met.where("kind = 'members'"), given, shards, keep, real)
        before, lists = lists, store(_kept(base, lists, found, shards, keep, real), f"nn{turn}")
        gone(met), gone(before)
        was, turn = keep, turn + 1
        edges, new = lists.agg(F.sum("edges"), F.sum("new")).first()
        if not enough and new <= SLOW * edges:
            truth = _sampled(own, k, seed) if truth is None else truth
            some = np.array(sorted({a for a, _ in truth}), np.int64)
            right = sum((r.src, r.dst) in truth for r in _edges(lists, k, real, some).collect())
            enough = right >= RECALL * len(truth) or keep >= n - 1
            if not enough:
                keep = min(2 * keep, n - 1)
                before, lists = lists, store(_kept(base, lists, _start(own, shards, keep, seed + turn, element), shards, keep, real, met=False), f"nn{turn}_wide")
                gone(before)
                continue
        if new <= SETTLED * edges:  # lists only get better, so this ends
            break
    gone(base)
    near = _edges(lists, k, real)
    return near if n == count["all"] else _copied(near, known, k)


def _copied(near: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The edges of all nodes from those between different vectors: a vector's copies are nearest to each other, and take the places of each other by id."""
    heads = known.where(F.col("place") <= k + 1).select(F.col("rep").alias("of"), "id")
    own = known.where("id = rep").select(F.col("id").alias("qid"), F.col("id").alias("of"), F.lit(0.0).alias("d2"))
    others = near.select(F.col("src").alias("qid"), F.col("dst").alias("of"), "d2").unionByName(own).join(heads, "of")
    first = top(others.select("qid", "id", "d2"), k + 1).select(F.col("qid").alias("rep"), F.col("id").alias("dst"), "d2")
    pairs = known.select(F.col("id").alias("qid"), "rep").join(first, "rep").where("qid != dst").select("qid", F.col("dst").alias("id"), "d2")
    return top(pairs, k).select(F.col("qid").alias("src"), F.col("rank").alias("pos"), F.col("id").alias("dst"), "d2")
