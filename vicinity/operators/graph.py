"""Neighbour graphs as edge tables (index_id, src, pos, dst, dst_t).

Indexes are made per category or per time slice, and cut into shards of a bounded
number of nodes, so that one task holds one shard however large a category is; a
search asks every shard of its index and merges. Within a shard each node is
linked to its nearest, pruned for diversity (a neighbour stays unless it is closer
to a kept one than to the node), links are made mutual and cut to 2 * M, and parts
that no link reaches are tied to the entry's part.
"""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.operators.descent import nn_descent  # noqa: F401
from vicinity.operators.knn import BLOCK_ROWS, matrix, search, top
from vicinity.operators.predicates import category_counts, slice_of
from vicinity.sources.shared import stored

M = 28
CANDIDATES = 200
#: The most nodes of a shard, about: what one task holds.
SHARD_ROWS = 20_000
_BLOCK = 1024
#: Cells of the largest matrix that a task makes for many nodes or queries at once.
_CELLS = 1 << 22
EDGES = "index_id string, src long, pos int, dst long, dst_t double, level int"


def _sharded(nodes: DataFrame, kind: str, key: str, counts: DataFrame, shard_rows: int) -> DataFrame:
    """Add index_id, "kind:key:shard"; the number of shards follows the key's number of rows."""
    sized = nodes.join(counts.select(F.col(key).alias("_key"), F.greatest(F.lit(1), F.ceil(F.col("n") / shard_rows)).alias("_shards")), F.col(key) == F.col("_key"))
    shard = F.pmod(F.xxhash64("id"), F.col("_shards"))
    return sized.withColumn("index_id", F.concat_ws(":", F.lit(kind), F.col(key).cast("string"), shard.cast("string"))).drop("_key", "_shards")


def by_category(nodes: DataFrame, share: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Nodes of the categories that hold at least a share of all rows, with index_id."""
    counts = category_counts(nodes)
    total = counts.agg(F.sum("n").alias("_all"))
    kept = counts.join(F.broadcast(total), F.lit(True)).where(F.col("n") >= share * F.col("_all"))
    return _sharded(nodes, "c", "c", kept, shard_rows)


def by_slice(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All nodes with the index_id of their time slice."""
    sliced = nodes.withColumn("slice", slice_of(F.col("t")))
    return _sharded(sliced, "s", "slice", sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("n")), shard_rows).drop("slice")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def nearest(vec: np.ndarray, k: int) -> np.ndarray:
    """Each node's k nearest others, nearest first (ties by place)."""
    n = len(vec)
    k = min(k, n - 1)
    out = np.empty((n, max(k, 0)), np.int64)
    for a in range(0, n, _BLOCK):
        d = distances(vec[a : a + _BLOCK], vec)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        far = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k else d[:, :0]
        row, place = np.nonzero(d <= far) if k else (np.empty(0, np.int64),) * 2  # all that are as far as the k-th: of equals the first stay
        order = np.lexsort((place, d[row, place], row))
        row, place = row[order], place[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        out[a + row[rank < k], rank[rank < k]] = place[rank < k]
    return out


def diverse(vec: np.ndarray, node: int, candidates: list[int], most: int) -> list[int]:
    """Candidates in order of distance, each kept unless a kept one is closer to it, by more than rounding, than the node is."""
    if not candidates:
        return []
    to_node = ((vec[candidates] - vec[node]) ** 2).sum(1)
    order = np.lexsort((candidates, to_node))
    places, to_node = np.asarray(candidates)[order], to_node[order]
    own = vec[places]
    square = (own * own).sum(1)
    margin = 1e-9 * (1 + square.max())
    dropped = np.zeros(len(places), bool)
    kept: list[int] = []
    while len(kept) < most:
        rest = np.flatnonzero(~dropped)
        if not len(rest):
            break
        i = rest[0]
        kept.append(int(places[i]))
        dropped |= square + square[i] - 2 * (own @ own[i]) < to_node - margin
        dropped[: i + 1] = True
    return kept


def _diverse_rows(vec: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """`diverse` of many nodes at once: a row of candidates each, and a row of at most `most` kept ones, both filled up with -1."""
    out = np.full((len(nodes), most), -1, np.int64)
    if not candidates.shape[1]:
        return out
    step = max(1, _CELLS // candidates.shape[1] ** 2)
    for a in range(0, len(nodes), step):
        places = candidates[a : a + step]
        to_node = ((vec[places] - vec[nodes[a : a + step], None]) ** 2).sum(2)
        to_node[places < 0] = np.inf
        order = np.lexsort((places, to_node), axis=1)
        places, to_node = np.take_along_axis(places, order, 1), np.take_along_axis(to_node, order, 1)
        own, dropped = vec[places], places < 0
        square = (own * own).sum(2)
        own[dropped], square[dropped] = 0, 0
        near = to_node - 1e-9 * (1 + square.max(1))[:, None]
        products, row = own @ own.transpose(0, 2, 1), np.arange(len(places))
        for p in range(most):
            i = dropped.argmin(1)
            live = ~dropped[row, i]
            if not live.any():
                break
            out[a + row[live], p] = places[live, i[live]]
            dropped |= square + square[row, i][:, None] - 2 * products[row, i] < near
            dropped[row, i] = True
    return out


def _mutual(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows filled up with -1) and their reverses, each once, in order: where each node's begin, and the ends."""
    n = len(links)
    src, place = np.nonzero(links >= 0)
    dst = links[src, place]
    both = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    return np.searchsorted(both, np.arange(n + 1) * n), both % max(1, n)


def build_links(vec: np.ndarray, m: int = M, candidates: int = CANDIDATES) -> list[list[int]]:
    """The links of each node of one shard."""
    first, ends = _mutual(_diverse_rows(vec, np.arange(len(vec)), nearest(vec, candidates), m))
    links, degree = [ends[a:b].tolist() for a, b in zip(first, first[1:])], np.diff(first)  # noqa: B905
    much = np.argsort(degree, kind="stable")
    much = much[degree[much] > 2 * m]
    at = 0
    while at < len(much):  # nodes of like degrees together, few at once where a degree is large
        some = much[at : at + max(1, _CELLS // int(degree[much[min(len(much), at + 256) - 1]]) ** 2)][:256]
        padded = np.full((len(some), int(degree[some].max())), -1, np.int64)
        for row, i in zip(padded, some, strict=True):
            row[: degree[i]] = ends[first[i] : first[i + 1]]
        for i, kept in zip(some.tolist(), _diverse_rows(vec, some, padded, 2 * m), strict=True):
            links[i] = kept[kept >= 0].tolist()
        at += len(some)
    return _connected(vec, links)


def _connected(vec: np.ndarray, links: list[list[int]], entry: int = 0) -> list[list[int]]:
    """Tie what the entry does not reach to its nearest reached node, both ways."""
    if not links:
        return links
    reached = np.zeros(len(links), bool)
    stack = [entry]
    reached[entry] = True
    while True:
        while stack:
            for j in links[stack.pop()]:
                if not reached[j]:
                    reached[j] = True
                    stack.append(j)
        rest = np.flatnonzero(~reached)
        if not len(rest):
            return links
        new, inside = int(rest[0]), np.flatnonzero(reached)
        old = int(inside[np.argmin(((vec[inside] - vec[new]) ** 2).sum(1))])
        links[old].append(new)
        links[new].append(old)
        reached[new] = True
        stack.append(new)


def levels(ids: np.ndarray, m: int = M) -> np.ndarray:
    """Each node's level: geometric with ratio 1 / m, from its id, so that a build can be repeated."""
    from vicinity.operators.hashing import unit

    return np.floor(-np.log(unit(ids)) / math.log(m)).astype(int)


def nsg_links(vec: np.ndarray, m: int = M, candidates: int = CANDIDATES) -> list[list[int]]:
    """Links of one shard for a search that always enters at the node nearest to the centroid, which comes first.

    Each node keeps diverse ones of its nearest and of those that lie on the way
    to it from the entry; each link's end may take the link back if it stays
    diverse; what the entry does not reach is tied to the nearest node that it does.
    """
    if not len(vec):
        return []
    entry = int(np.argmin(((vec - vec.mean(0)) ** 2).sum(1)))
    near = nearest(vec, candidates)
    links = []
    for i, row in enumerate(near):
        path, here = [], entry
        while here != i:  # greedily over the nearest-neighbour lists
            path.append(here)
            step = int(min([here, *near[here][:m]], key=lambda j: (((vec[j] - vec[i]) ** 2).sum(), j)))
            if step == here:
                break
            here = step
        links.append(diverse(vec, i, sorted({*row.tolist(), *path} - {i}), m))
    both = [set(x) for x in links]
    for i, row in enumerate(links):
        for j in row:
            both[j].add(i)
    links = [sorted(x) if len(x) <= m else diverse(vec, i, sorted(x), m) for i, x in enumerate(both)]
    return _connected(vec, links, entry)


def _flat(links: list[list[int]], at: np.ndarray, level: int) -> np.ndarray:
    """Rows (place, pos, place, level) of links between the places `at`."""
    count = np.array([len(row) for row in links], np.int64)
    src, dst = np.repeat(np.arange(len(links)), count), np.fromiter((j for row in links for j in row), np.int64, count.sum())
    return np.stack([at[src], np.arange(len(src)) - (np.cumsum(count) - count)[src], at[dst], np.full(len(src), level)], 1)


def _edges(index_id: str, ids: np.ndarray, t: np.ndarray, rows: list[np.ndarray]) -> pd.DataFrame:
    """The edge table from rows (place, pos, place, level)."""
    src, pos, dst, level = np.concatenate([np.empty((0, 4), np.int64), *rows]).T
    return pd.DataFrame({"index_id": index_id, "src": ids[src], "pos": pos, "dst": ids[dst], "dst_t": t[dst], "level": level})


def _arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(frame["vec"].to_list()).astype(np.float64), frame["id"].to_numpy(), frame["t"].to_numpy()


def build(indexed: DataFrame, m: int = M, candidates: int = CANDIDATES, kind: str = "levels") -> DataFrame:
    """The edge table of every shard, pos counting from 0. Kind `levels`: level 0 for all nodes, higher levels for the entry descent; `nsg`: level 0 alone, entered at the first node."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        vec, ids, t = _arrays(frame.sort_values("id", kind="stable").drop_duplicates("id"))
        rows = []
        if kind == "nsg":
            rows.append(_flat(nsg_links(vec, m, candidates), np.arange(len(vec)), 0))
        else:
            level = levels(ids, m)
            for l in range(int(level.max(initial=0)) + 1):
                at = np.flatnonzero(level >= l)
                rows.append(_flat(build_links(vec[at], m if l == 0 else max(2, m // 2), candidates), at, l))
        return _edges(frame["index_id"].iloc[0], ids, t, rows)

    return _dealt(indexed.select("index_id", "id", "t", "vec"), "index_id").groupBy("index_id").applyInPandas(one, EDGES)


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys to many more tasks than run at once, so that few get two shards and wait for each other."""
    return df.repartition(8 * max(8, df.sparkSession.sparkContext.defaultParallelism), *keys)


def extend(indexed: DataFrame, edges: DataFrame, added: DataFrame, m: int = M, candidates: int = CANDIDATES) -> DataFrame:
    """The edges of the shards that get new nodes (index_id, id, t, vec), which are linked into what is there.

    Only those shards are read. A new node links to diverse ones of its nearest,
    old or new; they link back, and a node with more than 2 * m links keeps diverse
    ones. Nodes that a shard has already are not added again.
    """

    def one(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        old, new = old.drop_duplicates("id").sort_values("id", kind="stable"), new.drop_duplicates("id").sort_values("id", kind="stable")
        new = new[~new["id"].isin(old["id"])]
        both = pd.concat([old[["id", "t", "vec"]], new[["id", "t", "vec"]]], ignore_index=True)
        vec, ids, t = _arrays(both)
        place, level, rows = {x: i for i, x in enumerate(ids.tolist())}, levels(ids, m), []
        known: dict[int, list[set[int]]] = {}
        for i, row in enumerate(old["links"]):
            for e in row:
                known.setdefault(e["level"], [set() for _ in ids])[i].add(place[e["dst"]])
        for l in range(int(level.max(initial=0)) + 1):
            at = np.flatnonzero(level >= l)
            own, width = {x: i for i, x in enumerate(at.tolist())}, m if l == 0 else max(2, m // 2)
            links = [{own[j] for j in known[l][x] if j in own} if l in known else set() for x in at.tolist()]
            changed = set()
            for i in (own[x] for x in range(len(old), len(ids)) if x in own):
                d = ((vec[at] - vec[at[i]]) ** 2).sum(1)
                d[i] = np.inf
                for j in diverse(vec[at], i, np.argsort(d, kind="stable")[: min(candidates, len(at) - 1)].tolist(), width):
                    links[i].add(j)
                    links[j].add(i)
                    changed |= {i, j}
            done = [sorted(x) if i not in changed or len(x) <= 2 * width else diverse(vec[at], i, sorted(x), 2 * width) for i, x in enumerate(links)]
            rows.append(_flat(_connected(vec[at], done), at, l))
        return _edges(key[0], ids, t, rows)

    touched = added.select("index_id").distinct()
    there = linked(indexed.join(touched, "index_id", "left_semi"), edges.join(touched, "index_id", "left_semi"))
    return there.groupBy("index_id").cogroup(added.select("index_id", "id", "t", "vec").groupBy("index_id")).applyInPandas(one, EDGES)


def linked(indexed: DataFrame, edges: DataFrame) -> DataFrame:
    """(index_id, id, t, vec, links): each node with its edges (level, pos, dst, dst_t)."""
    of = edges.groupBy("index_id", F.col("src").alias("id")).agg(F.collect_list(F.struct("level", "pos", "dst", "dst_t")).alias("links"))
    none = F.array().cast("array<struct<level:int,pos:int,dst:bigint,dst_t:double>>")
    return indexed.select("index_id", "id", "t", "vec").join(of, ["index_id", "id"], "left").withColumn("links", F.coalesce("links", none))


def knn_graph(nodes: DataFrame, k: int) -> DataFrame:
    """The exact k nearest others of each node in its category: (src, pos, dst, d2), by scans for blocks of nodes, never by pairs."""
    # among the k + 1 nearest is the node itself, or that many others are as near as it
    asked = nodes.where("c IS NOT NULL").select(F.col("id").alias("qid"), F.lit(1).alias("qtype"), F.col("c").alias("v"), F.lit(None).cast("double").alias("l"), F.lit(None).cast("double").alias("r"), F.col("vec").alias("qvec"))
    others = search(nodes, asked, k + 1).where("qid != id").drop("rank")
    return top(others, k).select(F.col("qid").alias("src"), F.col("rank").alias("pos"), F.col("id").alias("dst"), "d2")


def reversed_edges(edges: DataFrame) -> DataFrame:
    """Edges with their reverses, each once."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degree_stats(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return out.agg(F.count(F.lit(1)).alias("nodes"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 9).alias("mean"))


def violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: self loops, repeated edges, ends that are no node, and nodes that nothing links to."""
    known = nodes.select("id")
    lost = edges.join(known, edges["dst"] == known["id"], "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    unreached = known.join(edges, known["id"] == edges["dst"], "left_anti").agg(F.count(F.lit(1)).alias("unreached"))
    own = edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    twice = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    return own.join(F.broadcast(twice), F.lit(True)).join(F.broadcast(lost), F.lit(True)).join(F.broadcast(unreached), F.lit(True))


def search_shard(ids: np.ndarray, vec: np.ndarray, t: np.ndarray, links: dict[int, list[list[int]]], times: list[list[float]], query: np.ndarray, ef: int, low: float | None = None, high: float | None = None, wider: int = 1, entries: int = 10, entry: int | None = None) -> list[tuple[int, float]]:
    """Beam search of one query in one shard (ids ascending): up to ef (id, d2), nearest first.

    links are place lists per level, times the neighbours' times as the edges of
    level 0 have them.
    """
    src, pos, dst, level = np.concatenate([np.empty((0, 4), np.int64), *(_flat(rows, np.arange(len(ids)), l) for l, rows in links.items())]).T
    dst_t = np.zeros(len(dst))
    dst_t[level == 0] = [w for row in times for w in row]
    shard = Shard(ids, vec, t, ids[src], pos, ids[dst], dst_t, level)
    if entry is not None:
        shard.entry = entry
    nan = np.nan
    _, i, d, _ = shard.search(np.asarray(query, np.float64)[None], np.array([ef]), np.array([nan if low is None else low]), np.array([nan if high is None else high]), ef, wider, entries)
    return list(zip(i.tolist(), d.tolist(), strict=True))


def gather(links: list[list[int]], start: int, inside: np.ndarray, most: int = 32, hops: int | None = None) -> list[int]:
    """Up to `most` of the nodes in the filter that are nearest to a node in links, those with fewer links between first; `hops` may bound how many."""
    out, seen, ring = [], {start}, [start]
    while ring and hops != 0:
        ring = [j for j in dict.fromkeys(j for i in ring for j in links[i]) if j not in seen]
        seen.update(ring)
        out += [j for j in ring if inside[j]]
        if len(out) >= most:
            break
        hops = None if hops is None else hops - 1
    return out[:most]


class Shard:
    """One shard's nodes and links as arrays, searched for many queries at once."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, t: np.ndarray, src: np.ndarray, pos: np.ndarray, dst: np.ndarray, dst_t: np.ndarray, level: np.ndarray):
        """Nodes (ids, vec, t) and edges (src, pos, dst, dst_t, level), both in any order; ends of edges are ids."""
        self.ids, once = np.unique(ids, return_index=True)
        self.vec, self.t = np.asarray(vec, np.float64)[once], t[once]
        order = np.lexsort((pos, src, level))
        src, dst = (np.searchsorted(self.ids, x[order]) for x in (src, dst))
        level, times = level[order], dst_t[order]
        #: of each level: where each node's links begin, the places they lead to, and the times there
        self.levels = []
        for l in range(int(level.max(initial=0)) + 1):
            a, b = np.searchsorted(level, [l, l + 1])
            self.levels.append((np.searchsorted(src[a:b], np.arange(len(self.ids) + 1)), dst[a:b], times[a:b]))
        # without higher levels to come down from, a search enters in the middle
        self.entry = int(np.argmin(((self.vec - self.vec.mean(0)) ** 2).sum(1))) if len(self.levels) == 1 and len(self.ids) else None
        self.by_time = np.argsort(self.t, kind="stable")

    def search(self, asked: np.ndarray, ef: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, wider: int = 1, entries: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Beam search: (place of the query, id, d2, us) of the k nearest that a beam of ef finds, nearest first; low is nan for no range.

        Queries go in step. In each step each query opens the nearest nodes of its
        beam that are not open yet, a few at once, and ends when all of the beam are;
        so it sees at least what opening them one by one would have it see. With a
        range, entries are spread evenly over the nodes in it (in time order) and only
        neighbours in it join the beam; while those are fewer than `wider` times the
        neighbours not seen before, neighbours' neighbours are looked at too.
        A query's time, its share of its block's, stands in its first row.
        """
        parts = []
        for ranged in (False, True):
            own = np.flatnonzero(np.isnan(low) != ranged)
            own = own[np.argsort(ef[own], kind="stable")]
            step = max(1, _CELLS // max(1, len(self.ids)))
            for some in (own[a : a + step] for a in range(0, len(own), step)):
                began = time.perf_counter()
                pool_d, pool_i = self._beams(asked[some], ef[some], (low[some], high[some]) if ranged else None, wider, entries)
                row, place = np.nonzero(np.isfinite(pool_d))
                d, i = pool_d[row, place], self.ids[pool_i[row, place]]
                order = np.lexsort((i, d, row))
                row, d, i = row[order], d[order], i[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                took = 1e6 * (time.perf_counter() - began) / len(some)
                near = rank < k
                parts.append((some[row[near]], i[near], d[near], np.where(rank[near] == 0, took, 0.0)))
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
        return tuple(np.concatenate(x) for x in zip(empty, *parts, strict=True))

    def _far(self, asked: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for a in range(0, len(row), 1 << 13):
            s = slice(a, a + (1 << 13))
            apart = self.vec[place[s]] - asked[row[s]]
            out[s] = np.einsum("ij,ij->i", apart, apart)
        return out

    def _around(self, level: int, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All links of the given nodes of queries: (query, place, time there)."""
        first, ends, times = self.levels[level]
        count = first[place + 1] - first[place]
        at = np.repeat(first[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(row, count), ends[at], times[at]

    def _starts(self, asked: np.ndarray, during, entries: int) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(asked))
        if during is not None:
            timed = self.t[self.by_time]
            timed = timed[: np.searchsorted(timed, np.inf, "right")]  # no time is last
            a, b = np.searchsorted(timed, during[0]), np.searchsorted(timed, during[1], "right")
            spread = [np.unique(np.linspace(x, y - 1, min(entries, y - x)).astype(int)) if y > x else np.empty(0, int) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            return np.repeat(every, [len(x) for x in spread]), self.by_time[np.concatenate([np.empty(0, int), *spread])]
        if self.entry is not None:
            return every, np.full(len(asked), self.entry)
        first = self.levels[-1][0]
        linked = np.flatnonzero(np.diff(first))
        here = np.full(len(asked), linked[0] if len(linked) else 0)
        d = self._far(asked, every, here)
        for level in range(len(self.levels) - 1, 0, -1):
            moving = every
            while len(moving):
                row, place, _ = self._around(level, moving, here[moving])
                far = self._far(asked, row, place)
                order = np.lexsort((place, far, row))
                best = order[np.searchsorted(row[order], np.unique(row))]
                best = best[far[best] < d[row[best]]]
                moving = row[best]
                here[moving], d[moving] = place[best], far[best]
        return every, here

    def _beams(self, asked: np.ndarray, ef: np.ndarray, during, wider: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, places), a row for each query: its beam, nearest first, filled up with inf."""
        n, q, width = len(self.ids), len(asked), int(ef.max())
        seen, opened, mark = np.zeros(q * n, bool), np.zeros(q * n if during is not None else 0, bool), np.empty(q * n, np.int64)
        pool_d, pool_i, shut = np.full((q, width), np.inf), np.zeros((q, width), np.int64), np.ones((q, width), bool)
        beyond = np.arange(width)[None, :] >= ef[:, None]
        at_once = np.maximum(4, ef // 32)

        def once(row: np.ndarray, place: np.ndarray, known: np.ndarray) -> np.ndarray:
            """Where (row, place) is not known yet, each once; known from now on."""
            key = row * n + place
            new = np.flatnonzero(~known[key])
            key = key[new]
            mark[key] = new
            new = new[mark[key] == new]
            known[row[new] * n + place[new]] = True
            return new

        def join(row: np.ndarray, place: np.ndarray) -> None:
            """Put nodes into the beams, which keep their ef nearest."""
            d = self._far(asked, row, place)
            near = d < pool_d[row, ef[row] - 1]
            row, place, d = row[near], place[near], d[near]
            if not len(row):
                return
            order = np.argsort(row, kind="stable")
            row, place, d = row[order], place[order], d[order]
            rows, first, count = np.unique(row, return_index=True, return_counts=True)
            wide = np.arange(len(row)) - np.repeat(first, count)
            line = np.repeat(np.arange(len(rows)), count)
            new_d, new_i = np.full((len(rows), int(count.max())), np.inf), np.zeros((len(rows), int(count.max())), np.int64)
            new_d[line, wide], new_i[line, wide] = d, place
            both = np.concatenate([pool_d[rows], new_d], 1)
            order = np.argsort(both, axis=1, kind="stable")[:, :width]
            pool_d[rows] = np.where(beyond[rows], np.inf, np.take_along_axis(both, order, 1))
            pool_i[rows] = np.take_along_axis(np.concatenate([pool_i[rows], new_i], 1), order, 1)
            shut[rows] = np.take_along_axis(np.concatenate([shut[rows], ~np.isfinite(new_d)], 1), order, 1) | beyond[rows]

        row, place = self._starts(asked, during, entries)
        new = once(row, place, seen)
        join(row[new], place[new])
        live = np.arange(q)
        while len(live):
            wait = ~shut[live]
            line, at = np.nonzero(wait & (np.cumsum(wait, 1) <= at_once[live, None]))
            row = live[line]
            shut[row, at] = True
            live = live[np.unique(line)]
            around, place, when = self._around(0, row, pool_i[row, at])
            new = once(around, place, seen)
            if during is None:
                join(around[new], place[new])
                continue
            inside = lambda r, w: (w >= during[0][r]) & (w <= during[1][r])
            near = new[inside(around[new], when[new])]
            found = [(around[near], place[near])]
            short = wider * np.bincount(around[new], minlength=q) - np.bincount(around[near], minlength=q)
            later, turn = np.flatnonzero(short[around] > 0), 0
            while len(later):
                # the next few neighbours of each query that is still short, twice as many from turn to turn
                later = later[~opened[around[later] * n + place[later]] & (short[around[later]] > 0)]
                later = later[np.argsort(around[later], kind="stable")]
                rank = np.arange(len(later)) - np.searchsorted(around[later], around[later])
                now = rank < -(-short[around[later]] // self._degree) * 2**turn
                go = later[now]
                go = go[once(around[go], place[go], opened)]
                later, turn = later[~now], turn + 1
                row2, place2, when2 = self._around(0, around[go], place[go])
                new = once(row2, place2, seen)
                new = new[inside(row2[new], when2[new])]
                found.append((row2[new], place2[new]))
                short -= np.bincount(row2[new], minlength=q)
            join(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return pool_d, pool_i

    @property
    def _degree(self) -> int:
        return max(1, len(self.levels[0][1]) // max(1, len(self.ids)))


_FOUND = "qid long, id long, d2 double, us double"
#: Nodes and queries of a shard in one table, kind 0 and 1.
_ROWS = {"kind": "int", "id": "long", "t": "double", "vec": "array<float>", "ef": "int", "low": "double", "high": "double"}


def _kind(df: DataFrame, number: int, keys: tuple[str, ...]) -> DataFrame:
    """The columns of _ROWS, null where df lacks them."""
    return df.select(*keys, *((F.lit(number) if c == "kind" else F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _ROWS.items()))


def _by_shard(rows: DataFrame, edges: DataFrame, keys: tuple[str, ...], one) -> DataFrame:
    """`one` of each shard's rows and edges; these come flat, for lists of links take long to pass to Python, and apart, for so do null vectors."""
    own = [f"_{key}" for key in keys]  # other names, for both sides may come from one table
    ends = edges.select(*(F.col(key).alias(x) for key, x in zip(keys, own, strict=True)), "src", "pos", "dst", "dst_t", "level")
    return _dealt(rows, *keys).groupBy(*keys).cogroup(_dealt(ends, *own).groupBy(*own)).applyInArrow(one, _FOUND)


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    """A column as an array; null is nan where it is of floats."""
    return rows.column(name).to_numpy()


def _answers(nodes: pa.Table, edges: pa.Table, asked: pa.Table, k: int | None, wider: int = 1) -> pa.Table:
    """What a shard finds for queries (id, vec, ef, low, high): the k nearest, or as many as ef."""
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("d2", pa.float64()), ("us", pa.float64())])
    if not nodes.num_rows or not asked.num_rows:
        return schema.empty_table()
    shard = Shard(_numbers(nodes, "id"), matrix(nodes.column("vec").combine_chunks()), _numbers(nodes, "t"), *(_numbers(edges, x) for x in ("src", "pos", "dst", "dst_t", "level")))
    ef = _numbers(asked, "ef").astype(np.int64)
    q, i, d, us = shard.search(matrix(asked.column("vec").combine_chunks()), ef, *(_numbers(asked, x).astype(np.float64) for x in ("low", "high")), k or int(ef.max()), wider)
    return pa.Table.from_arrays([pa.array(_numbers(asked, "id")[q]), pa.array(i), pa.array(d), pa.array(us)], schema=schema)


def best(answers: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, d2) of the answers of all shards."""
    return top(answers.groupBy("qid", "id").agg(F.min("d2").alias("d2")), k).select("qid", "rank", "id", "d2")


def query_times(answers: DataFrame) -> DataFrame:
    """(qid, us): the microseconds that shards took for a query, in all; of stored answers, else they are found anew."""
    return answers.groupBy("qid").agg(F.sum("us").alias("us"))


def graph_search(indexed: DataFrame, edges: DataFrame, asked: DataFrame, k: int, wider: int = 1) -> DataFrame:
    """The k best per query over all shards asked: (qid, rank, id, d2)."""
    return best(graph_answers(indexed, edges, asked, wider, k), k)


def graph_answers(indexed: DataFrame, edges: DataFrame, asked: DataFrame, wider: int = 1, k: int | None = None) -> DataFrame:
    """(qid, id, d2, us): what each shard finds, of which it passes on its k nearest where k is given.

    asked has (index_id, qid, qvec, ef, low, high): what each shard is asked, low
    and high null for no range. Shard, links and queries meet by index_id, the
    queries in batches of a bounded size so that a much-asked shard is shared out.
    """

    def one(rows: pa.Table, links: pa.Table) -> pa.Table:
        own, asked = (rows.filter(pc.equal(rows.column("kind"), x)) for x in (0, 1))
        return _answers(own, links, asked, k, wider)

    # other names than the nodes', which the queries may come from
    to = asked.select(F.col("index_id").alias("shard"), F.col("qid").alias("id"), F.col("qvec").alias("vec"), "ef", "low", "high")
    parts = to.groupBy("shard").agg(F.floor(F.count(F.lit(1)) / QUERY_BATCH + 1).cast("int").alias("parts"))
    sized = parts.select(F.col("shard").alias("sized"), "parts")
    copies = sized.select(F.col("sized").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left, links = (x.withColumnRenamed("index_id", "shard").join(copies, "shard") for x in (indexed.select("index_id", "id", "t", "vec"), edges))
    right = to.join(sized, F.col("shard") == F.col("sized")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    keys = ("shard", "part")
    return _by_shard(_kind(left, 0, keys).unionByName(_kind(right, 1, keys)), links, keys, one)


def search_everywhere(indexed: DataFrame, edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As graph_search, of queries (qid, qvec, ef) that every shard is asked: they are sent in blocks, so none is copied for each shard."""
    none = F.lit(None).cast("double")
    asked = queries.select(F.col("qid").alias("id"), F.col("qvec").alias("vec"), "ef", none.alias("low"), none.alias("high"))
    n, out = max(1, -(-asked.count() // BLOCK_ROWS)), None
    for b in range(n):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b) if n > 1 else asked
        sent = indexed.sparkSession.sparkContext.broadcast(part.toArrow())
        found = best(_by_shard(_kind(indexed, 0, ("index_id",)), edges, ("index_id",), _asked(sent, k)), k)
        if n > 1:
            found = stored(found, "block")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _asked(sent, k: int):
    return lambda rows, links: _answers(rows, links, sent.value, k)


#: Queries that one copy of a shard answers, about.
QUERY_BATCH = 5000
