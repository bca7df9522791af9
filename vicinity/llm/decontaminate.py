"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents become lists of lower-case words. Seeds, the runs
of LEAST words of the items, are joined with the documents; where a document
shares a seed with an item, tiles are laid: the longest match of words not yet
marked is marked again and again, found by running Karp-Rabin, until none of
LEAST words is left. An item is leaked into a document if tiles cover THRESHOLD
of its words, in whatever order they stand there.

The items are sent to the executors in blocks of at most BLOCK_BYTES of text, so
what is broadcast is bounded whatever the benchmark's size; each block is a pass
over the documents. Expanded, a block is about 5 times its text in flat arrays and
a dictionary of its different words.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import ceil_div, in_slices, small_batches, written

LEAST = 5
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20
#: Where Karp-Rabin's search length starts.
FIRST_LENGTH = 20
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_WORDS = re.compile(r"[^\W_]+").findall


def tokens(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def _windows(free: list[bool], ids: list[int], length: int) -> Iterator[tuple[int, int]]:
    """(start, running hash) of each window of free places."""
    top = pow(_MULT, length - 1, 1 << 64)
    value = run = 0
    for i, x in enumerate(ids):
        if not free[i]:
            value = run = 0
            continue
        if run >= length:
            value = (value - ids[i - length] * top) & _MASK
        value = (value * _MULT + x) & _MASK
        run += 1
        if run >= length:
            yield i - length + 1, value


def tile(item: list[int], text: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """The tiles (length, start in item, start in text), longest first; of equals the first in the item, then in the text.

    Numbers below zero match nothing.
    """
    free_i, free_t = [x >= 0 for x in item], [x >= 0 for x in text]
    tiles: list[tuple[int, int, int]] = []
    length = max(least, FIRST_LENGTH)
    while True:
        found, longest = _scan(item, text, free_i, free_t, length)
        if longest > 2 * length:
            length = longest
            continue
        heap = [(-n, i, t) for n, i, t in found]
        heapq.heapify(heap)
        marked = False
        while heap:
            n, i, t = heapq.heappop(heap)
            n = -n
            if all(free_i[i : i + n]) and all(free_t[t : t + n]):
                free_i[i : i + n] = free_t[t : t + n] = [False] * n
                tiles.append((n, i, t))
                marked = True
                continue
            start = None  # what other tiles have left of it
            for k in range(n + 1):
                if k < n and free_i[i + k] and free_t[t + k]:
                    start = k if start is None else start
                elif start is not None:
                    if k - start >= length:
                        heapq.heappush(heap, (start - k, i + start, t + start))
                    start = None
        if marked and length > least:
            length = max(least, length // 2)
        elif not marked and length > least:
            length = max(least, length // 2)
        else:
            return sorted(tiles, key=lambda x: (-x[0], x[1], x[2]))


def _scan(item: list[int], text: list[int], free_i: list[bool], free_t: list[bool], length: int) -> tuple[list[tuple[int, int, int]], int]:
    """All maximal matches of free words of at least `length`, and the longest length."""
    at: dict[int, list[int]] = {}
    for t, h in _windows(free_t, text, length):
        at.setdefault(h, []).append(t)
    found, longest = [], 0
    for i, h in _windows(free_i, item, length):
        for t in at.get(h, ()):
            if i and t and free_i[i - 1] and free_t[t - 1] and item[i - 1] == text[t - 1]:
                continue  # part of a longer match that starts before
            n = 0
            while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                n += 1
            if n >= length:
                found.append((n, i, t))
                longest = max(longest, n)
    return found, longest


def shortened(text: np.ndarray, hashes: np.ndarray, least: int, longest: int) -> np.ndarray:
    """The words of a text without the middles of long periodic stretches; hashes are those of its runs of `least` words.

    Tiles take no more words of a text than the item has, and none is longer than
    the item. Where words repeat with a period over many times the item's length,
    whole periods in the middle therefore change nothing: what is left has every
    run of up to that length as often as tiles can use it.
    """
    n = len(hashes)
    if n < 8 * longest:
        return text
    order = np.argsort(hashes, kind="stable")
    before = np.full(n, -1)
    same = hashes[order[1:]] == hashes[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    period = np.where(before >= 0, np.arange(n) - before, 0)
    period[period > longest] = 0
    keep = np.ones(len(text), bool)
    edge = np.flatnonzero(np.diff(period)) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), n]):  # noqa: B905
        p = int(period[a])
        spare = (b - a - 4 * longest) // p * p if p else 0
        if spare > 0:
            keep[a + 2 * longest : a + 2 * longest + spare] = False
    return text[keep]


class Benchmark:
    """A block of items with the index of their seeds: flat arrays, but for the numbers of their words."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST):
        self.least = least
        self.number: dict[str, int] = {}
        self.item_ids, lists = [], []
        for item_id, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in tokens(text)]
            if len(ids) >= least:
                self.item_ids.append(item_id)
                lists.append(np.array(ids, np.int32))
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.words = np.concatenate([*lists, np.empty(0, np.int32)])
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        hashes = [self.hashes(x) for x in lists]
        flat = np.concatenate([*hashes, np.empty(0, np.uint64)])
        holder = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in hashes])
        order = np.lexsort((holder, flat))
        #: the different seeds in order, and the items that hold each, as often as they do
        self.seeds, first = np.unique(flat[order], return_index=True)
        self.first, self.holders = np.append(first, len(flat)), holder[order]

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.least + 1
        h = np.zeros(max(n, 0), np.uint64)
        if n > 0:
            x = ids.astype(np.int64).astype(np.uint64)
            for j in range(self.least):
                h = h * np.uint64(_MULT) + x[j : j + n] + np.uint64(1)
        return h

    def leaks(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, int]]:
        """(item_id, its words, covered words, tiles, longest tile) of each item leaked into a text."""
        if not text or not len(self.seeds):
            return []
        number, least = self.number, self.least
        ids = np.array([number.get(w, -1) for w in tokens(text)], np.int64)
        if len(ids) < least:
            return []
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        whole = np.flatnonzero(known[least:] - known[:-least] == least)
        if not len(whole):
            return []
        h = self.hashes(ids)[whole]
        place = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
        hit = self.seeds[place] == h
        starts, place = whole[hit], place[hit]
        if not len(starts):
            return []
        # an item of which too few seeds are there to cover enough goes before anything is laid out
        seen = np.unique(place)
        sharing = np.bincount(np.concatenate([self.holders[self.first[s] : self.first[s + 1]] for s in seen.tolist()]), minlength=len(self.sizes))
        out = []
        for k in np.flatnonzero(sharing * least >= threshold * self.sizes).tolist():
            item = self.words[self.begin[k] : self.begin[k + 1]]
            own = starts[np.isin(place, np.searchsorted(self.seeds, np.unique(self.hashes(item))))]
            part = []  # the words that seeds cover, stretch by stretch; others cannot be in a tile
            new = np.flatnonzero(np.diff(own) > least) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(own)]):  # noqa: B905
                stretch = ids[own[a] : own[b - 1] + least]
                part += shortened(stretch, self.hashes(stretch), least, len(item)).tolist()
                part.append(-1)
            tiles = tile(item.tolist(), part, least)
            covered = sum(n for n, _, _ in tiles)
            if covered >= threshold * len(item):
                out.append((self.item_ids[k], len(item), covered, len(tiles), max(n for n, _, _ in tiles)))
        return out


def blocks(benchmark: DataFrame, most_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks; a null text is no item."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, ceil_div(2 * total, most_bytes)) if total > most_bytes else 1
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
        yield sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


_LEAK = "item_id long, n_words integer, covered integer, n_tiles integer, longest integer"


def leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each document and item leaked into it: the columns `keep`, item_id, n_words, covered, n_tiles, longest.

    Null and empty texts hold nothing; items under LEAST words are never found;
    repeated documents or items give a row each; an empty table gives none. A very
    long text is read once a block, and long periodic stretches of it are cut to
    what tiles can use; columns that are not in `keep` are ignored.
    """
    out = None
    asked = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = asked.drop("_text").schema
    for name, kind in (x.split(" ") for x in _LEAK.split(", ")):
        schema = schema.add(name, kind)
    for block in blocks(benchmark):
        found = small_batches(asked).mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(Benchmark(block)), schema.names), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(sent, names):
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = sent.value
        for part in in_slices(batches, "_text"):
            rows, found = [], []
            for i, text in enumerate(part.column("_text").to_pylist()):
                for leak in bench.leaks(text):
                    rows.append(i)
                    found.append(leak)
            if rows:
                kept = part.drop_columns(["_text"]).take(pa.array(rows))
                new = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item is leaked, with their columns, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; an empty
    benchmark takes nothing. Of several blocks each is a pass over what the ones
    before have left, so a worker holds one block.
    """
    out, turn = docs, 0
    for block in blocks(benchmark):
        out = written(out, "cleaned") if turn else out
        out = small_batches(out).mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(Benchmark(block))), docs.schema)
        turn += 1
    return out


def _cleaner(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = sent.value
        for part in in_slices(batches, "text"):
            keep = [not bench.leaks(t) for t in part.column("text").to_pylist()]
            if any(keep):
                yield part.filter(pa.array(keep))

    return run


def op2(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks, with coverage."""
    return leaks(docs, benchmark, ["doc_id"]).withColumn("coverage", F.round(F.col("covered") / F.col("n_words"), 6))
