"""Substring dedup by suffix automata of reference shards.

The corpus is its own reference, so the reference grows with it and cannot be
sent whole to every executor. It is cut into shards instead, and documents go
only to the shards that can hold something of theirs:

1. Every window of WINDOW words has an anchor, the run of ANCHOR words in it with
   the smallest hash. Equal windows have equal anchors. Anchors are counted
   (pre-aggregated); those that occur twice or more mark the candidate windows,
   by a bit table of bounded size that every executor gets. A table too small for
   the corpus only lets more candidates through. Stretches of neighbouring
   candidates are regions; only their words travel further.
2. Candidate windows are counted by content (96 bits of hash); of each that occurs
   twice or more one place is its reference. Neighbouring references are a
   passage of at most PIECE windows, and each passage is a reference shard.
3. Regions ask shards. One window in EVERY, chosen by its hash, is joined with its
   reference and asks that shard about itself and its neighbours up to the next
   such windows. The shard's suffix automaton reads their words and gives at each
   word the length of the longest match that ends there; WINDOW words or more are
   a window found.
4. Windows that none of the shards asked had are all joined with their references
   in a second round, so none is missed; they are few, as texts mostly go on as
   their references do.

Every window has one reference at most, so no join makes more rows than windows
go into it, however often an anchor, passage or text occurs. A shard that many
regions ask is one key of a join of two exchanges, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vicinity.llm.common import bit_table, has_bit, in_slices, passing, small_batches, written
from vicinity.llm.hashing import batch_words, mix, runs

WINDOW = 35
ANCHOR = 8
#: The most windows of a shard, and of a region that one question is about.
PIECE = 1024
#: One window in so many asks in the first round.
EVERY = 8
_BATCH = 1 << 20
#: What makes the second 64 bits of a content's hash independent of the first.
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


class Scanner:
    """Windows and anchors of a batch of texts."""

    def __init__(self, texts: list[str | None], window: int):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        self.window = window
        self.words, self.at = batch_words(raw)
        anchor = min(ANCHOR, window)
        width = window - anchor + 1
        n = len(self.words) - window + 1
        if n <= 0:
            self.start = self.place = np.empty(0, np.int64)
            self.anchor, self.doc = np.empty(0, np.uint64), np.empty(0, np.int64)
            return
        # the first place of the smallest hash among `width` neighbours, by doubling
        value = runs(self.words, anchor)
        place, span = np.arange(len(value)), 1
        while span < width:
            step = min(span, width - span)
            later = value[step:] < value[:-step]
            value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
            span += step
        doc = np.repeat(np.arange(len(raw)), np.diff(self.at))
        inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
        #: of each window inside a text: its first word, its anchor and the anchor's place, its text
        self.start, self.anchor, self.place, self.doc = inside, value[inside], place[inside], doc[inside]

    def first_of_run(self) -> np.ndarray:
        """Which windows are the first with their anchor's place."""
        new = np.ones(len(self.place), bool)
        new[1:] = (self.place[1:] != self.place[:-1]) | (self.doc[1:] != self.doc[:-1])
        return new

    def candidates(self, table: np.ndarray) -> np.ndarray:
        """Which windows have an anchor whose bit is set."""
        return has_bit(table, self.anchor)


def _key() -> list[Column]:
    """Columns (i, t): the doc_id and a hash of the text. Rows that agree in both have the same text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("i"), F.xxhash64(F.col("text").cast("string")).alias("t")]


def repeated_anchors(docs: DataFrame, window: int) -> np.ndarray:
    """The bit table of the anchors that occur twice or more."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, "text", _BATCH):
            seen = Scanner(part.column("text").to_pylist(), window)
            yield pa.RecordBatch.from_arrays([pa.array(seen.anchor[seen.first_of_run()].view(np.int64))], names=["anchor"])

    twice = written(small_batches(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    return bit_table(twice)


_REGION = "i long, t long, lo int, words string"


def candidate_regions(docs: DataFrame, sent, window: int) -> DataFrame:
    """(region, i, t, lo, words): the maximal stretches of neighbouring candidate windows, numbered, with their first window's place and their words."""

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for part in in_slices(batches, "text", _BATCH):
            texts = part.column("text").to_pylist()
            seen = Scanner(texts, window)
            hit = np.flatnonzero(seen.candidates(table)) if len(seen.start) else np.empty(0, np.int64)
            if not len(hit):
                continue
            start, doc = seen.start[hit], seen.doc[hit]
            new = np.ones(len(hit), bool)
            new[1:] = (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(hit)) - 1
            own, held, stretches = [], -1, []
            for x, y in zip(first.tolist(), last.tolist(), strict=True):
                d = int(doc[x])
                if d != held:
                    held, own = d, texts[d].encode("utf-8", "replace").split()
                stretches.append(b" ".join(own[start[x] - seen.at[d] : start[y] - seen.at[d] + window]).decode("utf-8", "replace"))
            rows = pa.array(doc[first])
            lo = (start[first] - seen.at[doc[first]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("i").take(rows), part.column("t").take(rows), pa.array(lo), pa.array(stretches, pa.string())], names=["i", "t", "lo", "words"])

    return small_batches(docs.select(*_key(), F.col("text").cast("string").alias("text"))).mapInArrow(regions, _REGION).withColumn("region", F.monotonically_increasing_id())


def windows_of(regions: DataFrame, window: int, every: int = 1) -> DataFrame:
    """(h, g, region, off, a, b) of the windows whose hash `every` divides: their content's hash, their place, and the neighbours [a, b] that they ask for too.

    Of regions (region, words, spans) those in the spans [x, y) are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, "words", _BATCH):
            words, at = batch_words([x.encode("utf-8", "replace") for x in part.column("words").to_pylist()])
            h, g = runs(words, window), runs(mix(words ^ _OTHER), window)
            size = np.diff(at) - window + 1
            owner = np.repeat(np.arange(len(size)), size)
            off = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            place = at[owner] + off
            take = h[place] % np.uint64(every) == 0
            if "spans" in part.schema.names:
                found = part.column("spans")
                flat, cuts = found.flatten(), found.offsets.to_numpy() - found.offsets[0].as_py()
                base = np.repeat(np.cumsum(size) - size, np.diff(cuts))
                edge = np.zeros(len(owner) + 1, np.int64)
                np.add.at(edge, base + flat.field("x").to_numpy(), 1)
                np.add.at(edge, base + flat.field("y").to_numpy(), -1)
                take &= np.cumsum(edge[:-1]) == 0
            owner, off, place = owner[take], off[take], place[take]
            a, b = off, off
            if every > 1 and len(off):
                same = owner[1:] == owner[:-1]
                a = np.concatenate([[0], np.where(same, off[:-1] + 1, 0)])
                b = np.concatenate([np.where(same, off[1:] - 1, size[owner[:-1]] - 1), size[owner[-1:]] - 1])
            columns = [h[place].view(np.int64), (g[place] >> np.uint64(32)).astype(np.uint32).view(np.int32), part.column("region").to_numpy()[owner]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.array(x.astype(np.int32)) for x in (off, a, b))], names=["h", "g", "region", "off", "a", "b"])

    return small_batches(regions).mapInArrow(run, "h long, g int, region long, off int, a int, b int")


def reference_windows(regions: DataFrame, window: int) -> DataFrame:
    """(h, g, s, p, q): of each window that occurs twice or more its shard, the windows p to q of region s."""
    places = windows_of(regions.select("region", "words"), window).select("h", "g", "region", "off")
    # counts and extremes of numbers: hash aggregation, merged before the shuffle
    first = places.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("region").alias("s"), F.min_by("off", "region").alias("off")).where("n > 1")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a passage may be cut where a batch ends, too
            s, off = batch.column("s").to_numpy(), batch.column("off").to_numpy()
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (off[1:] != off[:-1] + 1) | (off[1:] % PIECE == 0)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(s)))
            p, q = np.repeat(off[first], size), np.repeat(off[first + size - 1], size)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("g"), batch.column("s"), pa.array(p), pa.array(q)], names=["h", "g", "s", "p", "q"])

    ordered = first.select("h", "g", "s", "off").repartition("s").sortWithinPartitions("s", "off")
    return ordered.mapInArrow(pieces, "h long, g int, s long, p int, q int")


def cut_out(regions: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(s, p, region, a, words): the words of the windows a to b of a region, for each row (s, p, region, a, b) of asked.

    A region's words are split once, whatever is cut out of it.
    """
    lists = asked.groupBy("region").agg(F.collect_list(F.struct("s", "p", "a", "b")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, "words", _BATCH):
            found = part.column("asked")
            at, flat = found.offsets.to_numpy() - found.offsets[0].as_py(), found.flatten()
            fields = {f: flat.field(f).to_numpy() for f in ("s", "p", "a", "b")}
            for i, text in enumerate(part.column("words").to_pylist()):
                own = text.split(" ")
                for x in range(at[i], at[i + 1], 64):
                    some = slice(x, min(x + 64, at[i + 1]))
                    words = [" ".join(own[a : b + window]) for a, b in zip(fields["a"][some].tolist(), fields["b"][some].tolist(), strict=True)]
                    region = np.full(len(words), part.column("region")[i].as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(fields["s"][some]), pa.array(fields["p"][some]), pa.array(region), pa.array(fields["a"][some]), pa.array(words, pa.string())], names=["s", "p", "region", "a", "words"])

    whole = lists.join(regions.select("region", "words").hint("merge"), "region")
    return small_batches(whole).mapInArrow(cut, "s long, p int, region long, a int, words string")


class SuffixAutomaton:
    """Of a list of words: the smallest automaton of all their runs."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def statistics(self, words: list[str]) -> Iterator[int]:
        """At each word the length of the longest run that ends there and occurs in the reference."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            yield n

    def spans(self, words: list[str], least: int) -> list[tuple[int, int]]:
        """The maximal stretches of words covered by matches of at least `least` words."""
        out: list[tuple[int, int]] = []
        for i, n in enumerate(self.statistics(words)):
            if n >= least:
                if out and i + 1 - n <= out[-1][1]:
                    out[-1] = (min(out[-1][0], i + 1 - n), i + 1)
                else:
                    out.append((i + 1 - n, i + 1))
        return out


def ask(windows: DataFrame, refs: DataFrame, shards: DataFrame, regions: DataFrame, window: int) -> DataFrame:
    """(region, x, y): the stretches of windows [x, y) of regions that the shards of these windows' references hold."""
    met = windows.join(refs.hint("merge"), ["h", "g"])
    asked = met.groupBy("region", "s", "p", F.expr(f"off div {PIECE}").alias("_part")).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    streams = cut_out(regions, asked, window).join(shards.hint("merge"), ["s", "p"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton = None, None
        for part in in_slices(batches, "words", _BATCH):
            regions, xs, ys = [], [], []
            columns = [part.column(c).to_pylist() for c in ("s", "p", "region", "a", "words")]
            for j, (s, p, region, a, text) in enumerate(zip(*columns, strict=True)):
                if (s, p) != known:  # what asks a shard comes in a row
                    known, automaton = (s, p), SuffixAutomaton(part.column("passage")[j].as_py().split(" "))
                for start, end in automaton.spans(text.split(" "), window):
                    regions.append(region)
                    xs.append(a + start)
                    ys.append(a + end - window + 1)
            yield pa.RecordBatch.from_arrays([pa.array(regions, pa.int64()), pa.array(xs, pa.int32()), pa.array(ys, pa.int32())], names=["region", "x", "y"])

    return written(small_batches(streams.select("s", "p", "region", "a", "words", "passage")).mapInArrow(match, "region long, x int, y int"), "found")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(i, t, spans): of each text the stretches of windows [x, y) to remove, sorted but perhaps overlapping."""
    with passing(docs.sparkSession) as lasting:
        sent = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs, window))
        regions = written(candidate_regions(docs, sent, window), "regions")
        refs = written(reference_windows(regions, window), "references")
        passage = refs.groupBy("s", "p").agg(F.max("q").alias("b")).select("s", "p", F.col("s").alias("region"), F.col("p").alias("a"), "b")
        shards = written(cut_out(regions, passage, window).select("s", "p", F.col("words").alias("passage")), "shards")
        texts = regions.select("region", "words")
        first = ask(windows_of(texts, window, EVERY), refs, shards, regions, window)
        none = F.array().cast("array<struct<x:int,y:int>>")
        left = texts.join(first.groupBy("region").agg(F.collect_set(F.struct("x", "y")).alias("spans")).hint("merge"), "region", "left").withColumn("spans", F.coalesce("spans", none))
        second = ask(windows_of(left, window), refs, shards, regions, window)
        found = regions.select("region", "i", "t", "lo").join(first.unionByName(second), "region")
        per_text = found.groupBy("i", "t").agg(F.array_sort(F.collect_set(F.struct((F.col("lo") + F.col("x")).alias("x"), (F.col("lo") + F.col("y")).alias("y")))).alias("spans"))
        return lasting(per_text, "spans")


def remove(docs: DataFrame, keep: list[str], window: int = WINDOW, digest: bool = False) -> DataFrame:
    """The columns `keep`, n_words, n_removed and kept: what is left of every whole text, its words joined by single spaces.

    With `digest` it is kept_sha256 instead, so that texts don't travel back.

    Windows are judged on the input. A null text has no words; repeated rows
    repeat each other and go; rows of one doc_id, or of none, with different texts
    are judged apart; a very long text asks piece by piece; an
    empty table gives no rows; further columns are ignored unless they are in `keep`.
    """
    spans = repeated_spans(docs, window)
    # only texts that the spans' bits select travel whole
    at = lambda i, t: F.xxhash64(i, t).alias("_at")
    sent = docs.sparkSession.sparkContext.broadcast(bit_table(spans.select(at("i", "t")).distinct()))
    i, t = _key()
    asked = docs.select(*keep, i.alias("_i"), t.alias("_t"), F.col("text").cast("string").alias("_text")).withColumn("_at", at("_i", "_t"))
    plain = asked.drop("_text", "_at").schema
    judged = StructType(plain.fields[:]).add("_n", "long").add("_kept", "string").add("_open", "boolean")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for part in in_slices(batches, "_text", _BATCH):
            texts = part.column("_text").to_pylist()
            is_open = has_bit(table, part.column("_at").to_numpy().view(np.uint64))
            words = [() if o else (t or "").encode("utf-8", "replace").split() for t, o in zip(texts, is_open, strict=True)]
            done = (lambda w: hashlib.sha256(b" ".join(w)).hexdigest()) if digest else (lambda w: b" ".join(w).decode("utf-8", "replace"))
            counts = [len(w) for w in words]
            kept = [t if o else done(w) for t, o, w in zip(texts, is_open, words, strict=True)]
            own = [part.column(c) for c in part.schema.names if c not in ("_text", "_at")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(kept, pa.string()), pa.array(is_open)], names=judged.names)

    return _finish(small_batches(asked).mapInArrow(scan, judged), spans, plain, digest, window)


def _finish(scanned: DataFrame, spans: DataFrame, plain: StructType, digest: bool, window: int) -> DataFrame:
    names = [x for x in plain.names if x not in ("_i", "_t")]
    schema = StructType([f for f in plain.fields if f.name in names]).add("n_words", "long").add("n_removed", "long").add("kept_sha256" if digest else "kept", "string")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, "_kept", _BATCH):
            removed, kept, counts = [], [], []
            for n, text, is_open, found in zip(*(part.column(c).to_pylist() for c in ("_n", "_kept", "_open", "spans")), strict=True):
                gone = 0
                if is_open:
                    own, at, left = text.encode("utf-8", "replace").split(), 0, []
                    n = len(own)
                    for span in found or ():
                        start, end = max(at, span["x"]), span["y"] + window - 1
                        if end > at:
                            left += own[at:start]
                            gone += end - start
                            at = end
                    raw = b" ".join(left + own[at:])
                    text = hashlib.sha256(raw).hexdigest() if digest else raw.decode("utf-8", "replace")
                removed.append(gone)
                kept.append(text)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    joined = scanned.join(spans.hint("merge"), (scanned["_i"] == spans["i"]) & (scanned["_t"] == spans["t"]), "left")
    return small_batches(joined.select(*names, "_n", "_kept", "_open", "spans")).mapInArrow(finish, schema)


def op1(docs: DataFrame) -> DataFrame:
    """Per document the number of words, of removed words, and the digest of what is left."""
    return remove(docs, ["doc_id"], digest=True)
