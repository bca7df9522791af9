"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles of SHINGLE lower-case words (a
shorter text is one shingle); a weight is the shingle's frequency in the text
times its damped idf, 1 + ln(N / df) / ln(N + 1). Document frequencies come from
all documents, counted in a table of BUCKETS hashed counters, whose size does not
grow with the corpus.

Each text gets BANDS * ROWS consistent weighted samples; two texts draw the same
sample with the probability of their weighted Jaccard similarity. Texts with
equal words are one node. Nodes that share a band meet at the band's head and are
verified by the exact weighted Jaccard similarity of their whole texts. The head
is the node that shares the most bands with others: of many copies the original.
In buckets of more than EXHAUSTED nodes, those that it does not match meet at more
heads, in HOT_ROUNDS rounds in all. Heads only spare work: what they have linked
is one class, and then every two nodes of a bucket that are not yet of one class
are compared, in tiles of bounded size. A bucket with more than SPLIT texts that
are unlike its largest class, as boilerplate makes it, is first split by
FINE_BANDS * FINE_ROWS further samples, at which alike texts meet all the same and
unlike ones seldom, so that the work does not grow with its square. Verified links form classes by their
connected components, found by star contraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinity.llm.common import in_files, in_slices, passing, small_batches, written
from vicinity.llm.hashing import batch_words, mix, runs

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
BUCKETS = 1 << 18
#: Buckets of up to so many texts have one head before all their pairs are compared; larger ones have so many rounds of heads: 1, then 4 more.
EXHAUSTED, HOT_ROUNDS = 16, 2
#: Buckets of which more texts than this are outside the largest class are split by further samples: two texts of similarity 0.8 then meet with probability 1 - 4e-7, those of 0.3 with 0.005.
SPLIT, FINE_BANDS, FINE_ROWS = 8192, 80, 8
#: The most texts and bytes of text of each side of a tile, about.
TILE_ROWS, TILE_BYTES = 1024, 4 << 20
#: Entries of the table of random triples that the samples share.
_TABLE = 1 << 16
_ONE = np.uint64(1)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its distinct shingles and their counts, all texts in a row, and the number of each text's."""
    words, at = batch_words([(t or "").lower().encode("utf-8", "replace") for t in texts])
    values, counts, sizes = [], [], []
    long = runs(words, SHINGLE)
    for a, b in zip(at, at[1:]):  # noqa: B905
        n = b - a
        if n >= SHINGLE:
            v, c = np.unique(long[a : b - SHINGLE + 1], return_counts=True)
        elif n:
            v, c = runs(words[a:b], n) + np.uint64(n), np.ones(1, np.int64)
        else:
            v, c = np.empty(0, np.uint64), np.empty(0, np.int64)
        values.append(v)
        counts.append(c)
        sizes.append(len(v))
    return np.concatenate([*values, np.empty(0, np.uint64)]), np.concatenate([*counts, np.empty(0, np.int64)]), np.array(sizes, np.int64)


def bucket(values: np.ndarray) -> np.ndarray:
    return (mix(values + _ONE) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many (document, shingle) pairs fall into each bucket; the last entry is the number of documents with words.

    Each task sends one row per used bucket, so what is shuffled and what comes
    to the driver are bounded by BUCKETS a task and in all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for part in in_slices(batches, "text", 1 << 20):
            values, _, sizes = shingles(part.column("text").to_pylist())
            total[:BUCKETS] += np.bincount(bucket(values), minlength=BUCKETS)
            total[BUCKETS] += int((sizes > 0).sum())
        used = np.flatnonzero(total)
        for i in range(0, len(used), 1 << 16):
            some = used[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = small_batches(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = rows.toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def idf(frequencies: np.ndarray) -> np.ndarray:
    """Damped idf of each bucket, between about 1 and 2; without frequencies all are 1."""
    n = max(1, int(frequencies[-1]))
    df = np.clip(frequencies[:-1], 1, n)
    return 1 + np.log(n / df) / np.log(n + 1)


class Sampler:
    def __init__(self, weights: np.ndarray):
        self.idf = weights
        rng = np.random.Generator(np.random.PCG64(20240229))
        self.r = rng.gamma(2.0, 1.0, _TABLE)
        self.log_c = np.log(rng.gamma(2.0, 1.0, _TABLE))
        self.beta = rng.random(_TABLE)
        self.odd = rng.integers(0, 1 << 63, BANDS * ROWS + FINE_BANDS * FINE_ROWS, dtype=np.uint64) * np.uint64(2) + _ONE

    def weights(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * self.idf[bucket(values)]

    def bands(self, texts: list[str | None], bands: int = BANDS, rows: int = ROWS, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The band keys of each text, from the samples from `first` on, and whether it has words at all."""
        values, counts, sizes = shingles(texts)
        has = sizes > 0
        out = np.zeros((len(texts), bands), np.uint64)
        if not len(values):
            return out, has
        log_w = np.log(self.weights(values, counts))
        begin = np.concatenate([[0], np.cumsum(sizes[has])])[:-1]
        size = sizes[has]
        for band in range(bands):
            key = np.full(len(begin), band + 1, np.uint64)
            for row in range(rows):
                place = ((values * self.odd[first + band * rows + row]) >> np.uint64(48)).astype(np.int32)
                r, beta = self.r[place], self.beta[place]
                t = np.floor(log_w / r + beta)
                log_a = self.log_c[place] - r * (t - beta + 1)
                least = np.minimum.reduceat(log_a, begin)
                # the samples of equal log_a: the one of the smallest hash
                at = np.flatnonzero(log_a == np.repeat(least, size))
                owner = np.searchsorted(begin, at, "right") - 1
                new = np.concatenate([[True], owner[1:] != owner[:-1]])
                at = at[new]  # values are sorted within a text
                sample = mix(values[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                key = mix(key * np.uint64(0xD1342543DE82EF95) + sample)
            out[has, band] = key
        return out, has

    def similarity(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
        """Weighted Jaccard similarity of two (sorted shingles, weights)."""
        common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        del common
        least = np.minimum(a[1][i], b[1][j]).sum()
        return float(least / (a[1].sum() + b[1].sum() - least))

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        values, counts, _ = shingles([text])
        return values, self.weights(values, counts)


def signatures(docs: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """(doc_id, hash, key, bands): key is equal for texts with equal words; it is null without words. hash is the text's own, to find it by."""
    sent = docs.sparkSession.sparkContext.broadcast(idf(frequencies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        sampler = Sampler(sent.value)
        for part in in_slices(batches, "text", 1 << 20):
            texts = part.column("text").to_pylist()
            bands, has = sampler.bands(texts)
            keys = [md5(b" ".join((t or "").lower().encode("utf-8", "replace").split())).digest() if h else None for t, h in zip(texts, has, strict=True)]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(texts) + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(keys, pa.binary()), listed], names=["doc_id", "hash", "key", "bands"])

    return small_batches(_own(docs)).mapInArrow(run, "doc_id long, hash long, key binary, bands array<long>")


def _own(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def verify(pairs: DataFrame, texts: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """Add `similar` to distinct pairs (a, b) of nodes; texts is (node, text)."""
    sent = pairs.sparkSession.sparkContext.broadcast(idf(frequencies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(sent.value)
        head, known = None, None
        for part in in_slices(batches, "text_a", 1 << 20):
            result, right = [], part.column("text_b")
            for j, (b, x) in enumerate(zip(part.column("b").to_pylist(), part.column("text_a").to_pylist(), strict=True)):
                if b != head:  # heads come in runs
                    head, known = b, sampler.vector(right[j].as_py())
                result.append(sampler.similarity(sampler.vector(x), known) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(result, pa.bool_())], names=["a", "b", "similar"])

    # texts meet by shuffles at every size: the pairs grow with the corpus
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return small_batches(both.select("a", "b", "text_a", "text_b")).mapInArrow(run, "a long, b long, similar boolean")


def compare(sampler: Sampler, texts: list[str], rest: np.ndarray, part: np.ndarray, roots: np.ndarray, bands: np.ndarray, bucket_: int) -> list[tuple[int, int]]:
    """Links, as places, that join the classes `roots` of one tile's texts.

    Every two texts of different classes are compared whose first common band is
    this bucket, where one is of the tile's first side: the texts of `rest`, or if
    all are, those of the least `part`. A link between classes that earlier links
    have joined already is left out.
    """
    if not rest.any():
        return []
    first = np.flatnonzero(rest & (part == part[rest].min()))
    second = np.setdiff1d(np.arange(len(texts)), first) if len(first) < len(texts) else first
    values, counts, sizes = shingles(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    total = np.bincount(owner, sampler.weights(values, counts), len(texts))
    x, y = first[:, None], second[None, :]
    open_ = (roots[x] != roots[y]) & (np.minimum(total[x], total[y]) >= (SIMILARITY - 1e-9) * np.maximum(total[x], total[y]))
    if first is second:
        open_ &= x < y
    before = np.ones(open_.shape, bool)
    for band in range(bands.shape[1]):  # a pair is compared in the first bucket that it shares
        here = bands[first, band] == bucket_
        equal = bands[first, band][:, None] == bands[second, band][None, :]
        open_ &= ~(before & equal & ~here[:, None])
        before &= ~equal
    if not open_.any():
        return []
    # a shingle that occurs n times is n tokens, so the sum of the lesser weights is a matrix product
    kinds, kind = np.unique(values, return_inverse=True)
    level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    token = np.repeat(kind, counts) * (int(counts.max()) + 1) + level
    owner = np.repeat(owner, counts)
    idf_of = sampler.idf[bucket(kinds)]
    side = np.zeros(len(texts), bool)
    side[first] = True
    several, times = np.unique(token, return_counts=True)
    mutual = several[times > 1] if first is second else np.intersect1d(token[side[owner]], token[~side[owner]])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    place = np.zeros(len(texts), np.int64)
    place[first] = np.arange(len(first))
    place_second = np.zeros(len(texts), np.int64)
    place_second[second] = np.arange(len(second))
    common = np.zeros(open_.shape)
    for i in range(0, len(mutual), 1024):
        some = mutual[i : i + 1024]
        lo, hi = np.searchsorted(token, some[0], "left"), np.searchsorted(token, some[-1], "right")
        column = np.searchsorted(some, token[lo:hi])
        have = some[column] == token[lo:hi]
        column, who = column[have], owner[lo:hi][have]
        left, right = np.zeros((len(first), len(some))), np.zeros((len(second), len(some)))
        at = side[who]
        left[place[who[at]], column[at]] = idf_of[some[column[at]] // (int(counts.max()) + 1)]
        at = ~side[who] if first is not second else at
        right[place_second[who[at]], column[at]] = 1
        common += left @ right.T
    alike = common / (total[x] + total[y] - common)
    parent: dict[int, int] = {}

    def root(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            r = up
        return r

    out = []
    for i, j in zip(*np.nonzero(open_ & (alike >= SIMILARITY - 1e-9)), strict=True):
        a, b = int(first[i]), int(second[j])
        ra, rb = root(int(roots[a])), root(int(roots[b]))
        if ra != rb and (alike[i, j] >= SIMILARITY + 1e-9 or sampler.similarity(sampler.vector(texts[a]), sampler.vector(texts[b])) >= SIMILARITY):
            parent[ra] = rb
            out.append((a, b))
    return out


def split(large: DataFrame, texts: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """(bucket, node, bands): the nodes of large buckets (bucket, node) dealt anew, each into FINE_BANDS smaller ones of its bucket."""
    sent = large.sparkSession.sparkContext.broadcast(idf(frequencies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(sent.value)
        for part in in_slices(batches, "text", 1 << 20):
            bands, _ = sampler.bands(part.column("text").to_pylist(), FINE_BANDS, FINE_ROWS, BANDS * ROWS)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, FINE_BANDS * len(bands) + 1, FINE_BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node"), listed], names=["node", "fine"])

    fine = small_batches(texts.join(large.select("node").distinct().hint("merge"), "node", "left_semi")).mapInArrow(run, "node long, fine array<long>")
    dealt = large.join(fine, "node").select("node", "bucket", F.explode("fine").alias("_f")).select("node", F.xxhash64("bucket", "_f").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return written(dealt.join(shared, "bucket").select("bucket", "node", F.array("bucket").alias("bands")), "split")


def exhaust(members: DataFrame, texts: DataFrame, found: DataFrame, frequencies: np.ndarray, splits: int = 1) -> DataFrame:
    """Links (a, b) between the classes that `found` makes, from all pairs of nodes of a bucket; members is (bucket, node, bands).

    The nodes of a bucket's largest class need not meet each other. They and the
    rest are dealt out in parts of about TILE_ROWS texts and TILE_BYTES, and a
    tile is two parts, not both of the largest class. A text is sent once a tile,
    not once a pair.
    """
    sent = members.sparkSession.sparkContext.broadcast(idf(frequencies))
    sized = members.join(texts.select("node", F.octet_length("text").alias("size")), "node")
    of = written(in_files(sized.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node")), members.count()), "members")
    by_root = of.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"))
    stats = by_root.groupBy("bucket").agg(F.max(F.struct("m", "root", "s")).alias("main"), F.sum("m").alias("n"), F.sum("s").alias("all"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    parts = lambda n, size: F.ceil(F.greatest(n / TILE_ROWS, size / TILE_BYTES)).cast("int")
    large = stats.where(F.col("n") - F.col("main.m") > SPLIT).select("bucket") if splits else None
    if large is not None and large.isEmpty():
        large = None
    stats = stats if large is None else stats.where(F.col("n") - F.col("main.m") <= SPLIT)
    sides = stats.select("bucket", F.col("main.root").alias("main"), parts(F.col("main.m"), F.col("main.s")).alias("mains"), parts(F.col("n") - F.col("main.m"), F.col("all") - F.col("main.s")).alias("rests"))
    dealt = of.join(sides, "bucket").withColumn("rest", F.col("root") != F.col("main"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tile = lambda main, i, j: F.struct(F.lit(main).alias("main"), i.alias("i"), j.alias("j"))
    part = F.col("part")
    own = F.concat(F.transform(upto("rests"), lambda j: tile(False, F.least(part, j), F.greatest(part, j))), F.transform(upto("mains"), lambda j: tile(True, part, j)))
    tiles = dealt.withColumn("tile", F.explode(F.when(F.col("rest"), own).otherwise(F.transform(upto("rests"), lambda i: tile(True, i, part)))))
    sent_to = tiles.select("node", "root", "bands", "bucket", "rest", "part", F.xxhash64("bucket", "tile").alias("tile"))
    full = sent_to.join(texts.select("node", "text").hint("merge"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, held = Sampler(sent.value), None

        def done(table: pa.Table) -> pa.RecordBatch:
            nodes, bucket_ = table.column("node").to_numpy(), int(table.column("bucket")[0].as_py())
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
            pairs = compare(sampler, table.column("text").to_pylist(), table.column("rest").to_numpy(), table.column("part").to_numpy(), table.column("root").to_numpy(), bands, bucket_)
            ends = np.array([(nodes[a], nodes[b]) for a, b in pairs], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ends.max(1)), pa.array(ends.min(1))], names=["a", "b"])

        for batch in batches:
            keys = batch.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):  # noqa: B905
                piece = pa.Table.from_batches([batch.slice(start, end - start)])
                if end > start and held is not None and held.column("tile")[0].as_py() != keys[start]:
                    yield done(held)
                    held = None
                if end > start:
                    held = piece if held is None else pa.concat_tables([held, piece])
        if held is not None:
            yield done(held)

    grouped = full.repartition("tile").sortWithinPartitions("tile", "node")
    out = written(small_batches(grouped).mapInArrow(run, "a long, b long"), "exhausted")
    if large is None:
        return out
    rest = split(of.join(large, "bucket").select("bucket", "node"), texts, frequencies)
    return out.unionByName(exhaust(rest, texts, found, frequencies, splits - 1))


def links(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], frequencies: np.ndarray) -> DataFrame:
    """Verified links (a, b), a > b, between nodes (node, bands): their classes are those of all alike nodes that share a bucket.

    texts_of gives (node, text), a row a node, of a table of nodes.
    """
    members = nodes.select("node", "bands", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = members.join(shared, "bucket")
    # the text that most others share bands with, as the original of many copies does, is the first head
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    every = written(met.join(weight, "node"), "buckets")
    left = every.drop("bands")
    texts = written(texts_of(left.select("node").distinct()), "texts")
    found = None
    for turn in range(HOT_ROUNDS):
        # from the second round on a bucket has several heads: few rounds empty even a bucket of unlike texts
        salt = F.pmod(F.xxhash64(F.col("node"), F.lit(turn)), F.lit(4**turn))
        heads = left.groupBy("bucket", salt.alias("salt")).agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("head")).select("bucket", "head")
        meet = left.join(heads, "bucket").where(F.col("node") != F.col("head"))
        pairs = meet.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
        checked = written(verify(pairs, texts, frequencies), "checked")
        good = checked.where("similar").select("a", "b")
        found = good if found is None else found.unionByName(good)
        if turn + 1 == HOT_ROUNDS:
            break
        # who has met a head that matches, or was a head, needs no more heads
        linked = meet.withColumn("a", F.greatest("node", "head")).withColumn("b", F.least("node", "head")).join(good, ["a", "b"]).select("bucket", "node")
        done = linked.unionByName(heads.select("bucket", F.col("head").alias("node"))).distinct()
        rest = left.where(F.col("n") > EXHAUSTED).join(done, ["bucket", "node"], "left_anti")
        more = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
        left = written(in_files(rest.join(more, "bucket"), every.count()), "buckets")
        if left.isEmpty():
            break
    found = found.distinct()
    return found.unionByName(exhaust(every.select("bucket", "node", "bands"), texts, found, frequencies)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest id of each connected component, for all but the roots, from edges (a, b) with a > b.

    Alternating star contraction: each round is a few joins on the edge table,
    which is written each time; nothing is collected but its checksum.
    """
    seen, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = written(in_files(both.join(least, "a").where("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), 2 * n), "large")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        down = edges.join(least, "a")
        small = down.select("a", F.col("m").alias("b")).unionByName(down.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = written(in_files(small, 2 * n), "small")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def classified(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, root, class_id) for every row: rows of one root are near duplicates, class_id is the smallest doc_id among them.

    A node is a text of its own words, whatever doc_ids it stands under, so rows
    of one doc_id with different texts are judged apart. Texts without words have
    no root.
    """
    with passing(docs.sparkSession) as lasting:
        frequencies = document_frequencies(docs)
        signed = lasting(signatures(docs, frequencies), "signed")
        copies = signed.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "hash", "bands")).alias("first"))
        nodes = written(copies.select("key", "first.doc_id", "first.hash", "first.bands", F.monotonically_increasing_id().alias("node")), "nodes")

        def texts_of(some: DataFrame) -> DataFrame:
            wanted = nodes.select("node", "doc_id", "hash").join(some, "node").hint("merge")
            # the join has dealt the rows by these columns already; repeated rows of a text are one
            return _own(docs).join(wanted, ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text")

        roots = components(links(nodes.select("node", "bands"), texts_of, frequencies))
        rooted = lasting(in_files(nodes.select("key", "doc_id", "node").join(roots, "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("root")), nodes.count()), "rooted")

    least = rooted.groupBy("root").agg(F.min("doc_id").alias("_class"))
    by_key = rooted.select("key", "root").join(least, "root").select(F.col("key").alias("_key"), "root", "_class")
    return signed.join(by_key, signed["key"] == by_key["_key"], "left").select("doc_id", "hash", "root", F.when(F.col("doc_id").isNotNull(), F.coalesce("_class", "doc_id")).alias("class_id"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every row: the smallest doc_id among its near duplicates.

    Texts without words (null, empty) and rows without doc_id are alone, the
    latter with a null class; repeated rows fall into one class; rows of one
    doc_id with different texts are judged apart; a very long text is compared
    whole; an empty table gives none; further columns are ignored.
    """
    return classified(docs).select("doc_id", "class_id")


def op4(docs: DataFrame) -> DataFrame:
    """Every document with its class and whether it stays: the one with the class's id does."""
    return classes(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, with its columns whatever their names: the one of the smallest doc_id, of several texts under it that of the smallest hash.

    Of repeated rows one stays; texts without words stay, and so do all rows without doc_id.
    """
    told = classified(docs).where("doc_id IS NOT NULL")
    first = told.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("f")).select("f.doc_id", "f.hash")
    stay = first.unionByName(told.where("root IS NULL").select("doc_id", "hash").distinct()).select(F.col("doc_id").alias("_stay"), F.col("hash").alias("_stay_hash"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    rank = F.row_number().over(W.partitionBy("_id", "_hash").orderBy("_id"))
    kept = rows.join(stay.hint("merge"), (F.col("_id") == F.col("_stay")) & (F.col("_hash") == F.col("_stay_hash"))).withColumn("_rank", rank).where("_rank = 1")
    return kept.select("_row.*").unionByName(docs.where("doc_id IS NULL"))
