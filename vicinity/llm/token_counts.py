"""Exact token counts of every prefix, by dynamic programming.

For each prefix of a piece the program stores the last token of its encoding: a
token t that ends there is the last one exactly if the token before it (the last
of the shorter prefix) and t stay apart when their bytes are merged together. So
one pass over a piece gives the count of each of its prefixes, and a text's
counts are those of its pieces in a row. Stored as differences per code point,
they answer "how many tokens has this prefix" and "how much of the text fits into
this budget" without encoding again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.bpe import MEMO_PIECES, Vocabulary, default_path, vocabulary
from vicinity.llm.common import in_slices, small_batches

LIMIT = 512
#: Token pairs in a worker's memo; it starts anew when full.
PAIRS = 300_000
_NEVER = 1 << 60
#: Fixed value: the longer contractions, whose first two characters are two pieces when the text ends there.
_SPLIT = {"'re", "'ve", "'ll"}


class PrefixCounter:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.longest = max(map(len, vocab.id_of))
        #: token: the rank that makes it, and the two it is made of
        self.made = {product: (rank, a, b) for (a, b), (rank, product) in vocab.merge.items()}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.memo: dict[str, bytes] = {}
        self.space_run = regex.compile(r"\s\s").search
        self.all_space = regex.compile(r"\s+").fullmatch
        #: left token << 32 | right token: whether they stay apart
        self.known_apart: dict[int, bool] = {}

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The symbols at one end of a token while it is being merged, each with the rank that ends it."""
        known = self.edges[right]
        if token not in known:
            steps, t, ends = [], token, _NEVER
            while True:
                steps.append((t, ends))
                if t not in self.made:
                    break
                rank, a, b = self.made[t]
                t, ends = (b if right else a), rank
            known[token] = steps[::-1]
        return known[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay apart: no pair of symbols that meet at the border merges before one of them is gone."""
        xs, ys, merge = self.edge(left, True), self.edge(right, False), self.vocab.merge
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            found = merge.get((x, y))
            # of equal ranks the merge further left comes first
            if found and found[0] < x_ends and found[0] <= y_ends:
                return False
            if x_ends == y_ends == _NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def byte_counts(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """For each piece the tokens of each of its prefixes, from 0 bytes to all.

        A prefix's entry depends on nothing behind it, so pieces in sorted order share the entries of their common beginnings.
        """
        find, known, longest = self.vocab.id_of.get, self.known_apart, self.longest
        last, count, before = [-1], [0], b""
        for piece in pieces:
            n, same = len(piece), 0
            for x, y in zip(piece, before):  # noqa: B905
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for end in range(same + 1, n + 1):
                for start in range(end - longest if end > longest else 0, end):
                    token = find(piece[start:end])
                    if token is not None:
                        if start:
                            pair = last[start] << 32 | token
                            ok = known.get(pair)
                            if ok is None:
                                ok = known[pair] = self.apart(last[start], token)
                            if not ok:
                                continue
                        last.append(token)
                        count.append(count[start] + 1)
                        break
            before = piece
            yield count

    def learn(self, pieces: set[str]) -> None:
        """Put pieces into the memo: differences of the counts from one code point to the next, as int16."""
        if len(self.known_apart) > PAIRS:
            self.known_apart.clear()
        if len(self.memo) + len(pieces) > MEMO_PIECES:
            self.memo.clear()
        new = sorted((p.encode("utf-8", "replace"), p) for p in pieces if p not in self.memo)
        for (raw, text), counts in zip(new, self.byte_counts(raw for raw, _ in new), strict=True):
            if len(raw) != len(text):  # entries between the bytes of a code point go
                shown = [c for c, b in zip(counts[1:], [*raw[1:], 0], strict=True) if b & 0xC0 != 0x80]
            else:
                shown = counts[1:]
            if text in _SPLIT:
                shown[1] = 2
            self.memo[text] = array("h", map(sub, shown, [0, *shown])).tobytes()

    def piece(self, text: str) -> np.ndarray:
        if text not in self.memo:
            self.learn({text})
        return np.frombuffer(self.memo[text], np.int16)

    def count(self, text: str) -> int:
        """The tokens of a whole piece."""
        return int(self.piece(text).sum())

    def deltas_batch(self, texts: list[str]) -> list[np.ndarray]:
        """deltas() of every text; the new pieces of all of them are learned together."""
        plain = [len(self.vocab.segments(t)) == 1 and not self.space_run(t) for t in texts]
        cut = [self.vocab.pieces(t) if ok else [] for t, ok in zip(texts, plain, strict=True)]
        self.learn({p for pieces in cut for p in pieces})
        memo = self.memo
        quick = [np.frombuffer(b"".join([memo[p] for p in pieces]), np.int16) for pieces in cut]
        return [d if ok else self.deltas(t) for t, ok, d in zip(texts, plain, quick, strict=True)]

    def deltas(self, text: str) -> np.ndarray:
        """For each code point, by how much it changes the token count of the prefix that ends with it."""
        parts = self.vocab.segments(text)
        out: list[np.ndarray] = []
        carry = 0  # tokens of the text so far, less what the differences so far add up to
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special(parts[k - 1], part, carry))
                carry = 0
                continue
            previous, total_before = "", 0
            for p in self.vocab.pieces(part):
                d = self.piece(p).copy()
                total = int(d.sum())
                d[0] += carry
                carry = 0
                if self.all_space(previous) and self.all_space(p[0]):
                    # a text that ends with this character has one piece of white space here
                    shown = self.count(previous + p[0]) - total_before
                    real = int(d[0])
                    d[0] = shown
                    if len(d) > 1:
                        d[1] += real - shown
                    else:
                        carry = real - shown
                out.append(d)
                previous, total_before = p, total
        return np.concatenate(out) if out else np.empty(0, np.int16)

    def special(self, before: str, string: str, carry: int) -> np.ndarray:
        """Differences over a special string: until it is whole it is ordinary text, then one token."""
        tail = self.vocab.pieces(before)[-1:]
        base = sum(self.count(p) for p in tail)
        counts = [0]
        for j in range(1, len(string)):
            counts.append(sum(self.count(p) for p in self.vocab.pieces("".join(tail) + string[:j])) - base)
        counts.append(1)
        d = np.diff(counts).astype(np.int16)
        d[0] += carry
        return d


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(vocabulary(path))


def store(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns `keep`, n_bytes and `prefix`: the compressed count differences of every whole `text`; null is empty."""
    path = path or default_path()
    asked = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = asked.drop("_text").schema.add("n_bytes", "long").add("prefix", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pack = counter(path), zstandard.ZstdCompressor(level=1)
        for part in in_slices(batches, "_text", 1 << 20):
            texts = part.column("_text").to_pylist()
            sizes = pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64())
            packed = pa.array([pack.compress(d.tobytes()) for d in counts.deltas_batch(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "_text"), sizes, packed], names=schema.names)

    return small_batches(asked).mapInArrow(run, schema)


def counts_of(prefix: bytes) -> np.ndarray:
    """From a stored prefix: the token counts of the prefixes of 0, 1, ... code points."""
    deltas = np.frombuffer(zstandard.ZstdDecompressor().decompress(prefix), np.int16) if prefix else np.empty(0, np.int16)
    return np.concatenate([[0], np.cumsum(deltas, dtype=np.int64)])


def answer(stored: DataFrame, keep: list[str], budget: int = LIMIT) -> DataFrame:
    """From store(): n_tokens of the whole text, and fits, the code points of its longest prefix within the budget."""
    asked = stored.select(*keep, "prefix")
    schema = asked.drop("prefix").schema.add("n_tokens", "long").add("fits", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts_of(x.as_py()) for x in batch.column("prefix")]
            total = pa.array([int(c[-1]) for c in rows], pa.int64())
            fits = pa.array([len(c) - 1 if c[-1] <= budget else int(np.flatnonzero(c <= budget)[-1]) for c in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "prefix"), total, fits], names=schema.names)

    return small_batches(asked).mapInArrow(run, schema)


def op5(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token counts of every document from its stored prefix counts.

    A null text is empty, a very long one or a very long unbroken piece is counted
    whole, repeated rows are answered one by one, an empty table gives no rows,
    further columns are ignored.
    """
    found = answer(store(docs, ["doc_id"], path), ["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fits")
