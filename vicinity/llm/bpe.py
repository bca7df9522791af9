"""Byte-level BPE: encoding through a pair occurrence index, and decoding.

The distinct pieces of a batch of texts lie side by side in one array of
symbols. An index maps every mergeable pair to all its positions there. The
active ranks are applied in ascending order, each to all its positions, and the
lists of the pairs to the left and right are updated. A merge's product only
occurs in merges of higher rank, so this gives what merging each piece on its own
gives. Pieces met before come from a bounded memo.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from vicinity.llm.common import in_slices, small_batches

#: Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces in a worker's memo; it starts anew when full.
MEMO_PIECES = 400_000

#: A pair of ids as one number.
_SHIFT = 32
_LOW = (1 << _SHIFT) - 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1 bytes are themselves, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A vocabulary file of the tokenizers library: byte-level BPE without a normalizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.id_of = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for t, i in self.id_of.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        #: pair of ids: its rank and product
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.merge[self.id_of[a], self.id_of[b]] = (rank, self.id_of[a + b])
        #: the same by one number for the pair
        self.merge_of = {a << _SHIFT | b: to for (a, b), to in self.merge.items()}
        self.byte_ids = np.array(self.byte_id, np.int64)
        self.pieces = regex.compile(PIECES).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.memo: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings; they stand at odd places."""
        return self.cut(text) if self.cut and any(s in text for s in self.special) else [text]

    def encode_pieces(self, pieces: Iterable[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        ids, ends = self.encode_flat(list(pieces))
        flat = ids.tolist()
        return [flat[x:y] for x, y in zip(ends, ends[1:])]  # noqa: B905

    def encode_flat(self, pieces: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """As _encoded, without searches for cyclic garbage: its many lists hold numbers only."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(pieces)
        finally:
            if on:
                gc.enable()

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The ids of all pieces, one after the other, and where each piece's begin and end, by the pair occurrence index over all of them."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        # a -1 after each piece: no pair reaches across pieces
        start = np.cumsum(length + 1) - length - 1
        at_first = np.full(int(length.sum()) + len(pieces), -1, np.int64)
        at_first[np.arange(int(length.sum())) + np.repeat(np.arange(len(pieces)), length)] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(at_first)
        symbol = at_first.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge, shift = self.merge_of, _SHIFT
        # the pairs there are, by rank
        key = np.where((at_first[:-1] >= 0) & (at_first[1:] >= 0), (at_first[:-1] << shift) | at_first[1:], -1) if n else np.empty(0, np.int64)
        kinds, kind = np.unique(key, return_inverse=True)
        place = np.argsort(kind, kind="stable")
        first = np.searchsorted(kind[place], np.arange(len(kinds) + 1)).tolist()
        place = place.tolist()
        where: dict[int, list[int]] = {pair: place[x:y] for pair, x, y in zip(kinds.tolist(), first, first[1:]) if pair in merge}  # noqa: B905
        active = [(*merge[p], p) for p in where]
        heapq.heapify(active)
        while active:
            _, product, pair = heapq.heappop(active)
            a, b = pair >> shift, pair & _LOW
            left, right = product << shift, product
            at = where.pop(pair)
            at.sort()
            for i in at:
                j = after[i]
                if symbol[i] != a or j >= n or symbol[j] != b:
                    continue  # one of the two has gone into another merge
                symbol[i], symbol[j] = product, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if symbol[k] >= 0:
                        new = left | symbol[k]
                        if new in where:
                            where[new].append(i)
                        elif new in merge:
                            where[new] = [i]
                            heapq.heappush(active, (*merge[new], new))
                h = before[i]
                if h >= 0 and symbol[h] >= 0:
                    new = symbol[h] << shift | right
                    if new in where:
                        where[new].append(h)
                    elif new in merge:
                        where[new] = [h]
                        heapq.heappush(active, (*merge[new], new))
        out = np.array(symbol, np.int32)
        kept = np.concatenate([[0], np.cumsum(out >= 0)])
        return out[out >= 0], [*kept[start].tolist(), int(kept[-1])]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, special strings as their ids."""
        cut = [[part if k % 2 else self.pieces(part) for k, part in enumerate(self.segments(t))] for t in texts]
        wanted = {p for parts in cut for part in parts[::2] for p in part}
        if len(self.memo) + len(wanted) > MEMO_PIECES:
            self.memo.clear()
        memo = self.memo
        new = [p for p in wanted if p not in memo]
        ids, ends = self.encode_flat([p.encode("utf-8", "replace") for p in new])
        raw_ids = ids.tobytes()
        memo.update((p, raw_ids[4 * x : 4 * y]) for p, x, y in zip(new, ends, ends[1:], strict=False))
        special = {s: np.array([i], np.int32).tobytes() for s, i in self.special.items()}
        out = []
        for parts in cut:
            raw = b"".join([special[part] if k % 2 else b"".join(map(memo.__getitem__, part)) for k, part in enumerate(parts)])
            out.append(np.frombuffer(raw, np.int32))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special ones included; ids that no token has give nothing."""
        table, n = self.bytes_of, len(self.bytes_of)
        try:
            raw = b"".join([table[i] for i in ids]) if min(ids, default=0) >= 0 else b"".join([table[i] for i in ids if 0 <= i < n])
        except IndexError:
            raw = b"".join([table[i] for i in ids if 0 <= i < n])
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in a worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns `keep` and `ids`, the token ids of every whole `text`; null is empty and has none."""
    path = path or default_path()
    asked = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = asked.drop("_text").schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in in_slices(batches, "_text"):
            rows = vocab.encode_batch(part.column("_text").to_pylist())
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "_text"), ids], names=schema.names)

    return small_batches(asked).mapInArrow(run, schema)


def decode(encoded: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns `keep` and `decoded`, the text of `ids`; null ids give an empty text."""
    path = path or default_path()
    asked = encoded.select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias("_ids"))
    schema = asked.drop("_ids").schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [vocab.decode(ids.values.to_numpy(zero_copy_only=False).tolist()) for ids in part.column("_ids")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "_ids"), pa.array(texts, pa.string())], names=schema.names)

    return small_batches(asked).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them.

    A null text is empty, a very long one or a very long unbroken piece is encoded
    whole, repeated rows are answered one by one, an empty table gives no rows,
    further columns are ignored.
    """
    path = path or default_path()
    asked = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = asked.drop("_text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # encoded and decoded in one worker: the ids need not travel
        vocab = vocabulary(path)
        numeral = list(map(str, range(len(vocab.bytes_of))))
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
        for part in in_slices(batches, "_text"):
            counts, of_ids, of_texts = [], [], []
            for row in vocab.encode_batch(part.column("_text").to_pylist()):
                ids = row.tolist()
                counts.append(len(ids))
                of_ids.append(sha(",".join([numeral[i] for i in ids])))
                of_texts.append(sha(vocab.decode(ids)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], names=schema.names)

    return small_batches(asked).mapInArrow(run, schema)
