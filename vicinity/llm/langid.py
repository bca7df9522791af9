"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of sample texts. A
text is cut into pieces, every piece is compressed with each dictionary, and the
language with the fewest bytes over all pieces wins. The margin to the second
becomes the score; `rejected` says that it is too narrow to trust.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import in_slices, small_batches

UNKNOWN = "und"
#: Bytes of sample text in a language's dictionary, and of one of its documents: the dictionaries are a bounded sample of the labelled rows.
DICT_BYTES, SAMPLE_BYTES = 96 << 10, 2 << 10
#: About how many texts of a language are looked at; with the number of languages this bounds what comes to the driver.
SAMPLES = 256
#: Samples of fewer letters than this are used only where longer ones don't fill the dictionary.
SHORT = 100
#: The most languages; a table with more labels than this is refused, for the dictionaries are sent to every executor.
MAX_LANGUAGES = 200
PIECE_BYTES = 2 << 10
LEVEL = 9
#: Below this score a prediction is rejected.
NARROW = 0.01


def letters(text: Column) -> Column:
    """The text in lower case with one space for each run of other characters than letters: what is compressed."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))


def samples(docs: DataFrame) -> DataFrame:
    """(lang, text, h): of each language about SAMPLES distinct texts, all if it has fewer, as samples of up to SAMPLE_BYTES characters around their middles.

    The texts with the smallest hashes are taken, so copies count once and any
    text or language may hold any share of all rows: one scan estimates each
    language's number of different texts in sketches of a fixed size, and a second
    keeps the texts whose hash is below what leaves that many. Nothing is ranked.
    """
    text = F.col("text").cast("string")
    learn = docs.where(F.col("lang").isNotNull() & text.rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), text.alias("_t"), F.xxhash64(text).alias("h"))
    sizes = learn.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; their dictionaries are sent to every executor")
    start = F.greatest(F.lit(1), (F.char_length("_t") - SAMPLE_BYTES) / 2).cast("int")
    below = F.lit(False)
    for lang, n in sorted(sizes):  # of all hashes this share, from the least on
        share = min(1.0, SAMPLES / max(1, n))
        below = below | ((F.col("lang") == lang) & (F.col("h") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))))
    middle = learn.where(below).select("lang", letters(F.substring(F.col("_t"), start, F.lit(SAMPLE_BYTES))).alias("text"), "h")
    return middle.groupBy("lang", "text").agg(F.min("h").alias("h"))


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of (text, lang), of at most DICT_BYTES; rows with null in either teach nothing.

    Samples of SHORT letters or more come first; shorter ones fill what is left,
    so a language that has only short texts is learned from those.
    """
    texts: dict[str, list[bytes]] = {}
    for lang, text, _ in sorted(samples(docs).collect(), key=lambda r: (r[0], len(r[1]) < SHORT, r[2], r[1])):
        have = texts.setdefault(lang, [])
        if sum(map(len, have)) < DICT_BYTES:
            have.append(text.encode())
    return {lang: b"\n".join(have[::-1])[-DICT_BYTES:] for lang, have in texts.items()}


def identify(docs: DataFrame, keep: list[str], dicts: dict[str, bytes]) -> DataFrame:
    """The columns `keep`, lang_pred, score (0 to 1) and rejected, from `text`.

    A null text, one without letters, and any text where no language was learned
    gets `und` with score 0; ties go to the language that sorts first.
    """
    names = sorted(dicts)
    sent = docs.sparkSession.sparkContext.broadcast([dicts[n] for n in names])
    text = F.col("text").cast("string")
    asked = docs.select(*keep, F.when(text.rlike(r"\p{L}"), letters(text)).alias("_text"))
    schema = asked.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ds = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in sent.value]
        for d in ds:
            d.precompute_compress(level=LEVEL)
        coders = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in ds]
        for batch in batches:
            for part in in_slices(iter([batch]), "_text"):
                preds, scores = [], []
                for value in part.column("_text"):
                    pred, score = UNKNOWN, 0.0
                    if coders and value.is_valid:
                        raw = value.as_buffer().to_pybytes()
                        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
                        sizes = [sum(len(c.compress(p)) for p in pieces) for c in coders]
                        best = min(range(len(sizes)), key=sizes.__getitem__)
                        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
                        pred, score = names[best], max(0.0, min(1.0, 1 - sizes[best] / second))
                    preds.append(pred)
                    scores.append(score)
                kept = [part.column(c) for c in part.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array([s < NARROW for s in scores], pa.bool_())], names=schema.names)

    return small_batches(asked).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op9(docs: DataFrame) -> DataFrame:
    """Predict every document's language from dictionaries of the documents that are not held out.

    lang, source and doc_id never reach the prediction. A null doc_id is not
    held out; a very long text is compressed whole, in pieces; repeated rows are
    answered one by one; an empty table gives none; further columns are ignored.
    """
    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    rows = docs.select("doc_id", fold.alias("held_out"), "text", "lang")
    return identify(rows, ["doc_id", "held_out"], dictionaries(rows.where(~F.col("held_out"))))
