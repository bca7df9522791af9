"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from vicinity.llm import bpe, chat, common, decontaminate, langid, near_dedup, pii, quality, substring_dedup, token_counts, warc

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
PROSE = " ".join(f"alpha{i} beta{i * 7 % 101}" for i in range(60))
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, PROSE),
    (6, PROSE),
    (6, PROSE),  # a repeated row
    (7, PROSE + " and a little more"),
    (8, LONG),
    (9, "mail a.b@c.de, b@d.org; 10.0.0.1 +1 (243) 555-5526 é 😀 4111 1111 1111 1111"),
    (10, "x" * 5000 + "\n" + "x" * 5000 + "\n\n\n"),
    (None, "a row without an id, not like any other"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _text string, spans string, k string, key string, bucket int, words string, _row string, class_id int, n_words int, _stay int, _rank int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 4 else "en", None, len(t or ""), "clash", "clash", "clash", "clash", 1, "clash", "clash", 1, 1, 1, 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, None, 1), (None, 1, 0), (4, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(PROSE.split()[10:40])), (2, None), (3, ""), (4, "too short")], "item_id long, text string")


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


ALL = Counter(i for i, _ in TEXTS)
OPS = {
    "op1": lambda d, l, b: substring_dedup.op1(d),
    "op2": lambda d, l, b: decontaminate.op2(d, b),
    "op3": lambda d, l, b: quality.op3(d, l),
    "op4": lambda d, l, b: near_dedup.op4(d),
    "op5": lambda d, l, b: token_counts.op5(d),
    "op8": lambda d, l, b: pii.op8(d),
    "op9": lambda d, l, b: langid.op9(d),
    "op10": lambda d, l, b: bpe.digests(d),
}


@pytest.mark.parametrize("name", OPS)
def test_every_row_is_answered(docs, labels, benchmark, name):
    rows = OPS[name](docs, labels, benchmark).collect()
    if name == "op2":
        assert ids(rows) == {5: 1, 6: 2, 7: 1} and {r.item_id for r in rows} == {1} and {r.coverage for r in rows} == {1.0}
    else:
        assert ids(rows) == ALL
    by = {r["doc_id"]: r for r in rows}
    empty = hashlib.sha256(b"").hexdigest()
    if name == "op1":
        assert (by[1].n_words, by[1].kept_sha256) == (0, empty) and by[2].n_words == by[3].n_words == 0
        assert by[6].n_removed == by[5].n_removed == 120 and by[7].n_removed == 120 and by[7].n_words == 124
        assert by[7].kept_sha256 == hashlib.sha256(b"and a little more").hexdigest()
    if name == "op3":
        assert by[1].base_failed and not by[1].kept and by[5].kept and by[10].n_dup_lines == 1 and by[2].word_chars == 0
    if name == "op4":
        assert by[5].class_id == by[6].class_id == by[7].class_id == 5 and by[1].class_id == 1 and by[2].class_id == 2 and by[None].class_id is None
        assert by[8].class_id == 8
    if name == "op5":
        assert by[1].n_tokens == by[2].n_tokens == 0 and by[8].over_limit
    if name == "op8":
        assert (by[9].n_email, by[9].n_ip, by[9].n_card, by[9].n_phone) == (2, 1, 1, 1) and by[1].base_sha256 == empty
    if name == "op9":
        assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[5].lang_pred == "en" and by[1].score == 0
    if name == "op10":
        assert by[1].n_tokens == 0 and by[8].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(docs, labels, benchmark, name):
    assert OPS[name](docs.where("false"), labels.where("false"), benchmark.where("false")).collect() == []


def test_stages_keep_columns(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, str(tmp_path))
        if name != "bpe_tokens":
            assert rows.schema.simpleString() == docs.schema.simpleString()
        left[name] = ids(rows.collect())
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []
    assert set(left["quality_rules"]) == {5, 6, 7}
    assert left["near_duplicates"] == Counter([1, 2, 3, 4, 5, 8, 9, 10, None])
    assert left["decontaminate"] == ALL - Counter([5, 6, 6, 7])
    assert left["personal_data"] == left["bpe_tokens"] == ALL


def test_arrow_batches_are_small(spark):
    """Rows of 20 KB come to Python in batches of a few megabytes, not of ten thousand rows."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    rows = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 20000) AS text")
    assert max(r.n for r in common.small_batches(rows).mapInArrow(sizes, "n long").collect()) <= common.BATCH_BYTES + 40_000


def test_redaction(spark):
    rows = [(1, "to é a@b.cd or +1 (243) 555-5526, 10.0.0.1", 0), (2, None, 0), (3, "plain", 0)]
    out = {r.doc_id: r for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    assert out[1].text == "to é <EMAIL> or <PHONE>, <IP>" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "plain"


def test_warc_edges(spark):
    pages = [(1, "u\r\nX: y", "same"), (2, "u", "same"), (3, "u", None), (4, None, ""), (5, "u", "WARC/1.1\r\n\r\nx"), (5, "u", "WARC/1.1\r\n\r\nx"), (None, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'clash' AS payload", "1 AS refers_to")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op6(spark, df).collect())
    assert got == Counter([(1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 13, "response", None), (5, 13, "response", None), (None, 4, "revisit", 2)])
    assert warc.op6(spark, df.where("false")).collect() == []


def test_chat_edges(spark):
    rows = [(1, 0, "user", "<|end|> <\\|x <|"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "|"), (None, 1, "user", "é😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS parts", "2 AS rows")
    out = {r.conv_id: r for r in chat.op7(spark, df).collect()}
    assert set(out) == {1, 2, None, -7} and out[1].n_turns == 3 and out[1].loss_chars == 0 and out[-7].loss_chars == 21
    said = "user\n<|end|> <\\|x <|\nassistant\n\nassistant\n\n"
    assert out[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert [r.conv_id for r in chat.op7(spark, df.where("false")).collect()] == [-7]
