"""The whole pipeline on the smallest tables, against a brute-force version of each stage on what the one before has left."""

import hashlib
import os
from collections import defaultdict

import duckdb
from pyspark.sql.functions import lit

import corpus_pipeline
from test_llm_brute import LIBRARY, ROOT, naive_leaks
from vicinity.llm import common, near_dedup, pii, quality
from vicinity.sources.shared import shared_dir
from vicinity.sources.tables import table


def good_by_sql():
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.OP3_SQL}) WHERE kept").fetchall()}


def one_of_each(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sampler = near_dedup.Sampler(near_dedup.idf(near_dedup.document_frequencies(docs)))
    vectors = {i: sampler.vector(t) for i, t in texts.items()}
    holders, parent = defaultdict(set), {i: i for i in texts}
    for i, (values, _) in vectors.items():
        for v in values.tolist():
            holders[v].add(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if sampler.similarity(vectors[a], vectors[b]) >= near_dedup.SIMILARITY:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: t for i, t in texts.items() if root(i) == i}


def redacted(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {}
    for r in pii.find(docs, ["doc_id"]).collect():
        text, at, new = texts[r.doc_id], 0, []
        for s in sorted(r.spans, key=lambda s: (s.start, -s.end, s.kind)):
            if s.start >= at:
                new += [text[at : s.start], f"<{s.kind.upper()}>"]
                at = s.end
        out[r.doc_id] = "".join([*new, text[at:]])
    return out


def test_pipeline(spark):
    docs = {r.doc_id: r.text for r in table(spark, ROOT, "documents").select("doc_id", "text").collect()}
    items = {r.item_id: r.text for r in table(spark, ROOT, "benchmark").collect()}
    good = {i: t for i, t in docs.items() if i in good_by_sql()}
    single = one_of_each(spark, good)
    clean = {i: t for i, t in single.items() if not naive_leaks(items, t)}
    final = redacted(spark, clean)
    assert len(docs) > len(good) > len(single) > len(clean) > 50 and any(final[i] != clean[i] for i in final)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, ROOT).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = {i: LIBRARY.encode(t, add_special_tokens=False).ids for i, t in final.items()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(final[i])) for i, x in ids.items()}


def test_tables_of_the_way_are_deleted(spark):
    """Of a run only the last stored stage is left, of a query what its result reads."""
    folder = f"{shared_dir(spark).removeprefix('file://')}/vicinity"
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, ROOT).count()
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"personal_data"}
    before = set(os.listdir(folder))
    near_dedup.op4(table(spark, ROOT, "documents")).count()
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"signed", "rooted"}


def test_passing_tables(spark):
    rows = spark.range(5).withColumn("x", lit(1))
    with common.passing(spark) as lasting:
        gone, left = common.written(rows, "gone"), lasting(rows, "left")
        assert gone.count() == 5
    assert left.count() == 5
    assert not os.path.exists(gone.inputFiles()[0].removeprefix("file://")) if gone.inputFiles() else True
