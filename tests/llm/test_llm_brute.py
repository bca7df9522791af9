"""Operators against brute-force versions, libraries, SQL and held-out rows, on the smallest tables."""

import base64
import gzip
import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vicinity.llm import bpe, chat, common, decontaminate, hashing, langid, near_dedup, pii, quality, queries, substring_dedup, token_counts, warc
from vicinity.sources.tables import table

ROOT = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, ROOT, "documents").select("doc_id", "text").collect()}


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    got = queries.QUERIES[name](spark, ROOT)
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    assert sorted(got.columns) == names
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


# substring dedup


def kept_words(rows, window):
    words = {k: (t or "").encode().split() for k, t in rows}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[k] = [x for x, g in zip(w, gone, strict=True) if not g]
    return words, out


def test_substring_dedup_of_documents(spark, texts):
    words, kept = kept_words(texts.items(), substring_dedup.WINDOW)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op1_substring_dedup"](spark, ROOT).collect()}
    assert got == {k: (len(words[k]), len(words[k]) - len(kept[k]), sha(b" ".join(kept[k]))) for k in texts}


def test_substring_dedup_of_small_alphabets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("ab" if i % 2 else "abcdefgh", k=rng.randint(0, 60)))) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(5)] + [(70, "a " * 40)]
    for window in (3, 9, 12):
        _, kept = kept_words(rows, window)
        got = {r.doc_id: r.kept for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], window).collect()}
        assert got == {k: b" ".join(w).decode() for k, w in kept.items()}


def test_one_doc_id_with_two_texts(spark):
    p, q, r = (" ".join(f"{x}{i}" for i in range(50)) for x in "pqr")
    rows = [(1, p), (2, p), (2, q + " " + r), (3, r), (None, q[:100]), (None, r)]
    got = Counter((x.doc_id, x.n_words, x.n_removed) for x in substring_dedup.op1(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 50, 50), (2, 50, 50), (2, 100, 50), (3, 50, 50), (None, len(q[:100].split()), 0), (None, 50, 50)])


def test_a_passage_in_many_contexts_and_a_long_repetition(spark):
    """A common passage between words of their own, and one word without end."""
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, " ".join([*(f"x{rng.randrange(10**9)}" for _ in range(40)), common, *(f"y{rng.randrange(10**9)}" for _ in range(40))])) for i in range(300)]
    rows += [(1000, "la " * 5000), (1001, "one " + "la " * 20)]
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup.op1(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: (140, 60) for i in range(300)}, 1000: (5000, 5000), 1001: (21, 0)}


def test_long_windows(spark):
    """Windows of more words than a run can number."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnop", k=60))) for i in range(3)]
    rows += [(3, rows[0][1] + " " + rows[1][1] + " " + rows[2][1]), (4, " ".join((rows[1][1] + " " + rows[2][1]).split()[7:115]))]
    _, kept = kept_words(rows, 100)
    got = {r.doc_id: r.kept for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], 100).collect()}
    assert got == {k: b" ".join(w).decode() for k, w in kept.items()} and kept[4] == []


def test_suffix_automaton():
    rng = random.Random(1)
    for _ in range(50):
        ref, text = [rng.choices("abc", k=rng.randint(1, 30)) for _ in range(2)]
        runs = {tuple(ref[i:j]) for i in range(len(ref)) for j in range(i + 1, len(ref) + 1)}
        want = [max([n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in runs]) for i in range(len(text))]
        assert list(substring_dedup.SuffixAutomaton(ref).statistics(text)) == want


def test_word_hashes_do_not_depend_on_the_batch():
    a, b = b"one two\tthree  four", b"two\n" + b"z" * 3000 + b" four"
    (alone, _), (together, at) = hashing.batch_words([b]), hashing.batch_words([a, b, b""])
    assert together[at[1] : at[2]].tolist() == alone.tolist() and at.tolist() == [0, 4, 7, 7]
    assert together[1] == together[4] and together[3] == together[6]
    few = hashing.runs(together, 3)
    assert len(few) == 5 and len(hashing.runs(together, 20)) == 0


# decontamination


def naive_tiles(item, text, least):
    free_i, free_t, tiles = [x >= 0 for x in item], [x >= 0 for x in text], []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                best = max(best, (n, i, t), key=lambda x: x[0])
        if best[0] < least:
            return tiles
        n, i, t = best
        tiles.append(best)
        free_i[i : i + n] = free_t[t : t + n] = [False] * n


def test_tiling(monkeypatch):
    rng = random.Random(3)
    for _ in range(200):
        item, text = [rng.randint(-1, 2) for _ in range(rng.randint(0, 40))], [rng.randint(-1, 2) for _ in range(rng.randint(0, 50))]
        least = rng.choice([1, 2, 3, 5])
        monkeypatch.setattr(decontaminate, "FIRST_LENGTH", rng.choice([5, 20]))
        assert sorted(decontaminate.tile(item, text, least)) == sorted(naive_tiles(item, text, least))


def naive_leaks(items, text):
    """Every item against the whole text, without seeds."""
    words, out = decontaminate.tokens(text), []
    for item_id, item in items.items():
        own = decontaminate.tokens(item)
        number = {w: i for i, w in enumerate(dict.fromkeys(own))}
        tiles = decontaminate.tile([number[w] for w in own], [number.get(w, -1) for w in words], decontaminate.LEAST) if len(own) >= decontaminate.LEAST else []
        covered = sum(n for n, _, _ in tiles)
        if tiles and covered >= decontaminate.THRESHOLD * len(own):
            out.append((item_id, len(own), covered, len(tiles), max(n for n, _, _ in tiles)))
    return out


def test_leaks_against_brute_force_with_repeated_seeds():
    rng = random.Random(5)
    for _ in range(60):
        items = {i: " ".join(rng.choices("abc", k=rng.randint(5, 14))) for i in range(4)}
        cycle = " ".join(rng.choices("abc", k=rng.randint(1, 4)))
        text = " ".join([*rng.choices("abcd", k=rng.randint(0, 30)), *[cycle] * rng.randint(0, 120), *rng.choices("abcd", k=rng.randint(0, 30)), *[cycle] * rng.randint(0, 60)])
        assert decontaminate.Benchmark(list(items.items())).leaks(text) == naive_leaks(items, text), (items, text)


def test_one_seed_without_end_takes_no_time():
    bench = decontaminate.Benchmark([(1, "la " * 400), (2, "la " * 30 + " ".join(f"w{i}" for i in range(40))), (3, "ha ho " * 50)])
    began = time.time()
    assert [x[0] for x in bench.leaks("la " * 500_000 + "ha ho " * 200_000)] == [1, 3]
    assert time.time() - began < 20


def test_a_large_benchmark_is_cut_and_small():
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(200_000)}" for _ in range(60))) for i in range(20_000)]
    text = sum(len(t) for _, t in items)
    assert text > decontaminate.BLOCK_BYTES
    bench = decontaminate.Benchmark(items)
    arrays = sum(x.nbytes for x in (bench.words, bench.begin, bench.sizes, bench.seeds, bench.first, bench.holders))
    assert arrays < 5 * text and bench.leaks(" ".join(items[77][1].split()[20:] + ["x"] + items[77][1].split()[:20])) == [(77, 60, 60, 2, 40)]


def test_reordered_passages_are_leaks_and_others_are_not():
    item = [f"w{i}" for i in range(60)]
    bench = decontaminate.Benchmark([(7, " ".join(item)), (8, "short one")])
    moved = item[40:] + ["x"] * 9 + item[:20] + ["y"] + item[20:40]
    assert bench.leaks(" ".join(moved).upper()) == [(7, 60, 60, 3, 20)]
    assert bench.leaks(" ".join(item[:29])) == [] and bench.leaks("short one") == [] and bench.leaks(None) == []


def test_leaks_of_documents(spark, texts):
    items = {r.item_id: r.text for r in table(spark, ROOT, "benchmark").collect()}
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if norm(x) in norm(t)}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op2_decontaminate"](spark, ROOT).collect()}
    assert whole <= got and len(got - whole) <= 1
    rows = {(r.doc_id, r.item_id): (r.n_words, r.covered, r.n_tiles, r.longest, r.coverage) for r in queries.QUERIES["op2_decontaminate"](spark, ROOT).collect()}
    assert rows == {(d, i): (n, c, k, m, round(c / n, 6)) for d, t in texts.items() for i, n, c, k, m in naive_leaks(items, t)}
    blocks = list(decontaminate.blocks(table(spark, ROOT, "benchmark"), 3000))
    assert len(blocks) > 1 and sorted(r for b in blocks for r in b) == sorted(items.items())


# quality


def test_binomial_tail(spark):
    from math import comb

    for n, k, p in ((10, 0, 0.3), (40, 3, 0.2), (500, 2, 0.01), (7, 7, 0.5)):
        got = spark.range(1).select(quality.binomial_tail(quality.F.lit(n).cast("long"), quality.F.lit(k).cast("long"), p)).first()[0]
        want = 1.0 if k >= n * p else sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert got == pytest.approx(want)


def test_cutoffs_reject_few_good_documents(spark):
    rows = [(i, "en", 100, 500, 200 if i % 10 == 0 else i % 4, 0, 1, 0, 0, 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_capital_pairs long, n_mark_pairs long, n_repeat_words long")
    labels = df.selectExpr("doc_id", "CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS quality")
    assert [(r.lang, r.rule, r.cutoff) for r in quality.calibrate(df, labels).collect()] == [("en", "symbols", 300)]
    assert quality.calibrate(df, labels.where("doc_id < 300")).collect() == []  # too few for a certificate


def test_certified_cutoffs_against_sql(spark):
    """Two languages with labels enough for certificates of several rules, some good documents among what they reject."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvwz", k=rng.randint(2, 9)))
    spoil = {"symbols": lambda w: [x + "##$%" if i % 3 == 0 else x for i, x in enumerate(w)], "capitals": lambda w: [x.upper() if i % 2 else x for i, x in enumerate(w)], "marks": lambda w: [x + "!!" if i % 4 == 0 else x for i, x in enumerate(w)], "dup_lines": lambda w: [*w[:40], *["\n" + " ".join(w[:4]) + "\n"] * 9, *w[40:]], "none": lambda w: w}
    rows, labels = [], []
    for lang, kinds in (("en", ["symbols", "dup_lines"]), ("de", ["capitals", "marks"]), (None, ["symbols"])):
        for i in range(1100 if lang else 200):
            kind = rng.choice(kinds) if i % 6 == 0 else "none"
            doc = len(rows)
            rows.append((doc, " ".join(spoil[kind]([word() for _ in range(60)])), lang))
            labels.append((doc, int(kind == "none"), 0))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chosen = {(r.lang, r.rule) for r in quality.calibrate(quality.features(docs, ["doc_id", "lang"]), told).collect()}
    assert chosen >= {("en", "symbols"), ("en", "dup_lines"), ("de", "capitals"), ("de", "marks")}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", told.toPandas())
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({quality.OP3_SQL})").fetchall())
    assert sorted(tuple(r) for r in quality.op3(docs, told).select(*names).collect()) == want
    assert sum(1 for r in want if r[-1]) > 250


def test_repeated_windows_are_told_by_their_words(spark):
    """Many different words, whose few bits of hash collide, repeat nothing; repeats among them are found."""
    n = 300_000
    odd = " ".join(f"w{i}" for i in range(n))
    rows = [(1, odd), (2, odd + " w5 w6 w7 w8 end"), (3, "a b a b a b a"), (4, "a b c a b d")]
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality.op3(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got == {1: (n, 0), 2: (n + 5, 8), 3: (7, 7), 4: (6, 0)}


# near duplicates


def test_classes_of_documents(spark, texts):
    def shingles(t):
        w = t.lower().encode().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    frequencies = near_dedup.document_frequencies(table(spark, ROOT, "documents"))
    assert frequencies[-1] == len(texts)
    sampler = near_dedup.Sampler(near_dedup.idf(frequencies))
    vectors = {i: sampler.vector(t) for i, t in texts.items()}
    holders = defaultdict(set)
    for i, t in texts.items():
        for s in shingles(t):
            holders[s].add(i)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        if sampler.similarity(vectors[a], vectors[b]) >= near_dedup.SIMILARITY:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op4_near_duplicates"](spark, ROOT).collect()}
    assert got == {i: root(i) for i in texts}


def test_samples_agree_as_often_as_texts_are_alike():
    rng = random.Random(2)
    sampler = near_dedup.Sampler(np.ones(near_dedup.BUCKETS))
    agree, alike = [], []
    for _ in range(60):
        a = [f"v{rng.randint(0, 10**6)}" for _ in range(200)]
        b = list(a)
        for _ in range(8):
            b[rng.randint(0, 199)] = "new"
        x, y = " ".join(a), " ".join(b)
        bands, _ = sampler.bands([x, y])
        agree.append((bands[0] == bands[1]).mean())
        alike.append(sampler.similarity(sampler.vector(x), sampler.vector(y)) ** near_dedup.ROWS)
    assert abs(np.mean(agree) - np.mean(alike)) < 0.05


def texts_of(docs):
    return lambda nodes: docs.selectExpr("doc_id AS node", "text").join(nodes, "node", "left_semi")


def test_one_doc_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (2, a + " tail"), (2, b), (3, b), (4, c), (4, c), (5, a), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.op4(docs).collect())
    assert got == Counter([(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (4, 4), (5, 1), (2, 2)])
    assert Counter(map(tuple, near_dedup.one_of_each(docs).collect())) == Counter([(1, a), (2, b), (4, c), (2, "")])


def test_unlike_texts_in_one_bucket_all_meet(spark):
    """Three groups share every band key: later rounds find what the first head does not match."""
    base = [" ".join(f"g{g}w{i}" for i in range(100)) for g in range(3)]
    rows = [(10 * g + j, base[g] + f" tail{j}") for g in range(3) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = docs.selectExpr("doc_id AS node", "array(1L, 2L) AS bands")
    found = near_dedup.components(near_dedup.links(nodes, texts_of(docs), np.zeros(near_dedup.BUCKETS + 1, np.int64)))
    assert {(r.node, r.root) for r in found.collect()} == {(10 * g + j, 10 * g) for g in range(3) for j in range(1, 4)}


def test_a_matched_text_still_meets_the_unmatched_ones(spark):
    """A is alike to the head H and to B, but B is not alike to H; all share one bucket."""
    words = [f"w{i}" for i in range(300)]
    changed = lambda at: " ".join("x" if i in at else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(0, changed(())), (1, changed((50, 100, 150))), (2, changed((50, 100, 150, 200, 220, 240, 260, 280)))], "doc_id long, text string")
    sampler = near_dedup.Sampler(near_dedup.idf(np.zeros(near_dedup.BUCKETS + 1, np.int64)))
    h, a, b = (sampler.vector(r.text) for r in docs.orderBy("doc_id").collect())
    assert min(sampler.similarity(h, a), sampler.similarity(a, b)) >= near_dedup.SIMILARITY > sampler.similarity(h, b)
    found = near_dedup.components(near_dedup.links(docs.selectExpr("doc_id AS node", "array(1L) AS bands"), texts_of(docs), np.zeros(near_dedup.BUCKETS + 1, np.int64)))
    assert {(r.node, r.root) for r in found.collect()} == {(1, 0), (2, 0)}


@pytest.mark.parametrize("tile", [1024, 7])
def test_families_in_one_large_bucket_all_meet(spark, monkeypatch, tile):
    """More families share one bucket than its heads: no link depends on a head, nor on how the bucket is cut into tiles."""
    monkeypatch.setattr(near_dedup, "TILE_ROWS", tile)
    rows = [(10 * g + j, " ".join(f"g{g}w{i}" for i in range(60)) + f" tail{j}" * 2) for g in range(30) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.components(near_dedup.links(docs.selectExpr("doc_id AS node", "array(1L, 2L) AS bands"), texts_of(docs), np.zeros(near_dedup.BUCKETS + 1, np.int64)))
    assert {(r.node, r.root) for r in found.collect()} == {(10 * g + j, 10 * g) for g in range(30) for j in (1, 2)}


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    """Many families with much text in common share one bucket; split by further samples, alike texts still meet."""
    monkeypatch.setattr(near_dedup, "SPLIT", 20)
    frame = " ".join(f"frame{i}" for i in range(25))
    rows = [(10 * g + j, frame + " " + " ".join(f"g{g}w{i}" for i in range(60)) + f" tail{j}" * 3) for g in range(40) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sampler = near_dedup.Sampler(near_dedup.idf(np.zeros(near_dedup.BUCKETS + 1, np.int64)))
    assert sampler.similarity(sampler.vector(rows[0][1]), sampler.vector(rows[1][1])) >= 0.8 > 0.4 > sampler.similarity(sampler.vector(rows[0][1]), sampler.vector(rows[3][1])) > 0.1
    parts = near_dedup.split(docs.selectExpr("7L AS bucket", "doc_id AS node"), texts_of(docs)(docs.selectExpr("doc_id AS node")), np.zeros(near_dedup.BUCKETS + 1, np.int64))
    assert parts.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 12
    found = near_dedup.components(near_dedup.links(docs.selectExpr("doc_id AS node", "array(1L, 2L) AS bands"), texts_of(docs), np.zeros(near_dedup.BUCKETS + 1, np.int64)))
    assert {(r.node, r.root) for r in found.collect()} == {(10 * g + j, 10 * g) for g in range(40) for j in (1, 2)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(101, 100)], "a long, b long")
    assert {(r.node, r.root) for r in near_dedup.components(edges).collect()} == {(i, 0) for i in range(1, 31)} | {(101, 100)}


# tokens

STRANGE = ["a", "the ", "  ", "\n", "\n\n", "\t", " ", "'re", "'ve", "'ll", "'s", "'", "é", "ß", "日本", "😀", "12", "٣", "!!", "<|endoftext|>", "<|", "endoftext", "\xa0", " ", "\x85", "\x1c", "_", "ING", "\r\n", "²", "́"]


def strange(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(STRANGE, k=rng.randint(0, 14))) for _ in range(n)]


def ids_of(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_encoding_and_decoding(texts):
    vocab = bpe.vocabulary(PATH)
    some = strange(1500, 1) + list(texts.values())
    want = ids_of(some)
    assert [list(map(int, x)) for x in vocab.encode_batch(some)] == want
    assert [vocab.decode(x) for x in want] == [LIBRARY.decode(x, skip_special_tokens=False) for x in want]
    assert vocab.decode([64, 10**6, 65]) == vocab.decode([64, 65])


def test_ids_of_pieces_side_by_side():
    """Flat ids and their ends, for empty pieces, repeats and pieces that end in the same rank."""
    import tokenizers

    vocab, library = bpe.vocabulary(PATH), tokenizers.Tokenizer.from_file(PATH)
    pieces = ["", "a", " the", "aaaaaaaaaaa", "", "\x00\x00", "\u00e9\u00e9\u00e9", " internationalisation", "the", "a"]
    ids, ends = vocab.encode_flat([p.encode() for p in pieces])
    got = [ids[x:y].tolist() for x, y in zip(ends, ends[1:])]  # noqa: B905
    assert len(got) == len(pieces) and got == [library.encode(p, add_special_tokens=False).ids for p in pieces] == vocab.encode_pieces(p.encode() for p in pieces)
    assert [x.tolist() for x in vocab.encode_flat([])[0:1]] == [[]] and vocab.encode_flat([])[1] == [0]



def test_counts_of_every_prefix():
    counter = token_counts.counter(PATH)
    for text in strange(300, 5):
        counts = np.concatenate([[0], np.cumsum(counter.deltas_batch([text])[0])]).tolist()
        assert counts == [len(x) for x in ids_of([text[:i] for i in range(len(text) + 1)])], repr(text)


def test_one_long_unbroken_piece(spark):
    rng = random.Random(2)
    rows = [(1, "x" * 40_000), (2, "".join(rng.choices("abc", k=20_000))), (3, " " * 30_000 + "a"), (4, "ab" * 9_999 + "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: x for (i, _), x in zip(rows, ids_of([t for _, t in rows]), strict=True)}
    assert {r.doc_id: r.n_tokens for r in token_counts.op5(docs).collect()} == {i: len(x) for i, x in want.items()}
    assert {r.doc_id: r.ids_sha256 for r in bpe.digests(docs).collect()} == {i: sha(",".join(map(str, x))) for i, x in want.items()}


def test_token_queries(spark, texts):
    want = dict(zip(texts, ids_of(list(texts.values())), strict=True))
    got = queries.QUERIES["op5_token_counts"](spark, ROOT).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len(texts[i].encode()), len(w), len(w) > 512) for i, w in want.items()}
    for r in got[:20]:
        fits = texts[r.doc_id][: r.fits]
        assert len(ids_of([fits])[0]) <= 512
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op10_bpe_codec"](spark, ROOT).collect()}
    assert got == {i: (len(w), sha(",".join(map(str, w))), sha(texts[i])) for i, w in want.items()}


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0])]


def test_base_spans(spark, texts):
    rng = random.Random(9)
    parts = ["a@b.c", "_d@e.f", "@", ".", "1.2.3.4", "255.0.0.01", "256.1.1.1", "0.0.0.0", "4111 1111 1111 1111", "4111-1111-1111-1111-0", "12", "+1 (243) 555-5526", "+", "+49 ", " ", "-", "é", "😀", "x", "\n"]
    made = {10**6 + i: "".join(rng.choices(parts, k=rng.randint(1, 12))) for i in range(400)}
    made[2 * 10**6] = " ".join(f"u{i}@example.org" for i in range(5000))
    every = texts | made
    docs = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(8)
    for r in pii.op8(docs).collect():
        want = base_spans(every[r.doc_id])
        assert r.base_sha256 == sha(",".join(want)), every[r.doc_id][:200]
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PATTERNS]


def test_planted_tokens_are_added(spark):
    root = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, root, "documents").select("doc_id", "text").collect()}
    got = {(r.doc_id, s) for r in queries.QUERIES["op8_pii_spans"](spark, root).collect() for s in r.spans.split(",") if s.startswith("secret")}
    want = {(i, f"secret:{m.start(1)}:{m.end(1)}") for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    assert got == want and want


def test_added_spans_follow_the_votes(spark):
    """What the classifier adds beside the base spans, against the same sums in plain Python."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    found = common.written(pii.propose(docs).select("doc_id", "_found"), "pii")
    weights = pii.fit(found)
    said = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in pii.decide(found, weights).collect()}
    want, added = {}, 0
    for r in found.collect():
        own = set()
        for x in r._found:
            score = weights.get(x["kind"], 0.0) + sum(weights.get(f"{x['kind']}:{n}:{x[n]}", 0.0) for n in pii.LABELERS + pii.FEATURES)
            if x["base"] or score > 0:
                own.add((x["kind"], x["start"], x["end"]))
                added += not x["base"]
        want[r.doc_id] = own
    assert said == want and added


def test_redaction_of_many_spans(spark):
    text = " ".join(f"u{i}@example.org and" for i in range(4000))
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out.text == " ".join("<EMAIL> and" for _ in range(4000))


def test_reliabilities():
    rng = random.Random(1)
    counts = Counter()
    for _ in range(5000):
        true = rng.random() < 0.3
        counts["x", tuple(int(rng.random() < (hit if true else miss)) for hit, miss in ((0.95, 0.02), (0.8, 0.1), (0.6, 0.3), (0.9, 0.2)))] += 1
    share, rates = pii.estimate([(*k, n) for k, n in counts.items()])["x"]
    assert abs(share - 0.3) < 0.05 and all(abs(a - b) < 0.07 for a, b in zip((x for x, _ in rates), (0.95, 0.8, 0.6, 0.9), strict=True))


# language


def test_copies_take_one_place_in_a_dictionary(spark):
    rng = random.Random(4)
    alone = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40)) for _ in range(30)]
    hot = sorted(alone, key=lambda t: spark.range(1).selectExpr(f"xxhash64('{t}') AS h").first().h)[0]
    docs = spark.createDataFrame([(t, "xx") for t in alone + [hot] * 300], "text string, lang string")
    assert sorted(r.text for r in langid.samples(docs).collect()) == sorted(alone)


def test_a_language_that_has_short_texts_only(spark):
    english = ["the house stands near the river and the people of the town walk there", "we have seen that this was not what they had been looking for"]
    german = ["das haus steht am fluss", "wir haben das nicht gewusst", "die leute gehen durch die stadt", "es war einmal ein kleiner hund", "heute ist das wetter sehr schoen"]
    docs = spark.createDataFrame([(f"{english[i % 2]} {i} " * 4, "en") for i in range(40)] + [(german[i % 5], "de") for i in range(40)], "text string, lang string")
    dicts = langid.dictionaries(docs)
    assert set(dicts) == {"en", "de"}
    asked = spark.createDataFrame([(1, "das wetter ist heute nicht schoen, die leute haben einen hund"), (2, "the people walk near the house of the town")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, ["doc_id"], dicts).collect()} == {1: "de", 2: "en"}


def test_samples_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLES", 50)
    rng = random.Random(1)
    docs = spark.createDataFrame([("".join(rng.choices("abcdefgh ", k=80)), "xx") for _ in range(3000)], "text string, lang string")
    assert 20 <= langid.samples(docs).count() <= 90


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = queries.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


# archives and chats


def test_bytes_and_other_records_survive_deduplication(spark, tmp_path):
    """Payloads that are no UTF-8, HTTP heads, dates, requests and revisits of what is elsewhere are written as they were."""
    def record(kind, name, block, **more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 2020-02-02T00:00:00Z", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"Content-Length: {len(block)}"]
        return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    body, http = b"\xff\xfe raw \x00 bytes", b"HTTP/1.1 203 Odd\r\nX-Own: 1\r\n\r\n"
    sha = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    parts = [record("warcinfo", "i", b"software: x\r\n"), record("response", "a", http + body, WARC_Payload_Digest=sha), record("request", "q", b"GET / HTTP/1.1\r\n\r\n"), record("response", "b", http + body, WARC_Payload_Digest=sha), record("revisit", "r", http, WARC_Payload_Digest="sha1:ABC", WARC_Refers_To="<elsewhere>")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    warc.deduplicate(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    rows = {r.record_id or bytes(r.other): r for r in warc.read_archives(spark, f"file://{tmp_path}/out").collect()}
    assert len(rows) == 5 and {k: r.record_type for k, r in rows.items() if r.record_type in ("response", "revisit")} == {"<a>": "revisit", "<b>": "response", "<r>": "revisit"}
    assert bytes(rows["<b>"].payload) == body and rows["<b>"].digest_ok and bytes(rows["<a>"].http_head) == http == bytes(rows["<b>"].http_head)
    assert rows["<a>"].refers_to_id == "<b>" and rows["<r>"].refers_to_id == "<elsewhere>" and rows["<a>"].date == "2020-02-02T00:00:00Z"
    assert {bytes(r.other) + b"\r\n" for r in rows.values() if r.other is not None} == {parts[0], parts[2]}


def test_archives_are_cut_by_bytes_and_read_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300_000)
    pages = spark.createDataFrame([(i, "u", f"{i} " * 20_000) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.resolved_pages(warc.as_payloads(pages)), f"file://{tmp_path}/a", 50_000)
    assert len(list((tmp_path / "a").glob("*.gz"))) >= 5
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "a").glob("*.gz"))
    many = b"".join(gzip.compress(raw[i : i + 70_001]) for i in range(0, len(raw), 70_001))
    plain = [(f["warc-page-id"], b) for f, b, _ in warc.parse(raw)]
    assert len(plain) == 30 and [(f["warc-page-id"], b) for f, b, _ in warc.parse(many)] == plain
    with pytest.raises(ValueError):
        list(warc.parse(raw[:-50]))


def exchanged(plan):
    """The columns of each exchange of a physical plan."""
    own = [[plan.output().apply(i).name() for i in range(plan.output().size())]] if plan.nodeName() == "Exchange" else []
    return own + [x for i in range(plan.children().size()) for x in exchanged(plan.children().apply(i))]


def test_headers_alone_are_shuffled_by_digest(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(warc, "written", lambda df, name: (seen.append(exchanged(df._jdf.queryExecution().executedPlan().initialPlan())), common.written(df, name))[1])
    pages = warc.as_payloads(table(spark, ROOT, "pages"))
    rows = warc.resolved_pages(pages)
    assert len(seen) == 1 and any("payload_digest" in x or "_digest" in x for x in seen[0]) and not any("payload" in x for x in seen[0])
    assert rows.where("refers_to IS NULL").count() + rows.where("refers_to IS NOT NULL").count() == pages.count()


def test_deduplicating_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "body %d é" % (i // 3)) for i in range(9)] + [(9, "u", "")], "page_id long, url string, html string")
    plain = warc.with_digest(warc.as_payloads(pages)).withColumn("refers_to", warc.F.lit(None).cast("long"))
    warc.write_archives(plain, f"file://{tmp_path}/a")
    warc.deduplicate(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    warc.deduplicate(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/c")
    for folder in "bc":
        rows = warc.follow(warc.read_archives(spark, f"file://{tmp_path}/{folder}")).collect()
        assert {(r.page_id, r.record_type, r.refers_to) for r in rows} == {(i, "response" if i in (2, 5, 8, 9) else "revisit", None if i in (2, 5, 8, 9) else i // 3 * 3 + 2) for i in range(10)}
        assert {r.payload_bytes for r in rows} == {9, 0} and all(r.digest_ok for r in rows if r.record_type == "response")


def test_attachments(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "s3://a", 4), ("document", None, "s3://b", None), ("odd", "x", None, None), ("text", None, None, None), ("audio", None, "s3://c", 10)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", None)], "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:bigint>>")
    row = chat.read_chats(chat.format_chats(df)).first()
    assert row.formatted == "<|turn|>user<|text|>see <\\|image|> <|image|><|document|><|audio|><|end|><|turn|>assistant<|text|>ok<|end|><|turn|>user<|text|><|end|>"
    assert [tuple(a) for a in row.attachments] == [(0, 0, "image", "s3://a", 1024), (0, 1, "document", "s3://b", 600), (0, 2, "audio", "s3://c", 250)]
    assert row.expanded_tokens == 1874 and row.loss_text == "ok" and row.turns[0].text == "see <|image|> <|image|><|document|><|audio|>"
