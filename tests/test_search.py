import math
import struct

import numpy as np
import pytest

from vicinity.functions import quantize as Q
from vicinity.functions import vector as V
from vicinity.operators import descent, evaluate, graph, knn, predicates, twophase
from vicinity.operators.hybrid import HybridIndex
from vicinity.plans.planner import Thresholds, selectivity, strategies
from vicinity.queries import data
from vicinity.schema import NODES, QUERIES, as_queries
from vicinity.sources import legacy
from vicinity.sources.shared import stored

ROOT = "/root/testdata/sf0.001"


def made(spark, n=60, dim=5, seed=1, queries=()):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), float(rng.random()), [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, NODES), spark.createDataFrame([(*q[:5], [float(x) for x in q[5]]) for q in queries], QUERIES)


def brute(rows, queries, k):
    out = []
    for qid, qtype, v, l, r, vec in queries:
        ok = [x for x in rows if (qtype in (0, 2) or x[1] == v) and (qtype in (0, 1) or l <= x[2] <= r)]
        near = sorted((round(float(sum((np.float32(a).astype(float) - np.float32(b).astype(float)) ** 2 for a, b in zip(x[3], vec))), 6), x[0]) for x in ok)[:k]
        out += [(qid, i + 1, node, d) for i, (d, node) in enumerate(near)]
    return sorted(out)


def collected(df):
    return sorted((r.qid, r.rank, r.id, round(r.d2, 6)) for r in df.collect())


ASKED = [
    (1, 0, None, None, None, [0.0] * 5),
    (2, 1, 1, None, None, [1.0, 0, 0, 0, 0]),
    (3, 2, -1, 0.2, 0.7, [0.0, 1, 0, 0, 0]),
    (4, 3, 2, 0.0, 1.0, [0.0, 0, 1, 0, 0]),
    (5, 2, None, 0.9, 0.1, [0.0] * 5),  # an empty range
    (6, 1, 99, None, None, [0.0] * 5),  # a category that is absent
    (7, 3, 0, 0.31, 0.32, [0.5] * 5),
]


@pytest.mark.parametrize("k", [1, 7, 200])
def test_search_and_joins_match_brute_force(spark, k):
    rows, nodes, asked = made(spark, queries=ASKED)
    want = brute(rows, ASKED, k)
    assert collected(knn.search(nodes, asked, k)) == want
    assert collected(knn.joined(nodes, asked, k)) == want


def test_search_in_several_blocks_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(knn, "BATCH_ROWS", 7)
    rows = [(i, 0, i / 40, [1.0, 2.0]) for i in range(40)]  # all alike: ids decide
    nodes = spark.createDataFrame(rows, NODES)
    asked = [(q, 0, None, None, None, [1.0, 2.0]) for q in range(5)]
    queries = spark.createDataFrame(asked, QUERIES)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 2)
    assert collected(knn.search(nodes, queries, 4)) == [(q, r + 1, r, 0.0) for q in range(5) for r in range(4)]


def test_empty_tables(spark):
    _, nodes, asked = made(spark, queries=ASKED)
    assert knn.search(nodes.where("false"), asked, 3).count() == 0
    assert knn.search(nodes, asked.where("false"), 3).count() == 0


def test_unknown_type_fails(spark):
    with pytest.raises(Exception, match="unknown query type 4"):
        as_queries(spark.createDataFrame([(1, 4, 0, 0.0, 1.0, [0.0])], QUERIES)).collect()


def test_times_at_the_edges_have_one_slice(spark):
    df = spark.sql("SELECT explode(array(-0.5D, 0D, 0.1D, 0.95D, 1D, 7D)) AS t")
    assert [r[0] for r in df.select(predicates.slice_of(df.t)).collect()] == [0, 0, 1, 9, 9, 9]


def test_interval_split(spark):
    nodes = spark.createDataFrame([(i, 0, i / 100, [0.0]) for i in range(100)], NODES)
    asked = spark.createDataFrame([(1, 2, None, 0.0154, 0.2466, [0.0])], QUERIES)
    got = {r.slice: (r["class"], round(r.local, 3)) for r in predicates.interval_split(nodes, asked, 0.2).collect()}
    assert got == {0: ("MEDIUM", 0.8), 1: ("FULL", 1.0), 2: ("MEDIUM", 0.5)}
    assert predicates.interval_split(nodes, asked, 0.6).where("class = 'SMALL'").count() == 1


def test_quantizers_on_flat_data(spark):
    nodes = spark.createDataFrame([(i, 0, 0.0, [0.0, 0.0]) for i in range(3)], NODES)
    for name in ("sq8sym", "sq8", "sq4"):
        assert {tuple(r.code) for r in Q.encoded(nodes, name).collect()} == {(0, 0)}
    some = spark.createDataFrame([(0, 0, 0.0, [-1.0, 0.5]), (1, 0, 0.0, [1.0, 0.5])], NODES)
    assert [r.code for r in Q.encoded(some, "sq8sym").orderBy("id").collect()] == [[-127, 64], [127, 64]]
    assert [r.code for r in Q.encoded(some, "sq8").orderBy("id").collect()] == [[0, 0], [255, 0]]
    four = Q.encoded(some, "sq4")
    assert [(r.code, bytes(r.b)) for r in four.withColumn("b", Q.pack_sq4(four.code)).orderBy("id").collect()] == [([0, 12], b"\xc0"), ([15, 12], b"\xcf")]


def test_code_distance_at_the_extremes(spark):
    df = spark.createDataFrame([([127] * 32, [-127] * 32)], "a array<int>, b array<int>")
    assert df.select(V.code_l2sq(df.a, df.b)).first()[0] == 32 * 254**2


def test_metric_names():
    assert V.metric("l2") is V.l2sq and V.metric("IP") is V.neg_ip
    with pytest.raises(ValueError):
        V.metric("cosine")


def test_selectivity_counts_every_query(spark):
    rows, nodes, asked = made(spark, queries=ASKED)
    got = {r.qid: r.hits for r in selectivity(nodes, asked).collect()}
    assert got == {q[0]: len([1 for x in brute(rows, [q], 10**6)]) for q in ASKED}


def test_every_strategy(spark):
    _, nodes, asked = made(spark, queries=ASKED)
    at = Thresholds(scan=0.1, scan_both=0.1, index=0.1)
    got = {r.qid: (r.strategy, r.ef) for r in strategies(nodes, asked, at).collect()}
    assert got[1] == ("slice_graphs", 425) and got[2][0] == "category_graph" and got[3][0] == "split_slices"
    assert got[4][0] == "category_range_graph" and got[5] == ("scan", None) and got[6] == ("scan", None)
    one = nodes.where("c = 1")
    assert {r.ef for r in strategies(one, asked.where("qid = 2"), at).collect()} == {1800}  # one category: no slope


def test_two_phase_recall(spark):
    nodes, asked = data(spark, ROOT)
    truth = knn.search(nodes, asked, 10)
    found = twophase.two_phase(nodes, asked, "sq8sym", 10, 20)
    assert evaluate.recall(evaluate.hits(found, truth)).first()[0] >= 0.99


def test_graph_is_sound_and_searches_well(spark):
    nodes, asked = data(spark, ROOT)
    indexed = stored(graph.by_slice(nodes), "indexed")
    edges = stored(graph.build(indexed, 8, 20), "edges")
    low = edges.where("level = 0")
    bad = graph.violations(low, nodes).first()
    assert (bad.loops, bad.repeated, bad.unknown, bad.unreached) == (0, 0, 0, 0)
    assert low.groupBy("src").count().agg({"count": "max"}).first()[0] <= 2 * 8 + 4
    own = asked.where("qtype = 0")
    shards = indexed.select("index_id").distinct()
    to = own.crossJoin(shards).selectExpr("index_id", "qid", "qvec", "24 AS ef", "CAST(NULL AS double) AS low", "CAST(NULL AS double) AS high")
    found = graph.graph_search(indexed, edges, to, 10)
    assert evaluate.recall(evaluate.hits(found, knn.search(nodes, own, 10))).first()[0] >= 0.9


def test_shards_have_a_bounded_size(spark):
    rows, nodes, _ = made(spark, 200)
    sizes = [r[1] for r in graph.by_category(nodes, 0.0, 20).groupBy("index_id").count().collect()]
    assert sum(sizes) == 200 and max(sizes) <= 40


def test_range_search_in_a_shard_returns_only_the_range():
    rng = np.random.default_rng(5)
    vec, t = rng.normal(size=(300, 4)), rng.random(300)
    links = {0: graph.build_links(vec, 6, 30)}
    query = rng.normal(size=4)
    times = [[float(t[j]) for j in row] for row in links[0]]
    got = graph.search_shard(np.arange(300), vec, t, links, times, query, 40, 0.3, 0.5)
    inside = {i for i in range(300) if 0.3 <= t[i] <= 0.5}
    want = sorted(inside, key=lambda i: ((vec[i] - query) ** 2).sum())[:10]
    assert {i for i, _ in got} <= inside and len({i for i, _ in got[:10]} & set(want)) >= 9
    assert graph.search_shard(np.arange(300), vec, t, links, times, query, 40, 2.0, 3.0) == []


def test_many_queries_of_a_shard_at_once():
    """Each finds what it finds alone, of its own beam and range."""
    rng = np.random.default_rng(11)
    n = 600
    vec, t, ids = rng.normal(size=(n, 6)), rng.random(n), np.arange(n) * 3 + 1
    rows = np.concatenate([graph._flat(graph.build_links(vec[at], m, 40), at, l) for l, at, m in ((0, np.arange(n), 8), (1, np.arange(0, n, 9), 4), (2, np.arange(0, n, 81), 4))])
    mixed = rng.permutation(len(rows))
    src, pos, dst, level = rows[mixed].T
    shard = graph.Shard(ids, vec, t, ids[src], pos, ids[dst], t[dst], level)
    asked, ef = rng.normal(size=(50, 6)), rng.integers(1, 200, 50)
    low = np.where(np.arange(50) % 3 == 0, np.nan, rng.random(50) * 0.6)
    high = low + 0.4
    low[4], high[4] = 3.0, 4.0
    found = shard.search(asked, ef, low, high, 10, 2)
    assert set(found[0].tolist()) == set(range(50)) - {4} and np.count_nonzero(found[3]) == 49
    hits = every = 0
    for q in range(50):
        got = found[1][found[0] == q].tolist()
        alone = shard.search(asked[q : q + 1], ef[q : q + 1], low[q : q + 1], high[q : q + 1], 10, 2)
        assert got == alone[1].tolist() and len(got) <= min(10, ef[q])
        d = ((vec - asked[q]) ** 2).sum(1)
        assert np.allclose(found[2][found[0] == q], d[[(i - 1) // 3 for i in got]]) and got == sorted(got, key=lambda i: d[(i - 1) // 3])
        inside = np.arange(n) if np.isnan(low[q]) else np.flatnonzero((t >= low[q]) & (t <= high[q]))
        assert set(got) <= set(ids[inside].tolist())
        if ef[q] >= 40:
            best = ids[inside[np.argsort(d[inside])[:10]]].tolist()
            hits, every = hits + len(set(got) & set(best)), every + len(best)
    assert hits >= 0.95 * every


def test_shards_pass_on_the_k_nearest(spark):
    rows, nodes, _ = made(spark, 200)
    indexed = stored(graph.by_slice(nodes), "indexed")
    edges = stored(graph.build(indexed, 4, 20), "edges")
    asked = spark.createDataFrame([(q, rows[q][3]) for q in range(20)], "qid long, qvec array<float>")
    to = asked.crossJoin(indexed.select("index_id").distinct()).selectExpr("index_id", "qid", "qvec", "30 AS ef", "CAST(NULL AS double) AS low", "CAST(NULL AS double) AS high")
    few, every = (stored(graph.graph_answers(indexed, edges, to, k=k), "answers") for k in (3, None))
    shards = indexed.select("index_id").distinct().count()
    assert few.groupBy("qid").count().where(f"count > {3 * shards}").count() == 0 and few.count() < every.count()
    assert collected(graph.best(few, 3)) == collected(graph.best(every, 3))


@pytest.mark.parametrize("qtype", range(4))
def test_registered_graph_searches_build_their_own_graph_only(spark, qtype, monkeypatch):
    from vicinity import queries

    monkeypatch.setattr(queries, "_built", {})
    assert queries.QUERIES[f"graph_search_type{qtype}"](spark, "/root/testdata/sf0.001").count()
    assert {k[2] for k in queries._built} == {"nodes", *((x, f"{x}_edges")[i] for x in (["slices"] if qtype in (0, 2) else ["categories"]) for i in (0, 1))}


def test_links_of_many_nodes_at_once():
    """As node by node, with equal vectors, short rows and rows of other lengths."""
    rng = np.random.default_rng(8)
    vec = rng.normal(size=(120, 5))
    vec[40:50] = vec[40]
    for most in (1, 7, 60):
        rows = [rng.permutation(120)[: rng.integers(0, 60)].tolist() for _ in range(120)]
        rows = [[j for j in row if j != i] for i, row in enumerate(rows)]
        padded = np.full((120, 60), -1)
        for i, row in enumerate(rows):
            padded[i, : len(row)] = row
        got = graph._diverse_rows(vec, np.arange(120), padded, most)
        assert [x[x >= 0].tolist() for x in got] == [graph.diverse(vec, i, row, most) for i, row in enumerate(rows)]


def test_hybrid_search(spark):
    nodes, asked = data(spark, ROOT)
    at = Thresholds(scan=0.05, scan_both=0.05, index=0.05)
    found = stored(HybridIndex.build(nodes, at, 16, 60, store=stored).search(asked, 10), "found")
    truth = knn.search(nodes, asked, 10)
    assert evaluate.recall(evaluate.hits(found, truth)).first()[0] >= 0.9
    pairs = found.join(asked, "qid").join(nodes, "id").where(~predicates.any_match())
    assert pairs.count() == 0 and found.groupBy("qid", "id").count().where("count > 1").count() == 0


def test_an_index_is_the_same_when_loaded_and_grows(spark, tmp_path):
    nodes, asked = data(spark, ROOT)
    at = Thresholds(scan=0.05, scan_both=0.05, index=0.05)
    truth = knn.search(nodes, asked, 10)
    part = HybridIndex.build(nodes.where("id % 4 != 0"), at, 16, 60, store=stored)
    part.save(f"file://{tmp_path}/part")
    loaded = HybridIndex.load(spark, f"file://{tmp_path}/part", at)
    assert (loaded.alpha, loaded.m) == (part.alpha, 16) and collected(loaded.search(asked, 10)) == collected(part.search(asked, 10))
    grown = loaded.add(nodes.where("id % 4 = 0"), store=stored)
    assert grown.nodes.count() == nodes.count() and grown.slices.count() == nodes.count()
    bad = graph.violations(grown.slice_edges.where("level = 0"), nodes).first()
    assert (bad.loops, bad.repeated, bad.unknown, bad.unreached) == (0, 0, 0, 0)
    assert grown.slice_edges.where("level = 0").groupBy("index_id", "src").count().agg({"count": "max"}).first()[0] <= 2 * 16 + 4
    assert evaluate.recall(evaluate.hits(grown.search(asked, 10), truth)).first()[0] >= 0.9
    again = grown.add(nodes.where("id = 4").withColumn("id", predicates.F.lit(10**6).cast("long")), store=stored)
    assert again.slice_edges.where("src = 1000000").count() and again.nodes.count() == nodes.count() + 1


def test_full_shards_open_new_ones(spark):
    rows, nodes, _ = made(spark, 200)
    at = Thresholds(index=0.0)
    index = HybridIndex.build(nodes.where("id < 100"), at, 4, 10, shard_rows=10, store=stored)
    grown = index.add(nodes.where("id >= 100"), store=stored)
    before, after = ({r[0] for r in x.categories.select("index_id").distinct().collect()} for x in (index, grown))
    assert before < after and grown.categories.count() == 200


def test_links_of_one_entry(spark):
    """Every node can be reached from the middle, by few links each, and the nearest are found."""
    rng = np.random.default_rng(2)
    vec = rng.normal(size=(400, 6))
    links = graph.nsg_links(vec, 8, 40)
    entry = int(np.argmin(((vec - vec.mean(0)) ** 2).sum(1)))
    seen, stack = {entry}, [entry]
    while stack:
        new = set(links[stack.pop()]) - seen
        seen |= new
        stack += new
    assert len(seen) == 400 and np.mean([len(x) for x in links]) <= 9
    nodes = spark.createDataFrame([(i, 0, 0.5, v.tolist()) for i, v in enumerate(vec)], NODES)
    indexed = stored(graph.by_category(nodes, 0.0), "indexed")
    asked = spark.createDataFrame([(q, 0, None, None, None, rng.normal(size=6).tolist()) for q in range(20)], QUERIES)
    found = graph.search_everywhere(indexed, stored(graph.build(indexed, 8, 40, "nsg"), "edges"), asked.selectExpr("qid", "qvec", "60 AS ef"), 10)
    assert evaluate.recall(evaluate.hits(found, knn.search(nodes, asked, 10))).first()[0] >= 0.9


def brute_links(vec, m, candidates):
    """The build, spelled out: nearest, diverse, mutual, cut."""
    d = ((vec[:, None] - vec[None]) ** 2).sum(2)
    def pick(i, some, most):
        kept = []
        for j in sorted(some, key=lambda j: (d[i, j], j)):
            if len(kept) < most and all(d[x, j] >= d[i, j] for x in kept):
                kept.append(j)
        return kept
    links = [pick(i, sorted((j for j in range(len(vec)) if j != i), key=lambda j: (d[i, j], j))[:candidates], m) for i in range(len(vec))]
    both = [{*row, *(j for j, x in enumerate(links) if i in x)} for i, row in enumerate(links)]
    return [set(pick(i, x, 2 * m)) if len(x) > 2 * m else x for i, x in enumerate(both)]


def test_links_against_brute_force():
    rng = np.random.default_rng(4)
    for n, m in ((1, 3), (2, 3), (40, 3), (150, 4)):
        vec = rng.normal(size=(n, 5))
        assert [set(x) for x in graph.build_links(vec, m, 20)] == graph_connected(vec, brute_links(vec, m, 20))


def graph_connected(vec, links):
    return [set(x) for x in graph._connected(vec, [sorted(x) for x in links])]


def test_inner_product_and_own_predicates(spark):
    rows, nodes, asked = made(spark, queries=ASKED[:1])
    asked = asked.withColumn("qvec", predicates.F.expr("array(1f, 2f, 0f, -1f, 0f)"))
    got = [(r.id, round(r.d2, 5)) for r in knn.search(nodes, asked, 5, "IP", predicates.F.col("id") % 2 == 0).orderBy("rank").collect()]
    ip = lambda v: -sum(float(np.float32(a)) * b for a, b in zip(v, (1, 2, 0, -1, 0), strict=True))
    assert got == [(i, round(d, 5)) for d, i in sorted((ip(x[3]), x[0]) for x in rows if x[0] % 2 == 0)[:5]]
    with pytest.raises(ValueError):
        knn.search(nodes, asked, 5, "cosine")


@pytest.mark.parametrize("qtype", range(4))
def test_registered_graph_searches_recall(spark, qtype):
    from vicinity import queries

    root = "/root/testdata/sf0.01"
    nodes, asked = data(spark, root)
    found = queries.QUERIES[f"graph_search_type{qtype}"](spark, root)
    truth = knn.search(nodes, asked.where(f"qtype = {qtype}"), queries.K)
    assert evaluate.recall(evaluate.hits(found, truth)).first()[0] >= 0.9


def test_ranks_of_ties_and_hot_moments(spark):
    rng = np.random.default_rng(6)
    times = [0.5] * 300 + rng.random(200).round(2).tolist() + [None]
    nodes = spark.createDataFrame([(i, i % 3 if i % 50 else None, t, [0.0]) for i, t in enumerate(times)], NODES)
    ends = [(q, str(q % 3) if q % 2 else predicates.ALL, *sorted(rng.random(2).round(2).tolist())) for q in range(30)] + [(30, predicates.ALL, 0.5, 0.5), (31, "7", 0.0, 1.0)]
    asked = spark.createDataFrame([*ends, (32, predicates.ALL, 0.9, 0.1), (33, predicates.ALL, None, 0.1)], "qid long, key string, l double, r double")
    got = {r.qid: (r.below, r.upto) for r in predicates.ranks(nodes, asked).collect()}
    rows = [(str(i % 3) if i % 50 else None, t) for i, t in enumerate(times) if t is not None]
    assert got == {q: (sum(t < l for c, t in rows if key in (predicates.ALL, c)), sum(t <= r for c, t in rows if key in (predicates.ALL, c))) for q, key, l, r in ends}


def test_counting_makes_no_pairs(spark):
    """No join of the plan makes more rows than nodes and queries together, whatever the ranges cover."""
    n = 4000
    nodes = spark.range(n).selectExpr("id", "CAST(0 AS int) AS c", "id / 4000D AS t", "array(0f) AS vec")
    asked = spark.range(500).selectExpr("id AS qid", "CAST(2 + id % 2 AS int) AS qtype", "CAST(0 AS int) AS v", "0.01D AS l", "0.99D AS r", "array(0f) AS qvec")
    assert {r.hits for r in selectivity(nodes, asked).collect()} == {3921}
    plan = selectivity(nodes, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "t#" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_nn_descent_recall(spark):
    nodes, _ = data(spark, ROOT)
    exact = graph.knn_graph(nodes.withColumn("c", predicates.F.lit(0)), 5).selectExpr("src AS qid", "dst AS id")
    found = graph.nn_descent(nodes, 5, 4, store=stored).selectExpr("src AS qid", "dst AS id")
    assert evaluate.recall(evaluate.hits(found, exact)).first()[0] >= 0.8


def nearest_rows(rows, k):
    """(src, pos, dst) of the k nearest others by (d2, id), from all pairs."""
    rows = [(i, np.asarray(v, np.float64)) for i, v in rows if v is not None]
    out = set()
    for i, v in rows:
        others = sorted((float(((v - w) ** 2).sum()), j) for j, w in rows if j != i)[:k]
        out |= {(i, pos, j) for pos, (_, j) in enumerate(others, 1)}
    return out


def test_nn_descent_of_copies_and_nodes_without_a_vector(spark):
    rng = np.random.default_rng(11)
    some = rng.normal(size=(120, 6)).astype(np.float32)
    which = [0] * 90 + [1, 1, 2, 2, 2] + list(range(3, 120)) + [None] * 7
    ids = (rng.permutation(len(which)) - 40).tolist()
    rows = [(i, None if w is None else some[w].tolist()) for i, w in zip(ids, which, strict=True)]
    nodes = spark.createDataFrame([(i, 0, 0.5, v) for i, v in rows], NODES)
    got = graph.nn_descent(nodes, 4, store=stored).collect()
    assert {(r.src, r.pos, r.dst) for r in got} == nearest_rows(rows, 4) and len(got) == 4 * (len(rows) - 7)
    assert all(r.d2 >= 0 for r in got)


def test_nn_descent_of_few_nodes(spark):
    for n in range(4):
        rows = [(i, [float(i * i), 1.0]) for i in range(n)]
        nodes = spark.createDataFrame([(i, 0, 0.5, v) for i, v in rows], NODES)
        assert {(r.src, r.pos, r.dst) for r in graph.nn_descent(nodes, 5, store=stored).collect()} == nearest_rows(rows, 5)


def test_nn_descent_widens_lists_that_lack_recall(spark):
    """Lists of 4 are too short for 3,000 nodes without clusters."""
    vec = np.random.default_rng(12).normal(size=(3000, 24)).astype(np.float32)
    nodes = spark.createDataFrame([(i, 0, 0.5, v.tolist()) for i, v in enumerate(vec)], NODES)
    rows = graph.nn_descent(nodes, 3, width=4, store=stored).collect()
    exact = {(i, int(j)) for i, near in enumerate(graph.nearest(vec.astype(np.float64), 3)) for j in near}
    found = {(r.src, r.dst) for r in rows}
    assert len(rows) == len(found) == 9000
    assert len(found & exact) / len(exact) >= 0.9


def test_local_join():
    rng = np.random.default_rng(13)
    vec, ids, width = rng.normal(size=(60, 5)).astype(np.float32), rng.permutation(1000)[:60] - 500, 4
    joins = [(c, int(b)) for c in range(20) for b in rng.choice(60, rng.integers(1, 15), replace=False)]
    c, b = np.array(joins).T
    new, last = rng.random(len(c)) < 0.4, np.where(rng.random(60) < 0.2, np.inf, rng.random(60) * 9)
    wide = vec.astype(np.float64)
    met = {(x, y) for i, (p, x) in enumerate(joins) for j, (q, y) in enumerate(joins) if p == q and x != y and (new[i] or new[j])}
    near = {}
    for x, y in met:
        d = ((wide[x] - wide[y]) ** 2).sum()
        if d <= last[x]:
            near.setdefault(x, []).append((d, ids[y], y))
    expected = {(x, y) for x, row in near.items() for _, _, y in sorted(row)[:width]}
    a, n, d = descent.local_join(c, b, new, vec, last, ids, width)
    assert len(a) == len(expected) and set(zip(a.tolist(), n.tolist(), strict=True)) == expected
    assert np.array_equal(d, ((wide[a] - wide[n]) ** 2).sum(1))


def test_equally_far_nodes_go_by_id(spark):
    """More copies of one vector in a batch than k: the smallest ids stay, wherever they lie."""
    rng = np.random.default_rng(3)
    ids, hot = rng.permutation(1500), rng.normal(size=8).astype(np.float32)
    rows = [(int(i), 0, 0.5, (hot if i % 3 else hot + 1).tolist()) for i in ids]
    nodes = spark.createDataFrame(rows, NODES).coalesce(1)
    asked = spark.createDataFrame([(0, 0, None, None, None, (hot + np.float32(0.1)).tolist())], QUERIES)
    got = [r.id for r in knn.search(nodes, asked, 5).orderBy("rank").collect()]
    assert got == [1, 2, 4, 5, 7]
    assert got == [r.id for r in knn.joined(nodes, asked, 5).orderBy("rank").collect()]


def test_registered_nn_descent_recall(spark):
    from vicinity import queries

    root = "/root/testdata/sf0.1"
    nodes, _ = data(spark, root)
    rows = nodes.select("id", "vec").orderBy("id").collect()
    ids, near = np.array([r.id for r in rows]), graph.nearest(np.array([r.vec for r in rows], np.float64), 5)
    exact = {(int(ids[i]), int(ids[j])) for i, row in enumerate(near) for j in row}
    found = {(r.src, r.dst) for r in queries.QUERIES["nn_descent"](spark, root).collect()}
    recall = len(found & exact) / len(exact)
    assert recall >= 0.9, recall


def test_legacy_files(spark, tmp_path):
    rows, nodes, _ = made(spark, 30)
    (tmp_path / "base.bin").write_bytes(b"".join(legacy.encode(nodes, legacy.BASE)))
    got = legacy.read(spark, f"file://{tmp_path}/base.bin", legacy.BASE, 5).orderBy("id").collect()
    assert [(r.id, r.c) for r in got] == [x[:2] for x in rows]
    assert all(math.isclose(a, np.float32(b)) for r, x in zip(got, rows, strict=True) for a, b in zip(r.vec, x[3], strict=True))
    (tmp_path / "cut.bin").write_bytes(struct.pack("<I", 9) + (tmp_path / "base.bin").read_bytes()[4 : 4 + 28 * 3 + 5])
    assert legacy.read(spark, f"file://{tmp_path}/cut.bin", legacy.BASE, 5).count() == 3


def test_legacy_results(spark, tmp_path):
    result = spark.createDataFrame([(0, 1, 7), (0, 2, 3), (1, 1, 5)], "qid long, rank int, id long")
    for header in (False, True):
        (tmp_path / "ids.bin").write_bytes(b"".join(legacy.encode_ids(result, 2, header)))
        back = legacy.read_ids(spark, f"file://{tmp_path}/ids.bin", 2, header)
        assert sorted(map(tuple, back.collect())) == [(0, 1, 7), (0, 2, 3), (1, 1, 5)]
    (tmp_path / "f.bin").write_bytes(np.array([1, 0.5, 2, 0.25], "<f4").tobytes())
    assert [tuple(r) for r in legacy.read_floats(spark, f"file://{tmp_path}/f.bin", ("qtype", "s")).collect()] == [(0, 1.0, 0.5), (1, 2.0, 0.25)]


def test_numbers_without_a_header(spark, tmp_path):
    rows = spark.createDataFrame([(2, 3.0, 0.5), (0, 1.0, 0.25), (1, 0.0, 1.0)], "qid long, qtype double, s double")
    (tmp_path / "f.bin").write_bytes(b"".join(legacy.encode_floats(rows, ("qtype", "s"))))
    assert sorted(map(tuple, legacy.read_floats(spark, f"file://{tmp_path}/f.bin", ("qtype", "s")).collect())) == [(0, 1.0, 0.25), (1, 0.0, 1.0), (2, 3.0, 0.5)]
    (tmp_path / "parts").mkdir()
    for i, ids in enumerate(([5, 6, 7, 0xFFFFFFFF], [8, 9])):
        (tmp_path / "parts" / f"{i}.bin").write_bytes(struct.pack("<I", len(ids) // 2) + np.array(ids, "<u4").tobytes())
    assert sorted(map(tuple, legacy.read_ids(spark, f"file://{tmp_path}/parts", 2, True).collect())) == [(0, 1, 5), (0, 2, 6), (1, 1, 7), (2, 1, 8), (2, 2, 9)]
    (tmp_path / "i.bin").write_bytes(np.array([7, -1, 9], "<i4").tobytes() + b"\x01")
    assert [tuple(r) for r in legacy.read_ints(spark, f"file://{tmp_path}/i.bin", ("hits",)).collect()] == [(0, 7), (1, -1), (2, 9)]


def test_times(spark):
    timed = spark.createDataFrame([(1, 0, 0.01, 9, 10.0), (2, 0, 0.91, 8, 30.0), (3, 2, 0.95, 7, 50.0)], "qid long, qtype int, selectivity double, hits long, us double")
    F = predicates.F
    assert sorted(map(tuple, evaluate.times(timed, F.col("qtype")).collect())) == [(0, 2, 40.0, 20.0), (2, 1, 50.0, 50.0)]
    assert sorted(map(tuple, evaluate.times(timed, evaluate.side(0.05)).collect())) == [("graph", 2, 80.0, 40.0), ("scan", 1, 10.0, 10.0)]
    assert sorted(map(tuple, evaluate.times(timed, evaluate.tenth()).collect())) == [(1, 1, 10.0, 10.0), (10, 2, 80.0, 40.0)]
    assert evaluate.scatter(timed).columns == ["qid", "qtype", "selectivity", "us", "hits"]
    nodes, asked = data(spark, ROOT)
    indexed = stored(graph.by_category(nodes, 0.0), "indexed")
    to = asked.where("qtype = 1").join(indexed.selectExpr("c AS v", "index_id").distinct(), "v").selectExpr("index_id", "qid", "qvec", "40 AS ef", "CAST(NULL AS double) AS low", "CAST(NULL AS double) AS high")
    answers = stored(graph.graph_answers(indexed, stored(graph.build(indexed, 8, 30), "edges"), to), "answers")
    took = graph.query_times(answers).collect()
    assert len(took) == to.select("qid").distinct().count() and all(r.us > 0 for r in took)
    assert graph.best(answers, 3).groupBy("qid").count().where("count > 3").count() == 0


def test_recall_of_a_graph_and_products_of_codes(spark):
    rows, nodes, _ = made(spark, 100)
    exact = graph.knn_graph(nodes.withColumn("c", predicates.F.lit(0)), 4)
    assert evaluate.graph_recall(exact, nodes, 4, 5).first()[0] == 1.0
    assert evaluate.graph_recall(exact.where("pos <= 2"), nodes, 4, 5).first()[0] == 0.5
    coded = Q.encoded(nodes, "sq8sym")
    most = max(sum(x * x for x in r.code) for r in coded.collect())
    assert tuple(evaluate.product_bound(coded).first()) == (most, most <= 32767) and evaluate.product_bound(coded, most).first().fits
    assert [Q.quantizer(x) for x in range(4)] == ["fp32", "sq8", "sq8", "sq8sym"]


def test_clustered_tables(spark):
    rows, nodes, _ = made(spark, 200)
    big = max(range(3), key=lambda c: (sum(r[1] == c for r in rows), -c))
    orders = {"category": lambda r: (r[1], r[2], r[0]), "time": lambda r: (r[2], r[0]), "largest": lambda r: (r[1] != big, r[2], r[0])}
    for how, key in orders.items():
        parts = predicates.clustered(nodes, how, 4)
        assert parts.columns == nodes.columns and [r.id for r in parts.collect()] == [r[0] for r in sorted(rows, key=key)]
    with pytest.raises(ValueError):
        predicates.clustered(nodes, "id", 4)


def test_gathering_in_a_filter():
    rng = np.random.default_rng(9)
    links = [rng.choice(50, 3, replace=False).tolist() for _ in range(50)]
    inside = rng.random(50) < 0.3
    hops = {0: 0}
    ring = [0]
    while ring:
        ring = [j for j in dict.fromkeys(j for i in ring for j in links[i]) if j not in hops and not hops.update({j: hops[i] + 1 for i in ring if j in links[i]})]
    every = graph.gather(links, 0, inside, 100)
    assert set(every) == {i for i in hops if i and inside[i]} and [hops[i] for i in every] == sorted(hops[i] for i in every)
    assert graph.gather(links, 0, inside, 4) == every[:4] and all(hops[i] <= 2 for i in graph.gather(links, 0, inside, 100, 2))


def test_equal_vectors_have_equal_hashes(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],), ([2.0, 1.0],)], "vec array<float>")
    assert df.select(V.hash_vector(df.vec)).distinct().count() == 2


def test_stream_of_queries(spark, tmp_path):
    from vicinity.streaming.search import answer_stream

    rows, nodes, asked = made(spark, queries=ASKED)
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(QUERIES).parquet(str(tmp_path / "in"))
    answer_stream(stream, nodes, str(tmp_path / "out"), str(tmp_path / "check"), 3).awaitTermination()
    assert collected(spark.read.parquet(str(tmp_path / "out"))) == brute(rows, ASKED, 3)
