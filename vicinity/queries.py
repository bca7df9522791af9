"""The registered queries of the search engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions import quantize as Q
from vicinity.functions import vector as V
from vicinity.operators import evaluate, graph, knn, predicates, twophase
from vicinity.operators.hybrid import HybridIndex
from vicinity.plans.planner import Thresholds, selectivity, strategies
from vicinity.schema import SLICES, as_nodes, as_queries
from vicinity.sources.fixtures import SQL as FIXTURE
from vicinity.sources.fixtures import nodes as read_nodes
from vicinity.sources.fixtures import queries as read_queries
from vicinity.sources.shared import stored

Query = Callable[[SparkSession, str], DataFrame]
K, CODED_K = 10, 20
#: The share of rows that a category needs to be listed: small, so that the small tables have some of each kind.
SHARE = 0.1
SPLIT = 0.2
AT = Thresholds(scan=0.05, scan_both=0.05, index=0.09)
#: Every category has a graph.
EVERY = Thresholds(index=0.0)
#: Length of the search lists of the graph queries.
EF = 64


def data(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    base = as_nodes(read_nodes(spark, root))
    return base, as_queries(read_queries(base))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def _of_type(*types: int) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        base, asked = data(spark, root)
        return _rounded(knn.search(base, asked.where(F.col("qtype").isin(*types)), K), "d2")

    return run


def _joined(*types: int) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        base, asked = data(spark, root)
        return _rounded(knn.joined(base, asked, K, types=types), "d2")

    return run


def _distance(f: Callable) -> Query:
    """Between each query and the rows of its category in its time range."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        base, asked = data(spark, root)
        return base.join(asked, predicates.matches(3)).select("qid", "id", (F.round(f(F.col("vec"), F.col("qvec")), 6) + F.lit(0.0)).alias("d"))

    return run


def _base(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, root: f(data(spark, root)[0])


def _both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, root: f(*data(spark, root))


def _codes(name: str) -> Query:
    return _base(lambda n: Q.encoded(n, name).select("id", F.array_join(F.col("code").cast("array<string>"), ",").alias("code")))


def _evaluated(base: DataFrame, asked: DataFrame) -> DataFrame:
    """What the coded two-phase search finds, against the truth."""
    hits = evaluate.hits(twophase.coded_search(base, asked, "sq4", K), knn.search(base, asked, K))
    return selectivity(base, asked).select("qid", "qtype", F.round("selectivity", 9).alias("selectivity")).join(hits, "qid")


def _scaled(base: DataFrame, asked: DataFrame) -> DataFrame:
    known = Q.trained(base, "sq8sym")
    return twophase.scaled(twophase.coded_search(base, asked, "sq8sym", CODED_K, known), known[0])


def _extended(metric: Callable) -> Query:
    """Float queries against per-dimension codes."""

    def run(base: DataFrame, asked: DataFrame) -> DataFrame:
        known = Q.trained(base, "sq8")
        low, width = (F.array(*map(F.lit, x)) for x in known)
        pairs = Q.encoded(base, "sq8", known=known).select("id", "c", "t", "code").join(asked, predicates.matches(3))
        return pairs.select("qid", "id", F.round(metric(F.col("qvec"), F.col("code"), low, width), 4).alias("d"))

    return _both(run)


def _once(spark: SparkSession, root: str, what: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is stored once a session in the shared folder and read from there after that."""
    key = (spark.sparkContext.applicationId, root, *what)
    if key not in _built:
        _built[key] = stored(make(), str(what[0]))
    return _built[key]


#: The tables that this process has stored.
_built: dict[tuple, DataFrame] = {}


def _graph(spark: SparkSession, root: str, kind: str, at: Thresholds) -> tuple[DataFrame, DataFrame]:
    """The indexed nodes and the edges of `categories` or `slices`; only the graphs that are asked for are built."""
    base = _once(spark, root, ("nodes",), lambda: data(spark, root)[0])
    share = at.index if kind == "categories" else None  # slices are the same for all thresholds
    indexed = _once(spark, root, (kind, share), lambda: HybridIndex.indexed(base, kind, at))
    return indexed, _once(spark, root, (f"{kind}_edges", share), lambda: graph.build(indexed))


def _index(spark: SparkSession, root: str, at: Thresholds) -> HybridIndex:
    """The tables' index, built once a session."""
    (categories, category_edges), (slices, slice_edges) = (_graph(spark, root, kind, at) for kind in ("categories", "slices"))
    base = _once(spark, root, ("nodes",), lambda: data(spark, root)[0])
    return HybridIndex.of(base, categories, slices, category_edges, slice_edges, at)


def _asked(spark: SparkSession, root: str) -> DataFrame:
    """The queries, from the stored nodes."""
    return as_queries(read_queries(_once(spark, root, ("nodes",), lambda: data(spark, root)[0])))


def _graph_search(qtype: int) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        """Category graphs for types 1 and 3, slice graphs for 0 and 2."""
        nodes, edges = _graph(spark, root, "slices" if qtype in (0, 2) else "categories", EVERY)
        own = _asked(spark, root).where(F.col("qtype") == qtype).withColumn("ef", F.lit(EF))
        if qtype == 0:
            return _rounded(graph.search_everywhere(nodes, edges, own, K), "d2")
        ends = [F.col(x) if qtype in (2, 3) else F.lit(None).cast("double") for x in "lr"]
        if qtype == 2:
            shards = nodes.select(predicates.slice_of(F.col("t")).alias("slice"), "index_id").distinct()
            to = own.withColumn("slice", F.explode(predicates.slices_between(F.col("l"), F.col("r")))).join(shards, "slice")
        else:
            to = own.join(nodes.select(F.col("c").alias("v"), "index_id").distinct(), "v")
        asked = to.select("index_id", "qid", "qvec", "ef", ends[0].alias("low"), ends[1].alias("high"))
        return _rounded(graph.graph_search(nodes, edges, asked, K, wider=2 if qtype == 2 else 1), "d2")

    return run


QUERIES: dict[str, Query] = {
    **{f"knn_type{t}": _of_type(t) for t in range(4)},
    "knn_type0_joined": _joined(0),
    "knn_type1_joined": _joined(1),
    "knn_type2_joined": _joined(2),
    "knn_type3_joined": _joined(3),
    "knn_hybrid_all": _of_type(0, 1, 2, 3),
    "knn_hybrid_joined": _joined(0, 1, 2, 3),
    "knn_k100_underfull": lambda s, r: _rounded(knn.search(*data(s, r), 100), "d2"),
    "dist_l2sq": _distance(V.l2sq),
    "dist_ip": _distance(V.ip),
    "dist_neg_ip": _distance(V.neg_ip),
    "dist_one_minus_ip": _distance(V.one_minus_ip),
    "dist_sq8_ext_l2": _extended(V.mixed_l2sq),
    "dist_sq8_ext_ip": _extended(V.mixed_neg_ip),
    "category_count": _base(predicates.category_counts),
    "category_extremes": _base(predicates.category_extremes),
    "category_map": _base(lambda n: predicates.category_map(n, SHARE)),
    "slice_map": _base(predicates.slice_counts),
    "interval_split": _both(lambda n, q: predicates.interval_split(n, q.where("qtype = 2"), SPLIT)),
    "selectivity": _both(lambda n, q: selectivity(n, q).withColumn("selectivity", F.round("selectivity", 9))),
    "strategy_choice": _both(lambda n, q: strategies(n, q, AT)),
    "sq8sym_train": _base(lambda n: _rounded(Q.train_sq8sym(n), "alpha")),
    "sq8_train": _base(lambda n: _rounded(Q.train_sq8(n), "low", "width")),
    "sq4_train": _base(lambda n: _rounded(Q.train_sq4(n), "low", "width")),
    "sq8sym_encode": _codes("sq8sym"),
    "sq8_encode": _codes("sq8"),
    "sq4_encode": _codes("sq4"),
    "code_square_sums": _base(lambda n: evaluate.code_overflow(Q.encoded(n, "sq8sym"), 0)),
    "sq8sym_knn": _both(lambda n, q: twophase.coded_search(n, q, "sq8sym", CODED_K)),
    "sq8sym_knn_scaled": _both(lambda n, q: _rounded(_scaled(n, q), "d2")),
    "sq8sym_two_phase": _both(lambda n, q: _rounded(twophase.two_phase(n, q, "sq8sym", K, CODED_K), "d2")),
    "sq8_two_phase": _both(lambda n, q: _rounded(twophase.two_phase(n, q, "sq8", K, CODED_K), "d2")),
    "sq4_two_phase": _both(lambda n, q: _rounded(twophase.two_phase(n, q, "sq4", K, CODED_K), "d2")),
    "recall_per_query": _both(_evaluated),
    "recall_total": _both(lambda n, q: _rounded(evaluate.recall(_evaluated(n, q)), "recall")),
    "recall_per_type": _both(lambda n, q: evaluate.by_type(_evaluated(n, q))),
    "query_stats_by_type": _both(lambda n, q: evaluate.by_ceiling(_evaluated(n, q))),
    "recall_by_side": _both(lambda n, q: evaluate.sides(_evaluated(n, q), 0.05)),
    "selectivity_histogram": _both(lambda n, q: evaluate.selectivity_histogram(selectivity(n, q))),
    "recall_frequency": _both(lambda n, q: evaluate.hits_frequency(_evaluated(n, q), 0.05)),
    "recall_ratio_by_selectivity": _both(lambda n, q: evaluate.good_share(_evaluated(n, q), 7, 0.05)),
    "sort_base_by_category_time": _base(predicates.sorted_base),
    "sort_base_by_time": _base(predicates.sorted_by_time),
    "sort_base_largest_first": _base(predicates.sorted_largest_first),
    "sort_queries": lambda s, r: predicates.sorted_queries(data(s, r)[1]),
    "centroid": _base(evaluate.centroid),
    "tombstones": _base(lambda n: predicates.without_deleted(n, n.where("id % 7 = 0")).select("id", "c")),
    "allow_list": _base(lambda n: predicates.allowed(n, n.where("id % 7 = 0")).select("id", "c")),
    "knn_graph": _base(lambda n: _rounded(graph.knn_graph(n, 5), "d2")),
    "graph_reverse": _base(lambda n: graph.reversed_edges(graph.knn_graph(n, 5))),
    "graph_degree_stats": _base(lambda n: graph.degree_stats(graph.reversed_edges(graph.knn_graph(n, 5)))),
    "graph_violations": _base(lambda n: graph.violations(graph.reversed_edges(graph.knn_graph(n, 5)), n)),
    "knn_graph_pruned": _base(lambda n: graph.build(graph.by_category(n, 0.0))),
    "nn_descent": _base(lambda n: _rounded(graph.nn_descent(n, 5, store=stored), "d2")),
    **{f"graph_search_type{t}": _graph_search(t) for t in range(4)},
    "hybrid_search": lambda s, r: _rounded(_index(s, r, AT).search(_asked(s, r), K), "d2"),
}

# ---------------------------------------------------------------------------
_L2 = "list_sum([(CAST(vec[i] AS DOUBLE) - CAST(qvec[i] AS DOUBLE)) * (CAST(vec[i] AS DOUBLE) - CAST(qvec[i] AS DOUBLE)) FOR i IN range(1, len(vec) + 1)])"
_IP = "list_sum([CAST(vec[i] AS DOUBLE) * CAST(qvec[i] AS DOUBLE) FOR i IN range(1, len(vec) + 1)])"
_MATCH = "(qtype = 0 OR (qtype = 1 AND c = v) OR (qtype = 2 AND t >= l AND t <= r) OR (qtype = 3 AND c = v AND t >= l AND t <= r))"
_SLICE = "CAST(greatest(0, least(9, floor(t * 10))) AS INTEGER)"


def _top(types: str, k: int) -> str:
    return f"{FIXTURE}, p AS (SELECT qid, id, {_L2} AS d2 FROM nodes, queries WHERE qtype IN ({types}) AND {_MATCH}), k AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank, id, round(d2, 6) AS d2 FROM p) SELECT qid, CAST(rank AS INTEGER) AS rank, id, d2 FROM k WHERE rank <= {k}"


def _dist(value: str) -> str:
    return f"{FIXTURE} SELECT qid, id, round({value}, 6) + 0.0::DOUBLE AS d FROM nodes, queries WHERE c = v AND t >= l AND t <= r"


_RANGES = """,
x AS (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM nodes),
dims AS (SELECT CAST(pos AS INTEGER) AS pos, CAST(min(x) AS DOUBLE) AS low, CAST(max(x) AS DOUBLE) - CAST(min(x) AS DOUBLE) AS width FROM x GROUP BY pos),
arr AS (SELECT list(low ORDER BY pos) AS low, list(width ORDER BY pos) AS width, min(low) AS low4, max(low + width) AS high4,
  greatest(max(abs(low)), max(abs(low + width))) AS a0 FROM dims),
par AS (SELECT low, width, (SELECT CAST(min(x) AS DOUBLE) FROM x) AS low4, (SELECT CAST(max(x) AS DOUBLE) - CAST(min(x) AS DOUBLE) FROM x) AS width4,
  (SELECT max(abs(CAST(x AS DOUBLE))) FROM x) AS alpha FROM arr)"""
_ENCODE = {
    "sq8sym": "[CASE WHEN alpha > 0 THEN CAST(round(greatest(-1.0, least(1.0, CAST({v}[i] AS DOUBLE) / alpha)) * 127) AS INTEGER) ELSE 0 END FOR i IN range(1, len({v}) + 1)]",
    "sq8": "[CASE WHEN width[i] > 0 THEN CAST(floor(least(1.0, greatest(0.0, (CAST({v}[i] AS DOUBLE) - low[i]) / width[i])) * 255) AS INTEGER) ELSE 0 END FOR i IN range(1, len({v}) + 1)]",
    "sq4": "[CASE WHEN width4 > 0 THEN CAST(floor(least(0.999, greatest(0.0, (CAST({v}[i] AS DOUBLE) - low4) / width4)) * 16) AS INTEGER) ELSE 0 END FOR i IN range(1, len({v}) + 1)]",
}


def _coded(name: str) -> str:
    enc = _ENCODE[name]
    return f"{FIXTURE}{_RANGES}, cn AS (SELECT id, c, t, vec, {enc.format(v='vec')} AS code FROM nodes, par), cq AS (SELECT qid, qtype, v, l, r, qvec, {enc.format(v='qvec')} AS qcode FROM queries, par)"


def _coded_top(name: str, k: int) -> str:
    d = "list_sum([(CAST(code[i] AS BIGINT) - qcode[i]) * (CAST(code[i] AS BIGINT) - qcode[i]) FOR i IN range(1, len(code) + 1)])"
    return f"{_coded(name)}, cp AS (SELECT qid, id, vec, qvec, CAST({d} AS BIGINT) AS d2 FROM cn, cq WHERE {_MATCH}), ck AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS INTEGER) AS rank FROM cp), coded AS (SELECT * FROM ck WHERE rank <= {k})"


def _two_phase(name: str) -> str:
    return f"{_coded_top(name, CODED_K)}, e AS (SELECT qid, id, {_L2} AS d2 FROM coded), k AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS INTEGER) AS rank, id, round(d2, 6) AS d2 FROM e) SELECT * FROM k WHERE rank <= {K}"


_SEL = f""",
hit AS (SELECT qid, count(*) AS hits FROM nodes, queries WHERE {_MATCH} GROUP BY qid),
sel AS (SELECT q.qid, qtype, v, l, r, CAST(coalesce(hits, 0) AS BIGINT) AS hits, coalesce(hits, 0) / (SELECT count(*) FROM nodes) AS s FROM queries q LEFT JOIN hit ON q.qid = hit.qid)"""
_EVAL = f"{_coded_top('sq4', K)}{_SEL}, xp AS (SELECT qid, id, {_L2} AS d2 FROM nodes, queries WHERE {_MATCH}), xk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM xp), truth AS (SELECT qid, id FROM xk WHERE rank <= {K}), ev AS (SELECT truth.qid, count(coded.id) AS hits, count(*) AS expected FROM truth LEFT JOIN coded ON truth.qid = coded.qid AND truth.id = coded.id GROUP BY truth.qid), evaluated AS (SELECT ev.qid, qtype, round(s, 9) AS selectivity, ev.hits, expected FROM ev JOIN sel ON ev.qid = sel.qid)"
_BIN = "CAST(least(floor(selectivity * 10), 9) AS INTEGER)"
_SIDE = "CASE WHEN selectivity < 0.05 THEN 'scan' ELSE 'graph' END"
_GRAPH = f"{FIXTURE}, gp AS (SELECT a.id AS src, b.id AS dst, {_L2.replace('qvec', 'b.vec').replace('(vec', '(a.vec').replace('CAST(vec', 'CAST(a.vec').replace('len(vec)', 'len(a.vec)')} AS d2 FROM nodes a JOIN nodes b ON a.c = b.c AND a.id <> b.id), gk AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS INTEGER) AS pos, dst, round(d2, 6) AS d2 FROM gp), g AS (SELECT * FROM gk WHERE pos <= 5), gr AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"
_CODE_TEXT = "array_to_string([CAST(x AS VARCHAR) FOR x IN code], ',')"

ORACLE_SQL: dict[str, str] = {
    **{f"knn_type{t}": _top(str(t), K) for t in range(4)},
    **{f"knn_type{t}_joined": _top(str(t), K) for t in range(4)},
    "knn_hybrid_all": _top("0, 1, 2, 3", K),
    "knn_hybrid_joined": _top("0, 1, 2, 3", K),
    "knn_k100_underfull": _top("0, 1, 2, 3", 100),
    "dist_l2sq": _dist(_L2),
    "dist_ip": _dist(_IP),
    "dist_neg_ip": _dist(f"-({_IP})"),
    "dist_one_minus_ip": _dist(f"1 - ({_IP})"),
    "dist_sq8_ext_l2": f"{_coded('sq8')} SELECT qid, id, round(list_sum([(255.0::DOUBLE * qvec[i] - ((code[i] + 0.5::DOUBLE) * width[i] + 255.0::DOUBLE * low[i])) ** 2 FOR i IN range(1, len(code) + 1)]), 4) AS d FROM cn, cq, par WHERE c = v AND t >= l AND t <= r",
    "dist_sq8_ext_ip": f"{_coded('sq8')} SELECT qid, id, round(-list_sum([CAST(qvec[i] AS DOUBLE) * ((code[i] + 0.5::DOUBLE) * width[i] / 255.0::DOUBLE + low[i]) FOR i IN range(1, len(code) + 1)]), 4) AS d FROM cn, cq, par WHERE c = v AND t >= l AND t <= r",
    "category_count": f"{FIXTURE} SELECT c, count(*) AS n FROM nodes GROUP BY c",
    "category_extremes": f"{FIXTURE}, k AS (SELECT c, count(*) AS n FROM nodes GROUP BY c) SELECT (SELECT c FROM k ORDER BY n DESC, c LIMIT 1) AS largest, max(n) AS most, min(n) AS fewest FROM k",
    "category_map": f"{FIXTURE}, k AS (SELECT c, count(*) AS n FROM nodes GROUP BY c HAVING count(*) >= {SHARE} * (SELECT count(*) FROM nodes)) SELECT c, CAST(coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n FROM k",
    "slice_map": f"{FIXTURE} SELECT {_SLICE} AS slice, count(*) AS n FROM nodes GROUP BY 1",
    "interval_split": f"""{FIXTURE}, s AS (SELECT {_SLICE} AS slice, count(*) AS n FROM nodes GROUP BY 1),
a AS (SELECT qid, l, r, slice, n FROM queries, s WHERE qtype = 2 AND l <= r AND slice >= least(9, floor(l * 10)) AND slice <= least(9, floor(r * 10))),
h AS (SELECT a.qid, a.slice, count(*) AS hits FROM a JOIN (SELECT t, {_SLICE} AS slice FROM nodes) x ON a.slice = x.slice AND t >= l AND t <= r GROUP BY 1, 2)
SELECT a.qid, a.slice, CASE WHEN l <= a.slice / 10 AND r >= (a.slice + 1) / 10 THEN 'FULL' WHEN coalesce(hits, 0) / n < {SPLIT} THEN 'SMALL' ELSE 'MEDIUM' END AS class, round(coalesce(hits, 0) / n, 9) AS local
FROM a LEFT JOIN h ON a.qid = h.qid AND a.slice = h.slice""",
    "selectivity": f"{FIXTURE}{_SEL} SELECT qid, qtype, hits, round(s, 9) AS selectivity FROM sel",
    "strategy_choice": f"""{FIXTURE}{_SEL}, k AS (SELECT c, count(*) AS n FROM nodes GROUP BY c), z AS (SELECT min(n) AS lo, max(n) AS hi, sum(n) AS al FROM k),
w AS (SELECT sel.*, n, CASE WHEN hi > lo THEN (n - lo) / (hi - lo) ELSE 0 END AS share, qtype <> 0 AND (s < {AT.scan} OR (qtype = 3 AND s < {AT.scan_both}) OR (qtype IN (1, 3) AND coalesce(n, 0) < {AT.index} * al)) AS scanned FROM sel LEFT JOIN k ON v = c, z)
SELECT qid, qtype, hits, round(s, 9) AS selectivity, CASE WHEN scanned THEN 'scan' WHEN qtype = 0 THEN 'slice_graphs' WHEN qtype = 1 THEN 'category_graph' WHEN qtype = 3 THEN 'category_range_graph' ELSE 'split_slices' END AS strategy,
CAST(CASE WHEN scanned THEN NULL WHEN qtype = 0 THEN {AT.ef_none} WHEN qtype = 1 THEN floor({AT.ef_category} + {AT.ef_category_span} * share) WHEN qtype = 3 THEN floor({AT.ef_category} + {AT.ef_both_span} * share) WHEN s < {AT.full_low} THEN {AT.ef_full[0]} WHEN s < {AT.full_high} THEN {AT.ef_full[1]} ELSE {AT.ef_full[2]} END AS INTEGER) AS ef FROM w""",
    "sq8sym_train": f"{FIXTURE}{_RANGES} SELECT round(alpha, 6) AS alpha FROM par",
    "sq8_train": f"{FIXTURE}{_RANGES} SELECT pos, round(low, 6) AS low, round(width, 6) AS width FROM dims",
    "sq4_train": f"{FIXTURE}{_RANGES} SELECT round(low4, 6) AS low, round(width4, 6) AS width FROM par",
    **{f"{q}_encode": f"{_coded(q)} SELECT id, {_CODE_TEXT} AS code FROM cn" for q in _ENCODE},
    "code_square_sums": f"{_coded('sq8sym')} SELECT id, CAST(list_sum([x * x FOR x IN code]) AS BIGINT) AS square_sum FROM cn WHERE list_sum([x * x FOR x IN code]) > 0",
    "sq8sym_knn": f"{_coded_top('sq8sym', CODED_K)} SELECT qid, rank, id, d2 FROM coded",
    "sq8sym_knn_scaled": f"{_coded_top('sq8sym', CODED_K)} SELECT qid, rank, id, round(CAST(d2 AS DOUBLE) * alpha * alpha, 6) AS d2 FROM coded, par",
    **{f"{q}_two_phase": _two_phase(q) for q in _ENCODE},
    "recall_per_query": f"{_EVAL} SELECT qid, qtype, selectivity, hits, expected FROM evaluated",
    "recall_total": f"{_EVAL} SELECT round(sum(hits) / sum(expected), 6) AS recall FROM evaluated",
    "recall_per_type": f"{_EVAL} SELECT qtype, count(*) AS n, round(avg(hits), 9) AS mean_hits, round(avg(selectivity), 9) AS mean_selectivity FROM evaluated GROUP BY qtype",
    "query_stats_by_type": f"{_EVAL} SELECT CAST(ceil(selectivity * 10) AS INTEGER) AS tenth, count(*) AS n, round(avg(hits), 9) AS mean_hits FROM evaluated GROUP BY 1",
    "recall_by_side": f"{_EVAL} SELECT {_SIDE} AS side, count(*) AS n, round(avg(hits), 9) AS mean_hits FROM evaluated GROUP BY 1",
    "selectivity_histogram": f"{FIXTURE}{_SEL} SELECT qtype, {_BIN.replace('selectivity', 's')} AS bin, count(*) AS n FROM sel GROUP BY 1, 2",
    "recall_frequency": f"{_EVAL} SELECT qtype, {_SIDE} AS side, hits, count(*) AS n FROM evaluated GROUP BY 1, 2, 3",
    "recall_ratio_by_selectivity": f"{_EVAL} SELECT {_BIN} AS bin, count(*) AS n, round(avg(CASE WHEN hits >= 7 THEN 1.0::DOUBLE ELSE 0 END), 9) AS share FROM evaluated WHERE qtype = 2 AND selectivity >= 0.05 GROUP BY 1",
    "sort_base_by_category_time": f"{FIXTURE} SELECT id, c, t, CAST(row_number() OVER (PARTITION BY c ORDER BY t, id) AS INTEGER) AS place FROM nodes",
    "sort_base_by_time": f"{FIXTURE} SELECT id, t, {_SLICE} AS slice, CAST(row_number() OVER (PARTITION BY {_SLICE} ORDER BY t, id) AS INTEGER) AS place FROM nodes",
    "sort_base_largest_first": f"{FIXTURE}, top AS (SELECT c AS top FROM nodes GROUP BY c ORDER BY count(*) DESC, c LIMIT 1), x AS (SELECT id, t, c = top AS largest, {_SLICE} AS slice FROM nodes, top) SELECT *, CAST(row_number() OVER (PARTITION BY largest, slice ORDER BY t, id) AS INTEGER) AS place FROM x",
    "sort_queries": f"{FIXTURE} SELECT qid, qtype, v, l, r, CAST(row_number() OVER (PARTITION BY qtype ORDER BY v, l, r, qid) AS INTEGER) AS place FROM queries",
    "centroid": f"{FIXTURE}{_RANGES} SELECT CAST(pos AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 9) AS mean FROM x GROUP BY 1",
    "tombstones": f"{FIXTURE} SELECT id, c FROM nodes WHERE id % 7 <> 0",
    "allow_list": f"{FIXTURE} SELECT id, c FROM nodes WHERE id % 7 = 0",
    "knn_graph": f"{_GRAPH} SELECT * FROM g",
    "graph_reverse": f"{_GRAPH} SELECT src, dst FROM gr",
    "graph_degree_stats": f"{_GRAPH}, d AS (SELECT src, count(*) AS n FROM gr GROUP BY src) SELECT count(*) AS nodes, min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean FROM d",
    "graph_violations": f"{_GRAPH} SELECT (SELECT count(*) FROM gr WHERE src = dst) AS loops, CAST((SELECT count(*) FROM gr) - (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM gr)) AS BIGINT) AS repeated, (SELECT count(*) FROM gr WHERE dst NOT IN (SELECT id FROM nodes)) AS unknown, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT dst FROM gr)) AS unreached",
}
