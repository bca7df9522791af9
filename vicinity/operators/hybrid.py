"""Hybrid search: every query by the strategy that its selectivity calls for.

scan                  coded scan of the matching rows, then exact distances
category_graph        the graphs of the query's category
category_range_graph  the same within the time range
slice_graphs          the graphs of all time slices
split_slices          slice by slice: whole slices by graph, large parts by graph
                      with the range, small parts by coded scan
Results of all parts are united, counted once, and ranked by exact distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions.quantize import trained
from vicinity.operators import graph
from vicinity.operators.predicates import interval_split, slice_of
from vicinity.operators.twophase import REFINE, coded_search, refine
from vicinity.plans.planner import Thresholds, strategies
from vicinity.schema import SLICES
from vicinity.sources.shared import stored

#: Candidates that the graph strategies pass on per query.
POOL = 150
_TABLES = ("nodes", "categories", "slices", "category_edges", "slice_edges")


class HybridIndex:
    """Nodes with their category and slice graphs, and the scale of their codes."""

    def __init__(self, tables: dict[str, DataFrame], alpha: float | None, at: Thresholds = Thresholds(), m: int = graph.M, candidates: int = graph.CANDIDATES, shard_rows: int = graph.SHARD_ROWS):
        self.nodes, self.categories, self.slices, self.category_edges, self.slice_edges = (tables[x] for x in _TABLES)
        self.tables, self.alpha, self.at, self.m, self.candidates, self.shard_rows = tables, alpha, at, m, candidates, shard_rows

    @classmethod
    def build(cls, nodes: DataFrame, at: Thresholds = Thresholds(), m: int = graph.M, candidates: int = graph.CANDIDATES, shard_rows: int = graph.SHARD_ROWS, store=lambda df, _: df) -> HybridIndex:
        """`store` may write a table and read it again, so that a search does not build."""
        categories, slices = (store(cls.indexed(nodes, kind, at, shard_rows), f"{name}_nodes") for kind, name in (("categories", "category"), ("slices", "slice")))
        edges = [store(graph.build(x, m, candidates), name) for x, name in ((categories, "category_edges"), (slices, "slice_edges"))]
        return cls.of(nodes, categories, slices, *edges, at, m, candidates, shard_rows)

    @staticmethod
    def indexed(nodes: DataFrame, kind: str, at: Thresholds = Thresholds(), shard_rows: int = graph.SHARD_ROWS) -> DataFrame:
        """The nodes with their shards: of the `categories` that have a graph, or of all `slices`."""
        return graph.by_category(nodes, at.index, shard_rows) if kind == "categories" else graph.by_slice(nodes, shard_rows)

    @classmethod
    def of(cls, nodes: DataFrame, categories: DataFrame, slices: DataFrame, category_edges: DataFrame, slice_edges: DataFrame, at: Thresholds = Thresholds(), m: int = graph.M, candidates: int = graph.CANDIDATES, shard_rows: int = graph.SHARD_ROWS) -> HybridIndex:
        """The index of tables that are there already."""
        return cls(dict(zip(_TABLES, (nodes, categories, slices, category_edges, slice_edges), strict=True)), trained(nodes, "sq8sym")[0], at, m, candidates, shard_rows)

    def save(self, path: str) -> None:
        """Write all tables below `path`, and how the index was made, so that load() gives an equal one."""
        for name, df in self.tables.items():
            df.write.parquet(f"{path}/{name}")
        how = self.nodes.sparkSession.createDataFrame([(self.alpha, self.m, self.candidates, self.shard_rows)], "alpha double, m int, candidates int, shard_rows int")
        how.coalesce(1).write.parquet(f"{path}/how")

    @classmethod
    def load(cls, spark: SparkSession, path: str, at: Thresholds = Thresholds()) -> HybridIndex:
        how = spark.read.parquet(f"{path}/how").first()
        return cls({x: spark.read.parquet(f"{path}/{x}") for x in _TABLES}, how.alpha, at, how.m, how.candidates, how.shard_rows)

    def add(self, new: DataFrame, store=lambda df, _: df) -> HybridIndex:
        """The index with further nodes (their ids not in it yet), linked into the graphs that are there.

        Only shards that get nodes are read and written anew. A key's new nodes go to
        its shards by their ids' hashes; where those are full, a new shard is opened
        for them. Categories that had no graph are scanned as before, until a new
        build lists them; codes keep the scale they have, and what exceeds it is cut.
        """
        tables = {"nodes": store(self.nodes.unionByName(new.select(*self.nodes.columns)), "nodes")}
        for kind, key in (("categories", "c"), ("slices", "slice")):
            edges = "category_edges" if kind == "categories" else "slice_edges"
            old, by = self.tables[kind], new if key == "c" else new.withColumn("slice", slice_of(F.col("t")))
            size = old.groupBy("index_id").agg(F.count(F.lit(1)).alias("_n"))
            kept = size.select(F.split("index_id", ":")[1].cast("int").alias("_key"), F.split("index_id", ":")[2].cast("long").alias("_shard"), "_n").groupBy("_key").agg(F.count(F.lit(1)).alias("_shards"), F.sum("_n").alias("_rows"))
            placed = by.join(F.broadcast(kept), by[key] == kept["_key"])  # a row per indexed category or slice
            shard = F.when(F.col("_rows") < F.col("_shards") * self.shard_rows, F.pmod(F.xxhash64("id"), F.col("_shards"))).otherwise(F.col("_shards"))
            name = F.concat_ws(":", F.lit("c" if key == "c" else "s"), F.col(key).cast("string"), shard.cast("string"))
            added = store(placed.withColumn("index_id", name).select(*old.columns), f"{kind}_added")
            more = graph.extend(old, self.tables[edges], added, self.m, self.candidates)
            rest = self.tables[edges].join(added.select("index_id").distinct(), "index_id", "left_anti")
            tables[kind] = store(old.unionByName(added), kind)
            tables[edges] = store(rest.unionByName(more), edges)
        return HybridIndex({x: tables[x] for x in _TABLES}, self.alpha, self.at, self.m, self.candidates, self.shard_rows)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, rank, id, d2), by (d2, id), of every query that matches anything."""
        plan = strategies(self.nodes, queries, self.at).select("qid", "strategy", "ef", "selectivity")
        asked = stored(queries.join(plan, "qid"), "asked")  # every strategy reads it
        found = [self._scan(asked.where("strategy = 'scan'"), max(k, REFINE)), self._by_category(asked), *self._by_slice(asked)]
        return refine(reduce(DataFrame.unionByName, found), self.nodes, queries, k)

    def _scan(self, asked: DataFrame, k: int) -> DataFrame:
        return coded_search(self.nodes, asked, "sq8sym", k, (self.alpha,)).select("qid", "id")

    def _by_category(self, asked: DataFrame) -> DataFrame:
        shards = self.categories.select(F.col("c").alias("v"), "index_id").distinct()
        both = F.col("strategy") == "category_range_graph"
        to = asked.where("strategy IN ('category_graph', 'category_range_graph')").join(shards, "v").select("index_id", "qid", "qvec", "ef", F.when(both, F.col("l")).alias("low"), F.when(both, F.col("r")).alias("high"))
        return graph.graph_search(self.categories, self.category_edges, to, POOL).select("qid", "id")

    def _by_slice(self, asked: DataFrame) -> list[DataFrame]:
        shards = self.slices.select(slice_of(F.col("t")).alias("slice"), "index_id").distinct()
        everywhere = graph.search_everywhere(self.slices, self.slice_edges, asked.where("strategy = 'slice_graphs'"), POOL)
        ranged = asked.where("strategy = 'split_slices'")
        # one split with each threshold; which of them holds depends on the query's own selectivity
        narrow = interval_split(self.nodes, ranged.where(F.col("selectivity") < self.at.narrow), self.at.split_narrow)
        wide = interval_split(self.nodes, ranged.where(F.col("selectivity") >= self.at.narrow), self.at.split)
        split = stored(narrow.unionByName(wide).join(ranged, "qid"), "split")
        part, s = F.col("class") == "MEDIUM", F.col("selectivity")
        full_ef = F.when(s < self.at.full_low, self.at.ef_full[0]).when(s < self.at.full_high, self.at.ef_full[1]).otherwise(self.at.ef_full[2])
        part_ef = F.when(s <= self.at.full_low, self.at.ef_part[0]).when(s <= self.at.full_high, self.at.ef_part[1]).otherwise(self.at.ef_part[2])
        graphs = split.where("class != 'SMALL'").join(shards, "slice").select("index_id", "qid", "qvec", F.when(part, part_ef).otherwise(full_ef).alias("ef"), F.when(part, F.col("l")).alias("low"), F.when(part, F.col("r")).alias("high"))
        by_graph = graph.graph_search(self.slices, self.slice_edges, graphs, POOL, wider=2)
        # a small part is a range of its own, of which the best by code go on, as from a scan
        last = F.lit(SLICES - 1)
        low = F.when(F.col("slice") == 0, F.col("l")).otherwise(F.greatest("l", F.col("slice") / SLICES))
        high = F.when(F.col("slice") == last, F.col("r")).otherwise(F.least("r", (F.col("slice") + 1) / SLICES))
        small = split.where("class = 'SMALL'").select((F.col("qid") * SLICES + F.col("slice")).alias("qid"), F.lit(2).alias("qtype"), "v", low.alias("l"), high.alias("r"), "qvec")
        scanned = self._scan(small, REFINE).select(F.expr(f"qid div {SLICES}").alias("qid"), "id")
        return [everywhere.select("qid", "id"), by_graph.select("qid", "id"), scanned]
