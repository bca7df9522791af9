"""Two-phase search: the best by codes, then exact distances of those."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions.quantize import encoded, trained
from vicinity.functions.vector import l2sq
from vicinity.operators.knn import K, search, top

#: Candidates that go into the second phase.
REFINE = 140


def coded_search(nodes: DataFrame, queries: DataFrame, quantizer: str = "sq8sym", k: int = REFINE, parameters: tuple | None = None) -> DataFrame:
    """(qid, rank, id, d2) with distances between codes; nodes and queries are coded with what the nodes teach, or with `parameters`.

    Codes are searched like vectors, by scans of the nodes; their distances are whole numbers and exact.
    """
    known = trained(nodes, quantizer) if parameters is None else parameters
    coded = encoded(nodes, quantizer, known=known).select("id", "c", "t", F.col("code").alias("vec"))
    asked = encoded(queries, quantizer, "qvec", known=known).drop("qvec").withColumnRenamed("code", "qvec")
    found = search(coded, asked, k)
    return found if quantizer == "fp32" else found.withColumn("d2", F.col("d2").cast("long"))


def scaled(found: DataFrame, alpha: float) -> DataFrame:
    """Distances between sq8sym codes in the vectors' scale, but for the codes' own: times alpha squared."""
    return found.withColumn("d2", F.col("d2").cast("double") * F.lit(alpha) * F.lit(alpha))


def refine(candidates: DataFrame, nodes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Exact distances of candidates (qid, id), each counted once, and the k best."""
    pairs = candidates.select("qid", "id").distinct().join(nodes.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
    return top(pairs.select("qid", "id", l2sq(F.col("vec"), F.col("qvec")).alias("d2")), k).select("qid", "rank", "id", "d2")


def two_phase(nodes: DataFrame, queries: DataFrame, quantizer: str = "sq8sym", k: int = K, refine_k: int = REFINE, parameters: tuple | None = None) -> DataFrame:
    return refine(coded_search(nodes, queries, quantizer, refine_k, parameters), nodes, queries, k)
