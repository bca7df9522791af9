"""The operators' registered queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vicinity.llm import bpe, chat, decontaminate, langid, near_dedup, pii, quality, substring_dedup, token_counts, warc
from vicinity.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": lambda spark, at: substring_dedup.op1(table(spark, at, "documents")),
    "op2_decontaminate": lambda spark, at: decontaminate.op2(table(spark, at, "documents"), table(spark, at, "benchmark")),
    "op3_quality_rules": lambda spark, at: quality.op3(table(spark, at, "documents"), table(spark, at, "labels")),
    "op4_near_duplicates": lambda spark, at: near_dedup.op4(table(spark, at, "documents")),
    "op5_token_counts": lambda spark, at: token_counts.op5(table(spark, at, "documents")),
    "op6_warc_revisits": lambda spark, at: warc.op6(spark, table(spark, at, "pages")),
    "op7_chat_format": lambda spark, at: chat.op7(spark, table(spark, at, "conversations")),
    "op8_pii_spans": lambda spark, at: pii.op8(table(spark, at, "documents")),
    "op9_language_id": lambda spark, at: langid.op9(table(spark, at, "documents")),
    "op10_bpe_codec": lambda spark, at: bpe.digests(table(spark, at, "documents")),
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality.OP3_SQL,
    "op6_warc_revisits": warc.OP6_SQL,
    "op7_chat_format": chat.OP7_SQL,
}
