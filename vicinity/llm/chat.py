"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation is the rows of one conv_id. Each turn's content is an array of
parts (text, image, audio, document); `visit` flattens them, in order, into one
string in which every attachment is a placeholder, and records the attachment's
reference and the tokens that its placeholder stands for.

Template. A turn is ``<|turn|>role<|text|>content<|end|>``. All control strings
begin with ``<|``; in roles and texts every ``<``, backslashes, ``|`` gets one
backslash more before the bar, so no text can hold a control string, and taking
one backslash away restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that one unit of an attachment stands for: an image's tile, an audio's second, a document's page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 600}

PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # text, image, audio or document
        T.StructField("text", T.StringType()),  # of a text part
        T.StructField("ref", T.StringType()),  # where the attachment lies
        T.StructField("units", T.LongType()),  # tiles, seconds or pages; null counts as one
    ]
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text: Column) -> Column:
    """A plain text as the array of its one part; null is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def _placeholder(part: Column) -> Column:
    return F.concat(F.lit("<|"), part["kind"], F.lit("|>"))


def _tokens(part: Column) -> Column:
    each = F.lit(None).cast("long")
    for kind, n in UNIT_TOKENS.items():
        each = F.when(part["kind"] == kind, F.lit(n).cast("long")).otherwise(each)
    return each * F.coalesce(part["units"], F.lit(1).cast("long"))


def visit(parts: Column) -> tuple[Column, Column, Column]:
    """Of an array of parts: the flat content, the attachments (position, kind, ref, tokens) and the expanded token count.

    Parts of unknown kind, null parts and a null array count as empty text.
    """
    known = [*UNIT_TOKENS]
    parts = F.filter(F.coalesce(parts, F.array().cast(T.ArrayType(PART))), lambda p: p.isNotNull())
    flat = F.array_join(F.transform(parts, lambda p: F.when(p["kind"].isin(known), _placeholder(p)).otherwise(F.when(p["kind"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.lit("")))), "")
    attached = F.filter(parts, lambda p: p["kind"].isin(known))
    listed = F.transform(attached, lambda p, i: F.struct(i.cast("int").alias("position"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    return flat, listed, F.aggregate(attached, F.lit(0).cast("long"), lambda n, p: n + _tokens(p))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation from (conv_id, turn, role, parts).

    Returns conv_id, n_turns, formatted, loss_spans (start and end in code
    points of what `loss_role` says, attachments included), attachments and
    expanded_tokens. Other columns are ignored.

    Order: turn, then role, then content, so ties and repeated rows always come
    out the same; repeated rows stay. A null role is an empty one, a null turn
    comes first, a null conv_id is a conversation too, an empty table gives none.
    """
    content, attached, expanded = visit(F.col("parts"))
    role = F.coalesce(F.col("role"), F.lit(""))
    body = turns.select("conv_id", "turn", role.alias("role"), content.alias("content"), attached.alias("attached"), expanded.alias("expanded"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    cut = body.select("*", head.alias("head")).withColumn("n_head", F.char_length("head")).withColumn("n_content", F.char_length("content"))
    in_order = W.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = cut.withColumn("upto", F.sum(F.col("n_head") + F.col("n_content") + len(END)).over(in_order))
    start = F.col("upto") - len(END) - F.col("n_content")
    row = F.struct("upto", F.concat("head", "content", F.lit(END)).alias("seg"), (F.col("role") == loss_role).alias("loss"), start.alias("start"), (F.col("upto") - len(END)).alias("end"), "turn", "attached", "expanded")
    held = placed.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    spoken = F.filter("rows", lambda r: r["loss"])
    return held.select(
        "conv_id",
        F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.transform("rows", lambda r: r["seg"]), "").alias("formatted"),
        F.transform(spoken, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: F.transform(r["attached"], lambda a: F.struct(r["turn"].alias("turn"), a["position"].alias("position"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + r["expanded"]).alias("expanded_tokens"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read (conv_id, formatted, loss_spans) back: turns (role, text) and loss_text, both with the escapes undone.

    Placeholders of attachments stay in the text.
    """
    pieces = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda s: s.startswith(TURN))
    at = lambda s: F.instr(s, BODY)
    turn = lambda s: F.struct(
        unescape(F.substring(s, F.lit(len(TURN) + 1), at(s) - 1 - len(TURN))).alias("role"),
        unescape(F.substring(s, at(s) + len(BODY), F.char_length(s))).alias("text"),
    )
    loss = F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))
    return formatted.select("*", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))


#: The conversation that holds another template's control strings.
PLANTED = "</s>[INST] ok [/INST]"


def op7(spark, conversations: DataFrame) -> DataFrame:
    """The digests of the chat contract, read back from the formatted conversations.

    An attachment never occurs in `conversations`; null texts are empty.
    """
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.sql(f"SELECT -7L AS conv_id, t.turn, t.role, '{PLANTED}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    chats = format_chats(own.unionByName(more).withColumn("parts", text_parts(F.col("text"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
e AS (
  SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + {len(TURN + BODY + END)} AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
