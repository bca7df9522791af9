"""Personal data by weak supervision, in DataFrame functions only.

1. Loose patterns (KINDS) propose spans in every whole text, with positions.
2. Four labelers vote on each proposal: a strict pattern, a gazetteer, the words
   before it (context) and its shape.
3. Expectation-maximisation over the counts of vote patterns, per kind, gives
   each labeler's reliability and each pattern's probability (two classes, votes
   independent within a class). The counts are at most 16 rows a kind, whatever
   the input, so this part runs on the driver in plain arithmetic.
4. A naive Bayes span classifier is trained on those probabilities as soft
   labels, from counts of (votes, features): at most SPAN_CELLS rows.
5. The classifier's verdict adds spans. Spans of the base patterns (email, ip,
   card, phone) that pass their checks stay in any case.

Patterns are written with possessive quantifiers and starts bound to the start
of a run, so that every text is scanned in linear time.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import written

_RUN = "[A-Za-z0-9._%+-]"
#: Loose pattern of each kind, and a cheap test that a text can hold it.
KINDS = {
    "email": (rf"(?:\G|(?<!{_RUN})){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "secret": (r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+=*+", r"[A-Za-z0-9_+/-]{20}"),
}
BASE = ["email", "ip", "card", "phone"]
#: Words of our own choice that often stand before personal data.
CUES = {
    "email": ["mail", "contact", "write", "reach"],
    "ip": ["ip", "address", "host", "server", "login"],
    "card": ["card", "visa", "mastercard", "account", "pay", "credit"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "contact"],
    "secret": ["token", "secret", "password", "passwd", "key", "bearer", "auth", "credential"],
}
#: The gazetteer of each kind, of our own choice, as a pattern on the span itself (for secrets, on what stands before it).
GAZETTEER = {
    "email": r"\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|127\.|255\.|224\.)[0-9]",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"(?i)(token|secret|passw(or)?d|api[_-]?key|access[_-]?key|private[_-]?key|bearer|auth)\W{0,6}$",
}
SHAPE = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{1,63}@",
    "ip": r"^[1-9][0-9]{0,2}(\.[0-9]{1,3}){3}$",
    "card": r"^([0-9]{16}|[0-9]{4}([ -][0-9]{4}){3})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,4}){2,4}$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z]).*$",
}
STRICT_SECRET = r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?=[^=]*[0-9].*[0-9].*[0-9].*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_+/-]{24,}=*)$"
LABELERS = ["strict", "gazetteer", "context", "shape"]
FEATURES = ["length", "before", "after", "digits"]
#: The most rows that counts of (kind, votes, features) can have.
SPAN_CELLS = len(KINDS) * 2 ** len(LABELERS) * 5 * 5 * 5 * 5
ROUNDS = 50
THRESHOLD = 0.5
_BLOCK = 256


def _luhn(digits: Column) -> Column:
    back = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    each = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def base_valid(kind: str, span: Column) -> Column:
    """Whether a match of the base pattern passes the base check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return span.rlike(rf"^{part}(\.{part}){{3}}$")
    digits = F.regexp_replace(span, r"[^0-9]", "")
    if kind == "card":
        return F.char_length(digits).between(16, 19) & _luhn(digits)
    return F.char_length(digits).between(8, 15)


def _class(char: Column) -> Column:
    """0 none, 1 space, 2 quote, 3 letter or digit, 4 other."""
    return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike("[\"'`]"), 2).when(char.rlike(r"[\p{L}\p{N}]"), 3).otherwise(4)


def _proposals(kind: str, rank: int, text: Column, items: Column) -> Column:
    """From (gap before, span, start): the array of judged proposals of one kind."""

    def judged(x: Column) -> Column:
        span, left, right = x["span"], x["left"], x["right"]
        # a lookup of what stands before: the last 24 characters
        strict = span.rlike(STRICT_SECRET) if kind == "secret" else base_valid(kind, span)
        listed = (left if kind == "secret" else span).rlike(GAZETTEER[kind])
        cue = left.rlike(rf"(?i)\b({'|'.join(CUES[kind])})\w*\W{{0,8}}$")
        shaped = span.rlike(SHAPE[kind])
        n = F.char_length(span)
        share = F.floor(4 * F.char_length(F.regexp_replace(span, "[^0-9]", "")) / n).cast("int")
        return F.struct(
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            x["start"].alias("start"),
            (x["start"] + n).alias("end"),
            F.lit(False).alias("base") if kind == "secret" else strict.alias("base"),
            *[v.cast("int").alias(k) for k, v in zip(LABELERS, (strict, listed, cue, shaped), strict=True)],
            F.when(n < 10, 0).when(n < 16, 1).when(n < 20, 2).when(n < 40, 3).otherwise(4).alias("length"),
            _class(F.substring(left, -1, 1)).alias("before"),
            _class(right).alias("after"),
            share.alias("digits"),
        )

    return F.transform(items, judged)


_ITEM = "array<struct<start:int,left:string,span:string,right:string>>"


def _placed(matches: Column, gaps: Column, m: Column) -> Column:
    """Matches with their starts: a running sum over blocks, each an array of its own until the end, so that a hundred thousand matches in one text stay cheap."""

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(
            F.sequence(b * _BLOCK, F.least(b * _BLOCK + _BLOCK, m) - 1),
            F.struct(acc["at"].alias("at"), F.array().cast(_ITEM).alias("out")),
            lambda a, i: F.struct(
                (a["at"] + F.char_length(F.get(gaps, i)) + F.char_length(F.get(matches, i))).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + F.char_length(F.get(gaps, i))).alias("start"), F.substring(F.get(gaps, i), -24, 24).alias("left"), F.get(matches, i).alias("span"), F.substring(F.get(gaps, i + 1), 1, 1).alias("right")))).alias("out"),
            ),
        )
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    blocks = F.when(m > 0, F.sequence(F.lit(0), F.floor((m - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_ITEM}>").alias("out")), block, lambda a: F.flatten(a["out"]))


def propose(docs: DataFrame) -> DataFrame:
    """The columns of docs and `_found`: the judged proposals of the whole text; none for null.

    Numbers that no labeler could take for personal data (card patterns under 12 digits) and words without a digit are no proposals.
    """
    none = F.array().cast("array<string>")
    out = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for kind, (pattern, hint) in KINDS.items():
        can = F.col("_text").contains(hint) if hint == "@" else F.col("_text").rlike(hint)
        out = out.withColumn(f"_m_{kind}", F.when(can, F.regexp_extract_all("_text", F.lit(pattern), 0)).otherwise(none))
        out = out.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split("_text", pattern, -1)).otherwise(none)).withColumn(f"_n_{kind}", F.size(f"_m_{kind}"))
    lists = []
    for rank, kind in enumerate(KINDS):
        items = _placed(F.col(f"_m_{kind}"), F.col(f"_g_{kind}"), F.col(f"_n_{kind}"))
        if kind == "card":
            items = F.filter(items, lambda x: F.char_length(x["span"]) >= 12)
        if kind == "secret":
            items = F.filter(items, lambda x: x["span"].rlike("[0-9]"))
        lists.append(F.when(F.col(f"_n_{kind}") > 0, _proposals(kind, rank, F.col("_text"), items)))
    empty = F.array().cast(_FOUND)
    return out.select(*docs.columns, F.concat(*[F.coalesce(x, empty) for x in lists]).alias("_found"))


_FOUND = "array<struct<rank:int,kind:string,start:int,end:int,base:boolean," + ",".join(f"{x}:int" for x in LABELERS + FEATURES) + ">>"


def estimate(patterns: list[tuple[str, tuple[int, ...], int]]) -> dict[str, tuple[float, list[tuple[float, float]]]]:
    """EM per kind over (kind, votes, count): the share of true spans, and per labeler P(vote 1 | true) and P(vote 1 | false)."""
    by_kind: dict[str, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for kind, votes, n in sorted(patterns):
        by_kind[kind].append((votes, n))
    model = {}
    for kind, rows in by_kind.items():
        post = [(sum(v) + 0.5) / (len(v) + 1) for v, _ in rows]
        for _ in range(ROUNDS):
            true = sum(p * n for p, (_, n) in zip(post, rows, strict=True))
            false = sum((1 - p) * n for p, (_, n) in zip(post, rows, strict=True))
            share = (true + 1) / (true + false + 2)
            rates = [((sum(p * n for p, (v, n) in zip(post, rows, strict=True) if v[j]) + 2) / (true + 3), (sum((1 - p) * n for p, (v, n) in zip(post, rows, strict=True) if v[j]) + 1) / (false + 3)) for j in range(len(LABELERS))]
            post = [posterior(share, rates, v) for v, _ in rows]
        model[kind] = (share, rates)
    return model


def posterior(share: float, rates: list[tuple[float, float]], votes: tuple[int, ...]) -> float:
    t = math.log(share) + sum(math.log(a if v else 1 - a) for v, (a, _) in zip(votes, rates, strict=True))
    f = math.log(1 - share) + sum(math.log(b if v else 1 - b) for v, (_, b) in zip(votes, rates, strict=True))
    return 1 / (1 + math.exp(min(700.0, f - t)))


def train(cells: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], model: dict) -> dict[str, float]:
    """The span classifier's weights, by "kind", and "kind:name:value" for each vote and feature: log odds from soft counts."""
    names = LABELERS + FEATURES
    total: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
    each: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
    for kind, votes, feats, n in sorted(cells):
        p = posterior(*model[kind], votes)
        total[kind][0] += n * p
        total[kind][1] += n * (1 - p)
        for name, value in zip(names, votes + feats, strict=True):
            each[f"{kind}:{name}:{value}"][0] += n * p
            each[f"{kind}:{name}:{value}"][1] += n * (1 - p)
    weights = {k: math.log(t / f) for k, (t, f) in total.items()}
    for key, (t, f) in each.items():
        T, N = total[key.split(":")[0]]
        weights[key] = math.log((t / (T + 4)) / (f / (N + 4)))
    return weights


def fit(found: DataFrame) -> dict[str, float]:
    """Train on all proposals of a table of propose(). Brings at most SPAN_CELLS counted rows to the driver."""
    cells = found.select(F.explode("_found").alias("x")).groupBy("x.kind", *[f"x.{c}" for c in LABELERS + FEATURES]).count().collect()
    rows = [(r[0], tuple(r[1 : 1 + len(LABELERS)]), tuple(r[1 + len(LABELERS) : -1]), r[-1]) for r in cells]
    patterns: dict[tuple, int] = defaultdict(int)
    for kind, votes, _, n in rows:
        patterns[kind, votes] += n
    return train(rows, estimate([(*k, n) for k, n in patterns.items()]))


def decide(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add `spans`: (kind, start, end, base), by kind as in KINDS, then start."""
    if weights:
        table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])
        weight = lambda key: F.coalesce(F.element_at(table, key), F.lit(0.0))

        def score(x: Column) -> Column:
            total = weight(x["kind"])
            for name in LABELERS + FEATURES:
                total = total + weight(F.concat(x["kind"], F.lit(f":{name}:"), x[name].cast("string")))
            return total

        good = F.filter("_found", lambda x: x["base"] | (score(x) > math.log(THRESHOLD / (1 - THRESHOLD))))
    else:
        good = F.filter("_found", lambda x: x["base"])
    spans = F.transform(F.sort_array(F.transform(good, lambda x: F.struct(x["rank"], x["start"], x["end"], x["kind"], x["base"]))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
    return found.withColumn("spans", F.when(F.size("_found") > 0, spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>"))).drop("_found")


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the spans of every document. Proposals are stored once, for training and for the verdict."""
    found = written(propose(docs).select(*keep, "_found"), "pii")
    return decide(found, fit(found))


def op8(docs: DataFrame) -> DataFrame:
    """Counts and spans per document.

    A null text is empty, a very long one is read whole, repeated rows are answered
    one by one, ties between kinds stand side by side, an empty table gives no
    rows, further columns are ignored.
    """
    out = find(docs.select("doc_id", "text"), ["doc_id"])
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; of overlapping spans the first, then the longer, counts.

    The columns stay, whatever their names; n_chars, if there is one, is counted
    anew. A null text stays null, and a text without spans as it is; repeated rows
    are redacted one by one; an empty table stays empty.
    """
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
    out = find(held, ["_row", "text"])
    by_start = F.sort_array(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    pick = lambda a, x: F.when(x["start"] >= F.coalesce(-F.try_element_at(a, F.lit(-1))["back"], F.lit(0)), F.concat(a, F.array(x))).otherwise(a)
    apart = F.when(F.size("spans") > 1, F.aggregate(by_start, F.array().cast("array<struct<start:int,back:int,kind:string>>"), pick)).otherwise(by_start)
    out = out.withColumn("_apart", apart).withColumn("_m", F.size("_apart"))
    gap_from = lambda i: F.when(i == 0, F.lit(0)).otherwise(-F.get(F.col("_apart"), i - 1)["back"])
    piece = lambda i: F.concat(
        F.substring(F.col("text"), gap_from(i) + 1, F.coalesce(F.get(F.col("_apart"), i)["start"], F.char_length("text")) - gap_from(i)),
        F.coalesce(F.concat(F.lit("<"), F.upper(F.get(F.col("_apart"), i)["kind"]), F.lit(">")), F.lit("")),
    )
    clean = F.when(F.col("_m") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.col("_m")), piece), "")).otherwise(F.col("text"))
    out = out.withColumn("_clean", clean)
    new = {"text": F.col("_clean"), "n_chars": F.char_length("_clean")}
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])
