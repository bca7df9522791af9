"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every document gets integer scores per thousand (RULES). Cutoffs are not set by
hand: for each stratum (language), rule and cutoff of a fixed grid, the labelled
good documents that the cutoff would reject are counted, and the cutoff is
certified only if an exact binomial test rejects "it rejects more than the
allowed share of good documents". The tests share one error probability by
Bonferroni's correction, and the rules share one allowed share by the union
bound; so with probability 1 - DELTA the certified rules together reject at most
ALPHA of those good documents of any stratum that pass the base rules, which are
fixed and not part of the guarantee. Of the certified cutoffs the one
that rejects the most labelled bad documents, each good one counting against
GOOD_WEIGHT of them, is taken; of equals the mildest.

All statistics cover all labelled rows; a stratum with too few labels for a
certificate simply has no cutoff.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Allowed share of good documents that a stratum may lose, and the probability that this fails.
ALPHA, DELTA = 0.05, 0.05
GOOD_WEIGHT = 20
#: A score above the cutoff rejects.
CUTOFFS = [10, 20, 30, 50, 80, 120, 200, 300, 450, 600, 800]
#: Rule: numerator and denominator of its score, floored per thousand.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capital_pairs", "word_chars"),
    "marks": ("n_mark_pairs", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


def _bits(n: Column) -> Column:
    """Bits for a position below n; the other bits of a long are the hash's."""
    return F.ceil(F.log2((n + 1).cast("double"))).cast("int")


def _packed_windows(word_list: Column, n: Column, bits: Column) -> Column:
    """Hashes of the 3-word windows, packed with their positions and sorted: n log n for any text."""
    rest = lambda k: F.slice(word_list, F.lit(k), F.greatest(n - k + 1, F.lit(0)))
    pairs = F.zip_with(word_list, rest(2), lambda a, b: F.xxhash64(a, b))
    windows = F.slice(F.zip_with(pairs, rest(3), lambda h, c: F.xxhash64(h, c)), F.lit(1), F.greatest(n - 2, F.lit(0)))
    return F.sort_array(F.transform(windows, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))))


def _twins(packed: Column, bits: Column) -> Column:
    """From sorted (hash, position) numbers: the positions of the windows whose bits of hash occur twice."""
    high = lambda x: F.call_function("shiftrightunsigned", x, bits)
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return F.array_distinct(F.flatten(_neighbours(packed, lambda a, b: F.when(high(a) == high(b), F.array(a.bitwiseAND(low), b.bitwiseAND(low))))))


def _neighbours(values: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """What `pair` gives for each value and the next, without nulls."""
    m = F.greatest(F.size(values) - 1, F.lit(0))
    return F.filter(F.zip_with(F.slice(values, F.lit(1), m), F.slice(values, F.lit(2), m), pair), lambda x: x.isNotNull())


def _spelled(word_list: Column, at: Column) -> Column:
    """The windows at these positions as (their words, position), sorted: few hash bits decide where to look, the words what is equal."""
    return F.array_sort(F.transform(at, lambda p: F.struct(F.concat_ws(" ", *[F.get(word_list, (p + k).cast("int")) for k in range(3)]).alias("w"), p.alias("p"))))


def _covered(spelled: Column) -> Column:
    """How many words lie in windows whose words occur twice."""
    at = F.array_distinct(F.flatten(_neighbours(spelled, lambda a, b: F.when(a["w"] == b["w"], F.array(a["p"], b["p"])))))
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2))))).cast("long")


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the counts that the rules use, of every whole text; a null text has no words and no lines."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    split = docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text")).withColumn("_words", words(F.col("_text")))
    lines = split.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))).withColumn("_n", F.size("_words")).withColumn("_bits", _bits(F.col("_n")))
    counted = lines.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}{2}")).cast("long").alias("n_capital_pairs"),
        F.regexp_count(text, F.lit("!!")).cast("long").alias("n_mark_pairs"),
        "_words",
        "_bits",
        _packed_windows(F.col("_words"), F.col("_n"), F.col("_bits")).alias("_packed"),
    )
    found = counted.withColumn("_at", _twins(F.col("_packed"), F.col("_bits"))).drop("_packed", "_bits")
    return found.withColumn("_spelled", _spelled(F.col("_words"), F.col("_at"))).drop("_words", "_at").withColumn("n_repeat_words", _covered(F.col("_spelled"))).drop("_spelled")


def scores() -> dict[str, Column]:
    """Each rule's score from the columns of features(); 0 where there is nothing to count."""
    return {k: F.when(F.col(d) > 0, F.floor(F.lit(1000).cast("long") * F.col(n) / F.col(d))).otherwise(F.lit(0)).cast("long") for k, (n, d) in RULES.items()}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X of Bin(n, p), exact; 1.0 where k >= n p, which never certifies."""
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))
    step = lambda s, j: F.struct((s["t"] + F.log((n - j + 1) / j) + F.lit(odds)).alias("t"), (s["sum"] + F.exp(s["t"] + F.log((n - j + 1) / j) + F.lit(odds))).alias("sum"))
    js = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(js, F.struct(first.cast("double").alias("t"), F.exp(first).alias("sum")), step, lambda s: s["sum"])
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(total)


def calibrate(featured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The chosen cutoff of each (lang, rule), from documents' features with doc_id and lang, and labels (doc_id, quality).

    A document with several labels is good if any of them says so; null doc_ids
    and null labels say nothing; null lang is the stratum ''. No row where no
    cutoff is certified.
    """
    says = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    exceeded = lambda s: reduce(add, [(s > c).cast("int") for c in CUTOFFS])
    per_rule = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), exceeded(s).alias("bucket")) for k, s in scores().items()])).alias("r")
    held = featured.withColumn("lang", F.coalesce("lang", F.lit(""))).join(says, "doc_id").where(~base_failed()).select("lang", "quality", per_rule)
    counts = held.groupBy("lang", "r.rule", "r.bucket").agg(F.sum(F.when(F.col("quality") >= 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") < 1, 1).otherwise(0)).alias("bad"))
    at = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(CUTOFFS) - 1))))
    over = lambda c: F.sum(F.when(F.col("bucket") > F.col("i"), F.col(c)).otherwise(0)).alias(f"{c}_lost")
    tests = at.groupBy("lang", "rule", "i").agg(F.sum("good").alias("n"), over("good"), over("bad"))
    strata = tests.agg(F.countDistinct("lang").alias("strata"))
    p = binomial_tail(F.col("n"), F.col("good_lost"), alpha / len(RULES))
    level = F.lit(delta) / (F.col("strata") * len(RULES) * len(CUTOFFS))
    passed = tests.withColumn("p", p).join(strata, F.lit(True)).where((F.col("p") <= level) & (F.col("bad_lost") > GOOD_WEIGHT * F.col("good_lost")))
    best = F.max_by("i", F.struct((F.col("bad_lost") - GOOD_WEIGHT * F.col("good_lost")).alias("gain"), F.col("i")))
    return passed.groupBy("lang", "rule").agg(best.alias("i")).select("lang", "rule", F.get(F.array(*map(F.lit, CUTOFFS)), F.col("i")).alias("cutoff"))


def judge(featured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add base_failed, kept and failed_rules (the certified rules that reject, sorted)."""
    by_lang = cutoffs.groupBy(F.col("lang").alias("_lang")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    joined = featured.join(by_lang, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left")
    failed = F.array_sort(F.filter(F.array(*[F.when(s > F.col("_cutoffs")[k], F.lit(k)) for k, s in scores().items()]), lambda x: x.isNotNull()))
    out = joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.coalesce(failed, F.array().cast("array<string>")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_lang", "_cutoffs")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on every document.

    A null text has no words and fails; a very long one is sorted in n log n like
    any other; repeated rows are judged one by one; an empty table gives none; no
    labels at all leave the base rules alone; further columns are ignored.
    """
    featured = written(features(docs, ["doc_id", "lang"]), "quality")
    out = judge(featured, calibrate(featured, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns, whatever their names. Texts are read once: the features are stored beside them.

    Rows with a null text, empty ones included, fail the base rules and go; repeated
    rows stay or go together; an empty table stays empty; without labels the base
    rules decide alone.
    """
    own = docs.columns
    held = docs.select(F.struct(*own).alias("_row"), "doc_id", "lang", "text")
    featured = written(features(held, ["_row", "doc_id", "lang"]), "quality")
    return judge(featured, calibrate(featured.drop("_row"), labels)).where("kept").select("_row.*")


def _sql() -> str:
    score = lambda k: f"CASE WHEN {RULES[k][1]} > 0 THEN CAST(floor(1000 * {RULES[k][0]} / {RULES[k][1]}) AS BIGINT) ELSE 0 END"
    p = ALPHA / len(RULES)
    union = " UNION ALL ".join(f"SELECT doc_id, lang, base_failed, '{k}' AS rule, {score(k)} AS score FROM f" for k in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
  list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^ \t-\r]')) AS l FROM documents),
win AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS t
  FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win WHERE t IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
f0 AS (SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(regexp_extract_all(text, '\p{{Lu}}{{2}}')) AS BIGINT) AS n_capital_pairs,
  CAST(len(regexp_extract_all(text, '!!')) AS BIGINT) AS n_mark_pairs,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f0),
s AS ({union}),
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
t AS (SELECT lang, rule, cutoff, count(*) FILTER (quality >= 1) AS n,
  count(*) FILTER (quality >= 1 AND score > cutoff) AS k, count(*) FILTER (quality < 1 AND score > cutoff) AS b
  FROM s JOIN q USING (doc_id), (SELECT unnest({CUTOFFS}) AS cutoff) WHERE NOT base_failed GROUP BY ALL),
c AS (SELECT *, CASE WHEN k >= n * {p} THEN 1.0 ELSE
  list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})) FOR j IN range(0, k + 1)]) END AS p FROM t),
best AS (SELECT lang, rule, max_by(cutoff, (b - {GOOD_WEIGHT} * k) * 10000 + cutoff) AS cutoff FROM c
  WHERE p <= {DELTA} / ((SELECT count(DISTINCT lang) FROM t) * {len(RULES)} * {len(CUTOFFS)}) AND b > {GOOD_WEIGHT} * k GROUP BY lang, rule),
bad AS (SELECT doc_id, string_agg(rule, ',' ORDER BY rule) AS failed FROM s JOIN best USING (lang, rule) WHERE score > cutoff GROUP BY doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed_rules
FROM f LEFT JOIN bad ON f.doc_id = bad.doc_id
"""


OP3_SQL = _sql()
