"""Quality rules as a bitmask ledger.

Every rule runs once per document. Its measurements and one failure bit per rule make up a ledger;
once that is stored, as op1_quality_rules does, a policy is a named, versioned mask over those
bits, and neither changing a policy nor asking what a rule costs reads the text again.

Defined cases: a null or empty text has no words, so it fails ``short``; lines that hold no
word never count as duplicates; rows with the same doc_id are judged one by one; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, map_arrow, read, stored

SYMBOLS = "#*$%&|<>"
#: All bytes but ASCII digits, punctuation and control signs: letters of any script and white space.
_NO_MARKS = bytes(c for c in range(256) if c >= 128 or chr(c).isalpha() or chr(c) in SPACES)
#: Rules in bit order. Never renumber: stored ledgers and policies name bits.
RULES = ("short", "repeats", "symbols", "duplicate_lines", "shouting", "long_words", "no_letters")
#: A policy is a set of rules; versions stay, so a stored verdict can be reproduced.
POLICIES = {
    "base-1": ("short", "repeats"),
    "web-1": ("short", "repeats", "symbols", "duplicate_lines", "shouting", "long_words", "no_letters"),
}
CURRENT = "web-1"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_vowels", "n_capitals", "n_marks")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
_ARROW = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])


def repeat_words(words: list) -> int:
    """Positions that lie in a window of three words which the list holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    covered, upto = 0, 0  # upto: first position that isn't counted yet
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    words = text.encode().split()
    gaps = sum(text.count(c) for c in SPACES)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    capitals = sum(text.count(c) for c in "AEIOU")
    vowels = capitals + sum(text.count(c) for c in "aeiou")
    marks = len(text.encode().translate(None, _NO_MARKS))
    return (len(words), len(text) - gaps, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines), vowels, capitals, marks)


def _measured(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [measure(t) for t in batch.column(1).to_pylist()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEASURES)
    return pa.RecordBatch.from_arrays([pc.cast(batch.column(0), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], schema=_ARROW)


def failures() -> dict:
    """Rule name -> condition over the measurements under which a document fails it."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 100 * F.col("n_symbols") > 10 * n,
        "duplicate_lines": (F.col("n_lines") >= 4) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        "shouting": (F.col("n_vowels") >= 20) & (100 * F.col("n_capitals") > 50 * F.col("n_vowels")),
        "long_words": F.col("word_chars") > 40 * n,
        "no_letters": 2 * F.col("n_marks") > F.col("word_chars"),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``: bit i is set where rule i fails. No shuffle."""
    rows = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), SCHEMA, _measured)
    tests = failures()
    bits = [F.when(tests[r], F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed)


def mask(policy: str = CURRENT) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def verdicts(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept under a policy to a ledger."""
    base = F.col("failed").bitwiseAND(F.lit(mask("base-1"))) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0))


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: how many fail it, and how many would be kept without it.

    One aggregation over the distinct failure masks: at most 2**len(RULES) groups, which
    partial aggregation reduces before the shuffle.
    """
    of = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    counts = rows.groupBy(of.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    each = counts.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored once; verdicts and ablations read its bits. Beside a document's verdict
    stand the rule that alone rejects it, if one does, and how many documents that rule rejects alone."""
    held = stored(ledger(read(spark, sf_dir, "documents")), "ledger")
    rows = verdicts(held)
    cost = ablations(held).select(F.col("rule").alias("sole_rule"), F.col("n_only_this").alias("n_sole"))  # one row per rule
    sole = F.lit(None).cast("string")
    for r in POLICIES[CURRENT]:
        sole = F.when(F.col("failed").bitwiseAND(F.lit(mask())) == 1 << RULES.index(r), F.lit(r)).otherwise(sole)
    rows = rows.withColumn("sole_rule", sole).join(F.broadcast(cost), "sole_rule", "left")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("failed").alias("failed_bits"), "sole_rule", "n_sole")


_CAPITALS = "length(regexp_replace(t, '[^AEIOU]', '', 'g'))"
_VOWELS = "length(regexp_replace(t, '[^AEIOUaeiou]', '', 'g'))"
_MARKS = r"length(regexp_replace(t, '[A-Za-z\x20\x09-\x0D]|[^\x00-\x7F]', '', 'g'))"
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
             len(ls) AS n_lines, {_VOWELS} AS v, {_CAPITALS} AS c, {_MARKS} AS k
      FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
        + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (v >= 20 AND 100 * c > 50 * v)::BIGINT
        + 32 * (word_chars > 40 * n_words)::BIGINT + 64 * (2 * k > word_chars)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits % 4 <> 0 AS base_failed, failed_bits = 0 AS kept,
       CAST(failed_bits AS BIGINT) AS failed_bits, s.rule AS sole_rule, CASE WHEN s.rule IS NOT NULL THEN count(*) OVER (PARTITION BY failed_bits) END AS n_sole
FROM b LEFT JOIN (VALUES {", ".join(f"({1 << i}, '{r}')" for i, r in enumerate(RULES))}) AS s(bit, rule) ON s.bit = failed_bits
"""
