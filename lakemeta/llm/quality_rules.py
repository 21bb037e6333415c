"""Quality rules as a ledger: every rule is evaluated once, failures are kept as bits.

``ledger`` measures each text and sets bit k of ``failures`` where rule k fails. A policy is a mask of
rules under a version number. Once the ledger is saved, applying a policy, comparing several and
computing ablations read its bits and never the texts. Only DataFrame expressions: words, windows and lines
live in arrays of their row, so measuring shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemeta.llm.common import documents, saved

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "[#*$%&|<>]"

#: Name of each rule, in bit order, and the measured condition under which a text fails it.
RULES = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
#: The rules each policy version enforces.
POLICIES = {1: ["few_words", "repeats"], 2: list(RULES)}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(version: int) -> int:
    return sum(bit(rule) for rule in POLICIES[version])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of each text; every step builds on columns of the one before."""
    def shifted(c: str, by: int) -> Column:
        return F.slice(c, by + 1, F.greatest(F.size(c) - by, F.lit(0)))

    def doubled(c: str, by: int) -> Column:
        """Hashes of twice as long runs: each joined with the one ``by`` places on."""
        return F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - by, F.lit(0))), shifted(c, by), lambda a, b: F.xxhash64(a, b))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("trimmed", F.trim("text", F.lit(_SPACES)))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(_SYMBOLS)).cast("bigint").alias("n_symbols"),
                       F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(
                           F.split("trimmed", r"[\x20\x09-\x0D]+")).alias("words"),
                       F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(_SPACES)) != "").alias("lines"))
    rows = rows.select("doc_id", "n_symbols", F.size("words").cast("bigint").alias("n_words"),
                       F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
                       F.size("lines").cast("bigint").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                       F.transform("words", lambda x: F.xxhash64(x)).alias("run1"))
    counts = [c for c in rows.columns if c != "run1"]
    for length in (1, 2, 4):
        rows = rows.select(*counts, doubled(f"run{length}", length).alias(f"run{2 * length}"))
    rows = rows.select(*counts, F.when(F.size(F.array_distinct("run8")) < F.size("run8"), F.sort_array(F.transform(
        "run8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    same = lambda x, j: F.coalesce(x["h"] == F.get("sorted", j)["h"], F.lit(False))
    twins = F.filter("sorted", lambda x, j: same(x, j - 1) | same(x, j + 1))
    rows = rows.select(*counts, F.sort_array(F.transform(twins, lambda x: x["i"])).alias("starts"))
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")), lambda acc, p: F.struct(
        (acc["words"] + 8 - F.greatest(acc["end"] - p, F.lit(0))).alias("words"), (p + 8).alias("end")), lambda acc: acc["words"])
    return rows.select(*counts, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, failures): one row per row of ``docs``, repeated rows included.

    Null and empty texts have no words and fail ``few_words``. Eight-word windows are told apart by 64-bit
    hashes inside their text. Other columns are not read.
    """
    bits = [F.when(F.expr(condition), bit(rule)).otherwise(0) for rule, condition in RULES.items()]
    failures = bits[0]
    for more in bits[1:]:
        failures = failures.bitwiseOR(more)
    return measured(docs, id_col, text_col).withColumn("failures", failures)


def apply_policy(found: DataFrame, version: int) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return found.withColumn("kept", F.col("failures").bitwiseAND(mask(version)) == 0)


def sole_rule(version: int) -> Column:
    """The one rule of the policy that a row fails; null where it fails none or several."""
    bits = F.col("failures").bitwiseAND(mask(version))
    return F.coalesce(*[F.when(bits == bit(rule), rule) for rule in POLICIES[version]])


def ablation(found: DataFrame, version: int) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that fail nothing else, and rows kept without it.

    Rows are first counted by their failure bits, at most 2^rules groups whatever the corpus.
    """
    patterns = found.groupBy(F.col("failures").bitwiseAND(mask(version)).alias("bits")).agg(F.count("*").alias("rows"))
    rules = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(bit(rule)).alias("bit")) for rule in POLICIES[version]]))
    each = patterns.select("bits", "rows", rules.alias("r")).select("bits", "rows", "r.rule", "r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))
    return each.groupBy("rule").agg(total(fails).alias("failed"), total(F.col("bits") == F.col("bit")).alias("failed_alone"),
                                    total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("kept_without"))


def judged(docs: DataFrame, base: int, version: int) -> DataFrame:
    """Each row of the ledger of ``docs`` under two policies and what the ablation says of it.

    ``base_failed`` is the verdict of policy ``base``; ``kept`` asks for both. ``sole_rule`` is the rule that alone
    keeps a row out of policy ``version``, and ``kept_without`` the number of rows that policy would keep if it
    dropped that rule. The ledger is written once; everything else is read from it. An empty table gives no rows.
    """
    found = saved(ledger(docs), "ledger")
    without = ablation(found, version).select(F.col("rule").alias("sole_rule"), "kept_without")
    rows = apply_policy(found, base).withColumnRenamed("kept", "base_kept")
    rows = apply_policy(rows, version).withColumn("sole_rule", sole_rule(version))
    rows = rows.join(F.broadcast(without), "sole_rule", "left")  # a row for each rule of the policy
    return rows.withColumn("base_failed", ~F.col("base_kept")).withColumn("kept", F.col("kept") & F.col("base_kept"))


def op6_quality_rules(spark, sf_dir):
    return judged(documents(spark, sf_dir), 1, 2).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "sole_rule", "kept_without")


OP6_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 7, 0) + 1)) AS i FROM words),
windows AS (SELECT p.doc_id, p.i, array_to_string(w.w[p.i:p.i + 7], ' ') AS window_words
            FROM places p JOIN words w USING (doc_id)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, window_words) AS times FROM windows),
covered AS (SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, i + unnest(range(0, 8)) AS place FROM again WHERE times > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)),
                 lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
measured AS (
    SELECT w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
           len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS n_symbols,
           len(l.l) AS n_lines, len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
    FROM words w JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
bits AS (SELECT *, (n_words < 20)::INT AS few_words, (100 * n_repeat_words > 30 * n_words)::INT AS repeats,
    (10 * n_symbols > 3 * n_words)::INT AS symbols, (2 * n_dup_lines > n_lines)::INT AS duplicate_lines,
    (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT AS word_length FROM measured),
judged AS (SELECT *, few_words + repeats + symbols + duplicate_lines + word_length AS failed FROM bits),
named AS (SELECT *, CASE WHEN failed = 1 THEN CASE WHEN few_words = 1 THEN 'few_words' WHEN repeats = 1 THEN 'repeats'
    WHEN symbols = 1 THEN 'symbols' WHEN duplicate_lines = 1 THEN 'duplicate_lines' ELSE 'word_length' END END AS sole_rule
    FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words + repeats > 0 AS base_failed,
       failed = 0 AS kept, sole_rule, CASE WHEN failed = 1 THEN count(*) OVER (PARTITION BY sole_rule)
         + count(*) FILTER (failed = 0) OVER () END AS kept_without
FROM named
"""
