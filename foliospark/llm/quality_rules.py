"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once for each whole text: its measurement is kept and
its failure sets one bit of a long. A policy is a version's set of rules, thus a
bit mask; applying one, or comparing what each rule of it removes, reads the
ledger only and never the texts.

DataFrame functions only. Words are split once and bound to a lambda variable,
so that no expression is evaluated again for each word. Windows of five words
are compared by 64-bit hashes; only texts with an equal pair are looked at further.

Defined cases: a null text has no words; repeated rows have a row each; an
empty table gives no rows; other columns are ignored by the ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import table

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Rule -> its failure, over the columns that measured() adds. The place in this dict is the rule's bit, for good.
RULES: dict[str, Column | Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 10,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > 15 * F.col("n_words"),
    "capitals": lambda: 10 * F.col("n_capitals") > 4 * F.col("word_chars"),
    "exclamations": lambda: 10 * F.col("n_exclamations") > 2 * F.col("n_words"),
}

POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
    "v2": tuple(RULES),
}


def mask(rules: Iterable[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(x) for x in rules)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value evaluated once."""
    return F.transform(F.array(value), body).getItem(0)


def repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, each word once."""

    def windows(hashes: Column) -> Column:
        whole = F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))
        return F.transform(whole, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))

    def covered(keys: Column) -> Column:
        def of(rows: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(rows, i)["h"] == x["h"], F.lit(False))
            at = F.array_sort(F.transform(F.filter(rows, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            add = lambda s, p: F.struct((s["n"] + p + WINDOW - F.greatest(p, s["end"])).alias("n"), (p + WINDOW).alias("end"))
            return F.aggregate(at, start, add, lambda s: s["n"])

        rows = F.array_sort(F.transform(keys, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(rows, of))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), covered))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements that the rules read, all longs."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("again")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    values = {
        "n_words": F.col("_w.n"), "word_chars": F.col("_w.chars"), "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)), "n_dup_lines": F.col("_l.again"),
        "n_repeat_words": F.col("_w.again"), "n_lines": F.col("_l.n"), "n_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")), "n_exclamations": F.regexp_count(t, F.lit("!")),
    }
    return docs.withColumns({"_w": of_words, "_l": of_lines}).withColumns({k: v.cast("long") for k, v in values.items()}).drop("_w", "_l")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and failures: bit k is set if the k-th rule failed."""
    rows = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    failures = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        failures = failures.bitwiseOR(F.when(rule(), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.withColumn("failures", failures)


def fails(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with base_failed and kept."""
    return rows.withColumn("base_failed", fails("base")).withColumn("kept", ~fails(policy))


def ablations(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy would keep without it. One pass, one row a rule."""
    own = F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long"))
    total = F.count("*").alias("n")
    sums = [F.struct(F.lit(x).alias("rule"), F.count_if(own.bitwiseAND(F.lit(mask([x])).cast("long")) != 0).alias("failed"), F.count_if(own == mask([x])).alias("failed_alone"), F.count_if(own.bitwiseAND(F.lit(mask(set(POLICIES[policy]) - {x})).cast("long")) == 0).alias("kept_without")) for x in POLICIES[policy]]
    return rows.agg(total, F.array(*sums).alias("rules")).select("n", F.inline("rules"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), g AS (
  SELECT rid, i, w[i : i + 4] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM s WHERE len(w) >= 5)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, range(0, 5) AS o(k) GROUP BY rid
), m AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')))::BIGINT AS n_capitals,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations
  FROM s LEFT JOIN covered c USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
     + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
     + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
     + CASE WHEN 10 * n_capitals > 4 * word_chars THEN 64 ELSE 0 END + CASE WHEN 10 * n_exclamations > 2 * n_words THEN 128 ELSE 0 END)::BIGINT AS failures
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
