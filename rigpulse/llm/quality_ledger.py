r"""Quality rules as a ledger of failure bits, built from DataFrame functions only.

``measure`` computes the measurements of each whole text, ``ledger`` evaluates every rule once and keeps one bit per
failed rule beside them. What to do about a failure is a matter of policies: a policy is a versioned mask of the rules
that reject, so verdicts (``apply_policy``) and ablations (``ablations``) need no second look at the texts.

Words are runs of ``[^\x20\x09-\x0D]``. Windows of three words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    failed: str
    base: bool = False


#: The place of a rule is its bit; rules are only ever added at the end.
RULES = (
    Rule("few_words", "n_words < 50", base=True),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words", base=True),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 10 * n_words"),
)


def mask_of(*names: str) -> int:
    places = {rule.name: k for k, rule in enumerate(RULES)}
    return sum(1 << places[name] for name in names)


BASE_MASK = mask_of(*(rule.name for rule in RULES if rule.base))
#: Versions of the policy: the rules that reject.
POLICIES = {1: BASE_MASK, 2: BASE_MASK | mask_of("symbols", "repeated_lines"), 3: mask_of(*(r.name for r in RULES))}
CURRENT = 3


def measure(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the measurements (long) of each row; null and empty texts measure 0 everywhere."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    split = docs.select(
        *(F.col(f"`{c}`") for c in keep), text.alias("_text"),
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\t\n\x0b\f\r", "     ")) != "").alias("_lines"))
    windows = split.select("*", F.expr("""array_sort(transform(slice(_words, 1, greatest(size(_words) - 2, 0)),
        (w, i) -> struct(xxhash64(w, _words[i + 1], _words[i + 2]) AS h, i AS i)))""").alias("_windows"))
    repeated = windows.select("*", F.expr("""array_sort(transform(filter(zip_with(
            _windows, slice(_windows, 2, greatest(size(_windows) - 1, 0)), (a, b) -> struct(a, b, a.h <=> b.h AS same)),
            p -> p.same), p -> p.a.i))""").alias("_first"),
        F.expr("""transform(filter(zip_with(
            _windows, slice(_windows, 2, greatest(size(_windows) - 1, 0)), (a, b) -> struct(a, b, a.h <=> b.h AS same)),
            p -> p.same), p -> p.b.i)""").alias("_second"))
    covered = F.expr("""aggregate(array_sort(array_union(_first, _second)), struct(0 AS e, 0L AS n),
        (s, i) -> struct(i + 3 AS e, s.n + i + 3 - greatest(i, s.e) AS n), s -> s.n)""")
    length = F.char_length("_text")
    return repeated.select(
        *(F.col(f"`{c}`") for c in keep),
        # not deterministic in name only: filters above must not pull the measurements down and evaluate them again
        F.when(F.monotonically_increasing_id() >= 0, F.size("_words").cast("long")).alias("n_words"),
        F.char_length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (length - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"))


def ledger(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the measurements and ``failure_bits`` (long): bit k is set where rule k fails.

    Null and empty texts fail few_words alone. Repeated rows have a row each, nulls in ``keep`` pass through, an empty
    table gives an empty ledger; columns not in ``keep`` are not read, whatever their names.
    """
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits + F.when(F.expr(rule.failed), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return measure(docs, text_column, keep).withColumn("failure_bits", bits)


def apply_policy(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """``entries`` with base_failed and kept: no rule of the policy's mask failed, and no base rule."""
    bits = F.col("failure_bits")
    return entries.select("*", (bits.bitwiseAND(F.lit(BASE_MASK)) != 0).alias("base_failed"),
                          (bits.bitwiseAND(F.lit(POLICIES[version] | BASE_MASK)) == 0).alias("kept"))


def ablations(entries: DataFrame) -> DataFrame:
    """(version, rule, failing, rejected_alone, kept, kept_without): what each rule does in each policy.

    The ledger is first reduced to counts of its distinct bit patterns, at most 2 to the number of rules.
    """
    spark = entries.sparkSession
    patterns = entries.groupBy("failure_bits").agg(F.count("*").alias("docs"))
    rows = [(version, mask, rule.name, 1 << k) for version, mask in POLICIES.items()
            for k, rule in enumerate(RULES) if mask >> k & 1]
    policies = spark.createDataFrame(rows, "version int, mask long, rule string, bit long")
    bits, docs = F.col("failure_bits").bitwiseAND(F.col("mask")), F.col("docs")
    without = F.col("failure_bits").bitwiseAND(F.col("mask").bitwiseXOR(F.col("bit")))
    some = lambda test: F.coalesce(F.sum(F.when(test, docs)), F.lit(0))
    slots = policies.withColumn("failure_bits", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << len(RULES)) - 1).cast("long"))))
    return slots.join(patterns, "failure_bits").groupBy("version", "rule").agg(
        some(bits.bitwiseAND(F.col("bit")) != 0).alias("failing"), some(bits == F.col("bit")).alias("rejected_alone"),
        some(bits == 0).alias("kept"), some(without == 0).alias("kept_without"))


def verdict_sql(version: int = CURRENT) -> str:
    """The ledger and its verdict as SQL over table ``documents``."""
    words = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    lines = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
    bits = " + ".join(f"CASE WHEN {rule.failed} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES))
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {lines} AS lines FROM documents),
l AS (SELECT r, {words} AS words FROM d),
u AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM l),
w AS (SELECT r, i, a, lead(a) OVER t AS b, lead(a, 2) OVER t AS c FROM u WINDOW t AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS c FROM w WHERE c IS NOT NULL),
p AS (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM g WHERE c > 1),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r),
k AS (SELECT r, len(words) AS n_words FROM l),
m AS (SELECT doc_id, n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words FROM d JOIN k USING (r) LEFT JOIN n USING (r)),
b AS (SELECT *, {bits} AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & {BASE_MASK} <> 0 AS base_failed,
  bits & {POLICIES[version] | BASE_MASK} = 0 AS kept, n_lines, CAST(bits AS BIGINT) AS failure_bits,
  CAST({version} AS INTEGER) AS policy_version FROM b"""
