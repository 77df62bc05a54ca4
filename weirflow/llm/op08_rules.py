"""Quality rules as a ledger of bits.

`ledger` evaluates every rule once for every document and stores two things:
the measurements and one long whose bit k says that rule k failed. Policies are
versioned sets of rules over that ledger, so a new policy, or the effect of
leaving one rule out, needs no second look at the text: `apply_policy` is a
mask on the bits and `ablation` an aggregation over them.

DataFrame functions only. A document is one row throughout; nothing shuffles.

Defined results: a null text has no words, lines or symbols and fails the rule
on the number of words; repeated rows are judged one by one; extra columns of
the input stay out of the ledger unless named.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

SYMBOLS = "#*$%&|<>"
#: Words of a window, as `_windows` builds them.
WINDOW = 8

#: Rule k fails if its expression over the measurements is true. Bits never change their meaning: new rules are appended.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "10 * n_symbols > n_words * 5"),
    ("repeated_lines", "n_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    ("odd_word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)"),
    ("giant_word", "max_word_chars > 400"),
    ("too_many_words", "n_words > 1000000"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force."""

    version: str
    rules: tuple[str, ...] = field(default_factory=tuple)

    @property
    def mask(self) -> int:
        return sum(BIT[x] for x in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("v1", ("too_few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "odd_word_length")),
    Policy("v2", ("too_few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "odd_word_length", "giant_word")),
)
CURRENT = POLICIES[-1]


def measurements(docs: DataFrame, text: str = "text", with_columns=("doc_id",)) -> DataFrame:
    """The named columns and the measurements, one row a document."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(*[F.col(f"`{c}`") for c in with_columns], t.alias("__text"))
    words = base.withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    words = _windows(words.withColumn("__joined", F.array_join("__words", "")))
    # Where no two windows are alike, as in most texts, nothing is sorted. Each step is a column of its own:
    # a column that is used twice is computed once, an expression twice.
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    words = words.withColumn("__placed", F.when(repeats, placed)).withColumn("__covered", F.coalesce(_covered(F.col("__placed")), F.lit(0)))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return words.withColumn("__lines", lines).select(
        *[F.col(f"`{c}`") for c in with_columns],
        F.size("__words").cast("bigint").alias("n_words"),
        F.length("__joined").cast("bigint").alias("word_chars"),
        F.regexp_count("__joined", F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.col("__covered").cast("bigint").alias("n_repeat_words"),
        F.coalesce(F.array_max(F.transform("__words", F.length)), F.lit(0)).cast("bigint").alias("max_word_chars"),
    )


def _windows(words: DataFrame) -> DataFrame:
    """__h, a hash for each window of 8 words: hashes of 1, 2, 4 and 8 words, each of two of the former."""
    words = words.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    for span in (1, 2, 4):
        # zip_with pads the shorter side with nulls; the sizes are made equal, so no null takes part.
        n = F.greatest(F.size("__h") - span, F.lit(0))
        words = words.withColumn("__h", F.zip_with(F.slice("__h", 1, n), F.slice("__h", 1 + span, n), lambda a, b: F.xxhash64(a, b)))
    return words


def _covered(placed: Column) -> Column:
    """Words inside windows that occur twice or more, from windows sorted as
    (hash, position). Positions of windows equal to a neighbour are kept;
    consecutive positions p < q cover min(q - p, window) words. Null in, null
    out: texts that repeat no window are told by the number of distinct hashes
    and are never sorted."""
    n = F.size(placed)
    none = F.array(F.lit(None).cast("bigint"))
    before = F.concat(none, F.slice(placed["h"], 1, n - 1))
    after = F.concat(F.slice(placed["h"], 2, n - 1), none)
    near = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    kept = F.zip_with(placed, near, lambda x, y: F.when(x["h"].eqNullSafe(y["b"]) | x["h"].eqNullSafe(y["a"]), x["p"]))
    at = F.sort_array(F.filter(kept, lambda p: p.isNotNull()))
    end = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["sum"] + F.least(p - a["last"], F.lit(WINDOW))).alias("sum"), p.alias("last"))
    return F.aggregate(at, end, step, lambda a: a["sum"])


def ledger(docs: DataFrame, text: str = "text", with_columns=("doc_id",)) -> DataFrame:
    """Measurements and failure_bits: every rule evaluated once."""
    m = measurements(docs, text, with_columns)
    bits = F.lit(0).cast("bigint")
    for k, (_, rule) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return m.withColumn("failure_bits", bits)


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the policy's version, its failures and its verdict."""
    hit = F.col("failure_bits").bitwiseAND(F.lit(policy.mask).cast("bigint"))
    return led.withColumns({"policy": F.lit(policy.version), "policy_failures": hit, "kept": hit == 0})


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """One row a rule of the policy: documents it fails, documents only it fails
    (those that come back without it) and what the policy without it keeps."""
    hit = F.col("failure_bits").bitwiseAND(F.lit(policy.mask).cast("bigint"))
    counts = led.groupBy(hit.alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    total = lambda p: F.coalesce(F.sum(F.when(p, F.col("n"))), F.lit(0)).alias
    rules = F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(BIT[x]).cast("bigint").alias("bit")) for x in policy.rules])
    return (
        counts.select("bits", "n", F.inline(rules))
        .groupBy("rule")
        .agg(total(fails)("failed"), total(alone)("failed_alone"), total((F.col("bits") == 0) | alone)("kept_without"), total(F.col("bits") == 0)("kept"))
    )


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents"))
    base = F.col("failure_bits").bitwiseAND(F.lit(BASE.mask).cast("bigint")) != 0
    return apply_policy(led, CURRENT).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failure_bits"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
starts AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (
    SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM starts) GROUP BY doc_id
),
m AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS longest
    FROM w LEFT JOIN covered USING (doc_id)
),
l AS (
    SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words * 5)::INT
        + 8 * (n_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::INT
        + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words))::INT
        + 32 * (longest > 400)::INT + 64 * (n_words > 1000000)::INT AS BIGINT) AS failure_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 AS base_failed, failure_bits & 63 = 0 AS kept, failure_bits FROM l
"""
