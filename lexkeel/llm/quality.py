"""Quality rules: a ledger of rule bits and measurements.

``ledger`` measures every text once and sets one bit for each rule that it fails.
A policy is a versioned mask over those bits: ``apply_policy`` decides by one bitwise
AND, so another policy, or the ablation of a rule, never reads a text again.
``ablation`` aggregates the bits: how many rows fail a rule, fail it alone under the policy,
and how many a policy without that rule keeps.

All of it runs in the JVM: there is no Python function on the path, and no
shuffle before ``ablation``'s partial aggregates of a few numbers.

Repeated 3-word windows: 64-bit hashes first prove that most texts have none (distinct
hashes mean distinct windows); only the other texts sort their windows, as text.

Edge cases: a null text has no word, so it fails ``min_words``; an empty or
blank text likewise; windows need three words; repeated rows each get a row; an empty
table gives an empty ledger; input columns are carried as they are, and the ledger's own
names replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Rule names by bit. Bits are never reused: a new rule takes the next one.
RULES = ("min_words", "repeated_windows", "symbol_ratio", "duplicate_lines", "mean_word_length", "few_lines_unique")
BASE = 0b11
#: Versioned policies: the rules whose failure rejects a row.
POLICIES = {1: 0b000011, 2: 0b011111, 3: 0b111111}
POLICY = 2


def repeated_words(w: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the same text."""
    n = F.size(w)
    starts = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda j, d: F.coalesce(F.get(s, j)["t"] == F.get(s, j + d)["t"], F.lit(False))
        hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, 1) | ((j > 0) & same(F.greatest(j, F.lit(1)), -1)))
        return F.sort_array(F.transform(hit, lambda j: F.get(s, j)["i"]))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).alias("end"))
        return F.aggregate(at, zero, step, lambda acc: acc["n"])

    unique = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(n < 3, 0).when(unique, 0).otherwise(let(windows, lambda s: covered(twice(s))))


MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    # The input travels as one struct, so that no name of its columns meets the names of what the measurements use more than once.
    row = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in MEASURED]
    one = docs.select(F.struct(*row).alias("row"), text.alias("text"), words_of(docs["text"]).alias("w"), lines.alias("ls"))
    w, ls = F.col("w"), F.col("ls")
    measured = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.size(F.split("text", SYMBOLS, -1)) - 1).cast("long"),
        "n_lines": F.size(ls).cast("long"),
        "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
        "n_repeat_words": let(w, repeated_words).cast("long"),
    }
    return one.select("row", *[c.alias(n) for n, c in measured.items()]).select("row.*", *MEASURED)


def failures(n_words: Column, word_chars: Column, n_symbols: Column, n_lines: Column, n_dup_lines: Column, n_repeat_words: Column) -> Column:
    """Bits of the rules that fail, in the order of ``RULES``; integers only, so that no rounding decides."""
    fails = [
        n_words < 50,
        100 * n_repeat_words > 50 * n_words,
        100 * n_symbols > 10 * n_words,
        100 * n_dup_lines > 50 * n_lines,
        (word_chars < 2 * n_words) | (word_chars > 14 * n_words),
        100 * n_dup_lines > 30 * n_lines,
    ]
    bits = F.lit(0)
    for i, failed in enumerate(fails):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` plus the measurements and ``failed`` int, a bit for each rule that the row fails."""
    return measure(docs).withColumn("failed", failures(*map(F.col, MEASURED)))


def apply_policy(led: DataFrame, version: int = POLICY) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(led: DataFrame, version: int = POLICY) -> DataFrame:
    """One row for each rule: rows failing it, failing only it, and kept by the policy without it."""
    mask, per = POLICIES[version], []
    bits = F.col("failed").bitwiseAND(F.lit(mask))
    for i, name in enumerate(RULES):
        per += [F.count_if(F.col("failed").bitwiseAND(F.lit(1 << i)) != 0).alias(f"f{i}"), F.count_if(bits == (1 << i) & mask if (1 << i) & mask else F.lit(False)).alias(f"o{i}"), F.count_if(bits.bitwiseAND(F.lit(~(1 << i))) == 0).alias(f"k{i}")]
    sums = led.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bits == 0).alias("kept"), F.bit_or("failed").alias("any_failed"), *per)
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"o{i}").alias("n_failed_alone"), F.col(f"k{i}").alias("n_kept_without")) for i, name in enumerate(RULES)])
    return sums.select(F.lit(version).alias("policy"), "rows", "kept", F.inline(rows))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


OP3_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM p),
d AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM d WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 16 ELSE 0 END
             + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END)::INTEGER AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 31) = 0 AS kept, failed FROM b
"""
