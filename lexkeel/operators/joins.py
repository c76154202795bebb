"""Joins that a checked corpus needs: anti, range, overlap, containment, as-of, theta.

Range predicates run beside an equality wherever there is one, so they hash on it; where only a range
exists, buckets make an equality of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key; of rows with equal order that of the greatest other values (maps aside, they have no order)."""
    values = [c for c in rows.columns if c not in key]
    ranked = [order, *[c for c, kind in rows.dtypes if c in values and c != order and "map<" not in kind]]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*ranked)).alias("v"))
    return best.select(*key, *[F.col(f"v.{c}").alias(c) for c in values])


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of half-open intervals ``[a_start, a_end)`` and ``[b_start, b_end)`` of one key that share a point."""
    return a.join(b, key).where((F.col("a_end") > F.col("b_start")) & (F.col("a_start") < F.col("b_end")))


def contained(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """``points`` (``start``, ``end``) with the first span (``s_start``, ``s_end``, ``s_id``) that holds them; null if none does."""
    found = points.join(spans, [points[key] == spans[key], spans["s_start"] <= points["start"], points["end"] <= spans["s_end"]], "left").drop(spans[key])
    keys = points.columns
    return found.groupBy(*keys).agg(F.min_by("s_id", F.struct("s_start", "s_id")).alias("s_id"))


def outside(points: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Points ``at`` that lie in no half-open range ``[r_start, r_end)`` of their key."""
    return points.join(ranges, [points[key] == ranges[key], ranges["r_start"] <= points["at"], points["at"] < ranges["r_end"]], "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the latest ``right`` row at or before it: one union and one window, no pairs.

    Of right rows at one time the greatest value counts.
    """
    lc = left.columns
    tagged = left.select(*lc, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    other = right.select(*[F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lc], F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    seen = Window.partitionBy(key).orderBy("__at", "__side", F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = tagged.unionByName(other).withColumn(f"asof_{value}", F.last("__v", ignorenulls=True).over(seen))
    return both.where("__side = 1").select(*lc, f"asof_{value}")


def contains_any(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle", shingle: int = 24) -> DataFrame:
    """Pairs of a text and a needle that it holds.

    Instead of trying all pairs, a needle is looked up by characters that a text which holds it must offer, and hits are
    verified by the exact test. The characters are, as the needle allows: ``shingle`` from its first word start behind a
    character of its own, or half as many from there (texts offer these at each word start, and that one is a
    word start in any text); or its first ``shingle`` (texts offer these wherever no word starts within half as many,
    so at most positions of unspaced scripts and at few of others). Needles that are too short for all of
    these are shorter than two shingles: for each of their few lengths texts offer what stands at every position.

    Texts offer only what some needle asks for, and offers meet the needles before anything is shuffled where these are few; a text costs at most a row for each
    of its characters and each length of short needles, of which there are fewer than ``2 * shingle``. The texts themselves join once, to what is left.
    """
    word, other, half = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]", shingle // 2
    own = needles.select(F.col(needle).alias("__n")).where("__n IS NOT NULL AND __n <> ''").distinct()
    whole, part, first = _inner(shingle, word, other), _inner(half, word, other), F.when(F.length("__n") >= shingle, F.substring("__n", 1, shingle))
    keys = own.withColumn("__p", F.coalesce(whole, part, first, "__n"))
    way = F.when(whole.isNotNull(), "whole").when(part.isNotNull(), "part").when(first.isNotNull(), "first").otherwise(F.length("__n").cast("string"))
    asked = {r[0] for r in own.select(way.alias("way")).distinct().collect()}  # three ways and the lengths of short needles
    spaced = F.concat(F.lit(" "), F.col(text))
    at_words = lambda n: F.regexp_extract_all(spaced, F.lit(rf"(?s)(?<!{word})(?=({word}.{{{n - 1}}}))"), F.lit(1))
    offers = {"whole": lambda: at_words(shingle), "part": lambda: at_words(half), "first": lambda: F.regexp_extract_all(spaced, F.lit(rf"(?s)(?!.{{0,{half - 1}}}?{other}{word})(?=(.{{{shingle}}}))"), F.lit(1))}
    every = [offers[k]() for k in offers if k in asked] + [F.regexp_extract_all(F.col(text), F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sorted(int(w) for w in asked if w.isdigit())]
    found = texts.limit(0).withColumn("__n", F.lit(""))
    if every:
        posts = texts.select(F.xxhash64(text).alias("__h"), F.explode(F.array_distinct(F.concat(*every))).alias("__p"))
        pairs = posts.join(keys, "__p").select("__h", "__n").distinct()
        found = texts.withColumn("__h", F.xxhash64(text)).join(pairs, "__h").where(F.contains(F.col(text), F.col("__n"))).drop("__h")
    # The empty needle is in every text.
    found = found.unionByName(texts.where(F.col(text).isNotNull()).withColumn("__n", F.lit("")))
    return found.join(needles, F.col("__n") == F.col(needle)).select(*texts.columns, *needles.columns)


def _inner(size: int, word: str, other: str) -> Column:
    return F.nullif(F.regexp_extract("__n", rf"(?s)^.*?{other}({word}.{{{size - 1}}})", 1), F.lit(""))


#: Patterns of a table that are tried on each text in turn; a larger table is refused.
PATTERNS = 1_000


def first_pattern(texts: DataFrame, patterns: DataFrame, text: Column, key: str) -> DataFrame:
    """The message of the first pattern (``pos``, ``pattern``, ``message``) that a text matches; patterns are a table of at most ``PATTERNS`` rows, tried in their order."""
    rows = patterns.orderBy("pos", "pattern", "message").limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns")
    none = F.lit(None).cast("struct<pos:bigint,message:string>")
    first = F.coalesce(*[F.when(text.rlike(r["pattern"]), F.struct(F.lit(int(r["pos"])).cast("long").alias("pos"), F.lit(r["message"]).alias("message"))) for r in rows], none)
    hit = texts.select(key, first.alias("hit")).where("hit IS NOT NULL")
    return hit.groupBy(key).agg(F.min("hit").alias("hit")).select(key, "hit.message")
