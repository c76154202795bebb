"""PII: regular expressions propose spans, checksums confirm them, context words adjust the score.

A kind of data is a pattern, a check of the match and a score. Cards must pass Luhn, IBANs the
ISO 7064 mod-97 test, address parts must be at most 255, phone numbers have 8 to 15 digits. Whole words beside a span, on either side and up to
the next match of its kind, raise or lower its score; ``redact`` leaves spans alone that fall below its threshold. All of it is built-in column
functions; each text is a row on its own, so there is no shuffle and no hot group.

Java's engine backtracks, so patterns are written to take linear time: a run of the
leading class is entered at its first character only (or where the last match ended, ``\\G``), and repetition is possessive
wherever the next character can't belong to it. They match the same spans as the plain forms in ``PLAIN``.

Positions come from the gaps between matches, whose lengths are summed up in two levels (``_running``); context is read from the gaps, and ``redact``
cuts the text out of blocks of a fixed length. So no step walks a text from its start for each span.

Edge cases: a null text has no span and stays null in ``redact``; failing matches are dropped without a retry; overlapping spans of different kinds
all count, and ``redact`` replaces their union once; repeated rows each get a row; an empty table gives an empty result;
input columns are carried as they are, but for one named ``spans``, which ``find`` replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: The contract's patterns, in the order of kinds, and the one that the method adds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
}
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+",
}
KINDS = tuple(PATTERNS)
BASE_KINDS = KINDS[:4]
#: Scores and steps in hundredths.
BASE_SCORE = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 90}
FOR, AGAINST = 10, 20
#: Words beside a span that speak for its kind, and words that speak against any.
CONTEXT = {"email": "mail|email|e-mail|contact|write to", "ip": "ip|address|host|server", "card": "card|visa|credit|payment", "phone": "phone|tel|telephone|call|mobile", "iban": "iban|account|bank"}
DOUBT = "example|sample|version|test"
#: Code points of context on either side, and redaction's threshold.
WINDOW, LEAST = 40, 0.5
#: What may stand before and behind a context word: parts of addresses and domains are no words.
LEFT, RIGHT = r"[^\p{L}\p{N}_.@]", r"[^\p{L}\p{N}_]"
NONE = "array<struct<kind:string,start:int,end:int,score:double>>"
_GROUP, _BLOCK = 64, 4096


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def digit(i: Column) -> Column:  # i counts from the right, from 0
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + digit(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes ISO 7064 mod 97-10."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(iban)), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        part = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda d: (F.length(d) <= 3) & (F.coalesce(d.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return mod97(m) if kind == "iban" else F.lit(True)


def _running(values: Column, op) -> Column:
    """What ``op``, a sum or a maximum of non-negative integers, makes of all values up to each; the array isn't empty."""
    fold = lambda a: F.aggregate(a, F.lit(0), op)
    at = lambda i: F.floor(i / _GROUP).cast("int")

    def of(vs: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), at(F.size(vs) - 1)), lambda g: fold(F.slice(vs, g * _GROUP + 1, F.lit(_GROUP))))
        within = lambda before: F.transform(vs, lambda _, i: op(F.get(before, at(i)), fold(F.slice(vs, at(i) * _GROUP + 1, i % _GROUP + 1))))
        return let(groups, lambda gs: let(F.transform(gs, lambda _, g: fold(F.slice(gs, F.lit(1), g))), within))

    return let(values, of)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def beside(words: str) -> tuple[str, str]:
    """Patterns of whole words before a span and behind one; each needs an edge on the side where the window may cut a word."""
    return f"(?i){LEFT}(?:{words})(?:{RIGHT}|$)", f"(?i)(?:^|{LEFT})(?:{words}){RIGHT}"


def _spans(kind: str, text: Column) -> Column:
    pattern = PATTERNS[kind]

    def place(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))

            def scored(m: Column, i: Column, end: Column) -> Column:
                before = F.right(F.concat(F.lit(" "), F.get(gaps, i)), F.lit(WINDOW + 1))
                after = F.left(F.concat(F.get(gaps, i + 1), F.lit(" ")), F.lit(WINDOW + 1))
                near = lambda words: before.rlike(beside(words)[0]) | after.rlike(beside(words)[1])
                points = F.lit(BASE_SCORE[kind]) + F.when(near(CONTEXT[kind]), FOR).otherwise(0) - F.when(near(DOUBT), AGAINST).otherwise(0)
                return F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), (points / 100.0).alias("score"))

            def all_of(ends: Column) -> Column:
                marked = F.transform(found, lambda m, i: F.when(_valid(kind, m), scored(m, i, F.get(ends, i))))
                return F.filter(marked, lambda s: s.isNotNull())

            return let(lengths, lambda ln: let(_running(ln, _plus), all_of))

        return let(F.split(text, pattern, -1), with_gaps)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), let(found, place)).otherwise(F.array().cast(NONE))


def spans_of(text: Column) -> Column:
    """The spans of a text, by kind as listed and start."""
    return F.concat(*[_spans(k, text) for k in KINDS])


def find(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` plus ``spans``: kind, start, end (code points, end exclusive) and score, by kind as listed and start."""
    return docs.withColumn("spans", spans_of(F.coalesce(F.col(f"`{column}`"), F.lit(""))))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with the union of overlapping spans (sorted, at least one) replaced by the kind of the first."""
    kinds = F.create_map(*[F.lit(x) for k in KINDS for x in (k, f"<{k.upper()}>")])

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / _BLOCK).cast("int"), F.floor((end - 1) / _BLOCK).cast("int")
        head, tail = F.get(blocks, first), F.get(blocks, last)
        several = F.concat(F.substring(head, start % _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), (end - 1) % _BLOCK + 1))
        return F.when(end <= start, F.lit("")).when(first == last, F.substring(head, start % _BLOCK + 1, end - start)).otherwise(several)

    def with_ends(reach: Column) -> Column:
        upto = lambda i: F.when(i == 0, 0).otherwise(F.get(reach, F.greatest(i - 1, F.lit(0))))
        numbered = F.transform(spans, lambda s, i: F.struct(upto(i).alias("from"), s["start"].alias("start"), s["kind"].alias("kind"), i.alias("i")))
        apart = F.filter(numbered, lambda s: (s["i"] == 0) | (s["start"] >= s["from"]))

        def joined(blocks: Column) -> Column:
            parts = F.transform(apart, lambda s: F.concat(cut(blocks, s["from"], s["start"]), F.element_at(kinds, s["kind"])))
            return F.concat(F.array_join(parts, ""), cut(blocks, F.element_at(reach, -1), F.length(text)))

        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), joined)

    return let(_running(F.transform(spans, lambda s: s["end"]), _most), with_ends)


def redact(docs: DataFrame, column: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with every span of at least that score replaced by its kind in angle brackets; of overlapping spans, the union, under the first one's kind."""
    text = F.col(f"`{column}`")
    wanted = F.filter(spans_of(F.coalesce(text, F.lit(""))), lambda s: s["score"] >= least)
    ordered = F.sort_array(F.transform(wanted, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return docs.withColumn(column, let(ordered, lambda spans: F.when(F.size(spans) > 0, let(spans, lambda own: _replaced(text, own))).otherwise(text)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"))


def _found_sql(kind: str) -> str:
    """The valid matches of one kind: row, place of the kind, start, end and score in hundredths."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digits}[-1 - i]::INT WHEN {digits}[-1 - i]::INT > 4 THEN 2 * {digits}[-1 - i]::INT - 9 ELSE 2 * {digits}[-1 - i]::INT END)) % 10 = 0"
    code = lambda c: f"CASE WHEN ascii({c}) < 58 THEN ascii({c}) - 48 ELSE ascii({c}) - 55 END"
    rest = "CASE WHEN y < 10 THEN (x * 10 + y) % 97 ELSE (x * 100 + y) % 97 END"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INT), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"list_reduce(list_concat([0], list_transform(string_split(m[5:] || m[1:4], ''), lambda c: {code('c')})), lambda x, y: {rest}) = 1",
    }[kind]
    near = lambda words: f"regexp_matches(before, '{beside(words)[0]}') OR regexp_matches(after, '{beside(words)[1]}')"
    score = f"{BASE_SCORE[kind]} + CASE WHEN {near(CONTEXT[kind])} THEN {FOR} ELSE 0 END - CASE WHEN {near(DOUBT)} THEN {AGAINST} ELSE 0 END"
    return f"""SELECT r, {KINDS.index(kind)} AS k, '{kind}' AS kind, ends - length(m) AS start, ends, {score} AS score FROM (
    SELECT r, found[i] AS m, list_sum(list_transform(range(1, i + 1), lambda j: length(gaps[j]) + length(found[j]))) AS ends,
           right(' ' || gaps[i], {WINDOW + 1}) AS before, left(gaps[i + 1] || ' ', {WINDOW + 1}) AS after
    FROM (SELECT r, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM (
          SELECT r, regexp_extract_all(text, '{PLAIN[kind]}') AS found, regexp_split_to_array(text, '{PLAIN[kind]}') AS gaps FROM t))) WHERE {valid}"""


OP9_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_found_sql(k) for k in KINDS)}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)},
      string_agg(kind || ':' || start || ':' || ends, ',' ORDER BY k, start) FILTER (k < {len(BASE_KINDS)}) AS base,
      string_agg(kind || ':' || start || ':' || ends, ',' ORDER BY k, start) AS spans, max(score) AS score FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(score, 0)::DOUBLE / 100 AS max_score
FROM t LEFT JOIN g USING (r)
"""
