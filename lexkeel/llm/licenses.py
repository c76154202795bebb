"""License scans by diagonal voting.

One pass over the texts yields all rolling ``K``-word runs, and the plain license phrases of each text beside them. The runs are joined by
hash with the positions of the templates' own (a table of a few hundred rows whose size is fixed by ``TEMPLATES``, hence broadcast) and
verified word for word there (a run's words are spelt out only where its hash is a template's). A hit votes for a diagonal: its word position less its
template position. Votes are gathered by (document, template, diagonal), neighbouring diagonals (an inserted or missing
word shifts them by one) are merged, and a merged span is accepted by the share of the template's words that it covers.

What is left behind the join is a row for each text and each hit; these are dealt by document once.

Edge cases: a null or empty text has no word and no label; texts shorter than ``K`` words can only hold phrases; repeated rows
each get a row and the same labels (votes are sets of positions); rows sharing an id with different texts are told apart by
a hash of the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, table

K = 4
#: Diagonals at most so far apart belong together.
SLACK = 3
#: A span is a notice if it covers this share of its template, or this many words of a longer one.
SHARE, WORDS = 0.75, 24
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels, and the notices that the labels' licenses ask for or that are in common use.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def license_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def runs(w: Column, known: list[int] | None = None, k: int = K) -> Column:
    """All runs of ``k`` words as structs of ``pos``, their hash ``gram`` and, where that is one of ``known`` (or any), their words ``run``."""
    said = lambda i: F.concat_ws(" ", *[F.get(w, i + d) for d in range(k)])
    spelt = lambda i, g: said(i) if known is None else F.when(g.isin(known), said(i))
    run = lambda i: let(F.xxhash64(*[F.get(w, i + d) for d in range(k)]), lambda g: F.struct(i.alias("pos"), g.alias("gram"), spelt(i, g).alias("run")))
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), run)).otherwise(F.array().cast("array<struct<pos:int,gram:bigint,run:string>>"))


def template_grams(templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> list[int]:
    """The hashes of the templates' runs, as Spark's ``xxhash64`` of ``k`` words has them: each word's XXH64, seeded by that before."""
    out = set()
    for _, text in templates:
        w = [x for x in re.split(BREAK, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
        for i in range(len(w) - k + 1):
            h = 42
            for x in w[i : i + k]:
                h = xxhash.xxh64_intdigest(x.encode(), h)
            out.add(h - (1 << 64) if h >> 63 else h)
    return sorted(out)


def template_positions(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """``gram``, ``run``, ``template`` number, ``label``, ``at`` and the template's word count."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    rows = rows.withColumn("w", license_words(F.col("text")))
    return rows.select("template", "label", F.size("w").alias("words"), F.explode(runs(F.col("w"), None, k)).alias("r")).select("template", "label", "words", F.col("r.pos").alias("at"), "r.run", "r.gram")


PLACES = "array<struct<at:bigint,label:string>>"


def places(w: Column) -> Column:
    """Word positions and labels of the plain phrases."""

    def of(phrase: str, label: str) -> Column:
        words = list(enumerate(phrase.split()))
        here = lambda i: F.forall(F.array(*[F.coalesce(F.get(w, i + d) == F.lit(x), F.lit(False)) for d, x in words]), lambda ok: ok)
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - 1), here), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    return F.when(F.array_contains(w, "license"), F.concat(*[of(p, label) for p, label in PHRASES.items()])).otherwise(F.array().cast(PLACES))


def hits(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """``doc_id`` and ``text_hash`` with, for each row of ``docs``, one row of ``n_words`` and ``places`` and no template, and one row for each verified run of a template."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), license_words(F.col("text")).alias("w"))
    w = F.col("w")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n_words", "long"), ("places", PLACES))]
    own = F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("gram"), F.lit("").alias("run"), F.size(w).cast("long").alias("n_words"), places(w).alias("places"))
    # Only runs whose hash a template has become rows.
    known_runs = F.filter(runs(w, template_grams(templates, k), k), lambda r: r["run"].isNotNull())
    each = F.transform(known_runs, lambda r: F.struct(r["pos"].alias("pos"), r["gram"].alias("gram"), r["run"].alias("run"), *none))
    rolled = keyed.select("doc_id", "text_hash", F.explode(F.concat(F.array(own), each)).alias("x")).select("doc_id", "text_hash", "x.*")
    known = template_positions(docs.sparkSession, templates, k)
    return rolled.join(F.broadcast(known), ["gram", "run"], "left").where((F.col("pos") < 0) | F.col("template").isNotNull()).drop("gram", "run")


def merged(found: DataFrame, k: int = K) -> DataFrame:
    """Of ``hits``: spans with ``first_word``, ``end_word``, the template's words covered, ``n``, and their ``share``; the rows without a template have ``copies``, ``n_words`` and ``places``."""
    key = ["doc_id", "text_hash", "template", "label", "words"]
    dealt = found.repartition("doc_id", "text_hash")
    # A diagonal holds at most one hit for each template position, so its set is bounded by the template.
    votes = dealt.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"), F.count("n_words").alias("copies"), F.first("n_words", True).alias("n_words"), F.first("places", True).alias("places"))
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    votes = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -(2**30)).over(order) > SLACK).cast("int"))
    votes = votes.withColumn("span", F.sum("new").over(order)).drop("new")
    # Each merged span counts a template word once, however many diagonals it is on.
    covered = votes.withColumn("a", F.explode_outer("at")).withColumn("t", F.explode_outer(F.sequence(F.col("a"), F.col("a") + k - 1)))
    some = [F.max("copies").alias("copies"), F.first("n_words", True).alias("n_words"), F.first("places", True).alias("places")]
    words = covered.groupBy(*key, "span", "t").agg(F.min(F.col("diagonal") + F.col("t")).alias("lo"), F.max(F.col("diagonal") + F.col("t")).alias("hi"), *some)
    spans = words.groupBy(*key, "span").agg(F.count("t").alias("n"), F.min("lo").alias("first_word"), (F.max("hi") + 1).alias("end_word"), *some)
    return spans.withColumn("share", F.col("n") / F.col("words"))


ACCEPTED = f"template IS NOT NULL AND (share >= {SHARE} OR n >= {WORDS})"


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """Verified spans: ``doc_id``, ``text_hash``, ``label``, ``template``, ``first_word``, ``end_word`` and ``share`` of the template's words."""
    return merged(hits(docs, templates, k), k).where(ACCEPTED).select("doc_id", "text_hash", "label", "template", "first_word", "end_word", "share")


def labelled(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``text_hash``, ``n_words``, ``places``, the labels ``found`` and the best ``share``."""
    own = F.expr(ACCEPTED)
    both = merged(hits(docs, templates, k), k).groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies"), F.first("n_words", True).alias("n_words"), F.first("places", True).alias("places"), F.collect_set(F.when(own, F.col("label"))).alias("found"), F.max(F.when(own, F.col("share"))).alias("share"))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = labelled(docs)
    labels = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["at"])
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    n = F.size("places").cast("long")
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(n > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        join(labels).alias("base_labels"), join(F.concat(labels, "found")).alias("labels"), score.alias("score"),
    )
