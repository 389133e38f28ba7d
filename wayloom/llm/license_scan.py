"""License scans by diagonal voting, with DataFrame operations only.

All rolling ``GRAM``-word grams of the texts are joined by hash (and, as the check, by their words)
to the positions they have in license templates. A match at word ``pos`` of a document and ``tpos``
of a template votes for the diagonal ``pos - tpos``: an unbroken copy puts all its votes on one, a
word put in or left out moves the rest to a neighbour. So each diagonal is merged with its neighbours
within a bounded distance of itself, never in a chain, which keeps a span near its template's length
whatever repeats around it. A span is verified if it covers enough of its template within a bounded
length; of spans within that distance of each other the best one stays.

The join's template side is a fixed list of texts (the parameter ``templates``), so it is broadcast:
its size does not depend on the data. Texts are never shuffled, only rows that voted, and one row
for each document.

Defined results: null counts as empty; a text without words has no places, no labels and score 0.
Every input row gives one row, repeated rows and null ids too. A text of any length is one array of
its words; only words that begin a known pair become rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.llm.common import documents, whole
from wayloom.session import stage

# Phrases and labels of the base rule (fixed values).
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Word characters: digits, a-z and everything beyond ASCII; text is lower-cased in A-Z before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals that differ from a span's own by no more than this belong to it; long templates bear
#: one more for every so many words.
MAX_SHIFT = 3
WORDS_PER_SHIFT = 8
#: Least share of a template's words that a verified span covers.
MIN_COVERAGE = 0.75
#: Longest verified span, as a multiple of its template.
MAX_STRETCH = 1.5

#: Notices and leading passages of public licenses, as words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the "
        "license at http www apache org licenses license 2 0",
    ),
    ("gpl", "licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "gnu general public license as published by the free software foundation either version 3 of the "
        "license or at your option any later version",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def words_of(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def grams_of(words: Column) -> Column:
    """The ``GRAM`` words from each place on, fewer at the end; null if there are no words."""
    places = F.sequence(F.lit(1), F.size(words))
    return F.when(F.size(words) > 0, F.transform(places, lambda i: _gram(words, i)))


def _gram(words: Column, place: Column) -> Column:
    return F.array_join(F.slice(words, place, F.lit(GRAM)), " ")


def template_grams(spark: SparkSession, templates) -> DataFrame:
    """``(gram, gram_hash, hits)``: where each full gram stands in the templates."""
    texts = F.array(
        *[F.struct(F.lit(k).alias("template"), F.lit(t).alias("text")) for k, (_, t) in enumerate(templates)]
    )
    listed = spark.range(1).select(F.inline(texts))
    listed = listed.select("template", F.posexplode(grams_of(F.split("text", " "))).alias("tpos", "gram"))
    whole_grams = F.size(F.split("gram", " ")) == GRAM
    grouped = listed.where(whole_grams).groupBy("gram").agg(
        F.collect_list(F.struct("template", "tpos")).alias("hits")
    )
    return grouped.withColumn("gram_hash", F.xxhash64("gram"))


def _candidates(words: Column, templates) -> Column:
    """``(pos, gram)`` of the words with which a phrase or a template's gram can begin.

    Decided by the first two words, so that the other grams are never built.
    """
    pairs = sorted(
        {
            " ".join(known[i : i + 2])
            for known in [p.split() for p, _ in PHRASES] + [t.split() for _, t in templates]
            for i in range(len(known) - 1)
        }
    )
    firsts = sorted({pair.split()[0] for pair in pairs})

    def known(i: Column) -> Column:
        word = F.get(words, i)
        return word.isin(firsts) & F.concat_ws(" ", word, F.get(words, i + 1)).isin(pairs)

    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), known)
    found = F.transform(places, lambda i: F.struct(i.alias("pos"), _gram(words, i + 1).alias("gram")))
    return F.when(F.size(words) > 0, found)


def _places(docs: DataFrame, id_col: str, text_col: str, templates) -> DataFrame:
    """A row for every document (``pos`` -1), and one for every word with a phrase or a vote."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        words_of(whole(text_col)).alias("words"),
    )
    itself = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("gram")))
    found = F.coalesce(F.concat(itself, _candidates(F.col("words"), templates)), itself)
    placed = rows.select("id", "row", F.size("words").alias("n_words"), F.inline(found))
    base = F.lit(None).cast("string")
    for phrase, label in reversed(PHRASES):
        base = F.when((F.col("gram") == phrase) | F.startswith("gram", F.lit(f"{phrase} ")), label).otherwise(base)
    known = F.broadcast(template_grams(docs.sparkSession, templates).withColumnRenamed("gram", "known"))
    found = placed.join(
        known, (F.xxhash64("gram") == F.col("gram_hash")) & (F.col("gram") == F.col("known")), "left"
    ).select("id", "row", "n_words", "pos", base.alias("base"), "hits")
    return found.where(F.expr("pos = -1 OR base IS NOT NULL OR hits IS NOT NULL"))


def reach_of(length: int) -> int:
    """How far the diagonals of one span may lie from its own."""
    return max(MAX_SHIFT, length // WORDS_PER_SHIFT)


def _spans(places: DataFrame, templates) -> DataFrame:
    """Spans by merged diagonals: ``(row, template, label, first, last, coverage, verified)``.

    Around each diagonal the neighbours are taken in at growing distance; the distance that verifies,
    then covers most, then is least, gives the span. Of spans nearer than the template's reach the
    one that is best by the same order stays (then: most votes of its own, smallest diagonal), so a
    verified span yields only to a verified one.
    """
    sizes = [len(text.split()) for _, text in templates]

    def listed(values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("template") + 1)

    votes = places.where(F.col("hits").isNotNull()).select("row", "pos", F.inline("hits"))
    lanes = (
        votes.withColumn("diagonal", F.col("pos") - F.col("tpos"))
        .groupBy("row", "template", "diagonal")
        .agg(
            F.collect_set("tpos").alias("found"),  # no more than the template has words
            F.min("pos").alias("first"),
            F.max("pos").alias("last"),
        )
        .withColumns({"length": listed(sizes), "reach": listed(map(reach_of, sizes))})
    )
    # No more diagonals than twice the longest template's reach and one.
    widest = max(map(reach_of, sizes), default=0)
    around = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-widest, widest)

    def merged(distance: Column) -> Column:
        near = F.filter("near", lambda lane: F.abs(lane["diagonal"] - F.col("diagonal")) <= distance)
        starts = F.flatten(F.transform(near, lambda lane: lane["found"]))
        words = F.flatten(F.transform(starts, lambda t: F.sequence(t, t + GRAM - 1)))
        return F.struct(
            distance.alias("distance"),
            (F.size(F.array_distinct(words)) / F.col("length")).alias("coverage"),
            F.array_min(F.transform(near, lambda lane: lane["first"])).alias("first"),
            (F.array_max(F.transform(near, lambda lane: lane["last"])) + GRAM - 1).alias("last"),
        )

    def judged(span: Column) -> Column:
        within = span["last"] - span["first"] < MAX_STRETCH * F.col("length")
        return F.struct(
            ((span["coverage"] >= MIN_COVERAGE) & within).alias("verified"),
            span["coverage"].alias("coverage"),
            (-span["distance"]).alias("nearness"),
            span["first"].alias("first"),
            span["last"].alias("last"),
        )

    spans = lanes.withColumn("near", F.collect_list(F.struct("diagonal", "found", "first", "last")).over(around))
    distances = F.transform(F.sequence(F.lit(0), F.col("reach")), merged)
    spans = spans.withColumn("span", F.array_max(F.transform(distances, judged)))
    rank = F.struct(
        "span.verified", "span.coverage", "span.nearness", F.size("found").alias("votes"), -F.col("diagonal")
    )
    spans = spans.select("row", "template", "diagonal", "reach", "span", rank.alias("rank"))
    spans = spans.withColumn("others", F.collect_list(F.struct("diagonal", "rank")).over(around))
    rivals = F.filter("others", lambda o: F.abs(o["diagonal"] - F.col("diagonal")) <= F.col("reach"))
    best = spans.where(F.array_max(F.transform(rivals, lambda o: o["rank"])) == F.col("rank"))
    return best.select(
        "row",
        "template",
        listed(label for label, _ in templates).alias("label"),
        *[f"span.{c}" for c in ("first", "last", "coverage", "verified")],
    )


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES
) -> tuple[DataFrame, DataFrame]:
    """The documents' labels, and the spans behind them.

    First ``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every
    row, ``score`` being the best coverage of any span; then the spans with the id of their row.
    """
    places = stage(_places(docs, id_col, text_col, templates))
    spans = stage(_spans(places, templates))
    start = F.when(F.col("base").isNotNull(), F.col("pos"))
    base = places.groupBy("row").agg(
        F.first("id").alias("id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.count("base").alias("n_base"),
        F.min(start).cast("long").alias("first_word"),
        F.max(start).cast("long").alias("last_word"),
        F.collect_set("base").alias("base"),
    )
    voted = spans.groupBy("row").agg(
        F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("more"),
        F.max("coverage").alias("score"),
    )
    none = F.array().cast("array<string>")
    found = base.join(voted, "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        _joined(F.col("base")).alias("base_labels"),
        _joined(F.array_union("base", F.coalesce("more", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    ids = places.where("pos = -1").select("row", F.col("id").alias(id_col))
    return found, ids.join(spans, "row").drop("row")


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(documents(spark, folder))[0]
