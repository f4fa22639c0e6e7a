"""License scans by diagonal voting, in DataFrame functions only.

Every rolling hash of ``K`` consecutive words of a document is joined to the
positions where the same words stand in a license template. A hit at document
position p and template position t votes for the diagonal p - t; votes are
counted by (document, template, diagonal), neighbouring diagonals are merged
(a few words put in or left out shift the diagonal), and a merged span is
verified by the share of the template's words that its hits cover. Short phrases that name
a license are counted beside it. No text is shuffled: a span carries the
template positions that voted for it.

Edge cases: null and empty texts have no words and no labels; repeated rows
are all returned, with equal results; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasklens.llm.common import ascii_lower

#: Words of a rolling hash.
K = 4
#: Largest difference between neighbouring diagonals that are merged.
GAP = 8
#: Share of a template's words that a verified span must hold.
COVER = 0.6

#: Phrases that name a license, and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices that projects paste into their files, and their labels (fixed values).
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software and to permit persons "
        "to whom the software is furnished to do so subject to the following conditions"),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file "
        "except in compliance with the license you may obtain a copy of the license at"),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation"),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met"),
    "cc-by": (
        "this work is licensed under the creative commons attribution 4 0 international license "
        "to view a copy of this license visit"),
}


def words_of(text: Column) -> Column:
    """Words of a text joined by single spaces (empty for no words)."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))),
                              r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.trim(spaced)


def count_words(joined: Column) -> Column:
    """Words in a string of words joined by single spaces."""
    n = F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1
    return F.when(joined == "", F.lit(0)).otherwise(n).cast("long")


def phrase_places(joined: str, phrases: dict[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and the found labels of a column of words."""
    padded = F.concat(F.lit(" "), F.col(joined), F.lit(" "))
    total, firsts, lasts, labels = F.lit(0), [], [], []
    for phrase, label in phrases.items():
        has = F.contains(padded, F.lit(f" {phrase} "))
        # the spaces around a place are shared with its neighbours
        parts = F.split(padded, f"(?<= ){phrase}(?= )")
        n_last = count_words(F.trim(F.element_at(parts, -1)))
        total = total + F.when(has, F.size(parts) - 1).otherwise(0)
        firsts.append(F.when(has, count_words(F.trim(F.element_at(parts, 1)))))
        lasts.append(F.when(has, count_words(F.col(joined)) - n_last - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    nothing = F.lit(None).cast("long")
    return {
        "n_base": total.cast("long"),
        "first_word": F.least(*firsts, nothing).cast("long"),
        "last_word": F.greatest(*lasts, nothing).cast("long"),
        "base": F.array_compact(F.array(*labels)),
    }


def rolling_hashes(words: Column, k: int = K) -> Column:
    """Array of the hashes of every ``k`` consecutive words (k a power of two)."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    step = 1
    while step < k:
        h = F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h), F.lit(1))),
                       lambda x, y: F.xxhash64(x, y))
        step *= 2
    return F.slice(h, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def template_table(spark: SparkSession, templates: dict[str, str], k: int = K) -> DataFrame:
    """(template, tpos, h): at most one row for each word of the templates."""
    t = spark.createDataFrame([(n, " ".join(x.split())) for n, x in sorted(templates.items())],
                              "template string, body string")
    h = rolling_hashes(F.split("body", " "), k)
    return t.select("template", F.posexplode(h).alias("tpos", "h"))


def diagonal_votes(docs: DataFrame, templates: dict[str, str], k: int = K) -> DataFrame:
    """(row_id, template, diag, lo, hi, held) of rows (row_id, words).

    ``held`` are the template positions that voted: at most as many as the
    template has words.
    """
    grams = docs.select("row_id", F.posexplode(rolling_hashes(F.col("words"), k)).alias("pos", "h"))
    # bounded by the templates above: a few hundred rows, whatever the documents
    t = F.broadcast(template_table(docs.sparkSession, templates, k))
    return (grams.join(t, "h")
            .groupBy("row_id", "template", (F.col("pos") - F.col("tpos")).alias("diag"))
            .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"),
                 F.collect_set("tpos").alias("held")))


def merged_spans(votes: DataFrame, gap: int = GAP, k: int = K) -> DataFrame:
    """Spans of neighbouring diagonals: (row_id, template, lo, hi, held)."""
    w = Window.partitionBy("row_id", "template").orderBy("diag")
    new = F.coalesce(F.col("diag") - F.lag("diag").over(w) > gap, F.lit(True))
    runs = votes.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w))
    return (runs.groupBy("row_id", "template", "run")
            .agg(F.min("lo").alias("lo"), (F.max("hi") + k).alias("hi"),
                 F.array_distinct(F.flatten(F.collect_set("held"))).alias("held")))


def scan_licenses(documents: DataFrame, phrases: dict[str, str] = PHRASES,
                  templates: dict[str, str] = TEMPLATES, k: int = K, gap: int = GAP,
                  cover: float = COVER) -> DataFrame:
    """One row per document: the base phrase figures, all labels, the score
    (largest share of a template that a verified span holds; 1 with a base
    phrase) and the verified ``spans`` (label, lo, hi, share) in words.

    A span is verified when the words of its voting grams make up ``cover`` of
    the template's words. Labels of phrases always stay; a verified span adds
    its template's label.
    """
    # equal rows share an id: they have equal spans
    read = documents.select(F.xxhash64("doc_id", "text").alias("row_id"), "doc_id",
                            words_of(F.col("text")).alias("joined"))
    words = F.when(F.col("joined") == "", F.array().cast("array<string>")).otherwise(
        F.split("joined", " "))
    votes = diagonal_votes(read.select("row_id", words.alias("words")), templates, k)
    size = F.create_map(*[F.lit(x) for n, b in templates.items() for x in (n, len(b.split()))])
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "held", lambda t: F.sequence(t, t + (k - 1))))))
    hit = (merged_spans(votes, gap, k)
           .withColumn("share", covered / size[F.col("template")])
           .filter(F.col("share") >= cover)
           .groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(
               F.col("template").alias("label"), "lo", "hi", "share"))).alias("spans")))
    base = read.withColumn("n_words", count_words(F.col("joined")))
    base = base.withColumns(phrase_places("joined", phrases)).drop("joined")
    out = base.join(hit, "row_id", "left")
    own = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"), "spans")
