"""License scans: an exact set-similarity join of text blocks with license templates. Native DataFrame code only.

A template with w words is looked for in blocks of 2w words that start at every multiple of w words of a text, so whatever
spreads over w words lies in one block whole. A template is found in a block that holds at least a share of its distinct words
(containment). The words of all templates are ordered by how often all texts have them, rarest first (one aggregation, as many
rows as templates have words). With m distinct words of which o are needed,

* prefix filter: a block must have one of the template's first m - o + 1 words, so only the blocks around such words are looked at;
* length filter: a block at a text's end must have at least o words;
* positional filter: from the first common word on, neither the template nor the block (its template words in the same order)
  may have fewer words left than are needed;

and what passes is counted in full. All three lose nothing. A text without any word of a prefix (nearly all texts) ends after one
look-up of its words in a set. No row leaves its task: the templates are bounded and part of the plan, and a text's blocks are
looked at where it was read, so neither a frequent notice nor a long text gathers anything.

Places of fixed phrases give the base labels. Only A-Z are lower-cased. A null text is an empty one; texts of any length are
looked at whole; repeated rows each give a row; rows with a null id are kept. Further columns are ignored. Empty tables give an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: every ASCII character but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's distinct words that a block must have.
THRESHOLD = 0.8

#: (phrase, label): fixed values of the query's contract.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: (label, text): fixed values, the notices by which texts state these licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD 3-Clause License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission"),
]

#: Blocks of one text and template are told apart by this many values.
SPAN = 1 << 40


def plain(text: Column) -> Column:
    """The words of a text, only A-Z lower-cased, joined by one space each."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, " "))


def words_of(text: str) -> list[str]:
    """The words of a template (a parameter, in plain ASCII)."""
    low = "".join(c if c.isdigit() or "a" <= c <= "z" else " " for c in text.lower())
    return low.split()


class Templates:
    """Templates with their words in the order of frequency, and what the filters need."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], threshold: float):
        self.all = []
        for label, text in templates:
            words = words_of(text)
            order = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
            if order:
                need = needed(len(order), threshold)
                self.all.append({"label": label, "n": len(words), "need": need, "words": order, "prefix": order[: len(order) - need + 1]})
        self.order = sorted({w for t in self.all for w in t["words"]}, key=lambda w: (frequency.get(w, 0), w))
        self.prefixes = sorted({w for t in self.all for w in t["prefix"]})

    def column(self) -> Column:
        """All as one array of structs, a constant of the plan."""
        strings = lambda x: F.array(*map(F.lit, x))
        return F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(t["label"]).alias("label"), F.lit(t["n"]).alias("n"), F.lit(t["need"]).alias("need"), strings(t["words"]).alias("words"), strings(t["prefix"]).alias("prefix")) for k, t in enumerate(self.all)])


def needed(distinct: int, threshold: float) -> int:
    """How many of a template's distinct words a block must have."""
    return max(1, math.ceil(threshold * distinct - 1e-9))


def frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[str, int]:
    """How often all texts have each word of the templates."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, text in templates for w in words_of(text)})
    if not vocabulary:
        return {}
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    words = docs.select(F.explode(F.split(F.translate("text", UPPER, LOWER), BETWEEN)).alias("word"))
    # as many rows as the templates have words, on both sides of the driver
    return {r["word"]: r["n"] for r in words.join(F.broadcast(known), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def matches(words: Column, templates: Templates) -> Column:
    """The templates found in an array of words: an array of structs of label and share (one for each block)."""
    all_, order = templates.column(), F.array(*map(F.lit, templates.order))
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("bigint").alias("i"))), lambda x: F.array_contains(F.array(*map(F.lit, templates.prefixes)), x["w"]))
    # a word at i lies in the blocks i div n and, but for the first, the one before
    blocks = lambda t, i: F.filter(F.array(F.floor(i / t["n"]), F.floor(i / t["n"]) - 1), lambda b: b >= 0)
    around = lambda x: F.flatten(F.transform(F.filter(all_, lambda t: F.array_contains(t["prefix"], x["w"])), lambda t: F.transform(blocks(t, x["i"]), lambda b: t["k"] * SPAN + b)))
    candidates = F.array_distinct(F.flatten(F.transform(hits, around)))
    template = lambda c: F.get(all_, F.floor(c / SPAN).cast("int"))
    block = lambda c: F.slice(words, ((c % SPAN) * template(c)["n"] + 1).cast("int"), 2 * template(c)["n"])
    long_enough = F.filter(candidates, lambda c: F.size(block(c)) >= template(c)["need"])
    with_words = F.transform(long_enough, lambda c: F.struct(template(c).alias("t"), F.array_intersect(order, block(c)).alias("own")))

    def possible(x: Column) -> Column:
        """The template's first word that the block has, and what is left behind it on both sides."""
        first = F.get(F.filter(x["t"]["words"], lambda w: F.array_contains(x["own"], w)), F.lit(0))
        left = F.least(F.size(x["t"]["words"]) - F.array_position(x["t"]["words"], first), F.size(x["own"]) - F.array_position(x["own"], first))
        return 1 + left >= x["t"]["need"]

    counted = F.transform(F.filter(with_words, possible), lambda x: F.struct(x["t"]["label"].alias("label"), F.size(F.array_intersect(x["t"]["words"], x["own"])).alias("n"), x["t"]["need"].alias("need"), F.size(x["t"]["words"]).alias("of")))
    return F.transform(F.filter(counted, lambda x: x["n"] >= x["need"]), lambda x: F.struct(x["label"].alias("label"), (x["n"] / x["of"]).alias("share")))


def scanned(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of ``docs`` (doc_id, text).

    ``score`` is the greatest containment of a template in a block, 0 if none reaches the threshold.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    known = Templates(templates, frequencies(docs, templates), threshold)
    rows = docs.select("doc_id", plain(F.col("text")).alias("_p"))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    rows = rows.select("doc_id", F.concat(F.lit(" "), "_p", F.lit(" ")).alias("_p"), F.when(F.col("_p") == "", 0).otherwise(spaces(F.col("_p")) + 1).cast("bigint").alias("n_words"))
    any_phrase = F.lit(False)
    n_base, firsts, lasts, labels = F.lit(0), [F.lit(None).cast("bigint")] * 2, [F.lit(None).cast("bigint")] * 2, []
    for phrase, label in phrases:
        inside = f" {phrase} "
        has = F.contains("_p", F.lit(inside))
        any_phrase |= has
        n_base += F.when(has, F.regexp_count("_p", F.lit(f"(?={inside})"))).otherwise(0)
        firsts.append(F.when(has, spaces(F.substring_index("_p", inside, 1)).cast("bigint")))
        lasts.append(F.when(has, F.col("n_words") - spaces(F.substring_index("_p", inside, -1)) - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    rows = rows.select(
        "doc_id",
        "n_words",
        F.when(any_phrase, n_base).otherwise(0).cast("bigint").alias("n_base"),
        F.when(any_phrase, F.least(*firsts)).alias("first_word"),
        F.when(any_phrase, F.greatest(*lasts)).alias("last_word"),
        F.when(any_phrase, F.array_compact(F.array(*labels))).otherwise(F.array().cast("array<string>")).alias("_base"),
        F.when(F.col("n_words") > 0, F.split(F.trim("_p"), " ")).alias("_words"),
    )
    some = F.arrays_overlap("_words", F.array(*map(F.lit, known.prefixes))) if known.prefixes else F.lit(False)
    rows = rows.withColumn("_words", F.when(some, F.col("_words")))
    none = F.array().cast("array<struct<label:string,share:double>>")
    rows = rows.withColumn("_found", F.when(F.col("_words").isNotNull(), matches(F.col("_words"), known)).otherwise(none) if known.all else none)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    share = F.coalesce(F.array_max(F.col("_found.share")), F.lit(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("_base")).alias("base_labels"), joined(F.concat("_base", F.col("_found.label"))).alias("labels"), share.alias("score"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every document states."""
    return scanned(table(spark, sf_dir, "documents"))


def _sql() -> str:
    strings = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]"
    templates, phrases = [], []
    for label, text in TEMPLATES:
        words = words_of(text)
        own = sorted(set(words))
        templates.append(f"('{label}', {strings(own)}, {len(words)}, {needed(len(own), THRESHOLD)})")
    for phrase, label in PHRASES:
        phrases.append(f"('{label}', {strings(phrase.split())})")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS w FROM documents),
t(label, words, n, need) AS (VALUES {', '.join(templates)}),
p(label, words) AS (VALUES {', '.join(phrases)}),
places AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(words)] = words)) AS place FROM d, p),
base AS (SELECT r, count(*) AS n, min(place) AS lo, max(place) AS hi, list(label) AS labels FROM places GROUP BY r),
blocks AS (SELECT r, label, words, need, w[b * n + 1:b * n + 2 * n] AS block FROM (SELECT r, w, label, words, n, need, unnest(range((len(w) + n - 1) // n)) AS b FROM d, t WHERE len(list_intersect(w, words)) >= need)),
found AS (SELECT r, label, len(list_intersect(words, block)) / len(words) AS share FROM blocks WHERE len(list_intersect(words, block)) >= need),
method AS (SELECT r, list(label) AS labels, max(share) AS share FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
 array_to_string(list_sort(list_distinct(coalesce(base.labels, []::VARCHAR[]))), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []::VARCHAR[]), coalesce(method.labels, []::VARCHAR[])))), ',') AS labels,
 coalesce(share, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN method USING (r)"""


SQL = _sql()
