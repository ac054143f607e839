"""License scans by diagonal voting, in DataFrame operations only.

A text's words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Hashes of
all runs of K words are joined to the positions of the same runs in license templates, and the words
behind them are compared; a hit votes for the diagonal (place in the text minus place in the template).
Diagonals merge to bands of 2 * SLACK + 1 neighbours, one from each diagonal with a vote, so a statement is
judged by what lies at its place, whatever else repeats its words. A band holds if hits of at least MIN_COVER of
the template's runs lie in it; its template's label is then the text's. Of bands that overlap, the best (then the tightest, then the first) is a span.

Beside it, fixed phrases are found where their words stand consecutively; their labels stay
whatever the vote says. The templates are fixed in this module, so their broadcast is bounded.

Defined results: null or empty texts have no words and no labels; rows that repeat a doc_id
but differ in text are told apart; null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, SLACK, MIN_COVER = 3, 3, 0.75
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters as ranges, which Java matches five times as fast as their complement.
WORD_RANGES = r"[0-9a-z\x80-\x{10FFFF}]+"

#: Phrase and label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Label and the statements by which texts declare that license.
TEMPLATES = {
    "mit": [
        "released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl-3": [
        "licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "cc-by-nc": [
        "licensed under CC BY-NC 4.0",
        "licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc0": ["The person who associated a work with this deed has dedicated the work to the public domain"],
    "epl-2": ["made available under the terms of the Eclipse Public License 2.0"],
}


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() does that fast; the two characters that it would turn into ASCII take the slow way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[İK]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _starts(words: Column, phrase: list[str]) -> Column:
    """Places where the phrase's words stand consecutively."""
    at = F.sequence(F.lit(0), F.size(words) - len(phrase))

    def here(i: Column) -> Column:
        test = words[i] == phrase[0]
        for j, word in enumerate(phrase[1:], 1):
            test = test & (words[i + j] == word)
        return test

    return F.when((F.size(words) >= len(phrase)) & F.array_contains(words, max(phrase, key=len)), F.filter(at, here)).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame) -> DataFrame:
    """Per text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first word, last word, cover)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(lowered(text), F.lit(WORD_RANGES), F.lit(0)).alias("words")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("tag"), words)

    statements = [(label, n, template_words(t)) for label, ts in TEMPLATES.items() for n, t in enumerate(ts)]
    grams = [(f"{label}/{n}", label, i, len(w) - K + 1, " ".join(w[i : i + K])) for label, n, w in statements for i in range(len(w) - K + 1)]
    template = spark.createDataFrame(grams, "template string, label string, at int, runs int, gram string")
    template = F.broadcast(template.withColumn("h", F.xxhash64("gram")))

    w = F.col("words")
    rolling = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.concat_ws(" ", *(w[i + j] for j in range(K))))
    rolling = F.when(F.size(w) >= K, rolling).otherwise(F.array().cast("array<string>"))
    each = texts.select("doc_id", "tag", F.posexplode(rolling).alias("pos", "gram")).withColumn("h", F.xxhash64("gram"))
    hits = each.join(template, ["h", "gram"])
    key = ["doc_id", "tag", "template", "label", "runs"]
    # A bit for each place of the template that voted; templates have fewer than 64.
    bit = F.expr("shiftleft(1L, at)")
    votes = hits.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal"))
    votes = votes.agg(F.bit_or(bit).alias("bits"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    along = W.partitionBy(*key).orderBy("diagonal")
    band = along.rangeBetween(0, 2 * SLACK)
    bands = votes.select(*key, "diagonal", F.bit_or("bits").over(band).alias("bits"), F.min("lo").over(band).alias("lo"), F.max("hi").over(band).alias("hi"))
    bands = bands.withColumn("cover", F.bit_count("bits") / F.col("runs"))
    rank = F.struct("cover", (F.col("lo") - F.col("hi")).alias("tight"), (-F.col("diagonal")).alias("first"))
    best = F.max(rank).over(along.rangeBetween(-2 * SLACK, 2 * SLACK))
    spans = bands.withColumn("best", best == rank).where((F.col("cover") >= MIN_COVER) & F.col("best"))
    span = F.struct("label", F.col("lo").alias("first_word"), (F.col("hi") + K - 1).alias("last_word"), "cover")
    found = spans.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(span)).alias("spans"))

    places = [(label, _starts(w, phrase.split())) for phrase, label in PHRASES.items()]
    all_places = F.concat(*(p for _, p in places))
    labelled = F.filter(F.array(*(F.when(F.size(p) > 0, label) for label, p in places)), lambda x: x.isNotNull())
    base = texts.select(
        "doc_id",
        "tag",
        F.size(w).cast("long").alias("n_words"),
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labelled)).alias("base"),
    )
    found = found.select(F.col("doc_id").alias("fd"), F.col("tag").alias("ft"), "spans")
    out = base.join(found, base["doc_id"].eqNullSafe(found["fd"]) & (F.col("tag") == F.col("ft")), "left")
    spans_col = F.coalesce("spans", F.expr("array()").cast("array<struct<label: string, first_word: int, last_word: int, cover: double>>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(spans_col, lambda s: s["cover"])), F.lit(0.0)))
    labels = F.array_join(F.array_sort(F.array_union("base", F.transform(spans_col, lambda s: s["label"]))), ",")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"), spans_col.alias("spans"))
