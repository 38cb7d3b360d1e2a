"""License scan by an exact set-similarity join, in DataFrame operations only.

Templates are the wordings of license notices, as sets of words. A block of text (a window of BLOCK words, every
STEP words) matches a template if it holds at least `threshold` of the template's words, and all that tell its license from
its neighbours (`must`). Where words of a neighbour's wording (`without`) stand in the block too, some window of as many words
as the template has must match without them: a notice and its neighbour one after another give both labels.

The join finds every such pair: words are ordered by how many documents of the corpus hold them, rarest first; a block that
matches holds one of the first |T| - o + 1 words of template T, where o is the overlap needed (prefix filter); it has o words of
templates at all (length filter); and from a common prefix word on, both sides have enough words left (positional filter).
Only what passes is counted. The templates are a parameter of fixed size; blocks without any prefix word go no further.

Base phrases are found exactly, as words that stand one after another. Null texts count as empty: no words, no labels,
score 0. Rows are scanned one by one: repeated rows and ties get equal results, and an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, text_or_empty

# The characters that separate words, the base phrases and their labels.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

THRESHOLD = 0.8
BLOCK, STEP = 128, 64


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    must: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


# Wordings of license notices by label. Longer ones than STEP words make steps and blocks longer, so that one
# that stands in a text lies in some block.
_GNU = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {} 4.0 International License"
_KINDS = ("noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd")
TEMPLATES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("sublicense", "merge")),
    Template("mit", "Released under the MIT License", ("mit", "license")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("fee", "purpose"), ("sublicense",)),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache",)),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache", "license")),
    Template("gpl", _GNU.format("This program", "General Public", 3), ("gnu",), ("lesser", "library", "affero")),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu",), ("lesser", "library", "affero")),
    Template("lgpl", _GNU.format("This library", "Lesser General Public", 2.1), ("gnu", "lesser")),
    Template("lgpl", "GNU Lesser General Public License", ("gnu", "lesser")),
    Template("agpl", _GNU.format("This program", "Affero General Public", 3), ("gnu", "affero")),
    Template("agpl", "GNU Affero General Public License", ("gnu", "affero")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ("redistribution", "binary")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla",)),
    Template("mpl", "Mozilla Public License 2.0", ("mozilla", "license")),
    Template("cc-by", _CC.format("Attribution"), ("creative", "commons", "attribution"), _KINDS),
    Template("cc-by-nc", _CC.format("Attribution-NonCommercial"), ("creative", "commons", "noncommercial"), ("sharealike", "noderivatives")),
    Template("cc-by-sa", _CC.format("Attribution-ShareAlike"), ("creative", "commons", "sharealike"), ("noncommercial",)),
    Template("cc-by-nd", _CC.format("Attribution-NoDerivatives"), ("creative", "commons", "noderivatives"), ("noncommercial",)),
    Template("cc-by-nc-sa", _CC.format("Attribution-NonCommercial-ShareAlike"), ("creative", "commons", "noncommercial", "sharealike")),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc", "by", "nc"), ("sa", "nd")),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc", "by", "sa"), ("nc",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc", "by", "nd"), ("nc",)),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", ("cc", "by", "nc", "sa")),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived", "neighboring")),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", ("unencumbered",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("alter", "freely")),
    Template("boost", "Distributed under the Boost Software License, Version 1.0", ("boost", "license")),
]


def words_of(text: str) -> list[str]:
    lower = text.translate(str.maketrans(UPPER, LOWER))
    return [w for w in re.split(BETWEEN, lower) if w]


def template_sets(templates: list[Template] = TEMPLATES) -> list[tuple[Template, list[str]]]:
    return [(t, sorted(set(words_of(t.text)))) for t in templates]


def with_words(df: DataFrame, text: str = "text", into: str = "_words") -> DataFrame:
    lower = F.translate(text_or_empty(text), UPPER, LOWER)
    return df.withColumn(into, F.filter(F.split(lower, BETWEEN), lambda w: w != ""))


def word_order(docs: DataFrame, templates: list[tuple[Template, list[str]]]) -> dict[str, int]:
    """Place of each template word in the global order: by documents that hold it, rarest first, then by the word.
    One row for each template word reaches the driver."""
    vocabulary = sorted({w for t, words in templates for w in (*words, *t.must, *t.without)})
    found = with_words(docs.select("text")).select(F.explode_outer(F.array_intersect("_words", strings(vocabulary))).alias("w")).where("w IS NOT NULL")
    count = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}


def strings(values: list[str]) -> Column:
    """A literal array, which the plan holds as one string."""
    return F.from_json(F.lit(json.dumps(values)), "array<string>") if values else F.array().cast("array<string>")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    data = F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>")
    return F.broadcast(spark.range(1).select(F.inline(data)))


def matches(docs: DataFrame, order: dict[str, int], templates: list[tuple[Template, list[str]]], threshold: float = THRESHOLD, step: int = STEP) -> DataFrame:
    """docs (with _words) with one row for each (label, score) of the blocks that match a template; score is the share of the
    template that the block holds. Blocks are BLOCK - STEP words longer than a step, or a step where that is more.

    Blocks meet templates in a join over the words of the templates' prefixes; the index of these is as large as the
    templates given, whatever the input, and is broadcast."""
    spark = docs.sparkSession
    rows, index = [], []
    for number, (t, words) in enumerate(templates):
        ordered = sorted(words, key=order.__getitem__)
        need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
        rows.append((number, t.label, ordered, need, list(t.must), list(t.without), len(words_of(t.text))))
        index += [(w, number, need, len(ordered) - place) for place, w in enumerate(ordered[: len(ordered) - need + 1])]
    index_rows = literal_rows(spark, index, "_word string, _template int, _need int, _rest int")
    template_rows = literal_rows(spark, rows, "_template int, label string, _of array<string>, _least int, _must array<string>, _without array<string>, _span int")
    prefixes, vocabulary = strings(sorted({r[0] for r in index})), strings(sorted(order, key=order.__getitem__))
    held = docs.withColumn("_held", F.array_intersect(vocabulary, F.col("_words"))).where(F.arrays_overlap("_held", prefixes))  # in the global order, as are all blocks below
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - 1, F.lit(0)), F.lit(step))
    width = step + max(step, BLOCK - STEP)
    block = lambda s: F.struct(s.alias("start"), F.array_intersect(F.col("_held"), F.slice("_words", s + 1, width)).alias("held"))
    # Blocks that hold the same words of templates in the same order differ at most in what stands around these.
    blocks = held.withColumn("_block", F.explode(F.filter(F.transform(starts, block), lambda b: F.arrays_overlap(b["held"], prefixes))))
    blocks = blocks.withColumns({"_around": F.slice("_words", F.col("_block.start") + 1, width), "_block": F.col("_block.held")}).drop("_words", "_held")
    met = blocks.withColumn("_word", F.explode(F.array_intersect("_block", prefixes))).join(index_rows, "_word")
    # Length, and place: from a common prefix word on, both sides have enough words left (and the word's own).
    before = F.size(F.array_intersect(F.slice("_block", 1, F.array_position("_block", F.col("_word")).cast("int") - 1), prefixes))
    left = F.least(F.size("_block") - F.array_position("_block", F.col("_word")) + 1, F.col("_rest"))
    met = met.where((F.size("_block") >= F.col("_need")) & (left + F.least(before, F.col("_need") - 1) >= F.col("_need"))).join(template_rows, "_template")
    common = F.size(F.array_intersect("_of", "_block"))
    window = lambda s: F.slice("_around", s + 1, F.col("_span"))
    # A neighbour's words in the same block don't count, unless no window as long as the template does without them.
    alone = F.exists(
        F.sequence(F.lit(0), F.greatest(F.size("_around") - F.col("_span"), F.lit(0))),
        lambda s: ~F.arrays_overlap(window(s), F.col("_without")) & (F.size(F.array_except(F.col("_must"), window(s))) == 0) & (F.size(F.array_intersect(F.col("_of"), window(s))) >= F.col("_least")),
    )
    fits = (common >= F.col("_least")) & (F.size(F.array_except("_must", "_block")) == 0) & (F.when(F.arrays_overlap("_without", "_around"), alone).otherwise(True))
    keep = [c for c in docs.columns if c != "_words"]
    return met.where(fits).select(*keep, "label", (common / F.size("_of")).alias("score"))


def license_scan(docs: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: n_words, the base places and labels, all labels, and the score: 1 for a base phrase, else the
    greatest share of a template that a block holds, 0 if none reaches the threshold."""
    sets = template_sets(templates)
    order = word_order(docs, sets)
    step = max([STEP, *(len(words_of(t.text)) for t in templates)])
    # Rows with one id and text have one result, so that these two are key enough.
    text = F.xxhash64(text_or_empty()).alias("_text_hash")
    rows = with_words(docs.select("doc_id", "text").select("doc_id", text, text_or_empty().alias("_text")), "_text").drop("_text")
    labels = matches(rows, order, sets, threshold, step).groupBy("doc_id", "_text_hash").agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score"))
    labels = stored(labels, "labels").withColumnsRenamed({"doc_id": "_id", "_text_hash": "_hash"})
    word = lambda i: F.get("_words", i)
    phrases = [(p.split(" "), label) for p, label in PHRASES.items()]

    def phrase_at(w: Column, i: Column) -> Column:
        out = None
        for words, label in phrases:
            here = w == words[0]
            for k, x in enumerate(words[1:], 1):
                here = here & (word(i + k) == x)
            out = F.when(here, label) if out is None else out.when(here, label)
        return F.when(w.isin([p[0] for p, _ in phrases]), F.struct(i.cast("long").alias("at"), out.alias("label")))

    places = F.filter(F.transform("_words", phrase_at), lambda x: x["label"].isNotNull())
    places = F.when(F.arrays_overlap("_words", strings([p[-1] for p, _ in phrases])), places).otherwise(F.filter(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("label"))), lambda x: F.lit(False)))
    ats = F.transform("_places", lambda x: x["at"])
    base = F.transform("_places", lambda x: x["label"])
    found = rows.withColumn("_places", places).select("doc_id", "_text_hash", F.size("_words").cast("long").alias("n_words"), ats.alias("_ats"), base.alias("_base"))
    found = found.join(labels.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    both = F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>")))
    return found.select(
        "doc_id", "n_words", F.size("_ats").cast("long").alias("n_base"), F.array_min("_ats").alias("first_word"), F.array_max("_ats").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct("_base"))).alias("base_labels"), F.concat_ws(",", F.array_sort(F.array_distinct(both))).alias("labels"),
        F.when(F.size("_ats") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).cast("double").alias("score"),
    )
