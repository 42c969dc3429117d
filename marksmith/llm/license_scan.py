"""License scan: an exact set-similarity join of text blocks with license templates, DataFrame operations only.

A text's words are cut into blocks, windows of twice the longest template's length at every such length, so that
any passage no longer than a template lies whole in a block. A block meets a template when it holds at least the
share ``threshold`` of the template's distinct words. Words are ordered by how many documents of the
whole table have them, rare ones first, and three filters leave few pairs to compare:

* prefix: of a template of t words that needs a of them, one of its t - a + 1 rarest must be among the
  block's b - a + 1 rarest; that is the join's key;
* length: a block needs a words of the templates' vocabulary;
* position: at the first word in common, what is left of either side must suffice for a.

What passes is compared in full. No pair that meets the threshold is lost, and nothing is sampled. Only words of
the templates' vocabulary, which MAX_VOCABULARY bounds, are joined, so its side is broadcast.

Base labels come from phrases whose words stand consecutively; they stay whatever the join finds.

Defined results: a null text counts as empty and has no words, no places and no labels. Texts may be of any length; all of their
blocks are searched. Rows that repeat an id, or have none, are rows of their own. Equal places of different phrases count
each. An empty table gives an empty table; without templates the labels are the base ones. Only the id and the text are
read, so extra columns may have any names and types.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD, MAX_VOCABULARY = 0.8, 1 << 14

#: Phrases and the labels that they stand for.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices as the licenses' publishers word them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def needed(distinct_words: int, threshold: float = THRESHOLD) -> int:
    """The least number of a template's distinct words that a block must hold."""
    return max(1, math.ceil(threshold * distinct_words - 1e-9))


def constant(tokens: Sequence[str]) -> Column:
    """An array of words, one constant of the plan."""
    return F.split(F.lit(" ".join(tokens)), " ") if tokens else F.expr("array()").cast("array<string>")


def phrase_places(text: Column, found: Column, phrases=PHRASES) -> Column:
    """array<struct<start, label>>: where the phrases stand among the words ``found``; texts without a phrase's longest word aren't looked through."""
    nowhere = F.expr("array()").cast("array<struct<start:bigint,label:string>>")

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()
        stands = lambda i: reduce(lambda a, b: a & b, [F.get(found, i + k) == p for k, p in enumerate(parts)])
        starts = F.filter(F.sequence(F.lit(0), F.size(found) - len(parts)), stands)
        may = F.contains(F.translate(text, UPPER, LOWER), F.lit(max(parts, key=len))) & (F.size(found) >= len(parts))
        return F.when(may, F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))).otherwise(nowhere)

    return F.concat(*[places(phrase, label) for phrase, label in phrases]) if phrases else nowhere


def block_sets(found: Column, vocabulary: Sequence[str], stride: int, least: int) -> Column:
    """array<array<string>>: the vocabulary's words in each block, of the blocks that hold ``least`` or more."""
    last = F.greatest(F.lit(0), F.ceil(F.size(found) / stride).cast("int") - 2)
    known = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_intersect(constant(vocabulary), F.slice(found, k * stride + 1, 2 * stride)))
    return F.filter(known, lambda b: F.size(b) >= least)


def matches(rows: DataFrame, templates: Sequence[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(row, label, share) for every block of ``rows`` (row, seen, blocks) and template that meet; seen: the vocabulary's words of the row's whole text."""
    spark = rows.sparkSession
    counted = rows.select(F.explode("seen").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r["w"]: r["n"] for r in counted.collect()}  # a row for each word of the vocabulary at most
    rare_first = lambda tokens: sorted(set(tokens), key=lambda w: (frequency.get(w, 0), w))
    sets = [(k, label, rare_first(words_of(text))) for k, (label, text) in enumerate(templates)]
    index = [
        (k, label, place, w, len(tokens), needed(len(tokens), threshold), tokens)
        for k, label, tokens in sets for place, w in enumerate(tokens[: len(tokens) - needed(len(tokens), threshold) + 1])
    ]
    prefix = spark.createDataFrame(index, "template int, label string, place int, w string, t int, a int, tokens array<string>")
    order = constant(rare_first(w for _, _, tokens in sets for w in tokens))
    blocks = rows.select("row", F.explode("blocks").alias("block")).select("row", F.array_intersect(order, "block").alias("block")).distinct()
    keyed = blocks.select("row", "block", F.posexplode("block").alias("at", "w"))
    b, t, a = F.size("block"), F.col("t"), F.col("a")
    met = keyed.join(F.broadcast(prefix), "w").where((b >= a) & (F.col("at") <= b - a) & (F.least(b - F.col("at"), t - F.col("place")) >= a))
    pairs = met.select("row", "label", "template", "block", "tokens", "a").dropDuplicates(["row", "template", "block"])
    shared = F.size(F.array_intersect("block", "tokens"))
    return pairs.where(shared >= F.col("a")).select("row", "label", (shared / F.size("tokens")).alias("share"))


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    tokens = [words_of(text) for _, text in templates]
    vocabulary = sorted({w for t in tokens for w in t})
    if len(vocabulary) > MAX_VOCABULARY or not all(tokens):
        raise ValueError(f"templates need words, of {MAX_VOCABULARY} kinds at most")
    stride = max([len(t) for t in tokens], default=1)
    least = min([needed(len(set(t)), threshold) for t in tokens], default=1)
    cut = texts(docs, id_col, text_col).select("doc_id", "text", words(F.col("text")).alias("found"))
    seen = cut.select("doc_id", "text", "found", F.array_intersect(constant(vocabulary), "found").alias("seen"))
    blocks = F.when(F.size("seen") >= least, block_sets(F.col("found"), vocabulary, stride, least)).otherwise(F.expr("array()").cast("array<array<string>>"))
    rows = written(
        seen.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("found").cast("long").alias("n_words"), phrase_places(F.col("text"), F.col("found"), phrases).alias("base"), "seen", blocks.alias("blocks")),
        "license_blocks",
    )
    found = matches(rows, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("met"), F.max("share").alias("share"))  # as many labels as templates have
    joined = rows.select("row", "doc_id", "n_words", "base").join(found, "row", "left")
    start, base_labels = F.transform("base", lambda x: x["start"]), F.array_distinct(F.transform("base", lambda x: x["label"]))
    listed = lambda labels: F.array_join(F.array_sort(labels), ",")
    return joined.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), listed(base_labels).alias("base_labels"),
        listed(F.array_union(base_labels, F.coalesce("met", F.expr("array()").cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
