"""License scans (operator 12) as an exact set-similarity join, in DataFrame functions alone.

Words are maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased.

**Base places** are the positions where a phrase's words stand consecutively (all of them, overlapping ones too).

**The join** finds the text blocks that contain a license template. For each size class (the power of two ``span`` at or
above a template's number of words) a document is cut into blocks of ``2 * span`` words, one starting every ``span``
words, so every passage as long as the template lies whole in a block. A block meets a template when it holds at least
``threshold`` of the template's distinct words (``needed``, rounded up). Every such pair is found:

1. Words are ordered by the number of documents that hold them, counted over the whole corpus, rarest first. Only words
   of templates can be shared, so only they are counted and kept.
2. Prefix filter: two sets with ``needed`` common words share one of the first ``size - needed + 1`` of either. Documents
   without a word of any template's prefix are done; the others' blocks are joined on the prefix words.
3. Length filter: a block with fewer template words than ``needed`` goes. Positional filter: with a common word at the
   places i and j, no more than ``min(i, j) + 1 + min(words behind each)`` words can be common.
4. What remains is verified on whole sets.

No shuffle carries a text: the words of documents that pass the prefix filter are staged once, the result of all others is
final in the scan. Templates are the caller's list; its size, not the corpus's, bounds the tables made of it, and Spark
chooses by their size whether to broadcast them. Blocks are the grouping keys, so neither a long document nor a word in
every document makes a large group: a group holds at most the distinct template words of one block.

Null and empty texts have no word: counts 0, places null, labels empty, score 0. Rows are documents, so repeated or null
ids keep one result a row. Ties in the word order are broken by the word. Extra columns are not read. An empty table gives
an empty result, an empty list of templates the base labels alone. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.llm.base import stage

# Phrases whose consecutive words name a license.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Opening statements of well-known licenses, as published.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
            "this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def words_of(text: str) -> list[str]:
    """The words of a template or phrase, by the same rule as :func:`word_array`."""
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(str.maketrans(UPPER, LOWER)))


def word_array(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS))
    return F.array_remove(F.split(spaced, " "), "")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def phrase_places(words: Column, phrase: Sequence[str]) -> Column:
    """All positions (from 0) where the phrase starts."""
    first, last = F.lit(0), F.size(words) - len(phrase)

    def starts(i: Column) -> Column:
        same = F.get(words, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            same = same & (F.get(words, i + k) == word)
        return same

    holds = F.array_contains(words, phrase[-1]) & (F.size(words) >= len(phrase))
    return F.when(holds, F.filter(F.sequence(first, F.greatest(first, last)), starts)).otherwise(
        F.array().cast("array<int>"))


def template_sets(templates: Sequence[tuple[str, str]], threshold: float) -> list[dict]:
    """One record a template: its distinct words, how many of them a block needs, and its size class."""
    out = []
    for label, text in templates:
        words = words_of(text)
        if words:
            own = sorted(set(words))
            needed = max(1, -(-round(threshold * 1_000_000) * len(own) // 1_000_000))
            out.append({"template": len(out), "label": label, "words": own, "n": len(own), "needed": needed,
                        "span": 1 << (len(words) - 1).bit_length()})
    return out


def order_words(docs_words: DataFrame, sets: list[dict]) -> dict[str, int]:
    """Rank of each template word, rarest first, by the number of documents that hold it (ties by the word)."""
    vocabulary = sorted({w for t in sets for w in t["words"]})
    held = docs_words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _table(spark, records: list[dict], schema: str) -> DataFrame:
    """The caller's templates as a table (one literal, parsed by Spark)."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(records)), f"array<struct<{schema}>>")).alias("r")
                                 ).select("r.*")


def similar_blocks(docs: DataFrame, sets: list[dict], ranks: dict[str, int]) -> DataFrame:
    """(row, template, label, start, n_words, common, containment) of all blocks that meet a template.

    ``docs`` has (row, words); ``start`` counts words from 0, a block is ``n_words`` long unless the text ends before.
    """
    spark = docs.sparkSession
    vocabulary = _table(spark, [{"word": w, "rank": r} for w, r in ranks.items()], "word string, rank int")
    least = {}
    for t in sets:
        least[t["span"]] = min(least.get(t["span"], t["needed"]), t["needed"])
    classes = F.array(*[F.struct(F.lit(s).alias("span"), F.lit(n).alias("least")) for s, n in sorted(least.items())]).cast(
        "array<struct<span:int,least:int>>")
    table = _table(spark, [{"template": t["template"], "label": t["label"], "n": t["n"], "needed": t["needed"],
                            "tspan": t["span"], "own": sorted(ranks[w] for w in t["words"])} for t in sets],
                   "template int, label string, n int, needed int, tspan int, own array<int>")
    at = docs.select("row", F.posexplode("words").alias("at", "word")).join(vocabulary, "word").select("row", "at", "rank")
    block = F.expr("at div span").cast("int")
    spread = at.select("row", "at", "rank", F.explode(classes).alias("c")).select("row", "at", "rank", "c.*").select(
        "row", "span", "least", "rank", F.explode(F.array(block, block - 1)).alias("block")).where("block >= 0")
    blocks = spread.groupBy("row", "span", "block", "least").agg(F.sort_array(F.collect_set("rank")).alias("set"))
    blocks = blocks.withColumn("size", F.size("set")).where("size >= least")
    theirs = table.select("template", "n", "needed", "tspan",
                          F.posexplode(F.slice("own", 1, F.col("n") - F.col("needed") + 1)).alias("i", "trank"))
    ours = blocks.select("row", "span", "block", "set", "size",
                         F.posexplode(F.slice("set", 1, F.col("size") - F.col("least") + 1)).alias("j", "rank"))
    bound = F.least("i", "j") + 1 + F.least(F.col("n") - F.col("i"), F.col("size") - F.col("j")) - 1
    pairs = ours.join(theirs, (F.col("rank") == F.col("trank")) & (F.col("span") == F.col("tspan"))
                      & (F.col("size") >= F.col("needed")) & (bound >= F.col("needed")))
    pairs = pairs.groupBy("row", "span", "block", "template").agg(F.first("set").alias("set"))
    checked = pairs.join(table, "template").withColumn("common", F.size(F.array_intersect("set", "own")))
    return checked.where("common >= needed").select(
        "row", "template", "label", (F.col("block") * F.col("span")).alias("start"), (2 * F.col("span")).alias("n_words"),
        "common", (F.col("common") / F.col("n")).alias("containment"))


def _prepared(docs: DataFrame, id_col: str, text_col: str, templates, threshold: float, phrases):
    """Staged documents (row, doc_id, n_words, base columns, words of those that may hold a template), sets, ranks."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       word_array(F.col(text_col).cast("string")).alias("words"))
    sets = template_sets(templates, threshold)
    ranks = order_words(base.select("words"), sets) if sets else {}
    prefix = sorted({w for t in sets for w in sorted(t["words"], key=ranks.get)[:t["n"] - t["needed"] + 1]})
    labelled = [(words_of(p), label) for p, label in phrases]
    found = base.select("doc_id", "words", *[phrase_places(F.col("words"), p).alias(f"p{i}")
                                             for i, (p, _) in enumerate(labelled)])
    places = F.concat(*[F.col(f"p{i}") for i in range(len(labelled))]) if labelled else F.array().cast("array<int>")
    named = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(labelled)])
                            ) if labelled else F.array().cast("array<string>")
    may = F.size(F.array_intersect("words", _strings(prefix))) > 0
    rows = found.select("doc_id", "words", places.alias("places"), F.array_sort(F.array_distinct(named)).alias("base"),
                        F.size("words").cast("long").alias("n_words"))
    return stage(rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "base",
        F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), F.when(may, F.col("words")).alias("words"))), sets, ranks


def license_blocks(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text block that meets a template: doc_id, template, label, start, n_words, common, containment, block."""
    rows, sets, ranks = _prepared(docs, id_col, text_col, templates, threshold, ())
    hits = similar_blocks(rows.where("words is not null").select("row", "words"), sets, ranks)
    return hits.join(rows.where("words is not null").select("row", "doc_id", "words"), "row").select(
        "doc_id", "template", "label", "start", "n_words", "common", "containment",
        F.array_join(F.slice("words", F.col("start") + 1, F.col("n_words")), " ").alias("block"))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                  phrases: Sequence[tuple[str, str]] = PHRASES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 for a document with a base place, else the best containment of a template it meets (0: none).
    """
    rows, sets, ranks = _prepared(docs, id_col, text_col, templates, threshold, phrases)
    hits = similar_blocks(rows.where("words is not null").select("row", "words"), sets, ranks)
    more = hits.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = rows.drop("words").join(more, "row", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                      F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
                      F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
