"""License scans as an exact set-similarity join, in DataFrame operations only.

Templates are word sets; a text block matches a template if CONTAINED of the template's words stand together in it: within
SPREAD times as many consecutive words as the template has. Words are ordered by how many documents of the corpus hold them,
rare ones first. A block that may match shares a word of both prefixes (else too few words are left), is long enough, and has
enough words behind the shared word on both sides (the positional filter); what remains is verified by the exact intersection,
and, in a block longer than that stretch, by those of the stretches that begin with one of the template's words. Only the words
that some template has can count, so a block is cut down to these first. Template tables are small and fixed.

One pass reads the texts: it counts words, finds phrases, and keeps the texts, and only those, that as a whole hold enough of
some template's words; the blocks are those texts'. Word counts are over all documents.

Blocks are the lines, and, for notices that are wrapped, the AROUND words on both sides of each line break of a paragraph
(a paragraph ends at a line without words). Of each side a template is sought in as many words as it has itself, and it
counts at a break only if neither side holds enough of it alone.

Phrases that name a license (PHRASES) are found as consecutive words, at every place.

Defined results: null and empty texts have no words and no labels; repeated rows each get their result; a very long text, in
one line too, is searched whole; templates that tie are all found; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spill

CONTAINED = 0.8
#: Words among which a template's may stand, in template lengths.
SPREAD = 2
#: Words taken on each side of a line break at least; or as many as the longest template has, where that is more.
AROUND = 32

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (label, text) of known notices; a caller may pass others.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word before A-Z are lower-cased.
WORD = r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def word_set(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))))


def n_words(text: str) -> int:
    return len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))


def need(size: int, contained: float = CONTAINED) -> int:
    """Words that a block must share with a template of so many."""
    return math.ceil(round(contained * size, 9))


def _quoted(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _lines(order: list[str]) -> str:
    """Each line's words that stand in order, in its order (words), and all its words (line)."""
    tokens = f"regexp_extract_all(translate(l, '{UPPER}', '{LOWER}'), '{WORD}', 0)"
    return rf"transform(transform(split(text, '\n', -1), l -> {tokens}), w -> struct(array_intersect({_quoted(order)}, w) as words, w as line))"


def _breaks(order: list[str], around: int) -> str:
    """Each line break's words that stand in order (words), and those before and behind it (left, right)."""
    apart = r"\\n[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*\\n"
    lines = rf"transform(split(p, '\n', -1), l -> regexp_extract_all(translate(l, '{UPPER}', '{LOWER}'), '{WORD}', 0))"
    ends = f"transform({lines}, t -> struct(slice(t, 1, {around}) as head, slice(t, greatest(1, size(t) - {around - 1}), {around}) as tail))"
    before = f"flatten(slice(e.tail, greatest(1, i - {around - 1}), least(i, {around})))"
    behind = f"slice(flatten(slice(e.head, i + 1, {around})), 1, {around})"
    sides = f"transform(array({before}), b -> struct(slice(b, greatest(1, size(b) - {around - 1}), {around}) as left, {behind} as right))[0]"
    at_breaks = f"transform(array({ends}), e -> if(size(e) < 2, array(), transform(sequence(1, size(e) - 1), i -> {sides})))[0]"
    each = f"flatten(transform(filter(split(text, '{apart}', -1), p -> contains(p, '\n')), p -> {at_breaks}))"
    return f"transform({each}, s -> struct(array_intersect({_quoted(order)}, concat(s.left, s.right)) as words, s.left as left, s.right as right))"


def measured(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """row, doc_id, n_words, places (see scan), has (the templates' words in the text), and text where it may hold a template."""
    words = sorted({w for _, t in templates for w in word_set(t)})
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    x = x.withColumn("w", F.expr(f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}', 0)"))
    x = x.withColumn("has", F.expr(f"array_intersect({_quoted(words)}, w)"))
    named = " or ".join(f"array_contains(w, '{v}')" for v in sorted({p.split()[-1] for p in PHRASES}))
    starts = []
    for phrase, label in PHRASES.items():
        test = " and ".join(f"get(w, i + {k}) = '{v}'" for k, v in enumerate(phrase.split()))
        starts.append(f"transform(filter(sequence(0, size(w) - 1), i -> {test}), i -> struct(i as start, '{label}' as label))")
    places = f"if({named}, array_distinct(concat({', '.join(starts)})), array())"
    may = " or ".join(f"size(array_intersect({_quoted(own)}, has)) >= {need(len(own), contained)}" for own in {tuple(word_set(t)) for _, t in templates})
    return x.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.expr(places).alias("places"), "has", F.expr(f"if({may}, text, null)").alias("text"))


def word_order(rows: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' words, those in the fewest documents of measured rows first."""
    words = sorted({w for _, t in templates for w in word_set(t)})
    counts = {r["word"]: r["count"] for r in rows.select(F.explode("has").alias("word")).groupBy("word").count().collect()}  # a row for each template word at most
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def prefixes(spark: SparkSession, order: list[str], templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """word, at, template, label, size, need, words, length: a row for each word of each template's prefix."""
    rank, rows = {w: k for k, w in enumerate(order)}, []
    for k, (label, text) in enumerate(templates):
        words = sorted(word_set(text), key=rank.__getitem__)
        least = need(len(words), contained)
        rows += [(w, at, k, label, len(words), least, words, n_words(text)) for at, w in enumerate(words[: len(words) - least + 1])]
    return spark.createDataFrame(rows, "word string, at int, template int, label string, size int, need int, words array<string>, length int")


def scan(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, places (array of start, label), found (array of labels of templates), score of every row of docs(doc_id, text)."""
    rows = spill(measured(docs, templates, contained), "licenses")
    order = word_order(rows, templates)
    least = min(need(len(word_set(t)), contained) for _, t in templates)
    around = max(AROUND, *(n_words(t) for _, t in templates))
    none = "cast(array() as array<string>)"
    lines = f"transform({_lines(order)}, b -> struct(b.words as words, b.line as line, {none} as left, {none} as right))"
    breaks = f"transform({_breaks(order, around)}, b -> struct(b.words as words, {none} as line, b.left as left, b.right as right))"
    x = rows.where("text is not null").select("row", F.explode(F.expr(f"filter(concat({lines}, {breaks}), b -> size(b.words) >= {least})")).alias("b"))
    x = x.select("row", F.col("b.words").alias("block"), "b.line", "b.left", "b.right")
    x = x.select("*", F.posexplode(F.expr(f"slice(block, 1, size(block) - {least} + 1)")).alias("block_at", "word"))
    x = x.join(F.broadcast(prefixes(docs.sparkSession, order, templates, contained)), "word")
    x = x.where((F.least(F.size("block") - F.col("block_at"), F.col("size") - F.col("at")) >= F.col("need")) & (F.size("block") >= F.col("need")))
    x = x.withColumns({"left": F.expr("slice(left, greatest(1, size(left) - length + 1), length)"), "right": F.expr("slice(right, 1, length)")})
    wrapped = F.size("left") + F.size("right") > 0
    x = x.withColumn("shared", F.size(F.array_intersect(F.when(wrapped, F.concat("left", "right")).otherwise(F.col("block")), "words"))).where("shared >= need")
    # a longer line holds the template only where one of its stretches does; each row stands for one line, template and shared word
    stretches = F.expr(f"array_max(transform(filter(sequence(0, size(line) - 1), i -> array_contains(words, line[i])), i -> size(array_intersect(words, slice(line, i + 1, {SPREAD} * length)))))")
    x = x.withColumn("shared", F.when(F.size("line") > SPREAD * F.col("length"), stretches).otherwise(F.col("shared")))
    one_side = F.greatest(*(F.size(F.array_intersect(c, "words")) for c in ("left", "right"))) >= F.col("need")
    met = x.where((F.col("shared") >= F.col("need")) & ~one_side).groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("size")).alias("best"))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    rest = rows.where("text is null").select("doc_id", "n_words", "places", F.expr(f"{none} as found"), F.lit(None).cast("double").alias("best"))
    held = rows.where("text is not null").select("row", "doc_id", "n_words", "places").join(met, "row", "left").select("doc_id", "n_words", "places", F.coalesce("found", F.expr(none)).alias("found"), "best")
    return rest.unionByName(held).select("doc_id", "n_words", "places", "found", score.alias("score"))
