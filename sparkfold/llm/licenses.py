"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line and, as notices are often wrapped, the lines that follow it within its paragraph,
up to the one that completes the number of words of the longest template. So every run of words as
long as a template lies whole in the block of the line that it begins in. A block contains a
template to the degree |block words in template| / |template words|.
All pairs of at least ``threshold`` are found without comparing every block with every template.
Words are put in order of their frequency over the whole corpus, rarest first. A block that holds
ceil(threshold * m) of a template's m words must hold one of its first m - ceil(threshold * m) + 1
words (prefix filter), so only these are joined. A pair also needs a block of enough distinct words
(length filter) and, at the place where the two prefixes first meet, enough words left on both sides
(positional filter). What passes is verified. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SEPARATORS, row_key

#: The separators without the line feed.
LINE_SEPARATORS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]"

#: Phrases that are found word by word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: License statements and their labels.
TEMPLATES = {
    "This work is licensed under the GNU General Public License": "gpl-notice",
    "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License": "gpl-notice",
    "Licensed under CC BY": "creative-commons",
    "This work is licensed under a Creative Commons Attribution International License": "creative-commons",
    "Licensed under CC BY NC": "cc-by-nc",
    "Licensed under CC BY SA": "cc-by-sa",
    "Released under the MIT License": "mit",
    "Permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "Licensed under the Apache License Version": "apache",
    "Redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl",
    "All rights reserved": "all-rights-reserved",
    "To the extent possible under law the author has waived all copyright and related rights to this work": "cc0",
    "This is free and unencumbered software released into the public domain": "unlicense",
}


def spaced_words(text: Column) -> Column:
    """A-Z lower-cased, then the words joined by single spaces. lower() changes no other letter into
    or out of a separator, and no ASCII letter of the phrases has a further capital but k."""
    return F.trim(F.regexp_replace(F.lower(text), F.lit(f"{SEPARATORS}+"), F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def with_phrases(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word (long) and base (sorted distinct labels).

    Each word gets a space on both sides, so a phrase is a substring and its places can't overlap:
    no phrase here begins with a word that it ends with.
    """
    docs = docs.withColumn("_words", spaced_words(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    docs = docs.withColumn("_apart", F.concat(F.lit(" "), F.replace("_words", F.lit(" "), F.lit("  ")), F.lit(" ")))
    docs = docs.withColumn("n_words", F.when(F.col("_words") == "", 0).otherwise(_spaces(F.col("_words")) + 1).cast("long"))
    marks = {p: F.lit(" " + p.replace(" ", "  ") + " ") for p in phrases}
    docs = docs.withColumns({f"_has{i}": F.contains("_apart", m) for i, m in enumerate(marks.values())})
    counts, firsts, lasts, labels = [], [], [], []
    for i, (p, mark) in enumerate(marks.items()):
        has, apart = F.col(f"_has{i}"), F.col("_apart")
        counts.append(F.when(has, ((F.octet_length(apart) - F.octet_length(F.replace(apart, mark, F.lit("")))) / F.octet_length(mark)).cast("long")).otherwise(0))
        firsts.append(F.when(has, (_spaces(F.substring_index(apart, " " + p.replace(" ", "  ") + " ", 1)) / 2).cast("long")))
        lasts.append(F.when(has, F.col("n_words") - (_spaces(F.substring_index(apart, " " + p.replace(" ", "  ") + " ", -1)) / 2).cast("long") - len(p.split())))
        labels.append(F.when(has, F.lit(phrases[p])))
    out = {
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": F.least(*firsts) if len(firsts) > 1 else firsts[0],
        "last_word": F.greatest(*lasts) if len(lasts) > 1 else lasts[0],
        "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }
    return docs.withColumns(out).drop("_words", "_apart", *[f"_has{i}" for i in range(len(marks))])


def template_words(templates: dict[str, str] = TEMPLATES) -> list[tuple[int, str, list[str]]]:
    return [(i, label, sorted(set(t.lower().split()))) for i, (t, label) in enumerate(templates.items())]


def blocks(docs: DataFrame, key: list, text: str, longest: int, wanted: list[str]) -> DataFrame:
    """One row per line with words that begins a block with one of the wanted words: the key, block (the
    line, from 0) and words, its distinct words.

    A block has a line's words and those of the lines after it, while these have fewer than ``longest``
    words in all and none is blank. Texts without a wanted word are not cut into lines. The explosion is
    an outer one: of an inner one the optimiser infers that there are blocks, and pushes that condition, with
    all of the cutting in it once for every line, down to the scan.
    """
    known = F.array(*map(F.lit, wanted))
    docs = docs.select(*key, F.regexp_replace(F.lower(F.col(text)), F.lit(f"{LINE_SEPARATORS}+"), F.lit(" ")).alias("_clean"))
    docs = docs.filter(F.arrays_overlap(F.split(F.translate("_clean", "\n", " "), " "), known))
    names = [c for c in docs.columns if c != "_clean"]
    docs = docs.select(*names, F.transform(F.split("_clean", "\n"), lambda x: F.filter(F.split(x, " "), lambda w: w != "")).alias("_lines"))

    def step(block: Column, line: Column) -> Column:
        more = block["open"] & (F.size(line) > 0) & (block["n"] < longest)
        return F.struct(F.when(more, F.concat(block["words"], line)).otherwise(block["words"]).alias("words"), (block["n"] + F.size(line)).alias("n"), more.alias("open"))

    def block(i: Column) -> Column:
        first = F.element_at("_lines", i + 1)
        whole = F.aggregate(F.slice("_lines", i + 2, F.lit(longest)), F.struct(first.alias("words"), F.lit(0).alias("n"), F.lit(True).alias("open")), step, lambda b: b["words"])
        return F.when(F.size(first) > 0, F.array_distinct(whole))

    docs = docs.select(*names, F.transform(F.sequence(F.lit(0), F.size("_lines") - 1), block).alias("_blocks"))
    return docs.select(*names, F.posexplode_outer("_blocks").alias("block", "words")).filter(F.arrays_overlap("words", known))


def template_matches(docs: DataFrame, key: tuple, text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """Every (block, template) of containment at least threshold: key columns, block, label, containment.

    The join's smaller side has the templates' prefixes, a constant of the program, and is broadcast.
    Word frequencies are counted over all documents; only words of templates need one.
    """
    spark, parts = docs.sparkSession, template_words(templates)
    vocabulary = sorted({w for *_, words in parts for w in words})
    known = F.array(*map(F.lit, vocabulary))
    present = F.array_intersect(F.split(spaced_words(F.col(text)), " "), known)
    seen = dict(docs.select(F.explode(present).alias("w")).groupBy("w").count().collect())  # no more rows than words of templates
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    rows, prefixes = [], set()
    for i, label, words in parts:
        need = math.ceil(threshold * len(words) - 1e-9)
        ordered = sorted(words, key=order.get)
        for place, w in enumerate(ordered[: len(words) - need + 1]):
            rows.append((w, i, label, place, need, ordered))
            prefixes.add(w)
    schema = T.StructType.fromDDL("token string, template int, label string, place int, need int, template_words array<string>")
    side = F.broadcast(spark.createDataFrame(rows, schema).coalesce(1))

    ranked = F.array(*map(F.lit, sorted(vocabulary, key=order.get)))
    longest = max((len(t.split()) for t in templates), default=0)
    found = blocks(docs, list(key), text, longest, sorted(prefixes))
    found = found.withColumn("n", F.size("words")).withColumn("words", F.array_intersect(ranked, "words"))
    names = [c for c in found.columns if c not in ("words", "n")]
    tokens = found.select("*", F.posexplode("words").alias("at", "token"))
    pairs = tokens.join(side, "token")
    pairs = pairs.filter(F.col("n") >= F.col("need"))
    left = F.least(F.size("template_words") - F.col("place"), F.size("words") - F.col("at"))
    met = F.size(F.array_intersect(F.slice("words", 1, F.col("at")), F.slice("template_words", 1, F.col("place"))))
    pairs = pairs.filter((F.col("at") + 1 <= F.size("words")) & (met == 0) & (left >= F.col("need")))  # a pair is verified once, where the prefixes first meet
    overlap = F.size(F.array_intersect("words", "template_words"))
    pairs = pairs.withColumn("containment", overlap / F.size("template_words")).filter(overlap >= F.col("need"))
    return pairs.select(*names, "template", "label", "containment")


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels), labels, score, per row of docs.

    labels has base and template labels; score is 1 with a phrase, else the largest containment, else
    0. A null text counts as empty: no words, no labels. A text of any length is scanned whole. A
    null doc_id is kept. Rows equal in doc_id and text share their labels and are returned each; where
    several blocks or templates tie, all their labels count. An empty table gives no rows; other columns are
    ignored.
    """
    mine = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    key = row_key(mine)
    whole = with_phrases(mine.select(*key, "text"))
    matches = template_matches(mine, key, "text", templates, threshold)
    matches = matches.groupBy("doc_id", "_h1", "_h2").agg(F.collect_set("label").alias("more"), F.max("containment").alias("top"))
    matches = matches.select(F.col("doc_id").alias("_id"), F.col("_h1").alias("_x"), F.col("_h2").alias("_y"), "more", "top")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_x")) & (F.col("_h2") == F.col("_y"))
    joined = whole.drop("text").join(matches, same, "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("top", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", labels.alias("labels"), score.alias("score"))
