"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens stand in one global order, rarest in the corpus first. A block can hold the wanted share of a template
only if it holds one of the template's first few tokens (prefix filter); it must have places of template tokens
enough (length filter), and so must the part of the order from the first token on that both have (positional
filter). Blocks that pass are checked against the template exactly, so every block that meets the threshold is
found. A block may begin at any word: one that begins between template tokens holds no more than the one that
begins at its first, so these are looked at.
The templates are a constant, so each document meets all of them where it lies.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Least share of a template's distinct tokens that a block holds.
THRESHOLD = 0.9

# The base phrases, and the texts that licenses ask for or that name them.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: Column) -> Column:
    """Words in lower case. ``lower`` also changes letters beyond A-Z, which moves no word's bounds, and
    brings none but the Kelvin sign into ASCII, whose letter is in no base phrase."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _tokens(text: str) -> list[str]:
    import re

    return re.findall(TOKEN, text.lower())


def frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each template token stands: as many rows as the templates have tokens."""
    held = F.explode(F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary])))
    return {w: n for w, n in words.select(held.alias("w")).groupBy("w").count().collect()}


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document its words, base places, and the blocks that match templates.

    Blocks are runs of twice a template's length that begin at any of its tokens. ``matches`` lists label, first
    word and containment of every block at or above the threshold; score is the largest, 0 without a match. Base phrases are found by place. Null and
    empty texts have no words; repeated rows are scanned each; other columns are ignored.
    """
    words = docs.select("doc_id", words_of(common.text_or_empty()).alias("words"))
    vocabulary = sorted({w for _, t in templates for w in _tokens(t)})
    seen = frequencies(words, vocabulary)
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    known, prefixes = [], set()
    for label, t in templates:
        ranks = sorted(order.index(w) + 1 for w in set(_tokens(t)))
        need = ceil(threshold * len(ranks) - 1e-9)
        prefix = ranks[: len(ranks) - need + 1]
        prefixes |= set(prefix)
        known.append(F.struct(F.lit(label).alias("label"), F.lit(len(_tokens(t))).alias("n"), F.lit(need).alias("need"), _longs(prefix).alias("prefix"), _longs(ranks).alias("tokens")))
    template, ordered, first = F.array(*known), _array(order), _array([order[r - 1] for r in sorted(prefixes)])

    found = F.filter(F.transform("words", lambda w, i: F.struct(F.array_position(ordered, w).alias("rank"), i.alias("i"))), lambda x: x["rank"] > 0)
    # prefix filter: a text without the rare tokens of a template has no block of it, whatever else it holds
    rare = lambda t: F.exists("found", lambda x: F.array_contains(t["prefix"], x["rank"]))
    places = lambda t: F.when(rare(t), F.filter("found", lambda x: F.array_contains(t["tokens"], x["rank"]))).otherwise(F.slice("found", 1, 0))
    placed = F.transform(template, lambda t: F.struct(*[t[c].alias(c) for c in ("label", "n", "need", "prefix", "tokens")], places(t).alias("places")))

    def block(t: Column, p: Column, k: Column) -> Column:
        within = F.filter(F.slice(t["places"], k + 1, 2 * t["n"]), lambda q: q["i"] < p["i"] + 2 * t["n"])
        return F.struct(t["label"].alias("label"), t["need"].alias("need"), t["prefix"].alias("prefix"), t["tokens"].alias("tokens"), p["i"].alias("first"), F.array_distinct(F.transform(within, lambda q: q["rank"])).alias("block"))

    # length filter: so many places must lie within a block's reach
    reached = F.transform("places_of", lambda t: F.filter(F.transform(t["places"], lambda p, k: F.when(F.get(t["places"], k + t["need"] - 1)["i"] < p["i"] + 2 * t["n"], block(t, p, k))), lambda c: c.isNotNull()))
    near = F.flatten(reached)
    # positional filter: template and block share nothing before the first token of the prefix that the block has,
    # so what either has from there on bounds what they share
    shared = F.transform("near", lambda c: F.struct(c["label"].alias("label"), c["first"].alias("first"), c["need"].alias("need"), c["tokens"].alias("tokens"), c["block"].alias("block"), F.array_min(F.array_intersect(c["block"], c["prefix"])).alias("shared")))
    both = F.filter("shared", lambda c: F.least(F.size(F.filter(c["block"], lambda r: r >= c["shared"])), F.size(F.filter(c["tokens"], lambda r: r >= c["shared"]))) >= c["need"])
    checked = F.transform(both, lambda c: F.struct(c["label"].alias("label"), c["first"].alias("first"), (F.size(F.array_intersect(c["block"], c["tokens"])) / F.size(c["tokens"])).alias("containment")))
    none = F.from_json(F.lit("[]"), "array<struct<label:string,first:int,containment:double>>")
    out = words.withColumns({"joined": F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), "found": F.when(F.arrays_overlap("words", first), found)})
    out = out.withColumn("places_of", F.when(F.size("found") > 0, placed)).withColumn("near", near)
    out = out.withColumn("shared", F.when(F.size("near") > 0, shared)).withColumn("matches", F.coalesce(F.filter(checked, lambda m: m["containment"] >= threshold - 1e-9), none))

    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        has, padded = F.contains(F.col("joined"), F.lit(f" {phrase} ")), f" {phrase} "
        counts.append(F.when(has, F.regexp_count("joined", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(F.lit(0)))
        firsts.append(F.when(has, spaces(F.substring_index("joined", padded, 1))))
        lasts.append(F.when(has, F.size("words") - spaces(F.substring_index("joined", padded, -1)) - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    return out.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
        "matches",
    )


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _longs(ranks: list[int]) -> Column:
    return F.array(*[F.lit(r).cast("long") for r in ranks])


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License blocks and base phrases of every whole document."""
    return scan(common.table(spark, sf_dir, "documents")).drop("matches")
