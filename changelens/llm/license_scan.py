"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.quality_rules import let
from changelens.llm.scratch import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
# Phrases with their labels, and license notices with theirs.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "agpl-notice": "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "artistic-2.0": "You can redistribute it under the terms of the Artistic License 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0",
    "cc-by-4.0": "Licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "gfdl": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "You can redistribute it and/or modify it under the terms of the GNU General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-notice": "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-warranty": "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "odbl": "This database is made available under the Open Database License",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
}


def template_tokens(templates: dict[str, str]) -> dict[str, list[str]]:
    return {label: sorted(set(re.findall(WORD + "+", text.lower()))) for label, text in templates.items()}


def lowered(text: Column) -> Column:
    """Lower case for the letters A-Z; other letters may change, but none turns into one of a-z."""
    kelvin = "\u212a"  # the sign of the unit, whose lower case is the letter k
    return F.lower(F.when(text.contains(kelvin), F.translate(text, kelvin, "\u00c5")).otherwise(text))


def known_words(docs: DataFrame, known: list[str], *, id_col: str, text_col: str) -> DataFrame:
    """(row_id, doc_id, n_words, hits): of each whole text, how many words it has, and the place (from 0) and word of each known one."""
    words = F.array_remove(F.split(lowered(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS), "")
    places = lambda w: F.filter(F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("token"))), lambda h: h["token"].isin(known))
    found = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), places(w).alias("hits")))
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), found.alias("found")).select("row_id", "doc_id", "found.*")


def phrase_starts(hits: Column, phrase: str) -> Column:
    """Where a phrase's words stand one behind the other. All of its words are known ones, so they are neighbours in hits."""
    words = phrase.split()

    def stands(h: Column, k: Column) -> Column:
        test = h["token"] == words[0]
        for i, word in enumerate(words[1:], start=1):
            other = F.get(hits, k + i)
            test &= F.coalesce((other["token"] == word) & (other["at"] == h["at"] + i), F.lit(False))
        return test

    return F.transform(F.filter(hits, stands), lambda h: h["at"])


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    threshold: float = 0.9,
    block_words: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """(rows, matches). rows: each document's words and phrase places. matches: every block that holds a template.

    A block is a run of block_words words; the next begins half a block later, so a notice of up to half a block lies
    whole in one. A block B holds a template T where |B and T| >= threshold * |T|, as sets of words. Tokens are
    ordered by how many documents have them, the rarest first. A pair that meets the threshold with overlap o shares
    its first common token within the first |T| - o + 1 tokens of T and |B| - o + 1 of B, so blocks and templates are
    joined on those prefix tokens, if B is long enough and the tokens behind the shared one can still make up o; the
    pairs found are confirmed on whole sets. Words outside all templates can't add to an overlap and are left out of
    B's order. A text without any template's prefix token holds none and is not cut into blocks.

    A text is split into words once; of these only the known ones, of templates and phrases, are kept, with their
    places. A null text counts as empty and has no block. Repeated rows each have their own row_id. An empty table
    gives two empty results, an empty set of templates no match. Templates are a parameter of tens of lines; their tables are broadcast.
    """
    spark = docs.sparkSession
    tokens = template_tokens(TEMPLATES if templates is None else templates)
    need = {label: math.ceil(threshold * len(t) - 1e-9) for label, t in tokens.items()}
    vocabulary = sorted(set().union(*tokens.values()))
    known = sorted({*vocabulary, *(word for phrase in PHRASES for word in phrase.split())})
    rows = written(known_words(docs, known, id_col=id_col, text_col=text_col), "license-words")
    # Documents that have each token, over all of them; a token that none has is the rarest.
    seen = rows.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["token"]))).alias("token")).groupBy("token").count()
    vocabulary_rows = spark.createDataFrame([(t,) for t in vocabulary], "token string")
    order = written(
        vocabulary_rows.join(F.broadcast(seen), "token", "left").select("token", F.coalesce("count", F.lit(0)).alias("n_docs")), "license-order"
    )
    template_rows = spark.createDataFrame([(label, t, need[label]) for label, t in tokens.items()], "label string, tokens array<string>, need int")
    ranked = lambda df, *keys: (
        df.withColumn("token", F.explode("tokens"))
        .join(F.broadcast(order), "token")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("n_docs", "token"))).alias("ranked"))
    )
    prefixes = (
        ranked(template_rows, "label", "need")
        .select("label", "need", F.size("ranked").alias("t_size"), F.posexplode("ranked").alias("t_pos", "x"))
        .filter("t_pos <= t_size - need")
        .select("label", "need", "t_size", "t_pos", "x.token")
    )
    prefixes = written(prefixes, "license-prefixes")
    first = F.lit([r["token"] for r in prefixes.select("token").distinct().collect()] or [""])
    step = block_words // 2
    # A word lies in the block that begins at its multiple of step, if there is one, and in the one before.
    last = F.floor(F.greatest(F.col("n_words") - 1 - step, F.lit(0)) / step)
    own = F.floor(F.col("h.at") / step)
    blocks = (
        rows.filter(F.arrays_overlap(F.transform("hits", lambda h: h["token"]), first))
        .select("row_id", "n_words", F.explode("hits").alias("h"))
        .filter(F.col("h.token").isin(vocabulary))
        .select("row_id", last.alias("last"), F.explode(F.array(own, own - 1)).alias("block"), F.col("h.token").alias("token"))
        .filter("block between 0 and last")
        .groupBy("row_id", "block")
        .agg(F.collect_set("token").alias("tokens"))
        .filter((F.size("tokens") >= min(need.values(), default=0)) & F.arrays_overlap("tokens", first))
    )
    matches = (
        ranked(blocks, "row_id", "block")
        .select("row_id", "block", F.size("ranked").alias("b_size"), "ranked", F.posexplode("ranked").alias("b_pos", "x"))
        .select("row_id", "block", "b_size", "b_pos", F.transform("ranked", lambda x: x["token"]).alias("b_tokens"), "x.token")
        .join(F.broadcast(prefixes), "token")
        .filter("b_size >= need and b_pos <= b_size - need")
        .filter("1 + least(t_size - t_pos - 1, b_size - b_pos - 1) >= need")
        .dropDuplicates(["row_id", "block", "label"])
        .join(F.broadcast(template_rows.select("label", "tokens")), "label")
        .withColumn("overlap", F.size(F.array_intersect("b_tokens", "tokens")))
        .filter("overlap >= need")
        .select("row_id", "block", "label", (F.col("overlap") / F.col("t_size")).alias("containment"))
    )
    return base_places(rows), matches


def base_places(rows: DataFrame) -> DataFrame:
    """rows(row_id, doc_id, n_words, hits) with n_base, first_word, last_word and base, the sorted labels of the phrases found."""
    starts = F.array(*(F.struct(F.lit(label).alias("label"), phrase_starts(F.col("hits"), phrase).alias("at")) for phrase, label in PHRASES.items()))
    found = F.col("starts")
    every = F.flatten(F.transform(found, lambda s: s["at"]))
    labels = F.array_sort(F.transform(F.filter(found, lambda s: F.size(s["at"]) > 0), lambda s: s["label"]))
    return rows.select("row_id", "doc_id", "n_words", starts.alias("starts")).select(
        "row_id",
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        labels.alias("base"),
    )


def license_labels(docs: DataFrame, **options) -> DataFrame:
    """One row a document: words, phrase places and labels. See scan_licenses for nulls, repeats and empty tables.

    score is 1 where a phrase stands, else the best containment of a template, else 0.
    """
    rows, matches = scan_licenses(docs, **options)
    by_row = matches.groupBy("row_id").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    none = F.array().cast("array<string>")
    return rows.join(by_row, "row_id", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
