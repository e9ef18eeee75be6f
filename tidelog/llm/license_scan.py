"""License scans by an exact set-similarity join.

A text block (a sentence, across single line ends) carries a license where it holds
at least ``threshold`` of the distinct words of a license template, among them those
that tell it from its like; of a block's templates the best count. Words are ordered
by how many documents hold them, rarest first, in templates and blocks. A block that
meets the threshold for a template of n words, of which it must hold a, holds one of
the template's first n - a + 1 words in that order (the prefix); so only blocks with a
prefix word meet templates, in an equi-join on that word. At the first such word the
block must have a words of the vocabulary left (the length and positional filters);
what then remains is counted exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices that are searched as words in a row, and the label of each.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences of license texts and notices as published, the label of each, and words that a block must have.
TEMPLATES = {
    "Licensed under the Apache License, Version 2.0": ("apache-2.0", ("apache",)),
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": ("apache-2.0", ()),
    "You may not use this file except in compliance with the License": ("apache-2.0", ("compliance",)),
    "Released under the MIT License": ("mit", ("mit",)),
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": ("mit", ()),
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": ("mit", ()),
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": ("mit", ()),
    "This work is licensed under the GNU General Public License, version 3": ("gpl-3.0", ("gnu", "3")),
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": ("gpl", ("gnu", "general")),
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": ("gpl", ("hope",)),
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": ("lgpl", ("lesser",)),
    "Licensed under CC BY 4.0": ("cc-by", ("cc", "by")),
    "Licensed under CC BY-NC 4.0": ("cc-by-nc", ("cc", "nc")),
    "Licensed under CC BY-SA 4.0": ("cc-by-sa", ("cc", "sa")),
    "This work is licensed under a Creative Commons Attribution 4.0 International License": ("cc-by", ("creative", "attribution")),
    "Redistribution and use in source and binary forms, with or without modification, are permitted": ("bsd", ("redistribution",)),
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": ("bsd", ("redistributions",)),
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": ("bsd", ("redistributions",)),
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": ("bsd-3-clause", ("endorse",)),
    "This Source Code Form is subject to the terms of the Mozilla Public License": ("mpl", ("mozilla",)),
    "If a copy of the MPL was not distributed with this file, You can obtain one at": ("mpl", ("mpl",)),
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": ("isc", ("fee",)),
    "This is free and unencumbered software released into the public domain": ("unlicense", ("unencumbered",)),
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": ("unlicense", ()),
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": ("bsl-1.0", ("organization",)),
}
#: Templates with at most so many words in all are broadcast (some 50 MB); more are joined by a shuffle.
BROADCAST_WORDS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """The words of a text: runs of a-z, 0-9 and non-ASCII, A-Z lower-cased; an empty string may stand first and last.

    The Kelvin sign is the one other character that lower() would turn into a
    letter of a-z alone, so it is kept from it.
    """
    return F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("\ue000"))), NOT_WORD)


def text_blocks(text: Column) -> Column:
    """Sentences: cut at blank lines, and at white space after . ! or ? A single line end is a space."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+|\n[ \t\r]*\n", "$1\n\n"), "\n\n")


def _plain_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text.lower()).split()


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, tuple[str, Sequence[str]]] = TEMPLATES, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    n_base counts all places where a phrase's words stand in a row, first_word
    and last_word are the first and last such place (words from 0; null if there
    is none). labels has the phrases' labels and those of the best templates of
    each block: those of which it holds the largest share, at least
    ``threshold``, of the distinct words, and of equal shares the longest
    (n_blocks: pairs of a block and a best template). score is the largest such
    share, 1 with any phrase, 0 with nothing. Null texts count as empty; repeated
    rows and null keys keep a row each; an empty table gives an empty result.
    Templates are text: (label, words that must be there); they are broadcast
    only if small.
    """
    spark = docs.sparkSession
    own = {t: list(dict.fromkeys(_plain_words(t))) for t in templates}
    vocabulary = sorted({w for ws in own.values() for w in ws})
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), split_words(F.col(text)).alias("all"))

    # How many documents hold each word of a template; at most one row per such word comes back.
    held = rows.select(F.explode_outer(F.array_intersect("all", strings(vocabulary))).alias("word")).where("word is not null")
    count = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    table, prefix = [], []
    for name, (t, ws) in enumerate(own.items()):
        need = ceil(round(threshold * len(ws), 9))
        label, must = templates[t]
        ws = sorted(ws, key=rank.__getitem__)
        table.append((name, label, ws, [w.lower() for w in must], need))
        prefix += [(w, name) for w in ws[: len(ws) - need + 1]]
    small = sum(map(len, own.values())) <= BROADCAST_WORDS
    table = spark.createDataFrame(table, "template int, label string, words array<string>, must array<string>, need int")
    first = spark.createDataFrame(prefix, "word string, template int").join(F.broadcast(table) if small else table, "template")
    starts = sorted({w for w, _ in prefix})

    # Blocks of documents with a prefix word, as words of the vocabulary in the order, then the equi-join on prefix words.
    some = F.when(F.arrays_overlap("all", strings(starts)), text_blocks(F.col("text")))
    blocks = F.filter(F.transform(some, lambda b: F.array_intersect(strings(order), split_words(b))), lambda b: F.arrays_overlap(b, strings(starts)))
    places = [F.when(F.array_contains("all", p.split()[0]), _places(F.col("all"), p.split())).otherwise(F.array().cast("array<int>")).alias(f"p{i}") for i, p in enumerate(phrases)]
    base = rows.select(F.monotonically_increasing_id().alias("n"), "id", "all", blocks.alias("blocks"), *places).select("n", "id", "blocks", *_found(phrases))
    base = base.withColumn("blocks", F.when(F.size("blocks") > 0, F.col("blocks")))

    found = base.select("*", F.posexplode_outer("blocks").alias("block", "held")).drop("blocks")
    found = found.select("*", F.posexplode_outer("held").alias("at", "word"))
    found = found.join(F.broadcast(first) if small else first.hint("shuffle_hash"), "word", "left")
    reach = F.size("held") - F.col("at") >= F.col("need")  # words of the vocabulary from here on; fewer can't reach it if this is the first in common
    share = F.when(reach & (F.size(F.array_intersect("must", "held")) == F.size("must")), F.size(F.array_intersect("held", "words")))
    hit = F.when(share >= F.col("need"), F.struct("block", "template", "label", (share / F.size("words")).alias("share"), F.size("words").alias("n")))
    kept = ["n", "id", "n_words", "n_base", "first_word", "last_word", "base"]
    out = found.groupBy(*kept).agg(F.collect_set(hit).alias("hits"))
    better = lambda x, y: (x["block"] == y["block"]) & ((x["share"] > y["share"]) | ((x["share"] == y["share"]) & (x["n"] > y["n"])))
    out = out.withColumn("hits", F.filter("hits", lambda y: ~F.exists("hits", lambda x: better(x, y))))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("hits", lambda h: h["label"]))))
    return out.select(
        F.col("id").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0))).alias("score"),
        F.size("hits").cast("long").alias("n_blocks"),
    )


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the words of a phrase stand in a row."""

    def fits(at: Column) -> Column:
        return F.coalesce(F.array_join(F.slice(words, at + 1, len(phrase)), " ") == " ".join(phrase), F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda at: F.when(F.get(words, at) == phrase[0], fits(at)).otherwise(False))


def _found(phrases: Mapping[str, str]) -> list[Column]:
    """Of the columns all and p0, p1 ... (places of each phrase): n_words, n_base, first_word, last_word, base (labels in order)."""
    words = F.col("all")
    lead = (F.get(words, F.lit(0)) == "").cast("int")
    tail = ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    at = F.flatten(F.array(*[F.col(f"p{i}") for i in range(len(phrases))]))
    labels = F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(x)) for i, x in enumerate(phrases.values())]), lambda x: x.isNotNull())
    return [(F.size(words) - lead - tail).cast("long").alias("n_words"), F.size(at).cast("long").alias("n_base"), (F.array_min(at) - lead).cast("long").alias("first_word"), (F.array_max(at) - lead).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base")]
