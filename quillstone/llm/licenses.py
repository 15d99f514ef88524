"""License scan: an exact set-similarity join of text blocks with license templates, and exact phrases.

The words of the whole text, whatever their lines, are cut into blocks: for templates of up to c words (c: the powers of two
from LEAST_SPAN on), windows of 2 c words, one every c words. So each run of c + 1 words lies in a block, however it is
wrapped, and a short template isn't looked for in a long block. A block matches a template of its span if it contains
CONTAINMENT of the template's distinct words or more. Template words are ordered by how many documents hold them, rarest
first. A matching block must hold one of the first m - need + 1 words of the template (prefix filter), at least `need`
template words (length filter), and enough of them from the shared word on (positional filter); survivors are compared
exactly.

Everything is DataFrame functions. The templates are a fixed list, so their table is broadcast; document counts are made
for the template words only, over all documents.

Defined cases: null text is the empty text; without words all counts are 0, places null and labels empty; repeated rows
each give a row; an empty table gives an empty one; only the id and text columns are read.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Workspace, lower_ascii, spread

# Phrases with their labels, and opening words of public licenses.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = [
    ("agpl", "gnu affero general public license"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "licensed under the apache license"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("public-domain", "dedicated to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]
CONTAINMENT = 0.9
LEAST_SPAN = 8

_NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = f"[^{_NOT_WORD}]+"
GAP = f"[{_NOT_WORD}]+"


def need(m: int) -> int:
    """Words of a template of m distinct words that a block must contain."""
    return ceil(CONTAINMENT * m - 1e-9)


def span(template: str) -> int:
    """The least power of two from LEAST_SPAN on that the template's words don't exceed."""
    return max(LEAST_SPAN, 1 << (len(template.split()) - 1).bit_length())


def words(text: Column) -> Column:
    """The words of a lower-cased text."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text))


def phrase_places(low: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of a phrase in the lower-cased text, and its first and last starting word."""
    parts = phrase.split()
    pieces = F.when(F.contains(low, F.lit(parts[0])) & F.contains(low, F.lit(parts[-1])), F.split(low, f"(?<!{WORD[:-1]})" + GAP.join(parts) + f"(?!{WORD[:-1]})")).otherwise(F.array(low))
    count = F.size(pieces) - 1
    first = F.when(count > 0, count_words(F.element_at(pieces, 1)))
    last = F.when(count > 0, n_words - count_words(F.element_at(pieces, -1)) - len(parts))
    return count, first, last


def document_counts(docs: DataFrame, tokens: list[str], text_col: str) -> dict[str, int]:
    """In how many documents each of `tokens` is; tokens is a fixed list, so the answer is as short."""
    held = F.array_intersect(words(lower_ascii(F.coalesce(F.col(text_col), F.lit("")))), F.array(*map(F.lit, tokens)))
    rows = docs.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()
    return {t: 0 for t in tokens} | {r["token"]: r["n"] for r in rows}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels and method_labels (sorted arrays), and score.

    score: the largest part of a matched template that a block contains; 1 where a phrase stands; else 0.
    """
    spark, docs = docs.sparkSession, spread(docs.select(id_col, text_col))
    everything = sorted({w for _, t in templates for w in t.split()})
    counts = document_counts(docs, everything, text_col)
    order = {w: k for k, w in enumerate(sorted(everything, key=lambda w: (counts[w], w)))}
    rows, prefixes = [], {}
    for number, (label, template) in enumerate(templates):
        own, c = sorted(set(template.split()), key=order.__getitem__), span(template)
        m, least = len(own), need(len(own))
        for at in range(m - least + 1):
            prefixes.setdefault(c, set()).add(own[at])
            rows.append((c, own[at], number, label, own, m, least, m - at))
    table = F.broadcast(spark.createDataFrame(rows, "span int, token string, template int, label string, own array<string>, m int, least int, rest int"))
    ordered = F.array(*map(F.lit, sorted(everything, key=order.__getitem__)))

    low = docs.select(F.col(id_col).alias("id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    split = low.select("id", "low", words(F.col("low")).alias("words"))
    base = [phrase_places(F.col("low"), F.size("words"), p) for p in PHRASES]

    def blocks_of(c: int) -> Column:
        """The template words of each block that holds one of a prefix, in the global order."""
        prefix = F.array(*map(F.lit, sorted(prefixes[c])))
        held = F.filter(windows_of(F.col("words"), c), lambda w: F.arrays_overlap(w, prefix))
        made = F.transform(held, lambda w: F.struct(F.lit(c).alias("span"), F.array_intersect(ordered, w).alias("held")))
        return F.when(F.arrays_overlap("words", prefix), made).otherwise(F.array().cast("array<struct<span:int,held:array<string>>>"))

    found = split.select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.size("words").cast("long").alias("n_words"),
        sum((c for c, _, _ in base), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(f for _, f, _ in base)).cast("long").alias("first_word"),
        F.greatest(*(x for _, _, x in base)).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*(F.when(c > 0, F.lit(label)) for (c, _, _), label in zip(base, PHRASES.values()))))).alias("base_labels"),
        F.concat(*map(blocks_of, sorted(prefixes))).alias("blocks"),
    )
    found = Workspace(spark, "licenses").keep(found, "found")  # the row number must not change between the two uses below
    keys = ["row", "id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    blocks = found.where("size(blocks) > 0").select("row", F.explode("blocks").alias("block")).select("row", "block.*")
    hits = blocks.select("row", "span", "held", F.posexplode("held").alias("at", "token")).join(table, ["span", "token"])
    hits = hits.where((F.size("held") >= F.col("least")) & (F.least(F.col("rest"), F.size("held") - F.col("at")) + (F.col("m") - F.col("rest")) >= F.col("least")))
    part = F.size(F.array_intersect("own", "held"))
    matched = hits.where(part >= F.col("least")).groupBy("row").agg(F.collect_set("label").alias("found"), F.max(part / F.col("m")).alias("part"))
    out = found.select(*keys).join(matched, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        *keys[2:],
        F.array_sort(F.coalesce("found", F.array().cast("array<string>"))).alias("method_labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
    )


def windows_of(run: Column, c: int) -> Column:
    """Blocks of 2 c words, one every c words; a shorter text is one."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(run) / c).cast("int") - 2))
    return F.transform(starts, lambda k: F.slice(run, k * c + 1, 2 * c))
