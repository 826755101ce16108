"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of every text is joined by hash to its positions in license templates.
A passage that follows a template gives votes on one diagonal (template position less text
position); a word added or lost moves them to a neighbouring one.  Votes are counted by diagonal,
neighbouring diagonals are merged, and a merged span is verified: its grams equal the template's
word for word, cover enough of the template, and stand densely in the span of the text.  Of
templates that claim overlapping spans (the GPL family shares most of its notice) the best covered
ones stay.

Votes belong to a row, by a number written with it before the grams are sent out, so rows that
share a doc_id or have none keep their own labels.

A word is a run of bytes outside ASCII but digits and small letters, after lowering A-Z (and no
other character: a Kelvin sign is not a k).

Templates are a table (label, text); :data:`TEMPLATES` is the one used by default and says which
licenses are known: those of :data:`PHRASES` and the labels listed there, nothing else.

Edge cases: a null text has no words, labels are then empty and the positions null; texts are
read whole; repeated rows and null doc_ids stay rows of their own; no templates leave the phrases
alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.workspace import materialize

GRAM = 3
#: Diagonals at most so far apart are one passage.
NEIGHBOUR = 2
#: Share of a template's grams that a verified passage covers at least.
LEAST_COVER = 0.6
#: Share of the grams of a verified passage's text that are the template's, at least.
LEAST_DENSITY = 0.5
#: Template grams up to which texts are filtered by their hashes before any gram leaves its row.
FILTER_GRAMS = 20_000
#: Template grams (about 60 bytes each) up to which their table is broadcast.
BROADCAST_GRAMS = 500_000

# Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Wording of public license notices.
TEMPLATES = [
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("artistic-2.0", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa-3.0", "Text is available under the Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("gfdl-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS), "")


def grams_at(words: Column, starts: Column, k: int) -> Column:
    """The grams of ``words`` at ``starts``, as structs (pos, gram)."""
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]).alias("gram")))


def all_starts(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))


def template_grams(spark: SparkSession, templates: DataFrame | list[tuple[str, str]], k: int) -> DataFrame:
    """(template, label, tpos, size, own, hash) of every gram of ``templates(label, text)``."""
    table = templates if isinstance(templates, DataFrame) else spark.createDataFrame(templates, "label string, text string")
    split = table.select(F.monotonically_increasing_id().alias("template"), "label", words_of(F.col("text")).alias("words"))
    grams = split.select("template", "label", F.explode(grams_at(F.col("words"), all_starts(F.col("words"), k), k)).alias("g"), (F.size("words") - k + 1).alias("size"))
    rows = grams.select("template", "label", F.col("g.pos").alias("tpos"), "size", F.col("g.gram").alias("own"))
    return materialize(rows.withColumn("hash", _gram_hash(F.split("own", " "), F.lit(0), k)), "license-templates")


def _gram_hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def shared_grams(words: Column, table: DataFrame, count: int, k: int) -> Column:
    """The grams of a row to send out.  While the templates are few, only those whose hash is a
    template gram's: the set of hashes travels with the plan."""
    starts = all_starts(words, k)
    if count <= FILTER_GRAMS:
        hashes = [r[0] for r in table.select("hash").distinct().collect()]
        starts = F.filter(starts, lambda i: _gram_hash(words, i, k).isin(hashes)) if hashes else F.filter(starts, lambda i: F.lit(False))
    return grams_at(words, starts, k)


def votes(rows: DataFrame, table: DataFrame, count: int, k: int) -> DataFrame:
    """(row, template, label, size, diagonal, tpos) of every gram of ``rows(row, grams)`` that stands in a template."""
    grams = rows.select("row", F.explode("grams").alias("g")).select("row", F.col("g.pos").alias("pos"), F.col("g.gram").alias("gram"))
    grams = grams.withColumn("hash", _gram_hash(F.split("gram", " "), F.lit(0), k))
    joined = grams.join(F.broadcast(table) if count <= BROADCAST_GRAMS else table, "hash").where("gram = own")
    return joined.select("row", "template", "label", "size", (F.col("tpos") - F.col("pos")).alias("diagonal"), "tpos")


def passages(found: DataFrame, neighbour: int = NEIGHBOUR, least_cover: float = LEAST_COVER, least_density: float = LEAST_DENSITY) -> DataFrame:
    """(row, label, cover, first, last) of every verified passage, the best of overlapping ones;
    first and last are text positions of grams."""
    key = ["row", "template", "label", "size"]
    # a row for each diagonal: template positions fit in the few words of a template
    diagonals = found.groupBy(*key, "diagonal").agg(F.collect_set("tpos").alias("tpos"))
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    breaks = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > neighbour, F.lit(True))
    runs = diagonals.withColumn("breaks", breaks.cast("int")).withColumn("run", F.sum("breaks").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    cells = runs.select(*key, "run", "diagonal", F.explode("tpos").alias("tpos")).withColumn("pos", F.col("tpos") - F.col("diagonal"))
    merged = cells.groupBy(*key, "run").agg(F.countDistinct("tpos").alias("n"), F.countDistinct("pos").alias("there"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    verified = merged.withColumn("cover", F.col("n") / F.col("size")).where((F.col("cover") >= least_cover) & (F.col("there") >= least_density * (F.col("last") - F.col("first") + 1)))
    # overlapping passages of a row form a cluster, whose best stay
    in_text = Window.partitionBy("row").orderBy("first", "last")
    apart = F.coalesce(F.col("first") > F.max("last").over(in_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    clusters = verified.withColumn("apart", apart.cast("int")).withColumn("cluster", F.sum("apart").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    best = clusters.withColumn("best", F.max("cover").over(Window.partitionBy("row", "cluster")))
    return best.where("cover = best").select("row", "label", "cover", "first", "last")


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of the places where the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    n = len(parts)
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - n), lambda i: _all([F.get(words, i + j) == p for j, p in enumerate(parts)]))
    there = _all([F.array_contains(words, p) for p in parts]) & (F.size(words) >= n)
    return F.when(there, starts).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan(docs: DataFrame, templates: DataFrame | list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, k: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, the phrase places (n_base, first_word, last_word, base_labels), the
    labels of phrases and verified passages, and the best cover as ``score``."""
    table = template_grams(docs.sparkSession, templates, k)
    count = table.count()
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    placed = split.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), *[phrase_places(F.col("words"), p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)], shared_grams(F.col("words"), table, count, k).alias("grams"))
    starts = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]))
    found = placed.select("row", "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"), "grams")
    # one reading of the texts; the row numbers are settled with it
    rows = materialize(found, "license-rows")
    verified = passages(votes(rows, table, count, k)).groupBy("row").agg(F.collect_set("label").alias("added"), F.max("cover").alias("cover"))
    joined = rows.drop("grams").join(verified, "row", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("added", F.array().cast("array<string>"))))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.coalesce("cover", F.lit(0.0)).alias("score"))


def op10_license_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and passages of the whole ``documents`` table."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _template_rows(templates: list[tuple[str, str]], k: int) -> list[tuple[int, str, int, int, str]]:
    rows = []
    for number, (label, body) in enumerate(templates):
        words = [w for w in re.split(_SEPARATORS, body.translate(str.maketrans(_UPPER, _LOWER))) if w]
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        rows += [(number, label, i, len(grams), g) for i, g in enumerate(grams)]
    return rows


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    grams = ", ".join(f"({t}, {quoted(label)}, {p}, {n}, {quoted(g)})" for t, label, p, n, g in _template_rows(TEMPLATES, GRAM))
    phrases = ", ".join(f"({quoted(p)}, {quoted(label)})" for p, label in PHRASES)
    lengths = sorted({len(p.split()) for p, _ in PHRASES})
    ahead = ", ".join(f"lead(w0, {k}) OVER (PARTITION BY r ORDER BY i) AS w{k}" for k in range(1, max(*lengths, GRAM)))
    joined = lambda n: " || ' ' || ".join(f"w{k}" for k in range(n))
    hits = " UNION ALL ".join(f"SELECT r, i - 1 AS start, ph.label FROM pos JOIN ph ON {joined(n)} = ph.phrase" for n in lengths)
    return rf"""
WITH tg(template, label, tpos, size, gram) AS (VALUES {grams}),
ph(phrase, label) AS (VALUES {phrases}),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), pos AS (
  SELECT *, {ahead} FROM (SELECT r, unnest(w) AS w0, generate_subscripts(w, 1) AS i FROM d)
), hits AS (
  {hits}
), base AS (
  SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM hits GROUP BY r
), v AS (
  SELECT r, template, label, size, tpos, i - 1 AS pos, tpos - (i - 1) AS diagonal
  FROM pos JOIN tg ON {joined(GRAM)} = tg.gram
), diag AS (SELECT DISTINCT r, template, label, size, diagonal FROM v),
gaps AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {NEIGHBOUR} THEN 0 ELSE 1 END AS brk FROM diag
), runs AS (SELECT *, sum(brk) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM gaps),
verified AS (
  SELECT runs.r, runs.template, runs.run, runs.label, count(DISTINCT v.tpos) / runs.size AS cover, min(v.pos) AS lo, max(v.pos) AS hi
  FROM runs JOIN v ON v.r = runs.r AND v.template = runs.template AND v.diagonal = runs.diagonal
  GROUP BY runs.r, runs.template, runs.label, runs.size, runs.run
  HAVING count(DISTINCT v.tpos) / runs.size >= {LEAST_COVER} AND count(DISTINCT v.pos) >= {LEAST_DENSITY} * (max(v.pos) - min(v.pos) + 1)
), fences AS (
  SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY r ORDER BY lo, hi, template, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS apart FROM verified
), clusters AS (SELECT *, sum(apart) OVER (PARTITION BY r ORDER BY lo, hi, template, run ROWS UNBOUNDED PRECEDING) AS cluster FROM fences),
best AS (SELECT *, max(cover) OVER (PARTITION BY r, cluster) AS top FROM clusters),
added AS (SELECT r, list(DISTINCT label) AS labels, max(cover) AS score FROM best WHERE cover = top GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(CASE WHEN base_labels IS NULL THEN [] ELSE string_split(base_labels, ',') END, coalesce(added.labels, [])))), ',') AS labels,
       coalesce(added.score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN added USING (r)
"""


OP10_SQL = _oracle()
