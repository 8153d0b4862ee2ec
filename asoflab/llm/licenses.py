"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Words are runs of ASCII letters and digits or of characters beyond ASCII, lower-cased.
Base labels come from phrases whose words stand consecutively. The join adds the
label of every template T with a block B of consecutive words (``len(T) + slack``
words wide, at any position, cut at the end of the text) for which
|B & T| >= containment * |T| over distinct words. Every such block is found and
told; blocks that start at consecutive words are told as one run.

All of it is DataFrame expressions. Template words are ordered by how many
documents hold them (counted over the whole table), rare first.

* Prefix filter: a block that reaches the threshold holds one of the
  |T| - ceil(c |T|) + 1 rarest words, so only blocks around places of those are built.
* Positional filter: a block is looked for from the place of its rarest template
  word. If that word is at position p of the order, the other words come from
  positions after p, so the words around the place must hold enough of those
  before any block there is built.
* Length filter: texts that hold fewer distinct template words than the needed
  overlap are left out.

Templates are few and fixed: they are literals in the plan, nothing is broadcast.
Null texts count as empty. Scores are the best containment over all blocks, 0 where
none reaches the threshold, and 1 where a base phrase stands. Rows with equal ids are
scanned one by one; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases of the base labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Customary wording of license notices, one line of each and the whole notices that projects put into their files.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "creative commons attribution noncommercial cc by nc 4 0": "cc-by-nc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or "
    "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
    "dealings in the software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
    "regard to this software including all implied warranties of merchantability and fitness": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution": "bsd",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
    "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
    "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
    "specific language governing permissions and limitations under the license": "apache-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it "
    "will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
    "general public license for more details you should have received a copy of the gnu general public license along with this program": "gpl-3",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
    "can obtain one at http mozilla org mpl 2 0": "mpl-2",
}

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-casing by ASCII rules only: letters beyond ASCII that would turn into ASCII ones are kept apart."""
    apart = F.translate(F.coalesce(text, F.lit("")), "Kİ", "ÅĲ")
    return F.filter(F.split(F.lower(apart), BETWEEN), lambda w: w != "")


def _places(own: Column, phrase: list[str]) -> Column:
    """Starts of the phrase, from 0: places of its first word whose followers match."""
    n = len(phrase)
    literal = F.array(*[F.lit(w) for w in phrase])
    starts = F.sequence(F.lit(0), F.size(own) - n)
    found = F.filter(starts, lambda i: (F.get(own, i) == phrase[0]) & (F.slice(own, i + 1, n) == literal))
    return F.when((F.size(own) >= n) & F.arrays_overlap(own, F.array(F.lit(phrase[0]))), found).otherwise(F.array().cast("array<int>"))


def word_order(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES) -> list[str]:
    """Template words by the number of documents that hold them, rare first: one small row from one pass."""
    every = sorted({w for t in templates for w in t.split()})
    held = docs.select(F.explode(F.array_intersect(words(F.col(text)), F.array(*map(F.lit, every)))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(every, key=lambda w: (counts.get(w, 0), w))


def _width(template: str, slack: int) -> int:
    return len(template.split()) + slack


def _blocks(own: Column, held: Column, template: str, order: list[str], containment: float, slack: int) -> Column:
    """(start, found) of every block that reaches the threshold, by start. held: the distinct template words of the text."""
    distinct = set(template.split())
    ranked = [w for w in order if w in distinct]
    n, width = len(ranked), _width(template, slack)
    need = ceil(containment * n - 1e-9)
    every = F.array(*map(F.lit, ranked))
    rare = F.array(*map(F.lit, ranked[: n - need + 1]))

    def around(i: Column) -> Column:
        """Whether the blocks that hold word i may hold enough words from its position in the order on."""
        first = F.greatest(i - width + 1, F.lit(0))
        near = F.slice(own, first + 1, i - first + width)
        return F.size(F.array_intersect(near, F.slice(every, F.array_position(rare, F.get(own, i)).cast("int"), n))) >= need

    places = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.array_contains(rare, F.get(own, i)))
    # blocks that hold word i start within the width before it
    starts = F.flatten(F.transform(F.filter(places, around), lambda i: F.sequence(F.greatest(i - width + 1, F.lit(0)), i)))
    found = F.transform(F.array_sort(F.array_distinct(starts)), lambda s: F.struct(s.alias("start"), F.size(F.array_intersect(F.slice(own, s + 1, width), every)).alias("found")))
    enough = (F.size(F.array_intersect(held, every)) >= need) & F.arrays_overlap(held, rare)
    none = F.array().cast("array<struct<start:int,found:int>>")
    return F.when(enough, F.filter(found, lambda b: b["found"] >= need)).otherwise(none)


def _runs(blocks: str, label: str, template: str, n_words: Column, slack: int) -> Column:
    """Blocks at consecutive starts as one: (label, start, end, blocks, containment); end is after the last block's last word."""
    own, n, width = F.col(blocks), float(len(set(template.split()))), _width(template, slack)
    start = lambda i: F.get(own, i)["start"]
    places = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.filter(places, lambda i: (i == 0) | (start(i) > start(i - 1) + 1))
    ends = F.filter(places, lambda i: (i == F.size(own) - 1) | (start(i + 1) > start(i) + 1))

    def run(head: Column, last: Column) -> Column:
        best = F.array_max(F.transform(F.slice(own, head + 1, last - head + 1), lambda b: b["found"])) / F.lit(n)
        end = F.least(start(last) + width, n_words.cast("int"))
        return F.struct(F.lit(label).alias("label"), start(head).cast("long").alias("start"), end.cast("long").alias("end"), (last - head + 1).cast("long").alias("blocks"), best.alias("containment"))

    return F.zip_with(heads, ends, run)


def blocks(docs: DataFrame, containment: float = 0.8, slack: int = 4, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, places, runs) of each row of docs(doc_id, text): starts of each phrase, and the runs of blocks of all templates."""
    order = word_order(docs, templates=templates)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    held = F.array_intersect("words", F.array(*map(F.lit, order)))
    found = own.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), held.alias("held"), F.array(*[_places(F.col("words"), p.split()) for p in phrases]).alias("places"))
    each = [_blocks(F.col("words"), F.col("held"), t, order, containment, slack).alias(f"b{k}") for k, t in enumerate(templates)]
    told = found.select("doc_id", "n_words", "places", *each)
    runs = [_runs(f"b{k}", label, t, F.col("n_words"), slack) for k, (t, label) in enumerate(templates.items())]
    return told.select("doc_id", "n_words", "places", F.concat(*runs).alias("runs"))


def scan(docs: DataFrame, containment: float = 0.8, slack: int = 4, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row for each document: words, places of base phrases, labels, score and number of blocks that reach the threshold."""
    full = blocks(docs, containment, slack, templates, phrases).withColumn("starts", F.flatten("places"))
    base = F.array_compact(F.array(*[F.when(F.size(F.get("places", F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    more = F.transform("runs", lambda r: r["label"])
    score = F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("runs", lambda r: r["containment"])), F.lit(0.0)))
    return full.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"), score.cast("double").alias("score"),
        F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["blocks"]).alias("n_blocks"),
    )
