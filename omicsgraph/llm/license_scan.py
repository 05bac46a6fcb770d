"""Licence notices by an exact set-similarity join, in DataFrame operations only.

Texts are cut into overlapping blocks of words: for each template blocks of twice its length (as a power of two), so
that a notice lies whole in one. A block matches a template if it holds at least `threshold` of the template's distinct
words, or all of them where the template has fewer than ALL_OF words. Words of templates are ordered by how many
documents have them, rarest first; a match must share a word of the template's prefix in that order (prefix filter),
have enough of its words (length filter), and enough words after the first shared one on both sides (positional
filter). What is left is compared in full.

Null texts have no words. Repeated rows stay. Ties need no order: all labels that match are given, with the best share.
The templates are a fixed list, so all that is collected or broadcast (their words and how common these are) has a
fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_key, materialize

#: What separates words, and the phrases found word by word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Statements and standard notices of common licences.
TEMPLATES = {
    "apache-2.0-line": "licensed under the apache license version 2 0",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-3-clause": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0 or send a letter to creative commons po box 1866 mountain view ca 94042 usa",
    "cc0": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit-line": "released under the mit license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software",
}
#: Templates of fewer distinct words must be there whole.
ALL_OF = 12
#: Letters that are lowered.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def half_block(template: str) -> int:
    """Words by which a template's blocks are apart: its length as a power of two, 8 at least."""
    return max(8, 1 << (len(template.split()) - 1).bit_length())


def needed(n: int, threshold: float) -> int:
    """How many of a template's n distinct words a block must hold."""
    return n if n < ALL_OF else math.ceil(threshold * n - 1e-9)


def spaced_words(text: Column) -> Column:
    """The words in lower case with a space before, between and after; one space if there is none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" ")), SEPARATORS, " ")


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _first(s: Column, phrase: str) -> Column:
    """Number of words before the first place of the phrase in spaced words; null if it has none."""
    at = F.instr(s, f" {phrase} ")
    return F.when(at > 0, _spaces(F.substring(s, F.lit(1), at - 1)))


def phrase_places(docs: DataFrame) -> DataFrame:
    """docs (with spaced words in `s`) with n_words, n_base, first_word, last_word and base (array of labels)."""
    s = F.col("s")
    n_words = _spaces(s) - 1
    count = lambda p: F.when(F.contains(s, F.lit(f" {p} ")), F.regexp_count(s, F.lit(f" {p}(?= )"))).otherwise(0)
    found = F.array_compact(F.array(*[F.when(F.contains(s, F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items()]))
    least = F.least(*[_first(s, p) for p in PHRASES])
    most = F.greatest(*[n_words - _first(F.reverse(s), p[::-1]) - len(p.split()) for p in PHRASES])
    some = F.size(found) > 0
    out = docs.withColumn("n_words", n_words.cast("long")).withColumn("base", found).withColumn("n_base", F.when(some, sum((count(p) for p in PHRASES), F.lit(0))).otherwise(0).cast("long"))
    return out.withColumn("first_word", F.when(some, least).cast("long")).withColumn("last_word", F.when(some, most).cast("long"))


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents (column s) each word of the vocabulary is; as many rows as the vocabulary has at most."""
    words = F.array_intersect(F.split("s", " "), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(words).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in rows}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels), found (labels), score of every document.

    found: labels of templates that a block matches. score: the best share of a template found, 1 for a phrase.
    docs needs doc_id and text; other columns are ignored; an empty table gives an empty one.
    """
    templates = templates or TEMPLATES
    sets = {k: sorted(set(t.split())) for k, t in templates.items()}
    steps = {k: half_block(t) for k, t in templates.items()}
    vocabulary = sorted({w for ws in sets.values() for w in ws})
    id_, key = doc_key()
    spaced = docs.select(id_.cast("long").alias("doc_id"), key, spaced_words(F.col("text")).alias("s"))
    frequency = word_frequencies(spaced.select("s"), vocabulary)
    order = sorted(vocabulary, key=lambda w: (frequency[w], w))
    place = {w: k for k, w in enumerate(order)}
    ranked = {k: sorted(place[w] for w in ws) for k, ws in sets.items()}
    need = {k: needed(len(r), threshold) for k, r in ranked.items()}
    prefixes = {k: r[: len(r) - need[k] + 1] for k, r in ranked.items()}
    rare = sorted({p for r in prefixes.values() for p in r})

    # the words of templates in each document that has a prefix word, with their places
    words = F.split("s", " ")
    all_words = F.array(*map(F.lit, order))
    pairs = F.filter(F.transform(words, lambda w, i: F.struct((i - 1).alias("at"), (F.array_position(all_words, w) - 1).cast("int").alias("w"))), lambda x: x["w"] >= 0)
    some = F.arrays_overlap(words, F.array(*[F.lit(order[p]) for p in rare]))
    read = phrase_places(spaced).withColumn("hits", F.when(some, pairs)).drop("s")
    read = materialize(read, "words")
    hit = read.where("hits is not null").select("doc_id", "text_key", F.explode("hits").alias("x")).select("doc_id", "text_key", "x.*")
    block = lambda step: F.floor(F.col("at") / step)
    places = F.array(*[F.struct(F.lit(step).alias("step"), (block(step) - k).alias("block")) for step in sorted(set(steps.values())) for k in (0, 1)])
    of_step = F.explode(F.array(*[F.struct(F.lit(place[w]).alias("w"), F.lit(step).alias("step")) for step, w in sorted({(steps[k], w) for k, ws in sets.items() for w in ws})]))
    known = F.broadcast(docs.sparkSession.range(1).select(of_step.alias("k")).select("k.*"))  # the templates' words by step
    dealt = hit.select("doc_id", "text_key", "w", F.explode(places).alias("p")).select("doc_id", "text_key", "w", "p.*").join(known, ["w", "step"])
    blocks = dealt.groupBy("doc_id", "text_key", "step", "block").agg(F.sort_array(F.collect_set("w")).alias("ws"))

    spark = docs.sparkSession
    rows = [(p, i, k, steps[k], len(r), need[k], r) for k, r in ranked.items() for i, p in enumerate(prefixes[k])]
    index = spark.createDataFrame(rows, "w int, i int, label string, step int, n int, need int, t array<int>")
    probes = blocks.select("doc_id", "text_key", "step", "block", "ws", F.posexplode("ws").alias("j", "w"))
    candidates = probes.join(F.broadcast(index), ["w", "step"]).where("size(ws) >= need and 1 + least(n - i - 1, size(ws) - j - 1) >= need")
    share = F.size(F.array_intersect("ws", "t")) / F.col("n")
    matched = candidates.withColumn("share", share).where(F.size(F.array_intersect("ws", "t")) >= F.col("need"))
    found = matched.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    joined = read.drop("hits").join(found, same, "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", "found", "share")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return joined.withColumn("score", score).withColumn("found", F.coalesce("found", F.array().cast("array<string>"))).drop("share")
