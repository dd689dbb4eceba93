"""License scans by a positional index of rare words.

The index holds every word of the licence templates with its positions. A word's rarity is its inverse document frequency over
all scanned files; of words that are equally rare, the one in fewer templates comes first. Each file's licence words are put in this
order, and for each template that shares half of its words with the file, the file's KEEP rarest words of it are looked up. Every
occurrence in the file votes for the place where the template would start (position in the file minus position in the template),
and places that differ by a few words count as one, so names and dates put into a notice, or words left out of it, do not
break it. A place that at least half of the looked-up words agree on is verified: the template's mandatory key phrases
must stand within the template's extent there (SLACK words before it included), word for word. A file without some word of
a key phrase cannot pass that, so it is no candidate.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import documents, durable, lower_ascii, whole

#: What separates words, once A-Z is lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: the phrases whose places are counted, and their labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_GNU = "{} is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation either version {} of the license or at your option any later version"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"

# fixed values: the wording of public licences' notices, in small letters and without signs
#: label, notice, key phrases that must all stand within its extent
TEMPLATES = [
    ("gpl-3.0", _GNU.format("this program", "", "3"), ["gnu general public license", "version 3"]),
    ("gpl-2.0", _GNU.format("this program", "", "2"), ["gnu general public license", "version 2"]),
    ("lgpl-3.0", _GNU.format("this library", "lesser ", "3"), ["gnu lesser general public license", "version 3"]),
    ("lgpl-2.1", _GNU.format("this library", "lesser ", "2 1"), ["gnu lesser general public license", "version 2 1"]),
    ("agpl-3.0", _GNU.format("this program", "affero ", "3"), ["gnu affero general public license", "version 3"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        ["apache license version 2 0"],
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("bsd-2-clause", _BSD, ["redistribution and use in source and binary forms", "redistributions in binary form"]),
    (
        "bsd-3-clause",
        _BSD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["redistribution and use in source and binary forms", "neither the name", "endorse or promote products"],
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mozilla public license v 2 0"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", ["mozilla public license version 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify", "with or without fee"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("mit", "permission is granted free of charge to any person obtaining a copy of this software", ["granted free of charge to any person obtaining a copy"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc0-1.0", "licensed under cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("epl-2.0", "made available under the terms of the eclipse public license v 2 0", ["eclipse public license v 2 0"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("epl-2.0", "made available under the terms of the eclipse public license version 2 0", ["eclipse public license version 2 0"]),
    ("epl-2.0", "made available under the terms of the eclipse public license v2 0", ["eclipse public license v2 0"]),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0", ["eclipse public license v1 0"]),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ["free and unencumbered software released into the public domain"],
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["granted to anyone to use this software for any purpose", "redistribute it freely"]),
]

# fixed values: identifiers of licences as files state them, and their labels
IDENTIFIERS = {
    "agpl 3 0": "agpl-3.0",
    "apache 2 0": "apache-2.0",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "bsl 1 0": "bsl-1.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc0 1 0": "cc0-1.0",
    "epl 1 0": "epl-1.0",
    "epl 2 0": "epl-2.0",
    "gpl 2 0": "gpl-2.0",
    "gpl 3 0": "gpl-3.0",
    "isc": "isc",
    "lgpl 2 1": "lgpl-2.1",
    "lgpl 3 0": "lgpl-3.0",
    "mit": "mit",
    "mpl 2 0": "mpl-2.0",
    "unlicense": "unlicense",
    "zlib": "zlib",
}
TEMPLATES += [(label, f"spdx license identifier {name}", [f"spdx license identifier {name}"]) for name, label in IDENTIFIERS.items()]
#: Words of a template that a file looks up; words by which places of one notice may differ.
KEEP, SLACK = 6, 16


def _phrase_at(words: Column, phrase: list[str], i: Column) -> Column:
    """Whether the phrase's words stand from position i on."""
    hit = words[i] == phrase[0]
    for k, w in enumerate(phrase[1:], 1):
        hit = hit & F.coalesce(F.get(words, i + k) == w, F.lit(False))
    return hit


def _places(words: Column, spaced: Column, phrase: str) -> Column:
    """All positions at which the phrase stands; the cheap test of the spaced text comes first."""
    parts = phrase.split()
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _phrase_at(words, parts, i))
    return F.when(F.contains(spaced, F.lit(f" {phrase} ")), at).otherwise(F.array().cast("array<int>"))


def word_weights(held: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of the templates' words over all rows (column held: those in the text)."""
    # a row for each word of the templates at most, and one (null) for all rows
    words = held.select(F.explode(F.concat("held", F.array(F.lit(None).cast("string")))).alias("w"))
    counts = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(counts.get(None, 0), 1)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 0.5)) + 0.01 for w in vocabulary}


def spread(templates) -> dict[str, int]:
    """In how many templates each word is."""
    return Counter(w for _, notice, _ in templates for w in set(notice.split()))


def by_rarity(templates, weights: dict[str, float]) -> list[str]:
    """The words of all templates: the highest inverse document frequency first, then those in fewer templates."""
    n = spread(templates)
    return sorted(n, key=lambda w: (-weights[w], n[w], w))


def _candidates(templates, held: Column) -> Column:
    """Templates of which a file holds half of the words, and that word of the key phrases which is in fewest templates (without it
    they cannot stand there; it is looked at first as most files lack it)."""
    n = spread(templates)

    def possible(notice: str, phrases: list[str]) -> Column:
        own = sorted(set(notice.split()))
        anchor = min((w for p in phrases for w in p.split()), key=lambda w: (n[w], w))
        return F.when(F.array_contains(held, anchor), F.size(F.array_intersect(F.array(*map(F.lit, own)), held)) * 2 >= len(own)).otherwise(False)

    return F.array_compact(F.array(*(F.when(possible(notice, phrases), F.lit(t)) for t, (_, notice, phrases) in enumerate(templates))))


def _matches(hits: DataFrame, templates, weights: dict[str, float], keep: int, slack: int) -> DataFrame:
    """Per row with a verified place: row, found (labels), best (the largest part of looked-up weight that agrees on a place).
    hits: row, words, held (the file's licence words), candidates (templates)."""
    order = by_rarity(templates, weights)
    index = hits.sparkSession.createDataFrame(
        [(t, w, i, float(weights[w])) for t, (_, notice, _) in enumerate(templates) for i, w in enumerate(notice.split())], "t int, w string, at int, weight double"
    )
    facts = hits.sparkSession.createDataFrame(
        [(t, label, len(notice.split()), [w for w in order if w in set(notice.split())], [f" {p} " for p in ps]) for t, (label, notice, ps) in enumerate(templates)],
        "t int, label string, n int, own array<string>, phrases array<string>",
    )
    # what each file looks up: of a template's words, in the order of rarity, the first that the file holds
    asked = hits.select("row", "held", F.explode("candidates").alias("t")).join(F.broadcast(facts.select("t", "own")), "t")
    asked = asked.select("row", "t", F.slice(F.array_intersect("own", "held"), 1, keep).alias("look"))
    looks = asked.groupBy("row").agg(F.collect_list(F.struct("t", "look")).alias("looks"))
    wanted = hits.select("row", "words").join(looks, "row").withColumn("every", F.array_distinct(F.flatten("looks.look")))
    places = wanted.select("row", "looks", "every", F.posexplode("words").alias("i", "w")).where(F.array_contains("every", F.col("w")))
    # a row for each word of the templates
    met = places.join(F.broadcast(index), "w").withColumn("look", F.filter("looks", lambda k: (k["t"] == F.col("t")) & F.array_contains(k["look"], F.col("w")))).where(F.size("look") > 0)
    votes = met.select("row", "t", "w", "weight", F.size(F.col("look")[0]["look"]).alias("looked_up"), F.col("look")[0]["look"].alias("look"), (F.col("i") - F.col("at")).alias("start"))
    # windows of ``slack`` words, each half over the next
    near = votes.withColumn("window", F.explode(F.array(F.floor(F.col("start") * 2 / slack), F.floor(F.col("start") * 2 / slack) - 1)))
    agreed = (
        near.groupBy("row", "t", "window")
        .agg(F.collect_set(F.struct("w", "weight")).alias("agree"), F.first("looked_up").alias("looked_up"), F.first("look").alias("look"), F.min("start").alias("start"), F.max("start").alias("last"))
        .where(F.size("agree") * 2 >= F.col("looked_up"))
    )
    weight = F.create_map(*(v for w in order for v in (F.lit(w), F.lit(float(weights[w])))))
    total = F.aggregate(F.array_sort("look"), F.lit(0.0), lambda a, w: a + F.element_at(weight, w))
    part = F.aggregate(F.array_sort("agree"), F.lit(0.0), lambda a, x: a + x["weight"]) / total
    known = agreed.join(F.broadcast(facts.select("t", "label", "n", "phrases")), "t")
    placed = known.select("row", "start", "last", part.alias("part"), "label", "n", "phrases").join(hits.select("row", "words"), "row")
    first = F.greatest(F.col("start") - slack, F.lit(0))  # words put in may have moved the beginning
    there = F.concat(F.lit(" "), F.array_join(F.slice("words", first + 1, F.greatest(F.col("last") + F.col("n") - first, F.lit(0))), " "), F.lit(" "))
    verified = placed.select("row", "part", "label", "phrases", there.alias("there")).where(F.forall("phrases", lambda p: F.contains("there", p)))
    return verified.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("part").alias("best"))


def license_scan(docs: DataFrame, templates=TEMPLATES, keep: int = KEEP, slack: int = SLACK) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty: no words, no labels, score 0. Every occurrence counts, also in repeated rows and
    very long texts. Templates of one label give it once. score is the largest share of looked-up weight that agrees on a
    verified place; a text with base phrases only has 0.5. An empty table gives no rows. Texts are read once: whole words are kept of
    candidates only.
    """
    vocabulary = sorted(spread(templates))
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(whole("text")), BETWEEN, " ")), F.lit(" "))
    words = F.split(F.trim("spaced"), " ")
    texts = docs.select("doc_id", spaced.alias("spaced")).withColumn("words", words)
    any_phrase = F.lit(False)
    for p in BASE:
        any_phrase = any_phrase | F.contains("spaced", F.lit(f" {p} "))
    places = F.concat(*(F.when(any_phrase, _places(F.col("words"), F.col("spaced"), p)).otherwise(F.array().cast("array<int>")) for p in BASE))
    base = F.array_compact(F.array_distinct(F.array(*(F.when(F.contains("spaced", F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()))))
    found = texts.withColumn("held", F.array_intersect(F.array(*map(F.lit, vocabulary)), F.col("words")))
    found = found.withColumn("candidates", _candidates(templates, F.col("held")))
    gate = durable(
        found.select(
            "doc_id",
            F.when(F.length("spaced") > 2, F.size("words")).otherwise(0).cast("long").alias("n_words"),
            places.alias("places"),
            base.alias("base"),
            "held",
            F.when(F.size("candidates") > 0, F.col("candidates")).alias("candidates"),
            F.when(F.size("candidates") > 0, F.col("words")).alias("words"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "license-gate",
    )
    weights = word_weights(gate.select("held"), vocabulary)
    matched = _matches(gate.where("candidates IS NOT NULL").select("row", "words", "held", "candidates"), templates, weights, keep, slack)
    facts = gate.select("row", "doc_id", "n_words", "places", "base").join(matched, "row", "left")
    none = F.array().cast("array<string>")
    labels = F.array_distinct(F.concat("base", F.coalesce("found", none)))
    return facts.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0))).alias("score"),
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
