import math
import re

from tesserae.llm.licenses import BASE, KEEP, SLACK, TEMPLATES, license_scan

SEPARATOR = re.compile(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = [w for w in SEPARATOR.split((text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    found = []
    for phrase, label in BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.",
    "GNU general-public\tLICENSE then MIT License, mit license; the CC BY",
    "Licensed under CC BY-NC 4.0. x",
    "Licensed under the Apache License, Version 2.0.",
    "gnu lesser general public license",
    "x " * 9000 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "cc byé license",
    "mit",
]


_BSD = next(notice for label, notice, _ in TEMPLATES if label == "bsd-2-clause")
MORE = [
    "x " * 70_000 + "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "Copyright A. B. " + _BSD.replace("copyright notice", "copyright notice of A B", 1),
    next(notice for label, notice, _ in TEMPLATES if label == "bsd-3-clause").replace("copyright holder", "A B C D"),
    " ".join(reversed(_BSD.split())),
]


#: Notices with words left out or changed, identifiers, and texts that only look like notices; and the labels.
LOOSE = {
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 3 of the License.": "gpl,gpl-3.0",
    "// SPDX-License-Identifier: Apache-2.0\nint main() { return 0; }": "apache-2.0",
    "# SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.": "cc0-1.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at a site": "epl-2.0",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish": "unlicense",
    "Permission is granted, free of charge, to any person obtaining a copy of this software": "mit",
    "the license of this software is granted to any person free of charge and a copy of the public domain": "",
    "version 3 of the program is free software as published": "",
}


def test_notices_with_words_left_out(spark):
    got = license_scan(spark.createDataFrame(list(enumerate(LOOSE)), "doc_id long, text string")).collect()
    assert {list(LOOSE)[r["doc_id"]]: r["labels"] for r in got} == LOOSE


def test_same_as_brute_force(spark, edge):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = edge.select("doc_id", "text", "kept", "row").unionByName(spark.createDataFrame([(100 + i, t, None, None) for i, t in rows], "doc_id long, text string, kept boolean, row long"))
    want = sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=repr)
    got = license_scan(docs).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr) == want
    assert all(0 <= r["score"] <= 1 for r in got)
    labels = {r["doc_id"]: r["labels"] for r in got if (r["doc_id"] or 0) >= 100}
    assert labels[100] == "gpl,gpl-3.0" and labels[102] == "cc-by,cc-by-nc-4.0" and labels[103] == "apache,apache-2.0" and labels[105] == "mit" and labels[107] == ""
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)


def whole_brute(texts):
    """Labels and scores, place by place."""
    split = [[w for w in SEPARATOR.split((t or "").translate({c: c + 32 for c in range(65, 91)})) if w] for t in texts]
    vocabulary = {w for _, notice, _ in TEMPLATES for w in notice.split()}
    weight = {w: math.log((len(texts) + 1) / (sum(w in words for words in map(set, split)) + 0.5)) + 0.01 for w in vocabulary}
    templates_with = {w: sum(w in notice.split() for _, notice, _ in TEMPLATES) for w in vocabulary}
    out = []
    for text, words in zip(texts, split):
        labels, best = set(filter(None, brute(text)[4].split(","))), 0.5 * (brute(text)[1] > 0)
        for label, notice, phrases in TEMPLATES:
            notice = notice.split()
            if 2 * len(set(notice) & set(words)) < len(set(notice)):
                continue
            rare = sorted(set(notice) & set(words), key=lambda w: (-weight[w], templates_with[w], w))[:KEEP]
            votes = [(i - p, w) for i, w in enumerate(words) if w in rare for p, v in enumerate(notice) if v == w]
            for window in {k for s, _ in votes for k in (s * 2 // SLACK, s * 2 // SLACK - 1)}:
                own = [(s, w) for s, w in votes if window in (s * 2 // SLACK, s * 2 // SLACK - 1)]
                agree = {w for _, w in own}
                if 2 * len(agree) < len(rare):
                    continue
                first, last = max(min(own)[0] - SLACK, 0), max(own)[0]
                there = f" {' '.join(words[first : max(last + len(notice), first)])} "
                if all(f" {p} " in there for p in phrases):
                    labels.add(label)
                    best = max(best, sum(weight[w] for w in agree) / sum(weight[w] for w in rare))
        out.append((",".join(sorted(labels)), round(min(best, 1.0), 9)))
    return out


def test_labels_and_scores_as_by_brute_force(spark, edge):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, *MORE, *LOOSE, *(r["text"] for r in edge.collect())])), "doc_id long, text string").repartition(3)
    rows = sorted(docs.collect())
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan(docs).collect()}
    assert [got[r["doc_id"]] for r in rows] == whole_brute([r["text"] for r in rows])
    labels = [got[len(TEXTS) + k][0] for k in range(len(MORE))]
    assert labels[0] == "gpl,gpl-3.0" and labels[1] == "lgpl-2.1" and labels[2] == "bsd,bsd-2-clause" and labels[3] == "bsd,bsd-2-clause,bsd-3-clause" and labels[4] == ""


def test_empty_table(nothing):
    assert license_scan(nothing).count() == 0
