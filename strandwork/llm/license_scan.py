"""License scans with a positional index of rare words.

DataFrame and SQL functions only; all of it happens in the text's row. Inverse document frequencies (IDF) of the
templates' words are counted over all texts. A template stands at a start when its words that are at their places, give or
take SHIFT words, have LEAST_SHARE of its IDF, and its mandatory phrases stand there. It is found like this:

* Of each template whose phrases' words the text holds, the text's highest-IDF words of it are looked up: as many
  as it takes to weigh more than what a stand may lack and one word more, so a stand holds at least two of them.
* Each of their places and each of their postings in the template give a start. Starts are dealt to cells of neighbouring
  starts, and the postings are intersected: only cells with two different words go on.
* The starts of such cells are judged on the whole template and its phrases.

So nothing that stands is missed, and a text's cost is in proportion to its licence words.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame, functions as F

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: base phrases and the label of each
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: (label, words that open or name the licence, phrases that must be there); the wordings of a licence share its label
TEMPLATES = [
    ("agpl", "this program is licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("bsd", "licensed under the bsd license", ("bsd license",)),
    ("bsd", "licensed under the bsd 2 clause license", ("bsd 2 clause",)),
    ("bsd", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    ("bsd", "use of this source code is governed by a bsd style license", ("bsd style license",)),
    ("boost", "boost software license version 1 0", ("boost software license",)),
    ("boost", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy of the software",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("this list of conditions and the following disclaimer",)),
    ("cc-by", "cc by 4 0", ("cc by 4 0",)),
    ("cc-by", "creative commons attribution 4 0", ("creative commons attribution 4 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0", ("creative commons attribution noderivatives 4 0",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-sa", "creative commons attribution sharealike 4 0", ("creative commons attribution sharealike 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "to the extent possible under law the author has waived all copyright", ("waived all copyright",)),
    ("cc0", "has waived all copyright and related or neighboring rights", ("waived all copyright",)),
    ("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    ("epl", "licensed under the eclipse public license", ("eclipse public license",)),
    ("epl", "under the terms of the eclipse public license", ("eclipse public license",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license as published",)),
    ("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "under the terms of the gnu general public license", ("gnu general public license",)),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("isc", "licensed under the isc license", ("isc license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("lgpl", "under the terms of the gnu library general public license", ("library general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge", "person obtaining a copy of this software")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("all copies or substantial portions of the software",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mpl", "licensed under the mozilla public license", ("mozilla public license",)),
    ("mpl", "are subject to the mozilla public license", ("mozilla public license",)),
    ("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("zlib", "released under the zlib license", ("zlib license",)),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("plainly marked as such",)),
]
SHIFT = 2  # words that a template's word may stand off its place
LEAST_SHARE = 0.8
SLACK = 1e-9  # of sums of doubles, in filters only


def words(text: str) -> Column:
    """Words of a text with A-Z lower-cased. The Kelvin sign is the one other letter whose lower case is ASCII."""
    t = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("K"), F.lit("Å")))
    return F.filter(F.split(t, WORD_BREAK), lambda x: x != "")


def _lits(xs) -> Column:
    """An array of words as one literal."""
    return F.split(F.lit(" ".join(xs)), " ")


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and how many of them hold each word of the templates. The answer is a row for each such word."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    present = docs.select(F.explode_outer(F.concat(F.array(F.lit("")), F.array_intersect(words("text"), _lits(vocabulary)))).alias("w"))
    got = dict(present.groupBy("w").count().collect())
    return got.pop("", 0), got


def _starts(w: Column, phrase: list[str]) -> Column:
    """Places where the phrase's words stand one after the other."""
    last = F.size(w) - len(phrase)
    here = lambda i: [F.get(w, i + k) == x for k, x in enumerate(phrase)]

    def all_(i):
        out = here(i)[0]
        for c in here(i)[1:]:
            out = out & c
        return out

    return F.when(F.array_contains(w, phrase[0]) & F.array_contains(w, phrase[-1]) & (last >= 0), F.filter(F.sequence(F.lit(0), last), all_)).otherwise(F.array().cast("array<int>"))


def _let(x: Column, f) -> Column:
    """f(x), with x computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


TEMPLATE = "struct<label:string,body:array<string>,weight:array<double>,phrases:array<string>,needed:array<string>,known:array<struct<x:string,v:double>>,total:double>"


def _templates(idf) -> Column:
    """The templates as one literal: words with their weights, and distinct words (``known``) by falling IDF."""
    out = []
    for label, text, phrases in TEMPLATES:
        body = text.split()
        rare = lambda ws: sorted(dict.fromkeys(ws), key=lambda w: (-idf(w), w))
        out.append({
            "label": label, "body": body, "weight": [idf(w) for w in body], "phrases": [f" {p} " for p in phrases],
            "needed": rare(w for p in phrases for w in p.split()),  # the rarest first, so that most texts fail there
            "known": [{"x": w, "v": idf(w) * body.count(w)} for w in rare(body)], "total": sum(idf(w) for w in body),
        })
    return F.from_json(F.lit(json.dumps(out)), f"array<{TEMPLATE}>")  # folded to a constant once a query


def _lookup(t: Column, present: Column) -> Column:
    """(xs: the words that are looked up, need: how many of them a stand holds at least)."""
    missing = (1 - LEAST_SHARE) * t["total"] + SLACK
    start = F.struct(F.array().cast("array<string>").alias("xs"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("most"))
    enough = lambda a: a["sum"] > missing + a["most"]
    longer = lambda a, o: F.struct(F.concat(a["xs"], F.array(o["x"])).alias("xs"), (a["sum"] + o["v"]).alias("sum"), F.greatest(a["most"], o["v"]).alias("most"))
    here = F.filter(t["known"], lambda o: F.array_contains(present, o["x"]))
    return F.aggregate(here, start, lambda a, o: F.when(enough(a), a).otherwise(longer(a, o)), lambda a: F.struct(a["xs"].alias("xs"), F.when(enough(a), 2).otherwise(1).alias("need")))


def _cells(w: Column, t: Column, look: Column) -> Column:
    """Cells of 2 * SHIFT + 1 neighbouring starts (with those of the cell before) that ``need`` different words vote for."""
    wide, many = 2 * SHIFT + 1, 1 << 12
    places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(look["xs"], F.get(w, i)))
    posted = lambda x: F.filter(F.sequence(F.lit(0), F.size(t["body"]) - 1), lambda q: F.get(t["body"], q) == x)
    # a vote as one number, cell and word, so that distinct votes are found by hash
    cell = lambda i, q: F.floor((i - q + F.size(t["body"])) / wide)
    vote = lambda i: F.transform(posted(F.get(w, i)), lambda q: cell(i, q) * many + F.array_position(look["xs"], F.get(w, i)))
    votes = F.array_distinct(F.flatten(F.transform(places, vote)))
    both = F.array_sort(F.array_distinct(F.concat(votes, F.transform(votes, lambda v: v + many))))
    again = lambda b: F.filter(b, lambda v, k: (look["need"] == 1) | (F.floor(v / many) == F.floor(F.get(b, k + 1) / many)))
    return F.array_distinct(F.transform(_let(both, again), lambda v: F.floor(v / many).cast("int")))


def _share(w: Column, t: Column, s: Column) -> Column:
    """The share of the template's IDF that stands at the start s; null where a mandatory phrase doesn't."""
    n = F.size(t["body"])
    part = lambda a, b: F.slice(w, F.greatest(F.lit(0), a) + 1, F.greatest(F.lit(0), b - F.greatest(F.lit(0), a)))
    text = F.concat(F.lit(" "), F.array_join(part(s - SHIFT, s + n + SHIFT), " "), F.lit(" "))
    phrased = _let(text, lambda x: F.forall(t["phrases"], lambda p: F.contains(x, p)))
    stands = F.transform(t["body"], lambda x, i: F.when(F.array_contains(part(s + i - SHIFT, s + i + SHIFT + 1), x), F.get(t["weight"], i)).otherwise(F.lit(0.0)))
    return F.when(phrased, _sum(stands) / t["total"])


def _found(w: Column, present: Column, t: Column) -> Column:
    """(label, share) of the template's best stand in the text; share null without any."""
    wide, n = 2 * SHIFT + 1, F.size(t["body"])
    cells = _let(_lookup(t, present), lambda look: _cells(w, t, look))
    starts = F.array_distinct(F.flatten(F.transform(cells, lambda c: F.sequence((c - 1) * wide - n - SHIFT, (c + 1) * wide - n + SHIFT))))
    return F.struct(t["label"].alias("label"), F.array_max(F.filter(F.transform(starts, lambda s: _share(w, t, s)), lambda x: x >= LEAST_SHARE)).alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of ``docs``.

    score: the largest share of a template's IDF that stands anywhere, 1 where only a base phrase stands, else 0. A null
    text has no words; repeated rows are scanned each on their own, texts of any length as a whole; columns other than
    doc_id and text aren't read, whatever their names. In an empty table every word is equally rare.
    """
    n, df = frequencies(docs)
    idf = lambda w: log((n + 1) / (df.get(w, 0) + 1)) + 1
    templates = _templates(idf)
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    d = docs.select("doc_id", words("text").alias("w"))
    d = d.select("doc_id", "w", F.array_intersect("w", _lits(vocabulary)).alias("present"), *[_starts(F.col("w"), p.split()).alias(f"b{k}") for k, p in enumerate(BASE)])
    present = F.col("present")
    bag = lambda t: _sum(F.transform(t["known"], lambda o: F.when(F.array_contains(present, o["x"]), o["v"]).otherwise(F.lit(0.0))))
    likely = lambda t: F.forall(t["needed"], lambda x: F.array_contains(present, x)) & (bag(t) >= LEAST_SHARE * t["total"] - SLACK)
    d = d.withColumn("likely", F.filter(templates, likely))
    d = d.withColumn("found", F.filter(F.transform("likely", lambda t: _found(F.col("w"), present, t)), lambda x: x["share"].isNotNull()))
    every = F.concat(*[F.col(f"b{k}") for k in range(len(BASE))])
    based = F.filter(F.array(*[F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values())]), lambda x: x.isNotNull())
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return d.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        joined(based).alias("base_labels"), joined(F.concat(based, F.transform("found", lambda x: x["label"]))).alias("labels"), F.least(F.lit(1.0), best).alias("score"),
    )
