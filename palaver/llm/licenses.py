"""Licence scans by the Dice coefficient over word bigrams, in DataFrame functions only.

Each line, and each paragraph of several lines, is normalised (lower case, words
of letters and digits) and compared with licence templates, and so is every run
of words in it that is as long as a template.  With bags of
bigrams, Dice = 2 |A n B| / (|A| + |B|), and a Dice of t bounds the sizes:
t / (2 - t) <= |A| / |B| <= (2 - t) / t.  So the number of words alone prunes
templates, before any bigram is built.  Bigrams that no template has are dropped
by a look-up in a constant set; only units that keep enough of them are compared.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

C, L = F.col, F.lit

# fixed values: notices as their licences word them
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bigrams(text: str) -> Counter:
    """The bag of word bigrams of a text, as the plan below builds it."""
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def normalised(text: Column) -> Column:
    """Words of letters and digits in lower case, as an array."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _units(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, number, content): the lines, and the paragraphs of two lines or more, numbered from 1."""
    lines = docs.select("doc_id", L("line").alias("unit"), F.posexplode(F.split("text", r"\r\n|\r|\n", -1)).alias("number", "content"))
    blocks = F.split(F.regexp_replace("text", r"\r\n|\r", "\n"), r"\n[ \t]*\n\s*", -1)  # a blank line ends a paragraph
    paragraphs = docs.select("doc_id", L("paragraph").alias("unit"), F.posexplode(blocks).alias("number", "content"))
    return lines.unionByName(paragraphs.where(F.instr("content", "\n") > 0)).withColumn("number", C("number").cast("long") + 1)


def _once(value: Column) -> Column:
    """A generator of one row: what uses the value later does not compute it again."""
    return F.explode_outer(F.array(value))


def _common(hits: Column, bag: Counter) -> Column:
    """|A n B| of the unit's bigrams and a template's, as bags."""
    total = L(0)
    for k in sorted(set(bag.values())):
        total = total + _at_most(hits, [b for b, n in bag.items() if n == k], k)
    return total


def _at_most(hits: Column, wanted: list[str], k: int) -> Column:
    """How many of the hits are ``wanted``, equal ones counted k times at most."""
    own = F.filter(hits, lambda h: h.isin(wanted))
    if k == 1:
        return F.size(F.array_distinct(own))
    return F.aggregate(F.array_distinct(own), L(0), lambda s, b: s + F.least(F.size(F.filter(own, lambda x: x == b)), L(k)))


def _runs(bags: list[tuple[str, Counter]], least: float) -> Column:
    """Runs of a template's size in a longer unit with a Dice of ``least``: the best first, then those that overlap none before.

    A run begins at a bigram of its template: moved there, any other keeps all
    it has in common.  ``hits`` are (bigram, place) in order.
    """
    kind = "array<struct<dice:double,size:int,license:string,place:int>>"

    def judged(name: str, bag: Counter) -> Column:
        size = sum(bag.values())
        need = next(k for k in range(size + 1) if k / size >= least)

        def of(own: Column) -> Column:
            dense = F.filter(own, lambda h, j: F.get(own, j + (need - 1)).place < h.place + size)
            inside = lambda h: F.transform(F.filter(own, lambda x: (x.place >= h.place) & (x.place < h.place + size)), lambda x: x.bigram)
            return F.transform(dense, lambda h: F.struct((_common(inside(h), bag) / L(float(size))).alias("dice"), L(size).alias("size"), L(name).alias("license"), h.place.alias("place")))

        own = F.filter("hits", lambda h: h.bigram.isin(sorted(bag)))
        runs = F.filter(F.flatten(F.transform(F.array(own), of)), lambda r: r.dice >= least)
        return F.when((C("n") > size) & (F.size("hits") >= need), runs).otherwise(F.array().cast(kind))

    found = [judged(name, bag) for name, bag in bags]
    ordered = F.array_sort(F.transform(F.flatten(F.array(*found)), lambda r: F.struct((-r.dice).alias("rank"), (-r["size"]).alias("short"), r.license.alias("license"), r.place.alias("place"))))
    apart = lambda s, r: ~F.exists(s, lambda x: (x.place <= r.place - r.short) & (r.place <= x.place - x.short))
    return F.reduce(ordered, F.array().cast("array<struct<rank:double,short:int,license:string,place:int>>"), lambda s, r: F.when(apart(s, r), F.concat(s, F.array(r))).otherwise(s))


def scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per line or paragraph that is or holds a licence notice: doc_id, unit, number, license, dice, word.

    ``unit`` is line or paragraph, ``number`` its place in the text, from 1.
    The best template counts, equal ones by name.  In a unit that is no notice
    as a whole each run of words that is one has a row, with its first ``word``
    in the unit, from 1; of runs that overlap the best counts, then the longest,
    and a paragraph has rows only for runs that no line of it holds whole.
    Texts are read whole; clean documents have no row.

    Defined cases: null and empty texts have no units that match; units of
    fewer than two words have no bigrams; equal rows are reported each; null
    ids are carried; an empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(C("doc_id").cast("long").alias("doc_id"), C("text").cast("string").alias("text")).where("text IS NOT NULL")
    bags = [(name, bigrams(text)) for name, text in TEMPLATES]
    sizes = [sum(bag.values()) for _, bag in bags]
    low, high = least / (2 - least), (2 - least) / least
    known = sorted({b for _, bag in bags for b in bag})
    words = _units(texts).select("doc_id", "unit", "number", "content", _once(normalised(C("content"))).alias("words")).withColumn("n", F.size("words") - 1)
    fits = words.where(C("n") >= low * min(sizes))
    pairs = F.transform(F.slice("words", 1, C("n")), lambda w, i: F.concat(w, L(" "), F.get(C("words"), i + 1)))
    # Dice >= t asks for half of t (|A| + |B|) common bigrams, with |A| >= t / (2 - t) |B|, or for t |B| in a run as long as B
    few = least / 2 * (1 + low) * min(sizes)
    some = fits.withColumn("pairs", _once(pairs)).where(F.size(F.filter("pairs", lambda b: b.isin(known))) >= few)
    placed = F.filter(F.transform("pairs", lambda b, i: F.struct(b.alias("bigram"), i.alias("place"))), lambda h: h.bigram.isin(known))
    kept = some.select("doc_id", "unit", "number", "n", "content", _once(placed).alias("hits"))
    whole = F.transform("hits", lambda h: h.bigram)
    found = []
    for (name, bag), size in zip(bags, sizes, strict=True):
        dice = 2 * _common(whole, bag) / (C("n") + size)
        found.append(F.when((C("n") >= low * size) & (C("n") <= high * size), F.struct(dice.alias("dice"), L(name).alias("license"))))
    best = F.reduce(
        F.filter(F.array(*found), lambda x: x.dice >= least), L(None).cast("struct<dice:double,license:string>"),
        lambda a, b: F.when(a.isNull() | (b.dice > a.dice) | ((b.dice == a.dice) & (b.license < a.license)), b).otherwise(a),
    )
    judged = kept.select("doc_id", "unit", "number", "n", "content", "hits", _once(best).alias("best"))
    run = F.transform(_runs(bags, least), lambda r: F.struct((-r.rank).alias("dice"), r.license.alias("license"), (r.place + 1).cast("long").alias("word"), (r.place + 1 - r.short).cast("long").alias("last")))
    one = F.array(F.struct(C("best.dice").alias("dice"), C("best.license").alias("license"), L(1).cast("long").alias("word"), (C("n") + 1).cast("long").alias("last")))
    rows = judged.select("doc_id", "unit", "number", "content", C("best").isNull().alias("inside"), F.explode(F.when(C("best").isNull(), run).otherwise(one)).alias("r"))
    # words up to the end of each line: a run that ends in the line it begins in is reported there
    sizes_ = F.transform(F.split("content", "\n|\r"), lambda x: F.size(F.filter(normalised(x), lambda w: w != "")))
    ends = F.transform(sizes_, lambda _, i: F.aggregate(F.slice(sizes_, 1, i + 1), L(0), lambda s, x: s + x))
    cut = F.exists(ends, lambda e: (e >= C("r.word")) & (e < C("r.last")))
    return rows.where((C("unit") == "line") | ~C("inside") | cut).select("doc_id", "unit", "number", "r.license", "r.dice", "r.word")
