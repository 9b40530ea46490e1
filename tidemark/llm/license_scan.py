"""License scans: text compared with licence templates by Dice coefficient over word bigrams.

DataFrame operations only. Templates are a bounded fixed table in the plan.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, settle

#: Common public licence notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT notice": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense dedication": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _words(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing A-Z."""
    return F.split(F.trim(F.regexp_replace(lower_ascii(text), "[^a-z0-9]+", " ")), " ")


def _pairs(w: Column) -> Column:
    """The bigrams of at least two words, in order."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _gate(grams: dict[str, list[str]], low: float) -> str:
    """A pattern that is in every text in which a window can reach a template.

    Such a window shares ``low n`` of a template's n bigrams, so it can't do without all of
    any ``n - low n + 1`` of them; the longest ones are the rarest.
    """
    after = defaultdict(set)
    for g in grams.values():
        least = max(1, math.ceil(low * len(g) - 1e-9))
        for x in sorted(g, key=lambda x: (-len(x), x))[: len(g) - least + 1]:
            first, second = x.split()
            after[first].add(second)
    each = "|".join(f"{a}[^A-Za-z0-9]++(?:{'|'.join(sorted(b))})(?![A-Za-z0-9])" for a, b in sorted(after.items()))
    return f"(?<![A-Za-z0-9])(?i:{each})"


def _windows(text: Column, grams: dict[str, list[str]], threshold: float, found: Column) -> Column:
    """The templates not named in ``found`` that a window of the words of ``text`` reaches, each with its best window's Dice.

    A best window starts at a bigram of the template. Starts go unless as many bigrams as
    any match shares, and then as many distinct ones, lie within the greatest length.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    rows = [
        F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("n"), F.lit(max(1, math.ceil(low * len(g) - 1e-9))).alias("least"), F.lit(math.floor(high * len(g) + 1e-9)).alias("most"))
        for k, g in grams.items()
    ]

    def value(w: Column, t: Column) -> Column:
        """The greatest Dice of the windows that start where ``w`` does."""
        start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("s"), F.lit(0.0).alias("best"))

        def step(acc: Column, i: Column) -> Column:
            x = F.get(w, i)
            new = F.array_position(w, x) == i + 1
            g = acc["g"] + F.when(new, 1).otherwise(0)
            s = acc["s"] + F.when(new & F.array_contains(t["grams"], x), 1).otherwise(0)
            return F.struct(g.alias("g"), s.alias("s"), F.greatest(acc["best"], 2 * s / (g + t["n"])).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(w) - 1), start, step, lambda acc: acc["best"])

    def best(p: Column, t: Column) -> Column:
        def of(at: Column) -> Column:
            near = lambda x, k: F.coalesce(F.get(at, k + t["least"] - 1) - x < t["most"], F.lit(False))

            def step(best: Column, a: Column) -> Column:
                def one(w: Column) -> Column:
                    shared = F.size(F.array_intersect(w, t["grams"]))
                    bound = 2 * shared / (shared + t["n"])
                    return F.when((F.round(bound, 6) >= threshold) & (bound > best), F.greatest(best, value(w, t))).otherwise(best)

                return F.when(best >= 1, best).otherwise(_let(F.slice(p, a + 1, t["most"]), one))

            return F.round(F.aggregate(F.filter(at, near), F.lit(0.0), step), 6)

        places = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.array_contains(t["grams"], F.get(p, i)))
        some = F.size(F.array_intersect(t["grams"], p)) >= t["least"]
        return F.when(some, _let(places, of)).otherwise(0.0)

    def search(w: Column) -> Column:
        left = F.filter(F.array(*rows), lambda t: ~F.array_contains(found, t["name"]))
        return F.when(F.size(w) >= 2, _let(_pairs(w), lambda p: F.transform(left, lambda t: F.struct(t["name"].alias("name"), best(p, t).alias("dice")))))

    return F.filter(F.when(text.rlike(_gate(grams, low)), _let(_words(text), search)), lambda x: x["dice"] >= threshold)


def scan(docs: DataFrame, *, text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = 0.8, most: int = 1000) -> DataFrame:
    """``docs`` with ``licenses`` (the names of the templates met, sorted, joined by ``; ``;
    empty if none), ``n_matches`` (pairs of a unit and a template, long) and ``best_dice``
    (double to six places; null if none). Columns of these names in the input are replaced.

    Units are the lines of a text, the text as a whole and windows of its words. Lines and the
    text are compared with each template: twice the
    bigrams they share over the bigrams both have, as sets. A pair that reaches
    ``threshold`` is a match; of a text of one line, the line counts once. By size alone a
    template of n bigrams can be reached only by a unit of ``t/(2-t) n`` to
    ``(2-t)/t n``: units out of every template's bounds go before any bigram is made, by
    their words and distinct words, and each template is compared only within its own.

    A template that none of these reaches is sought in every run of the text's words, across
    line ends and within lines, of ``(2-t)/t n`` bigrams at most, repeats counted; its best
    window is one match. So a notice wrapped over lines above code is found, and one between
    other sentences of a line.

    Null or empty text, and units of fewer than two words, match nothing. Rows are judged
    one by one and nothing is shuffled; an empty table gives an empty table.
    """
    if len(templates) > most:
        raise ValueError(f"{len(templates)} templates; at most {most} fit in a plan")
    names = ("licenses", "n_matches", "best_dice")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    grams = {k: template_bigrams(v) for k, v in sorted(templates.items())}
    grams = {k: v for k, v in grams.items() if v}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least = min((low * len(g) for g in grams.values()), default=1)
    greatest = max((high * len(g) for g in grams.values()), default=0)

    units, lines, hits = (fresh(c, docs) for c in ("_units", "_lines", "_hits"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # A unit of w words has w - 1 bigrams at most, and as many as its distinct words less one at least.
    whole = F.when(F.contains(text, F.lit("\n")), F.array(text)).otherwise(F.array().cast("array<string>"))
    parts = F.transform(F.concat(F.split(text, "\n"), whole), _words)
    pairs = lambda w: F.array_distinct(_pairs(w))
    seen = F.array(*[F.lit(g) for g in sorted({g for v in grams.values() for g in v})]) if grams else F.array().cast("array<string>")
    # A word of the templates' own is needed: cheap, and true of every unit that can match.
    words = F.array(*[F.lit(x) for x in sorted({w for v in grams.values() for g in v for w in g.split()})]) if grams else F.array().cast("array<string>")
    able = F.filter(parts, lambda w: (F.size(w) >= 2) & (F.size(w) - 1 >= least) & F.arrays_overlap(w, words) & (F.size(F.array_distinct(w)) - 1 <= greatest))
    out = docs.withColumn(units, F.filter(F.transform(able, pairs), lambda g: (F.size(g) <= greatest) & F.arrays_overlap(g, seen)))

    def dice(g: Column, t: list[str]) -> Column:
        fits = (F.size(g) >= low * len(t)) & (F.size(g) <= high * len(t))
        return F.when(fits, F.round(2 * F.size(F.array_intersect(g, F.array(*map(F.lit, t)))) / (F.size(g) + len(t)), 6)).otherwise(0.0)

    each = lambda g: F.array(*[F.struct(F.lit(k).alias("name"), dice(g, t).alias("dice")) for k, t in grams.items()])
    nothing = F.array().cast("array<struct<name:string,dice:double>>")
    some = F.filter(F.flatten(F.transform(units, each)), lambda x: x["dice"] >= threshold) if grams else nothing
    out = out.withColumn(lines, F.when(F.size(units) > 0, some).otherwise(nothing))
    more = _windows(text, grams, threshold, F.col(lines)["name"]) if grams else nothing
    out = out.withColumn(hits, F.concat(lines, F.coalesce(more, nothing)))
    h = F.col(hits)
    return settle(
        out,
        licenses=F.array_join(F.array_sort(F.array_distinct(F.transform(h, lambda x: x["name"]))), "; "),
        n_matches=F.size(h).cast("long"),
        best_dice=F.array_max(F.transform(h, lambda x: x["dice"])),
    ).drop(units, lines, hits)
