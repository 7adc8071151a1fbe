"""Licence scans: passages compared with licence templates by the Dice coefficient over word bigrams.

A passage is a line, a paragraph between empty lines, or the whole text; a text's equal passages
count once. Text is normalised to lower-case words (letters, digits, and what is beyond ASCII).
With a and b bigrams, of which c are common (repeats count), the coefficient is 2c / (a + b); it can
reach `threshold` only if a lies between b t / (2 - t) and b (2 - t) / t. The templates are
therefore keyed by all sizes that they admit, and an equi-join of a passage's size with that
broadcast table, which the templates bound, leaves its few candidates. Everything is built-in
functions, and nothing is shuffled.

Licences also stand across lines and paragraphs, in comments, and in the middle of lines. So what no
passage above has matched is searched for windows: any run of words, of whatever lines, from one of a
template's bigrams to another, that reaches the threshold. Of windows that overlap, that one counts which
has the most bigrams in common, less those that it or the template has alone; so a whole header goes
before a notice in it. A text is searched if it has one of `keywords`, without which no passage or window can reach it.

Null and empty texts, and passages of fewer than two words, match nothing; an empty table has no rows. A
text of any length is scanned whole. Columns may have any names. Of several templates that
reach the threshold the best is given, of equal ones the first by name. Repeated rows repeat.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, but for the line feed.
SEPARATORS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""
_LGPL = _GPL.replace("GNU General", "GNU Lesser General")
#: Licence texts and notices by name; a name's part after the slash tells its forms apart.
TEMPLATES: dict[str, str] = {
    "MIT/text": _MIT,
    "MIT/notice": "Released under the MIT License.",
    "MIT/licensed": "Licensed under the MIT License.",
    "ISC/text": _ISC,
    "BSD-2-Clause/text": _BSD,
    "Apache-2.0/header": _APACHE,
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0/header": _GPL.format(2),
    "GPL-3.0/header": _GPL.format(3),
    "MPL-2.0/header": _MPL,
    "Unlicense/text": _UNLICENSE,
    "AGPL-3.0/header": _GPL.replace("GNU General", "GNU Affero General").format(3),
    "BSD-3-Clause/text": f"""{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used
to endorse or promote products derived from this software without specific prior written permission.""",
    "LGPL-2.1/header": _LGPL.replace("program", "library").format("2.1"),
    "LGPL-3.0/header": _LGPL.format(3),
    "LGPL-3.0/library": _LGPL.replace("program", "library").format(3),
} | {
    f"{name}-{v}.0/{form}": text.format(v=v)
    for name, form, text, versions in (
        ("GPL", "notice", "This work is licensed under the GNU General Public License, version {v}.", (1, 2, 3)),
        ("CC-BY", "notice", "Licensed under CC BY {v}.0.", (2, 3, 4)),
        ("CC-BY-SA", "notice", "Licensed under CC BY-SA {v}.0.", (2, 3, 4)),
        ("CC-BY-NC", "notice", "Licensed under CC BY-NC {v}.0.", (2, 3, 4)),
        ("CC-BY-ND", "notice", "Licensed under CC BY-ND {v}.0.", (2, 3, 4)),
    )
    for v in versions
}


#: Words that many texts have; they are keywords only where a template needs them.
COMMON = frozenset("a an and any as at be by for free from in is it not of on or other person same that the this to under use which will with work you".split())


def words_of(text: str) -> list[str]:
    """A template's words; for templates alone, texts are normalised by `passages`."""
    lower = text.translate(str.maketrans(UPPER, LOWER))
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", lower).split()


def bigrams_of(text: str) -> Counter:
    words = words_of(text)
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def sizes(n: int, threshold: float) -> range:
    """Sizes that can reach the threshold with n bigrams."""
    low = math.ceil(n * threshold / (2 - threshold) - 1e-9)
    return range(max(1, low), math.floor(n * (2 - threshold) / threshold + 1e-9) + 1)


def keywords(templates: Mapping[str, str], threshold: float) -> list[str]:
    """Words of which every text that reaches the threshold has one, long ones first.

    c common bigrams of n reach it only if c >= n t / (2 - t). A template's words are taken until fewer
    bigrams than that are without them.
    """
    found: set[str] = set()
    for text in templates.values():
        grams = bigrams_of(text)
        left = {tuple(g.split(" ")): k for g, k in grams.items()}
        least = sum(grams.values()) * threshold / (2 - threshold) - 1e-9
        for w in sorted(set(words_of(text)), key=lambda w: (w in COMMON, w not in found, -len(w), w)):
            if sum(left.values()) < least or not left:
                break
            left = {g: k for g, k in left.items() if w not in g}
            found.add(w)
    return sorted(w for w in found if not any(o != w and o in w for o in found))


def searched(docs: DataFrame, text_col: str, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """The rows whose text has one of the keywords, without which nothing in it can reach the threshold."""
    lower = docs.select("*", F.explode(F.array(F.lower(F.col(text_col).cast("string")))).alias("__lower"))
    able = F.lit(False)
    for w in keywords(templates, threshold):
        able = able | F.col("__lower").contains(w)
    return lower.where(able).drop("__lower")


def by_size(spark: SparkSession, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """Columns __n, __templates (array of license, n, bigrams, counts): the candidates of each size."""
    rows: dict[int, list] = {}
    for name, text in sorted(templates.items()):
        grams = bigrams_of(text)
        n = sum(grams.values())
        for size in sizes(n, threshold) if n else ():
            rows.setdefault(size, []).append((name, n, list(grams), list(grams.values())))
    schema = "__n int, __templates array<struct<license: string, n: int, bigrams: array<string>, counts: array<int>>>"
    return spark.createDataFrame(sorted(rows.items()), schema)


def normalised(text: Column) -> Column:
    """Lower-case words between single spaces, with the line feeds."""
    return F.regexp_replace(F.translate(text.cast("string"), UPPER, LOWER), SEPARATORS, " ")


def passages(flat: Column) -> Column:
    """The distinct passages of a normalised text."""
    paragraphs = F.transform(F.split(flat, r"\n *\n"), lambda p: F.translate(p, "\n", " "))
    every = F.concat(F.split(flat, "\n"), paragraphs, F.array(F.translate(flat, "\n", " ")))
    return F.array_distinct(F.transform(every, lambda p: F.trim(F.regexp_replace(p, "  +", " "))))


def scan(
    docs: DataFrame, keep: list[str], text_col: str = "text",
    templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """The columns of keep, license, score, n_bigrams and passage: each passage or window that reaches the threshold."""
    rows = docs.select(F.struct(*keep).alias("__row"), F.col(text_col).alias("__text"))
    found = [f(rows, ["__row"], "__text", templates, threshold) for f in (by_passage, by_window)]
    return found[0].unionByName(found[1]).select("__row.*", "license", "score", "n_bigrams", "passage")


def grams_of(words: Column, n: Column) -> Column:
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def common(t: Column, grams: Column) -> Column:
    """Number of bigrams in common with a template, repeats included."""
    shared = F.zip_with(t["bigrams"], t["counts"], lambda g, c: F.least(c, F.size(F.filter(grams, lambda b: b == g))))
    return F.aggregate(shared, F.lit(0), lambda a, x: a + x)


def by_window(docs: DataFrame, keep: list[str], text_col: str, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """Windows that reach the threshold, in what is left of each text without the passages that do."""
    rows = []
    for name, text in sorted(templates.items()):
        grams = bigrams_of(text)
        n = sum(grams.values())
        if n:
            rows.append((name, n, sizes(n, threshold)[0], sizes(n, threshold)[-1], list(grams), list(grams.values())))
    schema = "__all array<struct<license: string, n: int, low: int, high: int, bigrams: array<string>, counts: array<int>>>, __grams array<string>"
    every = docs.sparkSession.createDataFrame([(rows, sorted({g for r in rows for g in r[4]}))], schema)
    # More words than a window has, so that none goes over a matched passage.
    gap = " \n" * (max((r[3] for r in rows), default=0) + 2) + " "

    def plain(p: Column) -> Column:
        return F.trim(F.regexp_replace(F.translate(p, "\n", " "), "  +", " "))

    def sized(p: Column) -> Column:
        words = F.split(p, " ")
        return F.struct(p.alias("p"), (F.size(words) - 1).alias("n"), grams_of(words, F.size(words) - 1).alias("b"))

    def able_of(t: Column, present: Column) -> Column:
        """Whether enough of a template's bigrams are there; present has all templates' bigrams that are."""
        seen = F.zip_with(t["bigrams"], t["counts"], lambda g, c: F.when(F.array_contains(present, g), c).otherwise(0))
        return (F.size(present) > 0) & (F.aggregate(seen, F.lit(0), lambda a, x: a + x) >= t["low"])

    def marked(u: Column) -> Column:
        return F.struct(u["p"].alias("p"), u["n"].alias("n"), u["b"].alias("b"), F.array_intersect("__grams", u["b"]).alias("g"))

    def matches(u: Column) -> Column:
        fits = lambda t: (u["n"] >= t["low"]) & (u["n"] <= t["high"]) & able_of(t, u["g"])
        return F.exists(F.filter("__all", fits), lambda t: 2.0 * common(t, u["b"]) / (u["n"] + t["n"]) >= threshold)

    def left_of(p: Column) -> Column:
        lines = F.transform(F.split(p, "\n"), lambda x: F.when(F.array_contains("__done", plain(x)), F.lit(gap)).otherwise(x))
        return F.when(F.array_contains("__done", plain(p)), F.lit(gap)).otherwise(F.array_join(lines, " "))

    def once(e: Column, name: str) -> list:
        """Computed once, and not in each lambda that uses it."""
        return ["*", F.explode(F.array(e)).alias(name)]

    words = F.split("__rest", " ")
    texts = (
        docs.select(*keep, F.col(text_col).alias("__text"))
        .transform(lambda d: searched(d, "__text", templates, threshold))
        .select(*keep, F.explode(F.array(normalised(F.col("__text")))).alias("__flat"))
        .join(F.broadcast(every))
        .select(*once(F.filter(F.transform(passages(F.col("__flat")), sized), lambda u: u["n"] >= 1), "__sized"))
        .select(*once(F.transform("__sized", marked), "__units"))
        .select(*once(F.transform(F.filter("__units", matches), lambda u: u["p"]), "__done"))
        .where(~F.array_contains("__done", plain(F.col("__flat"))))
        .select(*once(F.array_join(F.transform(F.split("__flat", r"\n *\n"), left_of), " "), "__left"))
        # The gaps' line feeds are words.
        .select(*once(F.trim(F.regexp_replace("__left", "  +", " ")), "__rest"))
        .select(*once(words, "__w"))
        .where(F.size("__w") > 1)
        .select(*once(grams_of(F.col("__w"), F.size("__w") - 1), "__b"))
        .select(*once(F.array_intersect("__grams", "__b"), "__present"))
        .select(*once(F.filter("__all", lambda t: able_of(t, F.col("__present"))), "__able"))
        .where(F.size("__able") > 0)
    )

    def marks(t: Column) -> Column:
        """Where the template's bigrams are, and for each of these marks the last one before it that it is one too many with."""
        at = F.filter(F.sequence(F.lit(1), F.size("__b")), lambda i: F.array_contains(t["bigrams"], F.element_at("__b", i)))
        return F.struct(t.alias("t"), at.alias("at"), F.transform(at, lambda i: F.element_at("__b", i)).alias("gram"))

    def repeats(m: Column) -> Column:
        """A bigram that the template has c times counts in a window unless c of its kind come before it there: `past` is the c-th of those, or 0."""
        t, gram = m["t"], m["gram"]

        def past(g: Column, k: Column) -> Column:  # k from 0
            c = F.element_at(t["counts"], F.array_position(t["bigrams"], g).cast("int"))
            first = F.greatest(k - t["high"], F.lit(0))
            same = F.filter(F.transform(F.slice(gram, first + 1, k - first), lambda x, d: F.when(x == g, first + d + 1)), lambda d: d.isNotNull())
            return F.coalesce(F.try_element_at(same, -c), F.lit(0))

        return F.struct(t.alias("t"), m["at"].alias("at"), F.transform(gram, past).alias("past"))

    near = F.transform(F.transform("__able", marks), repeats)

    def windows(m: Column) -> Column:
        t, at, past, k = m["t"], m["at"], m["past"], F.size(m["at"])

        def size(i: Column, j: Column) -> Column:
            return F.element_at(at, j) - F.element_at(at, i) + 1

        def of(i: Column) -> Column:
            """Windows from mark i on; bigrams in common with those of marks i to j are the marks among them that aren't one too many."""
            far = F.filter(F.sequence(i, F.least(k, i + t["high"] - 1)), lambda j: size(i, j) <= t["high"])
            shared = F.aggregate(
                F.slice(past, i, F.size(far)), F.array().cast("array<int>"),
                lambda c, p: F.concat(c, F.array(F.coalesce(F.get(c, F.size(c) - 1), F.lit(0)) + F.when(p < i, 1).otherwise(0))),
            )
            reached = F.filter(
                F.transform(shared, lambda c, d: F.struct(c.alias("c"), size(i, i + d).alias("n"), F.element_at(at, i).alias("s"), F.element_at(at, i + d).alias("e"))),
                lambda w: 2.0 * w["c"] / (w["n"] + t["n"]) >= threshold,
            )
            return F.transform(
                reached,
                lambda w: F.struct(
                    (w["n"] + t["n"] - 3 * w["c"]).alias("loss"), (-2.0 * w["c"] / (w["n"] + t["n"])).alias("minus"),
                    t["license"].alias("license"), w["s"].alias("s"), w["e"].alias("e"),
                ),
            )

        # A window has `low` marks at least, so that many must lie within the longest one.
        able = F.filter(F.sequence(F.lit(1), F.greatest(k - t["low"] + 1, F.lit(1))), lambda i: (i + t["low"] - 1 <= k) & (size(i, F.least(k, i + t["low"] - 1)) <= t["high"]))
        return F.flatten(F.transform(able, of))

    every_window = F.flatten(F.transform("__near", windows))
    none = F.array().cast("array<struct<loss: int, minus: double, license: string, s: int, e: int>>")
    best = F.aggregate(
        F.array_sort("__windows"),
        none,
        lambda kept, w: F.when(F.exists(kept, lambda x: (x["s"] <= w["e"]) & (w["s"] <= x["e"])), kept).otherwise(F.concat(kept, F.array(w))),
    )
    row = F.array_distinct(
        F.transform(
            "__best",
            lambda w: F.struct(
                w["license"].alias("license"),
                F.round(-w["minus"], 6).alias("score"),
                (w["e"] - w["s"] + 1).cast("bigint").alias("n_bigrams"),
                F.array_join(F.slice("__w", w["s"], w["e"] - w["s"] + 2), " ").alias("passage"),
            ),
        )
    )
    return (
        texts.select(*once(near, "__near"))
        .select(*once(every_window, "__windows"))
        .where(F.size("__windows") > 0)
        .select(*once(best, "__best"))
        .select(*keep, F.inline(row))
    )


def by_passage(docs: DataFrame, keep: list[str], text_col: str, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """Passages that reach the threshold."""
    candidates = by_size(docs.sparkSession, templates, threshold)
    grams = grams_of(F.split("__p", " "), F.col("__n"))
    # explode() of one element keeps an expression from being put into the lambdas that use it.
    units = (
        searched(docs, text_col, templates, threshold)
        .select(*keep, F.explode(F.array(normalised(F.col(text_col)))).alias("__flat"))
        .select(*keep, F.explode(passages(F.col("__flat"))).alias("__p"))
        # As many spaces as bigrams.
        .withColumn("__n", F.length("__p") - F.length(F.translate("__p", " ", "")))
        .join(F.broadcast(candidates), "__n")
        .select("*", F.explode(F.array(grams)).alias("__b"))
    )

    def scored(t: Column) -> Column:
        # Repeats can't add more to the different bigrams in common than the template has.
        most = F.size(F.array_intersect(t["bigrams"], F.col("__b"))) + t["n"] - F.size(t["bigrams"])
        able = 2.0 * most / (F.col("__n") + t["n"]) >= threshold
        dice = F.when(able, 2.0 * common(t, F.col("__b")) / (F.col("__n") + t["n"])).otherwise(0.0)
        return F.struct((-dice).alias("minus"), t["license"].alias("license"))

    best = F.array_min(F.transform("__templates", scored))
    return (
        units.select("*", F.explode(F.array(best)).alias("__best"))
        .where(F.col("__best.minus") <= -threshold)
        .select(
            *keep,
            F.col("__best.license").alias("license"),
            F.round(-F.col("__best.minus"), 6).alias("score"),
            F.col("__n").cast("bigint").alias("n_bigrams"),
            F.col("__p").alias("passage"),
        )
    )
