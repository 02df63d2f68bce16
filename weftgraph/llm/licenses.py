"""License scans: normalised text against licence templates by Dice's coefficient over word bigrams. No Python runs on rows.

Compared are a text's lines, its paragraphs (between blank lines) and the text as a whole, each as the set of bigrams of
its normalised words. Normalised: ASCII letters in lower case, every run of other characters than a-z and 0-9 a break.
A unit of w words, d of them distinct, has between d - 1 and w - 1 distinct bigrams, so it is pruned before bigrams are made
if no template's size bounds meet that range, and its bigrams are only compared with templates within bounds. A unit must
also hold one of the anchor words of some template: words so chosen that a unit without any of them lacks too many of the
template's bigrams. Licences whose notices differ by a word or two all pass the threshold, so a unit counts for its best
template alone, of equally good ones for the alphabetically first licence.

Null and empty texts match nothing and are returned with nulls. Repeated rows each get their result; of equal scores the
alphabetically first licence wins; other columns of the input play no part.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

THRESHOLD = 0.8
#: Licence notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-3.0": (
        "Licensed under CC BY 3.0.",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    ),
    "CC-BY-SA-3.0": (
        "Licensed under CC BY-SA 3.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    ),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Everyday words that are no good anchors.
COMMON = frozenset("a an and any are at be by for from in is it of on or that the this to under use was with you work version".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).strip()


def bigrams(text: str) -> set[str]:
    w = plain(text).split()
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def size_bounds(n: int, threshold: float = THRESHOLD) -> tuple[float, float]:
    """Sizes of sets that can reach the threshold against a set of n."""
    return threshold / (2 - threshold) * n, (2 - threshold) / threshold * n


def anchors(grams: set[str], threshold: float = THRESHOLD) -> set[str]:
    """Words of which every unit that reaches the threshold holds one.

    A unit reaching it shares at least threshold / (2 - threshold) of the template's bigrams, so it can't miss all
    bigrams of words that together touch more than the rest.
    """
    spare = 1 - threshold / (2 - threshold)
    touched: set[str] = set()
    chosen: set[str] = set()
    count = Counter(w for g in grams for w in set(g.split()))
    for w in sorted(count, key=lambda w: (w in COMMON, len(w) < 3, -count[w], w)):
        if len(touched) > spare * len(grams) + 1e-9:
            break
        chosen.add(w)
        touched |= {g for g in grams if w in g.split()}
    return chosen


def _units(text: Column) -> Column:
    """Lines, paragraphs and the whole text, once each."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \\t\\r]*\n"), F.array(text)))


def _grams(unit: Column, low: float, high: float) -> Column:
    """The distinct bigrams of a unit's normalised words; none if their number can't lie between low and high."""
    plain_words = F.filter(F.split(F.regexp_replace(F.translate(unit, UPPER, LOWER), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    return let(
        plain_words,
        lambda w: F.when((F.size(w) < 2) | (F.size(w) - 1 < low - 1e-9) | (F.size(F.array_distinct(w)) - 1 > high + 1e-9), F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))
        ),
    )


def license_matches(text: Column, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """Array of (score, license) of the units' best templates, a licence once with its best score, best first and then by name."""
    sets = [(name, sorted(bigrams(t))) for name, texts in sorted(templates.items()) for t in texts]
    bounds = [size_bounds(len(g), threshold) for _, g in sets]
    low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
    anchor = "(?i)(?<![a-z0-9])(?:" + "|".join(sorted(set().union(*(anchors(set(g), threshold) for _, g in sets)))) + ")(?![a-z0-9])"
    pair = "array<struct<score:double,license:string>>"

    def scored(g: Column) -> Column:
        dice = [
            F.struct(
                F.when(F.size(g).between(lo - 1e-9, hi + 1e-9), 2.0 * F.size(F.array_intersect(g, F.array(*map(F.lit, grams)))) / (F.size(g) + len(grams))).otherwise(0.0).alias("score"),
                F.lit(name).alias("license"),
            )
            for (name, grams), (lo, hi) in zip(sets, bounds, strict=True)
        ]
        # Templates are in the order of names, so of equal scores the first name comes first.
        over = lambda d: F.filter(d, lambda x: x["score"] >= threshold)
        first = let(over(F.array(*dice)), lambda d: F.slice(F.filter(d, lambda x: x["score"] == F.array_max(F.transform(d, lambda y: y["score"]))), 1, 1))
        return F.when(F.size(g).between(low - 1e-9, high + 1e-9), first).otherwise(F.array().cast(pair))

    units = F.filter(_units(text), lambda u: u.rlike(anchor))
    found = F.flatten(F.transform(units, lambda u: let(_grams(u, low, high), scored)))
    by_name = lambda f: F.array_distinct(F.transform(f, lambda d: d["license"]))
    best = lambda f: F.transform(by_name(f), lambda n: F.struct((-F.array_max(F.transform(F.filter(f, lambda d: d["license"] == n), lambda d: d["score"]))).alias("score"), n.alias("license")))
    ranked = let(found, lambda f: F.transform(F.array_sort(best(f)), lambda d: F.struct((-d["score"]).alias("score"), d["license"].alias("license"))))
    return F.when(text.rlike(anchor), ranked).otherwise(F.array().cast(pair))


def license_scan(docs: DataFrame) -> DataFrame:
    """A row per row of docs (doc_id, text): the best licence and its score, nulls if none, their number and all of them."""
    found = docs.select("doc_id", license_matches(F.coalesce(F.col("text"), F.lit(""))).alias("m"))
    return found.select(
        "doc_id",
        F.get("m", F.lit(0))["license"].alias("license"),
        F.round(F.get("m", F.lit(0))["score"], 6).alias("dice"),
        F.size("m").cast("long").alias("n_licenses"),
        F.array_join(F.transform("m", lambda d: d["license"]), ",").alias("licenses"),
    )


def license_sql(templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same over a view documents, without any pruning."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(name)}, {quoted(plain(t))})" for name, texts in sorted(templates.items()) for t in texts)
    bigram = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    split = "list_filter(string_split(regexp_replace(translate({0}, '" + UPPER + "', '" + LOWER + "'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH templates AS (SELECT license, {bigram} AS t FROM (SELECT license, string_split(line, ' ') AS w FROM (VALUES {known}) v(license, line))),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (SELECT r, row_number() OVER () AS n, u FROM (SELECT r, unnest(list_distinct(list_concat(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n[ \t\r]*\n')), [text]))) AS u FROM docs)),
grams AS (SELECT r, n, {bigram} AS g FROM (SELECT r, n, {split.format("u")} AS w FROM units) WHERE len(w) > 1),
scored AS (SELECT r, n, license, 2.0 * len(list_intersect(g, t)) / (len(g) + len(t)) AS score FROM grams, templates WHERE len(g) <= 3 * len(t) AND len(t) <= 3 * len(g)),
firsts AS (SELECT r, license, score FROM scored WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, license) = 1),
best AS (SELECT r, license, max(score) AS score FROM firsts GROUP BY r, license),
ranked AS (SELECT r, list(license ORDER BY score DESC, license) AS names, max(score) AS top FROM best GROUP BY r)
SELECT doc_id, names[1] AS license, round(top, 6) AS dice, CAST(coalesce(len(names), 0) AS BIGINT) AS n_licenses, coalesce(array_to_string(names, ','), '') AS licenses
FROM docs LEFT JOIN ranked USING (r)"""
