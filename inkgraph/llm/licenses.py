"""License scans: text units against licence templates by Dice coefficient over word bigrams.

The units of a document are its lines, and its paragraphs of more than one line. A unit is lower-
cased, everything but letters and digits counts as a space, and its set of word bigrams is held
against each template's: 2 * common / (unit + template). Since common is at most the smaller size, a
template of n bigrams needs a unit of n * t / (2 - t) to n * (2 - t) / t bigrams at the threshold t;
templates out of these bounds are not compared, and a unit too short for all of them is not even
normalised. A unit that shares no bigram with any template is left out by one set lookup.

With ``inline``, notices inside longer lines, wrapped over lines or in comment blocks are units too:
in what lines and paragraphs that match leave of the text, a run of words of a template's size around
each of its anchors, where the anchor stands in the template. Anchors are so many of a template's
bigrams, those with the longest words, that no run can reach the threshold without one; the best runs
that don't overlap count. Words put in or left out between the anchors and the rest shift a run, so
such a notice is found if the run at any one of its anchors still reaches the threshold.

All of it is one narrow projection of built-in expressions: no shuffle, no user function. The
templates are a table of constants in the plan.

Long licences are held paragraph by paragraph, as texts that quote one wrap and part it in many ways.

Defined cases: a null or empty text has no units and no licence; equal scores go to the first
template by name; units of one word have no bigrams and match nothing; texts of any length are read
whole, in one row's memory; repeated rows repeat their result; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7

# Notices by which licences are named, and the paragraphs of short licences (fixed values, as their
# publishers word them).
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0 terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Artistic-2.0": "This work is licensed under the Artistic License 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD source clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD binary clause": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib disclaimer": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Zlib grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


def normalised(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    words = normalised(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(size: int, threshold: float) -> tuple[float, float]:
    """Bigrams a unit must have to reach the threshold against a template of ``size``."""
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def anchors(text: str, threshold: float) -> list[tuple[str, int]]:
    """Bigrams of a template with their places in its words; a unit without any stays under the threshold."""
    own, words = bigrams(text), normalised(text)
    least = math.ceil(bounds(len(own), threshold)[0] - 1e-9)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    by_length = sorted(own, key=lambda g: -max(map(len, g.split())))
    return [(g, pairs.index(g)) for g in by_length[: len(own) - least + 1]]


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


#: A word that stands for what has matched already.
_GONE = "\u01c1"


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def _inline(text: Column, threshold: float, templates: dict[str, str]) -> Column:
    """(start, m) of the runs of words in ``text`` that match a template, in the order of the text."""
    names = sorted(templates)
    at: dict[str, list[tuple[int, int]]] = {}
    for k, name in enumerate(names):
        for gram, place in anchors(templates[name], threshold):
            at.setdefault(gram, []).append((k, place))
    # Where an anchor is, so is the longer of its words.
    telling = sorted({max(gram.split(), key=len) for gram in at})
    telling = [w for w in telling if not any(o in w for o in telling if o != w)]
    entries = F.create_map(*[x for gram, es in at.items() for x in (F.lit(gram), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("place")) for k, p in es]))])
    own = F.array(*[F.array(*[F.lit(g) for g in bigrams(templates[n])]) for n in names])
    long = F.array(*[F.lit(len(normalised(templates[n])) - 1) for n in names])
    name_of = F.array(*[F.lit(n) for n in names])
    empty = F.array().cast("array<struct<start:int,m:struct<minus:double,name:string>>>")

    def scored(pairs: Column, x: Column) -> Column:
        begin, end = F.greatest(x["start"], F.lit(0)), x["start"] + long[x["k"]]
        def score(grams: Column) -> Column:
            common = F.size(F.array_intersect(grams, own[x["k"]]))
            return F.struct((-2.0 * common / (F.size(grams) + F.size(own[x["k"]]))).alias("minus"), name_of[x["k"]].alias("name"), begin.alias("start"), end.alias("end"))
        return _let(F.array_distinct(F.slice(pairs, begin + 1, end - begin)), score)

    def runs(pairs: Column) -> Column:
        hits = F.filter(F.transform(pairs, lambda g, i: F.struct(i.alias("i"), g.alias("g"))), lambda h: h["g"].isin(list(at)))
        starts = F.flatten(F.transform(hits, lambda h: F.transform(entries[h["g"]], lambda e: F.struct((h["i"] - e["place"]).alias("start"), e["k"].alias("k")))))
        return F.array_sort(F.filter(F.transform(F.array_distinct(starts), lambda x: scored(pairs, x)), lambda r: -r["minus"] >= threshold))

    def apart(found: Column) -> Column:
        """Of overlapping runs the best."""
        none = F.array().cast("array<struct<minus:double,name:string,start:int,end:int>>")
        # Runs of n bigrams that only touch share a word: the bigram between two notices is in neither.
        clash = lambda r, x: (r["start"] <= x["end"]) & (x["start"] <= r["end"])
        return F.aggregate(found, none, lambda got, x: F.when(F.exists(got, lambda r: clash(r, x)), got).otherwise(F.concat(got, F.array(x))))

    in_order = lambda got: F.array_sort(F.transform(got, lambda r: F.struct(r["start"].alias("start"), F.struct(r["minus"].alias("minus"), r["name"].alias("name")).alias("m"))))

    def gated(low: Column) -> Column:
        some = F.lit(False)
        for w in telling:
            some = some | low.contains(w)
        return F.when(some, _let(_words(low), lambda w: _let(_pairs(w), lambda p: in_order(apart(runs(p)))))).otherwise(empty)

    return _let(F.lower(text), gated)


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES, inline: bool = False) -> DataFrame:
    """doc_id, license (of the best unit), score, n_matches, found for every row of ``docs``.

    ``found`` lists unit number, licence and score of all units that match, in the order of the text:
    lines first, then paragraphs of several lines, then with ``inline`` the runs of words.
    """
    table = [(name, bigrams(text)) for name, text in sorted(templates.items())]
    limits = [bounds(len(g), threshold) for _, g in table]
    least, most = min(lo for lo, _ in limits), max(hi for _, hi in limits)
    known = sorted({g for _, grams in table for g in grams})

    def best(grams: Column) -> Column:
        """The best template of a unit's bigrams, as (score, name), or null."""
        n = F.size(grams)
        scores = []
        for (name, own), (lo, hi) in zip(table, limits, strict=True):
            common = F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in own])))
            score = 2.0 * common / (n + len(own))
            fits = (n >= lo - 1e-9) & (n <= hi + 1e-9)
            scores.append(F.when(fits & (score >= threshold), F.struct((-score).alias("minus"), F.lit(name).alias("name"))))
        return F.when(F.exists(grams, lambda g: g.isin(known)), F.array_min(F.array(*scores)))

    def of_unit(unit: Column) -> Column:
        words = _words(unit)
        pairs = lambda w: F.array_distinct(_pairs(w))
        # A unit of n characters has fewer than n / 2 bigrams. How many are different shows only in the set.
        enough = F.char_length(unit) > 2 * least
        return F.when(enough, _let(words, lambda w: F.when(F.size(w) > least, _let(pairs(w), lambda g: F.when(F.size(g) <= most, best(g))))))

    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n[\x20\t\r]*\n"), lambda p: F.trim(p).contains("\n"))
    units = F.concat(lines, paragraphs)
    matched = F.filter(
        F.transform(units, lambda u, i: F.struct(i.alias("unit"), of_unit(u).alias("m"))), lambda x: x["m"].isNotNull()
    )
    if inline:
        def left(found: Column) -> Column:
            """The text with a word in place of each unit found."""
            of = lambda some: F.transform(F.filter(found, some), lambda x: F.get(units, x["unit"]))
            whole, single = of(lambda x: x["unit"] >= F.size(lines)), of(lambda x: x["unit"] < F.size(lines))
            less = F.aggregate(whole, text, lambda t, p: F.replace(t, p, F.lit(_GONE)))
            return F.array_join(F.transform(F.split(less, "\n"), lambda x: F.when(F.array_contains(single, x), F.lit(_GONE)).otherwise(x)), "\n")

        runs = lambda found: F.transform(_inline(F.when(F.size(found) > 0, left(found)).otherwise(text), threshold, templates), lambda x, i: F.struct((F.size(units) + i).alias("unit"), x["m"].alias("m")))
        matched = _let(matched, lambda found: F.concat(found, runs(found)))
    got = docs.select(F.col("doc_id"), matched.alias("found"))
    top = F.array_min(F.transform("found", lambda x: x["m"]))
    return got.select(
        "doc_id",
        top["name"].alias("license"),
        F.round(-top["minus"], 6).alias("score"),
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["unit"].cast("string"), x["m"]["name"])), ",").alias("found"),
    )


def _sql() -> str:
    lists = ", ".join("('{}', [{}])".format(n.replace("'", "''"), ", ".join("'{}'".format(g.replace("'", "''")) for g in bigrams(t))) for n, t in sorted(TEMPLATES.items()))
    return rf"""
WITH templates(name, own) AS (VALUES {lists}),
docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
    list_filter(regexp_split_to_array(coalesce(text, ''), '\n[\x20\t\r]*\n'), lambda p: contains(trim(p), chr(10))) AS paragraphs FROM documents),
units AS (SELECT r, unnest(range(len(lines) + len(paragraphs))) AS unit, unnest(list_concat(lines, paragraphs)) AS t FROM docs),
words AS (SELECT r, unit, string_split(trim(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (SELECT r, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words),
scores AS (SELECT r, unit, name, 2.0::DOUBLE * len(list_intersect(g, own)) / (len(g) + len(own)) AS s FROM grams JOIN templates ON list_has_any(g, own)),
best AS (SELECT r, unit, name, s, row_number() OVER (PARTITION BY r, unit ORDER BY s DESC, name) AS k FROM scores WHERE s >= {THRESHOLD}),
found AS (SELECT r, count(*) AS n, arg_min(name, (-s, name)) AS license, max(s) AS score, string_agg(unit || ':' || name, ',' ORDER BY unit) AS found FROM best WHERE k = 1 GROUP BY r)
SELECT doc_id, license, round(score, 6) AS score, coalesce(n, 0)::BIGINT AS n_matches, coalesce(found, '') AS found FROM docs LEFT JOIN found USING (r)
"""


SQL = _sql()
