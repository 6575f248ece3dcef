"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit of text carries a licence from this coefficient on.
LEAST = 0.8
#: Licences and notices as their publishers word them; long licences by the notice that goes with a work.
TEMPLATES = {
    "Apache-2.0 name": "Apache License, Version 2.0",
    "Apache-2.0 short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT name": "MIT License",
    "MIT name long": "The MIT License (MIT)",
    "MIT short": "Released under the MIT License.",
    "MIT licensed": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "GPL name": "GNU General Public License",
    "GPL short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL no warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY": "Licensed under CC BY 4.0.",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "CC-BY long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Proprietary": "All rights reserved.",
} | {f"SPDX {x}": f"SPDX-License-Identifier: {x}" for x in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "EPL-2.0", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense")}
#: Words that most texts have: no cues if others do.
COMMON = set("a all an and any are as at be been but by can copy for from has have if in including into is it its may more no not of on only or other out provided purpose shall source subject that the this to under use used was what where whether which who will with without work you your".split())
#: Fixed value: what ends a sentence.
SENTENCE_END = "[.!?][ \\t\\n\\r\\f]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _candidates(templates: Mapping[str, str], least: float) -> dict[int, list[str]]:
    """By a unit's number of distinct bigrams: the templates that can reach the coefficient. 2 min(a, b) / (a + b) bounds it."""
    sizes = {name: len({*zip(w, w[1:])}) for name, text in templates.items() for w in [_words(text)]}
    top = int(max(sizes.values()) * (2 - least) / least) + 1
    return {n: names for n in range(1, top + 1) if (names := sorted(t for t, s in sizes.items() if 2 * min(n, s) >= least * (n + s)))}


def _cues(templates: Mapping[str, str], least: float) -> list[str]:
    """Words of which a unit has at least one if it reaches the coefficient for any template.

    Such a unit lacks at most 1 - least / (2 - least) of a template's bigrams. Words are chosen, those of most use first, until
    every template has more bigrams with one of them than it may lack.
    """
    need: dict[str, int] = {}
    grams: dict[str, set[tuple[str, str]]] = {}
    for name, text in templates.items():
        w = _words(text)
        grams[name] = {*zip(w, w[1:])}
        need[name] = int(len(grams[name]) * (1 - least / (2 - least)) + 1e-9) + 1
    cues: list[str] = []
    while any(n > 0 for n in need.values()):
        use: dict[str, float] = defaultdict(float)
        for name, n in need.items():
            if n > 0:
                for word, k in Counter(x for g in grams[name] for x in {*g}).items():
                    use[word] += min(k, n) * (min(len(word), 6) ** 2 if word not in COMMON else 0.001)  # long words are rarer in other texts
        best = max(use, key=lambda x: (use[x], x))
        cues.append(best)
        for name in need:
            hit = {g for g in grams[name] if best in g}
            need[name] -= len(hit)
            grams[name] -= hit
    return sorted(cues)


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row per row of docs: id, licenses (names found, sorted), best_license, best_dice (rounded to 4 digits after the comparison), unit (place of the best one, from 0), n_lines, inside (names whose whole wording stands anywhere in the text, sorted).

    Units are a text's lines; then, where blank lines separate them, its paragraphs of several lines, and the whole; then its
    sentences, which may go over lines. So a notice is found on a line of its own, hard-wrapped, or as a sentence inside other text.
    A unit is normalised: lower case, runs of other characters than a-z and 0-9 as one space. Only units with a cue word, one of
    which every match has (_cues), are normalised, and they are compared with those templates alone whose size lets them reach the
    coefficient. Everything happens within the row, on built-in functions, so nothing is shuffled. A notice in the middle of a
    sentence is no unit: inside has it if it is worded as its template, one worded otherwise isn't found.

    Nulls: a null or empty text has one line and no licence: licenses is empty, best_license and unit are null, best_dice is 0. A
    null id stays null. The best licence is the one that shares most bigrams with its unit, so that a licence's text outranks a short notice in it; ties go to
    the higher coefficient, the unit that comes first, then the name. Repeated rows are scanned each. Empty table: no
    rows. Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    sizes = _candidates(templates, least)
    grams = {name: sorted({f"{a} {b}" for a, b in zip(w, w[1:])}) for name, text in templates.items() for w in [_words(text)]}
    candidate = lambda name: F.struct(F.lit(name).alias("name"), F.array(*[F.lit(g) for g in grams[name]]).alias("grams"))
    all_ = F.array(*[candidate(n) for n in sorted(templates)])
    place = {n: i + 1 for i, n in enumerate(sorted(templates))}
    by_size = F.create_map(*[x for n, names in sizes.items() for x in (F.lit(n), F.array(*[F.lit(place[t]) for t in names]))])
    cued = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(c)) for c in _cues(templates, least)])

    none = F.array().cast("array<string>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = docs.select(F.col(id_col).alias("id"), F.lower(text).alias("text"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))
    apart, sentences = F.split("text", r"\n[ \t]*\n"), F.split("text", SENTENCE_END)
    paragraphs = F.when(F.size(apart) > 1, F.concat(F.filter(apart, lambda p: F.contains(p, F.lit("\n"))), F.array("text"))).otherwise(none)
    units = F.concat(F.split("text", "\n"), paragraphs, F.when(F.size(sentences) > 1, sentences).otherwise(none))
    numbered = F.transform(units, lambda u, i: F.struct(i.alias("unit"), u.alias("text")))
    said = F.concat(F.lit(" "), F.regexp_replace("text", "[^a-z0-9]+", " "), F.lit(" "))
    worded = F.transform(F.array(said), lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(f" {' '.join(_words(templates[n]))} ")), n) for n in sorted(templates)])))[0]  # a transform, so that said is made once
    inside = F.when(cued(F.col("text")), worded).otherwise(none)
    out = low.select("id", "n_lines", inside.alias("inside"), F.when(cued(F.col("text")), F.filter(numbered, lambda u: cued(u["text"]))).alias("units"))
    words = lambda u: F.filter(F.split(u["text"], "[^a-z0-9]+"), lambda w: w != "")
    out = out.withColumn("units", F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), words(u).alias("words"))))
    out = out.withColumn("units", F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), F.when(F.size(u["words"]) >= 2, _bigrams(u["words"])).alias("grams"))))
    largest = max(sizes)
    out = out.select("id", "n_lines", "inside", F.filter("units", lambda u: u["grams"].isNotNull() & (F.size(u["grams"]) <= largest)).alias("units"))

    def compared(u: Column) -> Column:
        names = F.coalesce(F.try_element_at(by_size, F.size(u["grams"])), F.array().cast("array<int>"))
        shared = lambda t: F.size(F.array_intersect(u["grams"], t["grams"]))
        sized = F.transform(names, lambda k: F.struct((-shared(F.element_at("all", k))).alias("minus_shared"), (F.size(u["grams"]) + F.size(F.element_at("all", k)["grams"])).alias("both"), F.element_at("all", k)["name"].alias("name")))
        return F.transform(sized, lambda m: F.struct(m["minus_shared"].alias("minus_shared"), (F.lit(2.0) * m["minus_shared"] / m["both"]).alias("minus"), u["unit"].alias("unit"), m["name"].alias("name")))

    found = F.array_sort(F.filter(F.flatten(F.transform("units", compared)), lambda m: m["minus"] <= -least))
    out = out.withColumn("all", all_).select("id", "n_lines", "inside", F.coalesce(found, F.array().cast("array<struct<minus_shared: int, minus: double, unit: int, name: string>>")).alias("found"))
    best = F.try_element_at("found", F.lit(1))
    return out.select(F.col("id").alias(id_col), F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"]))).alias("licenses"), best["name"].alias("best_license"), F.coalesce(F.round(-best["minus"], 4), F.lit(0.0)).alias("best_dice"), best["unit"].alias("unit"), "n_lines", "inside")


def query(docs: DataFrame) -> DataFrame:
    """The columns that the query's SQL has; inside isn't among them."""
    return scan_licenses(docs).drop("inside").withColumn("licenses", F.array_join("licenses", ","))


def _sql() -> str:
    rows = ", ".join("('{}', [{}])".format(name.replace("'", "''"), ", ".join(f"'{g}'" for g in sorted({f"{a} {b}" for a, b in zip(w, w[1:])}))) for name, text in TEMPLATES.items() for w in [_words(text)])
    return rf"""
WITH t(name, grams) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, string_split_regex(text, '\n[ \t]*\n') AS apart, string_split_regex(text, '[.!?][ \t\n\r\f]+') AS sentences FROM d),
u AS (SELECT doc_id, len(lines) AS n_lines, list_concat(lines, CASE WHEN len(apart) > 1 THEN list_append(list_filter(apart, lambda x: contains(x, chr(10))), text) ELSE [] END, CASE WHEN len(sentences) > 1 THEN sentences ELSE [] END) AS units FROM p),
e AS (SELECT doc_id, unnest(units) AS unit, generate_subscripts(units, 1) - 1 AS pos FROM u),
w AS (SELECT doc_id, pos, list_filter(string_split_regex(lower(unit), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM e),
g AS (SELECT doc_id, pos, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams FROM w WHERE len(ws) >= 2),
m AS (SELECT doc_id, pos, name, len(list_intersect(g.grams, t.grams)) AS shared, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice FROM g JOIN t ON 2 * least(len(g.grams), len(t.grams)) >= 0.8 * (len(g.grams) + len(t.grams))),
b AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, arg_min(name, (-shared, -dice, pos, name)) AS best_license, round(arg_min(dice, (-shared, -dice, pos, name)), 4) AS best_dice, arg_min(pos, (-shared, -dice, pos, name)) AS unit FROM m WHERE dice >= 0.8 GROUP BY 1)
SELECT u.doc_id, coalesce(licenses, '') AS licenses, best_license, coalesce(best_dice, 0)::DOUBLE AS best_dice, unit::INT AS unit, u.n_lines::INT AS n_lines FROM u LEFT JOIN b ON b.doc_id = u.doc_id"""


SQL = _sql()
