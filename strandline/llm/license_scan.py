"""Licence scans: lines of documents that belong to licence notices or licences.

Method: text units and templates are normalised to words of a-z and 0-9 and compared by the Dice
coefficient of their sets of word bigrams, 2 |A and B| / (|A| + |B|). A coefficient of ``least`` or more needs |A|
between |B| least / (2 - least) and |B| (2 - least) / least, and least / (2 - least) of B's bigrams in the unit.
Templates outside the size bounds are not compared.

There are two kinds of units. A line is compared with the short notices. A passage of a template is a longest run of
lines (lines without words are skipped) of which each has half of its bigrams in the template, those that it shares
with the lines around it included; it is compared with its template, short or long. So notices that are wrapped, indented or commented, and
whole licences, are found in time that follows the text's length. A line's match is the best of those that cover it.

What a unit must hold prunes documents twice: from each template so many bigrams are named by *anchor* words that a
unit without any anchor has too few, and documents without any anchor are not split at all; of the others only
those that hold enough bigrams of a template are searched for its passages. Narrow: no shuffle, DataFrame functions only.

A null text has one empty line. Units with fewer than two words have no bigrams and match nothing. Long texts and lines are
worked on whole. Repeated rows get a result each; an empty table gives an empty one. Of matches with the same
coefficient the one whose name sorts last is the line's. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 0.8
SLACK = 1e-9  # keeps rounding from pruning a template on its bound
#: Short notices of common licences; (name, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved."),
]

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_BSD2 = _BSD.replace(" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "")
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
#: Whole licences and standard headers; only passages are compared with them.
TEXTS = [("Apache-2.0", _APACHE), ("BSD-2-Clause", _BSD2), ("BSD-3-Clause", _BSD), ("GPL-3.0-or-later", _GPL), ("ISC", _ISC), ("LGPL-2.1-or-later", _LGPL), ("MIT", _MIT), ("MPL-2.0", _MPL), ("Unlicense", _UNLICENSE), ("Zlib", _ZLIB)]


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order."""
    words = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def anchors(made: list[list[str]], least: float = LEAST) -> list[str]:
    """Words of which any unit that matches one of the templates holds at least one.

    A unit may lack all but least / (2 - least) of a template's bigrams. Words are taken, long ones that stand in many
    bigrams first, until fewer bigrams than that are without one of them.
    """
    chosen: list[str] = []
    for grams in made:
        spare = math.ceil(len(grams) * least / (2 - least) - SLACK) - 1  # so many may be without an anchor
        left = [g for g in grams if not set(g.split()) & set(chosen)]
        while len(left) > spare:
            worth = {}
            for g in left:
                for w in set(g.split()):
                    worth[w] = worth.get(w, 0) + max(len(w) - 3, 0.1) ** 2
            chosen.append(max(worth, key=lambda w: (worth[w], w)))
            left = [g for g in left if chosen[-1] not in g.split()]
    return chosen


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a generated column: computed once a row, however often lambdas refer to it."""
    return df.withColumn(name, F.explode(F.array(value)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _table(made: list[tuple[str, list[str]]], ratio: float) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g) * ratio - SLACK).alias("low"), F.lit(len(g) / ratio + SLACK).alias("high")) for name, g in made))


def _dice(grams: Column, t: Column) -> Column:
    """(dice, name) of a set of bigrams and a template, null outside the size bounds."""
    size = F.size(grams)
    both = F.size(F.array_intersect(grams, t["grams"]))
    return F.when(size.between(t["low"], t["high"]), F.struct((both * 2 / (size + F.size(t["grams"]))).alias("dice"), t["name"].alias("name")))


def _passages(lines: Column, t: Column) -> Column:
    """Runs (a, b) of places in ``lines`` (line, words) that each have half of their bigrams in template ``t``."""

    def belongs(u: Column, i: Column) -> Column:
        none = F.array().cast("array<string>")
        before = F.coalesce(F.slice(F.get(lines, i - 1)["words"], -1, 1), none)
        after = F.coalesce(F.slice(F.get(lines, i + 1)["words"], 1, 1), none)
        return _let(_pairs(F.concat(before, u["words"], after)), lambda p: (F.size(p) > 0) & (F.size(F.filter(p, lambda g: F.array_contains(t["grams"], g))) * 2 >= F.size(p)))

    def step(state: Column, x: Column) -> Column:
        """``open``: where the run began, or -1."""
        begin = F.when(state["open"] < 0, x["i"]).otherwise(state["open"])
        close = F.concat(state["done"], F.array(F.struct(state["open"].alias("a"), (x["i"] - 1).alias("b"))))
        ended = F.struct(F.lit(-1).alias("open"), F.when(state["open"] < 0, state["done"]).otherwise(close).alias("done"))
        return F.when(x["in"], F.struct(begin.alias("open"), state["done"].alias("done"))).otherwise(ended)

    marks = F.transform(lines, lambda u, i: F.struct(i.alias("i"), belongs(u, i).alias("in")))
    marks = F.concat(marks, F.array(F.struct(F.size(lines).alias("i"), F.lit(False).alias("in"))))
    begin = F.struct(F.lit(-1).alias("open"), F.array().cast("array<struct<a:int,b:int>>").alias("done"))
    return F.aggregate(marks, begin, step, lambda state: state["done"])


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, text: str = "text", id_col: str = "doc_id", spans: bool = False, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """One row for each document: id, n_lines, n_license_lines, licenses, best_dice (and the matches themselves)."""
    short = [(name, grams) for name, t in templates if (grams := bigrams(t))]
    whole = short + [(name, grams) for name, t in texts if (grams := bigrams(t))]
    ratio = least / (2 - least)
    fewest = min((math.ceil(len(g) * ratio - SLACK) for _, g in short), default=0)
    given = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    n_lines = F.octet_length(given) - F.octet_length(F.replace(given, F.lit("\n"), F.lit(""))) + 1
    match = "array<struct<line:int,best:struct<dice:double,name:string>>>"

    def normal(value: Column) -> Column:
        """Lines with their words; all that is no word becomes a space, and lines without words go."""
        split = F.split(F.regexp_replace(F.translate(value, UPPER, LOWER), "[^a-z0-9\n]+", " "), "\n", -1)
        worded = F.transform(split, lambda line, i: F.struct(i.alias("line"), F.trim(line).alias("words")))
        return F.transform(F.filter(worded, lambda u: u["words"] != ""), lambda u: F.struct(u["line"], F.split(u["words"], " ").alias("words")))

    def by_line(lines: Column) -> Column:
        table = _table(short, ratio)
        units = F.filter(lines, lambda u: F.size(u["words"]) > max(fewest, 1))
        best = F.transform(units, lambda u: F.struct(u["line"].alias("line"), _let(F.array_distinct(_pairs(u["words"])), lambda g: F.array_max(F.transform(table, lambda t: _dice(g, t)))).alias("best")))
        return F.filter(best, lambda m: m["best"]["dice"] >= least)

    def by_passage(lines: Column, able: Column) -> Column:
        def matched(t: Column) -> Column:
            runs = F.transform(_passages(lines, t), lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1))
            scored = F.transform(runs, lambda r: F.struct(r.alias("lines"), _dice(F.array_distinct(_pairs(F.flatten(F.transform(r, lambda u: u["words"])))), t).alias("best")))
            found = F.filter(scored, lambda m: m["best"]["dice"] >= least)
            return F.flatten(F.transform(found, lambda m: F.transform(m["lines"], lambda u: F.struct(u["line"].alias("line"), m["best"].alias("best")))))

        return F.flatten(F.transform(able, matched))

    out = docs.select(F.col(f"`{id_col}`"), n_lines.cast("long").alias("n_lines"), given.alias("text"))
    if whole:
        words = anchors([g for _, g in whole], least)
        out = _once(out, "lower", F.lower("text"))
        tests = [F.contains("lower", F.lit(w)) for w in words if len(w) > 5]
        if brief := [w for w in words if len(w) <= 5]:  # as whole words: many others hold them
            tests.append(F.rlike("text", F.lit(f"(?i)(?<![a-z0-9])(?:{'|'.join(brief)})(?![a-z0-9])")))
        some = reduce(or_, tests)
        out = _once(out, "lines", F.when(some, normal(F.col("text")))).drop("text", "lower")
        every = F.array(*map(F.lit, dict.fromkeys(g for _, grams in whole for g in grams)))
        held = F.array_intersect(_pairs(F.flatten(F.transform("lines", lambda u: u["words"]))), every)
        out = _once(out, "held", F.when(F.size("lines") > 0, held))
        # a coefficient of least needs so many of the template's own bigrams
        out = _once(out, "able", F.when(F.size("held") > 0, F.filter(_table(whole, ratio), lambda t: F.size(F.array_intersect(t["grams"], F.col("held"))) >= t["low"])))
        found = F.concat(by_line(F.col("lines")) if short else F.array().cast(match), by_passage(F.col("lines"), F.col("able")))
        # sorted, the last match of a line is its best
        found = F.array_sort(F.array_distinct(F.transform(found, lambda m: F.struct(m["line"].alias("line"), m["best"].alias("best")))))
        out = _once(out, "found", F.when(F.size("able") > 0, found))
        last = F.filter("found", lambda m, i: F.coalesce(F.get("found", i + 1)["line"] != m["line"], F.lit(True)))
        matches = F.coalesce(last, F.array().cast(match))
    else:
        matches = F.array().cast(match)
    out = out.select(F.col(f"`{id_col}`"), "n_lines", F.explode(F.array(matches)).alias("matches"))
    dice = F.array_max(F.transform("matches", lambda m: m["best"]["dice"]))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["best"]["name"]))), ",")
    return out.select(F.col(f"`{id_col}`"), "n_lines", F.size("matches").cast("long").alias("n_license_lines"), names.alias("licenses"), dice.alias("best_dice"), *["matches"] * spans)
