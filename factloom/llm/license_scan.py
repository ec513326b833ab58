"""Licence scan: passages of texts compared with licence templates by the Dice coefficient of their word bigrams.

Passages are the whole text, its paragraphs (blocks between empty lines), their lines, the sentences of lines, and
sentences that go over several lines. Of passages within one another the outermost that matches counts, so that a span
counts once. Templates are whole notices and each of their longer sentences, so that a notice is found within other
prose and over several paragraphs, sentence by sentence.

Text is normalised first: lower case, and everything but letters and digits as one space. With bigram sets of sizes a and
b, Dice is at most 2 min(a, b) / (a + b): a template is compared only if its size lies within the bounds that the
threshold leaves around the passage's. A passage that matches shares at least t / (2 - t) of a template's bigrams at
threshold t; anchors are words that so many of them hold, in every template, that each such passage holds one: texts and
passages without an anchor aren't compared. The templates are a short configured list; they are constants of the plan.
Everything is DataFrame functions.

Defined results: null and empty texts, and texts of single words, match nothing; texts of any length are compared whole;
ties go to the first template by name; repeated rows each get their own result; an empty table gives an empty result.
Other columns are kept; a column of the output's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fresh, table

THRESHOLD = 0.8

# The templates, by licence; a licence may have several.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "all-rights-reserved": ("All rights reserved.",),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd-2-clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "bsd-3-clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission.",
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to "
        "the public domain worldwide. This software is distributed without any warranty.",
    ),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available "
        "at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    "lgpl-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
    ),
}


#: Bigrams that a sentence of a template has at least to be compared apart from it.
SENTENCE = 8
_ENDS, _MARK = r"([.!?])[ \t\r\n]+", "\u0001"


def bigram_set(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def template_sets(templates: Mapping[str, tuple[str, ...]]) -> list[tuple[str, list[str]]]:
    """(licence, bigrams) of whole templates and their longer sentences, by name; equal sets once, under the first name."""
    found = {}
    for name, texts in sorted(templates.items()):
        for text in texts:
            for part in (text, *re.split(r"(?<=[.!?])\s+", text)):
                own = bigram_set(part)
                if part == text or len(own) >= SENTENCE:
                    found.setdefault(tuple(own), name)
    return sorted((name, list(own)) for own, name in found.items())


def anchors_of(sets: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every passage that reaches the threshold with some template holds one: of each template's bigrams more
    than the rest that such a passage may lack hold an anchor. Long words that serve many templates come first."""
    open_sets = [(set(own), int(len(own) * (1 - threshold / (2 - threshold)) + 1e-9) + 1) for _, own in sets]
    chosen: list[str] = []
    while open_sets:
        gain: dict[str, float] = {}
        for own, need in open_sets:
            for bigram in own:
                for word in set(bigram.split()):
                    gain[word] = gain.get(word, 0.0) + (1.0 if len(word) > 5 else 0.001) / need
        chosen.append(max(gain, key=lambda w: (gain[w], w)))
        left = [(own, need, {b for b in own if chosen[-1] in b.split()}) for own, need in open_sets]
        open_sets = [(own - held, need - len(held)) for own, need, held in left if need > len(held)]
    return sorted(chosen)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def sentences_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, _ENDS, "$1" + _MARK), _MARK)


def passages_of(text: Column) -> Column:
    """Array of (b, l, k, p): whole text (-1, -1, -1), paragraph (b, -1, -1), line (b, l, -1), sentence of a line (b, l, k),
    sentence over several lines (b, -2, k). What is the same as the passage around it is left out."""
    none = F.array().cast("array<struct<b:int,l:int,k:int,p:string>>")
    blocks = F.split(text, r"\r?\n[ \t]*\r?\n")

    def at(b, l, k, p):
        return F.struct(*(F.lit(x).cast("int").alias(n) if isinstance(x, int) else x.cast("int").alias(n) for n, x in (("b", b), ("l", l), ("k", k))), p.alias("p"))

    def several(parts: Column, made) -> Column:
        return F.when(F.size(parts) > 1, F.transform(parts, made)).otherwise(none)

    def lines(p):
        return F.split(p, r"\r?\n")

    return F.concat(
        F.array(at(-1, -1, -1, text)),
        several(blocks, lambda p, b: at(b, -1, -1, p)),
        F.flatten(F.transform(blocks, lambda p, b: several(lines(p), lambda q, l: at(b, l, -1, q)))),
        F.flatten(F.transform(blocks, lambda p, b: F.flatten(F.transform(lines(p), lambda q, l: several(sentences_of(q), lambda s, k: at(b, l, k, s)))))),
        F.flatten(F.transform(blocks, lambda p, b: F.filter(several(sentences_of(p), lambda s, k: at(b, -2, k, s)), lambda x: F.contains(x["p"], F.lit("\n"))))),
    )


def best_licence(passages: Column, sets: list[tuple[str, list[str]]], anchors: str, threshold: float) -> Column:
    """Array of (dice, licence, b, l, k) of the passages that reach the threshold, each with its best template."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [len(s) for _, s in sets]
    least, most = min(sizes) * low, max(sizes) * high

    def best(bigrams: Column) -> Column:
        n = F.size(bigrams)
        tried = []
        for name, own in sets:
            both = F.size(F.array_intersect(bigrams, F.array(*(F.lit(b) for b in own))))
            value = F.when(n.between(len(own) * low, len(own) * high), 2.0 * both / (n + len(own)))
            tried.append(F.struct(F.coalesce(value, F.lit(0.0)).alias("dice"), F.lit(name).alias("licence")))
        # the highest Dice, and of those the first name
        return F.aggregate(F.array(*tried[1:]), tried[0], lambda a, b: F.when(b["dice"] > a["dice"], b).otherwise(a)) if len(tried) > 1 else tried[0]

    def bigrams_of(words: Column) -> Column:
        n = F.size(words) - 1
        return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b)))

    def fits(passage: Column) -> Column:
        return (F.length(passage) - F.length(F.replace(passage, F.lit(" "), F.lit("")))).between(max(1, least), most)

    def keep(x: Column, name: str, value: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in ("b", "l", "k")), value.alias(name))

    # one transform for each step: a lambda's variable is computed once, an expression each time that it is named
    anchored = F.filter(passages, lambda x: F.lower(x["p"]).rlike(anchors))
    fitting = F.filter(F.transform(anchored, lambda x: keep(x, "p", _normal(x["p"]))), lambda x: fits(x["p"]))
    bigrams = F.transform(F.transform(fitting, lambda x: keep(x, "w", F.split(x["p"], " "))), lambda x: keep(x, "g", bigrams_of(x["w"])))
    matched = F.filter(F.transform(bigrams, lambda x: keep(x, "m", best(x["g"]))), lambda x: x["m"]["dice"] >= threshold - 1e-9)
    return F.transform(matched, lambda x: F.struct(x["m"]["dice"].alias("dice"), x["m"]["licence"].alias("licence"), *(x[c].alias(c) for c in ("b", "l", "k"))))


def outermost(matched: Column) -> Column:
    """matched without passages that lie within another one of it."""

    def around(a: Column, m: Column) -> Column:
        whole = (a["b"] == -1) & (m["b"] != -1)
        block = (a["b"] == m["b"]) & (a["l"] == -1) & (m["l"] != -1)
        line = (a["b"] == m["b"]) & (a["l"] == m["l"]) & (a["l"] >= 0) & (a["k"] == -1) & (m["k"] != -1)
        return whole | block | line

    return F.filter(matched, lambda m: ~F.exists(matched, lambda a: around(a, m)))


def scan_licences(df: DataFrame, text: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, out: str = "licences") -> DataFrame:
    """df with an array of (dice, licence, b, l, k), one for each passage that matches and lies in no other: see passages_of."""
    sets = template_sets(templates)
    anchors, matched = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(anchors_of(sets, threshold))})(?![\p{{L}}\p{{N}}])", fresh(df, "matched")
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<dice:double,licence:string,b:int,l:int,k:int>>")
    found = F.when(F.lower(t).rlike(anchors), best_licence(passages_of(t), sets, anchors, threshold)).otherwise(none)
    return df.withColumn(matched, found).withColumn(out, outermost(F.col(matched))).drop(matched)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licences", lambda m: m["licence"])))
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_passages"),
        F.array_join(names, ",").alias("licences"),
        F.round(F.array_max(F.transform("licences", lambda m: m["dice"])), 6).alias("best_dice"),
    )


def _sql() -> str:
    """The same in SQL: every passage with every template whose size its bounds allow, without anchors."""
    sets = template_sets(TEMPLATES)
    rows = ", ".join("('{}', [{}])".format(name, ", ".join("'" + b.replace("'", "''") + "'" for b in own)) for name, own in sets)
    sizes, low, high = [len(own) for _, own in sets], THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD

    def sentences(p: str) -> str:
        return f"string_split(regexp_replace({p}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1))"

    return f"""
WITH templates(licence, own) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
bs AS (SELECT r, regexp_split_to_array(t, '\\r?\\n[ \\t]*\\r?\\n') AS ps FROM d),
bl AS (SELECT r, len(ps) AS nb, unnest(generate_series(1, len(ps))) AS b, unnest(ps) AS p FROM bs),
ls AS (SELECT r, b, regexp_split_to_array(p, '\\r?\\n') AS qs FROM bl),
ln AS (SELECT r, b, len(qs) AS nl, unnest(generate_series(1, len(qs))) AS l, unnest(qs) AS p FROM ls),
ss AS (SELECT r, b, l, {sentences("p")} AS qs FROM ln),
sn AS (SELECT r, b, l, len(qs) AS ns, unnest(generate_series(1, len(qs))) AS k, unnest(qs) AS p FROM ss),
ws AS (SELECT r, b, {sentences("p")} AS qs FROM bl),
wr AS (SELECT r, b, len(qs) AS ns, unnest(generate_series(1, len(qs))) AS k, unnest(qs) AS p FROM ws),
u AS (
  SELECT r, 0 AS b, 0 AS l, 0 AS k, t AS p FROM d UNION ALL SELECT r, b, 0, 0, p FROM bl WHERE nb > 1 UNION ALL SELECT r, b, l, 0, p FROM ln WHERE nl > 1
  UNION ALL SELECT r, b, l, k, p FROM sn WHERE ns > 1 UNION ALL SELECT r, b, -1, k, p FROM wr WHERE ns > 1 AND contains(p, chr(10))
), w AS (
  SELECT r, b, l, k, string_split(trim(regexp_replace(lower(p), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), ' ') AS words FROM u
), g AS (
  SELECT r, b, l, k, list_distinct(list_transform(generate_series(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w
  WHERE len(words) - 1 BETWEEN {max(1.0, min(sizes) * low)!r} AND {max(sizes) * high!r}
), s AS (
  SELECT g.r, g.b, g.l, g.k, x.licence, 2.0 * len(list_intersect(g.grams, x.own)) / (len(g.grams) + len(x.own)) AS dice
  FROM g JOIN templates x ON len(g.grams) BETWEEN len(x.own) * {low!r} AND len(x.own) * {high!r}
), m AS (
  SELECT r, b, l, k, max(dice) AS dice, arg_min(licence, (-dice, licence)) AS licence FROM s GROUP BY r, b, l, k HAVING max(dice) >= {THRESHOLD} - 1e-9
), o AS (
  SELECT * FROM m WHERE NOT EXISTS (
    SELECT 1 FROM m a WHERE a.r = m.r AND ((a.b = 0 AND m.b <> 0) OR (a.b = m.b AND a.l = 0 AND m.l <> 0) OR (a.b = m.b AND a.l = m.l AND a.l > 0 AND a.k = 0 AND m.k <> 0))
  )
), n AS (
  SELECT r, count(*) AS n_passages, list_aggregate(list_sort(list_distinct(list(licence))), 'string_agg', ',') AS licences, round(max(dice), 6) AS best_dice FROM o GROUP BY r
)
SELECT doc_id, coalesce(n_passages, 0) AS n_passages, coalesce(licences, '') AS licences, best_dice FROM d LEFT JOIN n USING (r)
"""


OP2_SQL = _sql()
