"""License scans by the Dice coefficient over word bigrams (native).

Lines, paragraphs of several lines and whole texts are units. A unit is normalised (lower case, anything but a-z and
0-9 becomes a space) and turned into its set of word bigrams. With n and m bigrams, Dice >= t needs
``t/(2-t) <= n/m <= (2-t)/t``: units with too few words for any template are dropped before their bigrams are made, units
whose number of different bigrams is within no template's bounds before these are joined, and the bounds of each template
are part of the join condition. Before that, texts and units without any of the pivots that a match must hold (``pivots``)
are passed over. The join is
from bigrams to the fixed table of template bigrams, so no unit is paired with a template that it shares nothing with,
and only counts are shuffled.

A text's license is the one that explains most of it: a match weighs the bigrams that it shares times its score, a
license the best of its matches in each unit, added up over lines, or over paragraphs, or the whole text, whichever gives
most. What two licenses have in common is a template of either, so that it is their difference that decides.

Null and empty texts have no license (null, 0.0, 0). Ties in the weight go to the first license by name. Repeated rows
each get the result of their text; unlike texts under one id are told apart. A very long text is one unit like others,
its set of bigrams made only if it holds a pivot. An empty table gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections import Counter
from functools import cache, reduce
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmark.llm.common import text_of

LEAST_DICE = 0.8

# Notices and short texts of public licenses; long ones lie in WHOLE_TEXTS.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CONDITIONS = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE_GRANT = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_DISCLAIMER = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'


def _gnu(what: str, name: str, version: str, only: bool = False) -> tuple[str, str]:
    """The notice of a license of the GNU family: its grant alone, and with what follows."""
    versions = f"version {version} of the License." if only else f"either version {version} of the License, or (at your option) any later version."
    grant = f"{what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {versions}"
    disclaimer = f"{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    copy = f"You should have received a copy of the {name} along with {what.lower()}. If not, see <https://www.gnu.org/licenses/>."
    return grant, f"{grant} {disclaimer} {copy}"


_FAMILY = (
    ("agpl-3.0", "This program", "GNU Affero General Public License", "3"),
    ("gpl-2.0", "This program", "GNU General Public License", "2"),
    ("gpl-3.0", "This program", "GNU General Public License", "3"),
    ("lgpl-2.1", "This library", "GNU Lesser General Public License", "2.1"),
    ("lgpl-3.0", "This library", "GNU Lesser General Public License", "3"),
)

TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", _APACHE_GRANT),
    ("apache-2.0", _APACHE_DISCLAIMER),
    ("apache-2.0", f"{_APACHE_GRANT} {_APACHE_DISCLAIMER}"),
    ("bsd-2-clause", _BSD_GRANT),
    ("bsd-2-clause", _BSD_DISCLAIMER),
    ("bsd-2-clause", f"{_BSD_GRANT} {_BSD_CONDITIONS}"),
    ("bsd-2-clause", f"{_BSD_GRANT} {_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", _BSD_GRANT),
    ("bsd-3-clause", _BSD_DISCLAIMER),
    ("bsd-3-clause", _BSD_NAMES),
    ("bsd-3-clause", f"{_BSD_GRANT} {_BSD_CONDITIONS} 3. {_BSD_NAMES}"),
    ("bsd-3-clause", f"{_BSD_GRANT} {_BSD_CONDITIONS} 3. {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", _ISC_GRANT),
    ("isc", f"{_ISC_GRANT} {_ISC_DISCLAIMER}"),
    ("mit", "Released under the MIT License."),
    ("mit", _MIT_GRANT),
    ("mit", f"{_MIT_GRANT} {_MIT_REST}"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    *((license, text) for license, what, name, version in _FAMILY for text in _gnu(what, name, version)),
    *((license, _gnu(what, name, version, only=True)[0]) for license, what, name, version in _FAMILY),
)

#: Whole texts of public licenses, one file for each beside this module; the file's name is the license.
WHOLE_TEXTS = "license_texts"
#: Templates of more bigrams than this are whole texts that only long units can match; they have pivots of their own.
SHORT = 400
#: Pivots are the first letters of words, so that one serves all forms of a word.
STEM = 6


@cache
def templates() -> tuple[tuple[str, str], ...]:
    """(license, text): the notices, then the whole texts by name."""
    folder = resources.files(__package__) / WHOLE_TEXTS
    files = sorted((f for f in folder.iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return (*TEMPLATES, *((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files))


#: Units with their level: lines, paragraphs, the whole.
_UNITS = """concat(transform(split(_l_text, '\\n', -1), x -> struct(0 AS level, x AS text)),
  transform(filter(split(_l_text, '\\n[ \\t]*\\n', -1), x -> contains(x, '\\n')), x -> struct(1 AS level, x AS text)),
  transform(filter(array(_l_text), x -> contains(x, '\\n')), x -> struct(2 AS level, x AS text)))"""


def _normal(s: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in s.lower()).split()


def _bigrams(text: str) -> list[tuple[str, str]]:
    w = _normal(text)
    return sorted(set(zip(w, w[1:])))


def template_bigrams() -> list[tuple[int, str, int, str]]:
    """(template, license, number of its bigrams, bigram)."""
    rows = []
    for k, (name, text) in enumerate(templates()):
        grams = _bigrams(text)
        rows += [(k, name, len(grams), f"{a} {b}") for a, b in grams]
    return rows


@cache
def pivots(least: float = LEAST_DICE, long: bool = False) -> list[tuple[str, ...]]:
    """Beginnings of words, or pairs of words in a row, of which a unit must hold one to reach ``least`` with a template.

    A match shares ``least / (2 - least)`` of the template's bigrams at least. If more bigrams than may be missing have a
    word that begins with one of some stems, then a match holds one of these. Stems are taken one after the other, each the
    one that serves the templates best that still lack some; templates of too few long words are served by pairs. With
    ``long``, the pivots that templates of more than ``SHORT`` bigrams need beside those of the others; they have long
    words enough to do without those of five letters, which are often common ones.
    """
    grams = [_bigrams(text) for _, text in templates()]
    short, whole = ([g for g in grams if (len(g) > SHORT) == side] for side in (False, True))
    chosen = _stems(short, least, 5, set())
    if long:
        return [(x,) for x in _stems(whole, least, STEM, set(chosen))]
    pairs: set[tuple[str, ...]] = set()
    for g in short:
        own = [x for x in g if not _stems_of(x) & {*chosen}]
        pairs |= {x for x in sorted(own, key=lambda x: (x not in pairs, -len("".join(x)), x))[: _lacking(g, least, {*chosen})]}
    return sorted([*((x,) for x in chosen), *pairs])


def _stems_of(gram: tuple[str, str], letters: int = 5) -> set[str]:
    return {x[:STEM] for x in gram if len(x) >= letters}


def _lacking(grams: list[tuple[str, str]], least: float, chosen: set[str]) -> int:
    """How many bigrams more must have a pivot, so that a match cannot miss them all."""
    may_miss = int(len(grams) * (1 - least / (2 - least)) + 1e-9)
    return max(0, may_miss + 1 - sum(bool(_stems_of(g) & chosen) for g in grams))


def _stems(texts: list[list[tuple[str, str]]], least: float, letters: int, chosen: set[str]) -> list[str]:
    out: list[str] = []
    while True:
        gains: Counter[str] = Counter()
        for grams in texts:
            if lacking := _lacking(grams, least, chosen):
                own = Counter(x for g in grams if not _stems_of(g) & chosen for x in _stems_of(g, letters))
                gains.update({x: min(n, lacking) / lacking for x, n in own.items()})
        if not gains:
            return out
        out.append(max(gains, key=lambda x: (gains[x], x)))
        chosen = chosen | {out[-1]}


def _any_of(some: list[tuple[str, ...]]) -> str:
    """A pattern that finds any of some pivots where a word begins: one pass, with few branches at each word."""
    rest: dict[str, list[str]] = {}
    for first, *more in some:
        rest.setdefault(first[0], []).append(first[1:] + "".join(f"[^a-z0-9]+{w}(?![a-z0-9])" for w in more))
    return "[^a-z0-9](?:" + "|".join(f"{x}(?:{'|'.join(sorted(ys))})" for x, ys in sorted(rest.items())) + ")"


def _may_match(text: Column, least: float) -> Column:
    """Whether a text in lower case holds what it must to match; whole licenses take texts of some length."""
    fewest = min(n for n in _sizes() if n > SHORT) * least / (2 - least)
    text, short, long = F.concat(F.lit(" "), text), pivots(least), pivots(least, long=True)
    # n bigrams need more than n words, and each word but the last takes two characters at least
    return F.when(F.length(text) > 2 * int(fewest), text.rlike(_any_of([*short, *long]))).otherwise(text.rlike(_any_of(short)))


def _sizes() -> list[int]:
    return sorted({len(_bigrams(text)) for _, text in templates()})


def _may_have(size: Column, least: float) -> Column:
    """Whether a unit of so many bigrams is within the bounds of any template."""
    merged: list[list[float]] = []
    for n in _sizes():
        low, high = n * least / (2 - least), n * (2 - least) / least
        if merged and low <= merged[-1][1]:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    return reduce(lambda a, b: a | b, ((size >= low) & (size <= high) for low, high in merged))


def scan_licenses(docs: DataFrame, least: float = LEAST_DICE) -> DataFrame:
    """One row per document: doc_id, its best license, the Dice score of that and the number of units that match any."""
    rows = template_bigrams()
    table = docs.sparkSession.createDataFrame(rows, "_t_id int, _t_license string, _t_n int, _t_gram string")
    low, high = least / (2 - least), (2 - least) / least
    fewest = min(r[2] for r in rows) * low
    keyed = docs.select(F.col("doc_id").alias("_l_id"), text_of().alias("_l_text")).select("*", F.xxhash64("_l_text").alias("_l_key"))
    units = (
        keyed.select("_l_id", "_l_key", F.lower("_l_text").alias("_l_text"))
        .filter(_may_match(F.col("_l_text"), least))
        .select("_l_id", "_l_key", F.posexplode(F.expr(_UNITS)).alias("_u_at", "_u_unit"))
        .select("_l_id", "_l_key", F.struct("_u_unit.level", F.col("_u_at").alias("at")).alias("_u_no"), F.col("_u_unit.text").alias("_u_text"))
        .filter(_may_match(F.col("_u_text"), least))
        .select("_l_id", "_l_key", "_u_no", F.regexp_replace("_u_text", "[^a-z0-9]+", " ").alias("_u_text"))
        # n bigrams need more than n words, and each word takes two characters at least
        .filter(F.length("_u_text") >= 2 * int(fewest))
        .select("_l_id", "_l_key", "_u_no", F.filter(F.split("_u_text", " "), lambda w: w != "").alias("_u_words"))
        .filter(F.size("_u_words") > fewest)
        .select(
            "_l_id", "_l_key", "_u_no",
            F.array_distinct(F.zip_with(F.slice("_u_words", 1, F.size("_u_words") - 1), F.slice("_u_words", 2, F.size("_u_words") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("_u_grams"),
        )
        .select("_l_id", "_l_key", "_u_no", F.size("_u_grams").alias("_u_n"), F.explode(F.when(_may_have(F.size("_u_grams"), least), F.col("_u_grams"))).alias("_u_gram"))
    )
    in_bounds = (F.col("_u_n") >= F.col("_t_n") * low) & (F.col("_u_n") <= F.col("_t_n") * high)
    matches = units.join(F.broadcast(table), (F.col("_u_gram") == F.col("_t_gram")) & in_bounds)
    # of each unit and license, the best of its templates
    scored = (
        matches.groupBy("_l_id", "_l_key", "_u_no", "_u_n", "_t_id", "_t_license", "_t_n")
        .agg(F.collect_set("_u_gram").alias("_shared"))
        .select("_l_id", "_l_key", "_u_no", "_t_license", F.size("_shared").alias("_n"), (2.0 * F.size("_shared") / (F.col("_u_n") + F.col("_t_n"))).alias("_dice"))
        .filter(F.col("_dice") >= least)
        .groupBy("_l_id", "_l_key", "_u_no", "_t_license")
        .agg(F.max(F.struct(F.round(F.col("_n") * F.col("_dice"), 6).alias("weight"), F.col("_dice").alias("dice"))).alias("_own"))
    )
    levels = scored.groupBy("_l_id", "_l_key", "_t_license", F.col("_u_no.level").alias("_level")).agg(
        F.sum("_own.weight").alias("_weight"), F.max("_own").alias("_top")
    )
    licenses = levels.groupBy("_l_id", "_l_key", "_t_license").agg(F.max(F.struct(F.round("_weight", 6).alias("weight"), F.col("_top.dice").alias("dice"))).alias("_best"))
    best = licenses.groupBy(F.col("_l_id").alias("_b_id"), F.col("_l_key").alias("_b_key")).agg(
        F.min(F.struct((-F.col("_best.weight")).alias("w"), F.col("_t_license").alias("name"), F.col("_best.dice").alias("dice"))).alias("_best")
    )
    units_of = scored.select("_l_id", "_l_key", "_u_no").distinct().groupBy(F.col("_l_id").alias("_n_id"), F.col("_l_key").alias("_n_key")).agg(F.count(F.lit(1)).alias("_n"))
    best = best.join(units_of, F.col("_b_id").eqNullSafe(F.col("_n_id")) & (F.col("_b_key") == F.col("_n_key")))
    return keyed.select("_l_id", "_l_key").join(
        best, F.col("_l_id").eqNullSafe(F.col("_b_id")) & (F.col("_l_key") == F.col("_b_key")), "left"
    ).select(
        F.col("_l_id").alias("doc_id"),
        F.col("_best.name").alias("license"),
        F.round(F.coalesce("_best.dice", F.lit(0.0)), 6).alias("dice"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("n_units"),
    )


def _sql() -> str:
    values = ",\n".join("({}, '{}', {}, '{}')".format(*r) for r in template_bigrams())
    low, high = LEAST_DICE / (2 - LEAST_DICE), (2 - LEAST_DICE) / LEAST_DICE
    lines, paragraphs, whole = "string_split(x, chr(10))", "list_filter(regexp_split_to_array(x, '\\n[ \\t]*\\n'), lambda y: contains(y, chr(10)))", "list_filter([x], lambda y: contains(y, chr(10)))"
    unit = lambda level, xs: f"SELECT doc_id, {level} AS level, unnest({xs}) AS unit, generate_subscripts({xs}, 1) AS no FROM x"
    return f"""
WITH t(id, license, n, gram) AS (VALUES {values}),
x AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
u AS ({unit(0, lines)} UNION ALL {unit(1, paragraphs)} UNION ALL {unit(2, whole)}),
w AS (SELECT doc_id, level, no, list_filter(string_split(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g'), ' '), lambda y: y <> '') AS ws FROM u),
g AS (SELECT doc_id, level, no, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams FROM w WHERE len(ws) > 1),
e AS (SELECT doc_id, level, no, len(grams) AS n, unnest(grams) AS gram FROM g),
s AS (
  SELECT e.doc_id, e.level, e.no, t.license, CAST(2 * count(*) AS DOUBLE) / (e.n + t.n) AS dice, count(*) AS shared
  FROM e JOIN t ON e.gram = t.gram AND e.n >= t.n * CAST({low!r} AS DOUBLE) AND e.n <= t.n * CAST({high!r} AS DOUBLE)
  GROUP BY e.doc_id, e.level, e.no, e.n, t.id, t.license, t.n HAVING CAST(2 * count(*) AS DOUBLE) / (e.n + t.n) >= {LEAST_DICE}),
o AS (SELECT doc_id, level, no, license, max(row(round(shared * dice, 6), dice)) AS own FROM s GROUP BY ALL),
v AS (SELECT doc_id, license, level, round(sum(own[1]), 6) AS weight, max(own)[2] AS dice FROM o GROUP BY doc_id, license, level),
b AS (SELECT doc_id, license, max(row(weight, dice)) AS best FROM v GROUP BY doc_id, license),
r AS (SELECT doc_id, license, best[2] AS dice, row_number() OVER (PARTITION BY doc_id ORDER BY best[1] DESC, license) AS k FROM b),
c AS (SELECT doc_id, count(*) AS n_units FROM (SELECT DISTINCT doc_id, level, no FROM s) GROUP BY doc_id)
SELECT d.doc_id, r.license, round(CAST(coalesce(r.dice, 0.0) AS DOUBLE), 6) AS dice, CAST(coalesce(c.n_units, 0) AS BIGINT) AS n_units
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r.k = 1 LEFT JOIN c ON d.doc_id = c.doc_id
"""


ORACLE_SQL = _sql()
