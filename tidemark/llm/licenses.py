"""Licence scans: TF-IDF cosine of headers and licence files to templates, and inheritance from the nearest directory.

A text is looked at as a whole, by paragraphs (the lines between blank ones, joined, without the marks of comments), by lines and
by sentences. Each of these is compared with all templates, whole texts of licences and the headers and statements that refer to
them, by the cosine of sparse TF-IDF vectors, and has to share four of its uncommon words and a quarter of them; identifiers of the SPDX kind count as they are. A
stretch can only do so if it holds one of some words of the template: without these the rest of the template is shorter than
the threshold, or too few words are left to share. Stretches without any such word are left out first, which loses nothing; the
words are chosen so that ordinary text seldom has them.

A file with a licence of its own has that licence. A licence file (by its name, or if the text found is most of it) also
licenses its directory; a file without one inherits from the nearest directory above it that has one, up to the root. Directories
are resolved once each and meet licences and files under salted keys. DataFrame functions only; templates are a bounded list.

Defined results: null or empty texts have no licence of their own; a file without a path inherits nothing; several licences of
a file or directory: the best cosine counts, then the least name; repeated rows are separate files with equal results; other
columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, pick

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. "
    "This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
    "You should have received a copy of the GNU {name} along with this {work}. If not, see <https://www.gnu.org/licenses/>."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
_GNU_TITLE = "GNU {name} Version {v}, {date} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_general, _lesser, _affero = "General Public License", "Lesser General Public License", "Affero General Public License"
# Public texts of licences, the headers that refer to them and the usual short statements, by their public identifiers.
TEMPLATES = (
    ("MIT", "Released under the MIT License."), ("MIT", "The MIT License (MIT)"), ("MIT", _MIT_GRANT), ("MIT", _MIT_GRANT + _WARRANTY),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", _APACHE_HEADER), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", _GNU.format(work="program", name=_general, v=3)), ("GPL-3.0", _GNU_TITLE.format(name=_general, v=3, date="29 June 2007")), ("GPL-3.0", "GNU General Public License v3.0"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."), ("GPL-2.0", _GNU.format(work="program", name=_general, v=2)), ("GPL-2.0", _GNU_TITLE.format(name=_general, v=2, date="June 1991")), ("GPL-2.0", "GNU General Public License v2.0"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."), ("LGPL-3.0", _GNU.format(work="library", name=_lesser, v=3)), ("LGPL-3.0", _GNU_TITLE.format(name=_lesser, v=3, date="29 June 2007")),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."), ("AGPL-3.0", _GNU.format(work="program", name=_affero, v=3)), ("AGPL-3.0", _GNU_TITLE.format(name=_affero, v=3, date="19 November 2007")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_WARRANTY), ("BSD-3-Clause", _BSD + _BSD_THIRD), ("BSD-3-Clause", _BSD_THIRD),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."), ("BSD-2-Clause", _BSD + _BSD_WARRANTY), ("BSD-2-Clause", _BSD),
    ("ISC", "Released under the ISC License."), ("ISC", _ISC_GRANT + _ISC_WARRANTY), ("ISC", _ISC_GRANT),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."), ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
THRESHOLD = 0.6
#: Uncommon words that a stretch and a template have to share, or all of the template's if these are fewer; and a quarter of them.
SHARED = 4
# Common words of languages that licences or texts are written in.
COMMON = frozenset(
    "a about after all also an and any are as at be been but by can com could de der die do el en first for from free had has have he her his how http https i if in inc into is it its la may mit more most my new no not of on one only or "
    "org other our out over que shall she so some such than that the their them then there they this time to two under und up use was we were what when which who will with work would www you your".split()
)
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([a-z0-9][a-z0-9.+-]*[a-z0-9+])"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
#: The marks of a comment at the start of a line, and the border of a block.
_COMMENT = r"(?m)^[ \t]*(?:/{2,}|#+|\*+/?|/\*+|--+|;+|<!--+|%+|REM\b)[ \t]?"
SALTS = 32


def tokens(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def idf_of(templates) -> dict[str, float]:
    df = Counter(w for _, t in templates for w in set(tokens(t)))
    return {w: math.log((len(templates) + 1) / (n + 0.5)) for w, n in sorted(df.items())}


def unknown(templates) -> float:
    """Words of no template weigh as the rarest."""
    return math.log((len(templates) + 1) / 0.5)


def vectors_of(templates) -> list[tuple[str, dict[str, float]]]:
    """Each template's name and unit vector."""
    idf = idf_of(templates)
    out = []
    for name, text in templates:
        raw = {w: n * idf[w] for w, n in sorted(Counter(tokens(text)).items())}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.append((name, {w: x / norm for w, x in raw.items()}))
    return out


def least_shared(n: int) -> int:
    """Of the n uncommon words of a template, those that a match has to share."""
    return max(min(SHARED, n), -(-n // 4))


def anchors(templates, threshold: float) -> list[str]:
    """Words of which any text that matches a template holds one. Without its anchors a template is shorter than the threshold,
    or has fewer words left than a match has to share."""
    found = set()
    for _, vector in vectors_of(templates):
        rare = sorted((w for w in vector if w not in COMMON), key=lambda w: (len(w) < 3, -vector[w], w))
        left = sum(x * x for x in vector.values())
        for k, w in enumerate(rare):
            if left < (threshold - 1e-9) ** 2 or len(rare) - k < least_shared(len(rare)):
                break
            found.add(w)
            left -= vector[w] ** 2
    return sorted(found)


def gate_of(words: list[str]) -> str:
    """One of the words as a word, grouped by first letter, so that few of them are tried at a place."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(re.escape(w[1:]))
    return rf"(?<![a-z0-9])(?:{'|'.join(f'{c}(?:{chr(124).join(rest)})' for c, rest in sorted(groups.items()))})(?![a-z0-9])"


def stretches(text: Column, gate: str) -> Column:
    """array<string> of a text's sentences, lines, paragraphs and itself, of those that hold a word of the gate."""
    plain = F.regexp_replace(text, _COMMENT, " ")
    lines = F.split(plain, r"\r?\n")
    sentences = F.split(plain, r"(?<=[.!?;])\s+|\r?\n")
    paragraphs = F.split(plain, r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")
    holds = lambda xs: F.filter(xs, lambda x: F.lower(x).rlike(gate))
    return F.array_distinct(F.concat(holds(sentences), holds(lines), holds(paragraphs), F.array(plain)))


def ancestors(directory: Column) -> Column:
    """The root "", and the directories down to this one."""
    parts = F.split(directory, "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.concat(F.array(F.lit("")), F.filter(paths, lambda x: x != ""))


def own_licences(files: DataFrame, templates, threshold: float) -> DataFrame:
    """files (key, text) to (key, score, name, most) of the best licence in each text; most: the stretch is half of the text or more."""
    spark = files.sparkSession
    # A bounded list: the templates' words, and the words of one stretch after the other, are joined by word.
    idfs = idf_of(templates)
    words = [(w, float(x), i, n, idfs[w], w not in COMMON, least_shared(sum(y not in COMMON for y in v))) for i, (n, v) in enumerate(vectors_of(templates)) for w, x in v.items()]
    table = spark.createDataFrame(words, "w string, x double, t int, name string, idf double, rare boolean, least int")
    gate = gate_of(anchors(templates, threshold))
    texts = files.where(F.col("text").isNotNull())
    # The stretches, few as they are, are written once: three sums start from them.
    held = cut(texts.where(F.lower("text").rlike(gate)).select("key", F.length(F.regexp_replace("text", r"\s", "")).alias("whole"), F.posexplode(stretches(F.col("text"), gate)).alias("s", "stretch")))
    counted = held.select("key", "s", F.explode(F.regexp_extract_all(F.lower("stretch"), F.lit(WORD), F.lit(0))).alias("w")).groupBy("key", "s", "w").agg(F.count("*").alias("n"))
    weighed = counted.join(F.broadcast(table.select("w", "idf").distinct()), "w", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(unknown(templates))))
    norms = weighed.groupBy("key", "s").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.select("key", "s", "w", F.col("x").alias("q")).join(F.broadcast(table), "w").groupBy("key", "s", "t", "name", "least").agg(F.sum(F.col("q") * F.col("x")).alias("dot"), F.count_if("rare").alias("shared")).where("shared >= least")
    cosines = dots.join(norms, ["key", "s"]).withColumn("score", F.col("dot") / F.col("norm")).where(F.col("score") >= threshold)
    sizes = held.select("key", "s", "whole", (2 * F.length(F.regexp_replace("stretch", r"\s", "")) >= F.col("whole")).alias("most"))
    stated = cosines.join(sizes, ["key", "s"]).select("key", "score", "name", "most")
    ids = {n.lower(): n for n, _ in templates}
    known = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    exact = texts.where(F.col("text").contains("SPDX-") | F.col("text").contains("spdx-")).select("key", F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("id"))
    base = F.regexp_replace(F.lower("id"), "(-only|-or-later|\\+)$", "")
    named = exact.select("key", F.lit(1.0).alias("score"), F.coalesce(F.try_element_at(known, base), F.col("id")).alias("name"), F.lit(False).alias("most"))
    both = stated.unionByName(named)
    best = F.min(F.struct((-F.round("score", 9)).alias("score"), "name")).alias("b")
    return both.groupBy("key").agg(best, F.bool_or("most").alias("most")).select("key", (-F.col("b.score")).alias("score"), "b.name", "most")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """One row per file: id_col, path, own_license, own_score, is_license_file, inherited_license, inherited_from, license.

    templates: pairs of a licence's name and a text of it, a bounded list.
    """
    key = lambda n: F.xxhash64(F.lit(n), "id", "path", "text")
    files = pick(df, id=id_col, text=text_col, path=path_col).withColumn("key", F.struct(key(1).alias("a"), key(2).alias("b")))
    own = own_licences(files.select("key", "text"), templates, threshold)
    directory = F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", ""))
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    rows = files.select("id", "path", "key", directory.alias("dir")).join(own, "key", "left").withColumn("is_license_file", F.col("name").isNotNull() & (named | F.coalesce("most", F.lit(False))))
    # Only files with a licence of their own can license a directory, so this side starts from them.
    licensed = rows.where("is_license_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("score"), "name")).alias("best"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    licensed = licensed.select(F.col("dir").alias("above"), F.col("best.name").alias("name"), every)
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int").alias("salt")
    above = files.where("path is not null").groupBy(directory.alias("dir")).agg(F.lit(1).alias("one")).select("dir", salt("dir"), F.posexplode(ancestors(F.col("dir"))).alias("depth", "above"))
    nearest = above.join(licensed, ["above", "salt"]).groupBy("dir").agg(F.max_by(F.struct("name", "above"), "depth").alias("nearest"))
    joined = rows.select("*", salt("key")).join(nearest.select("dir", "nearest", every), ["dir", "salt"], "left")
    alone = F.col("name").isNull()
    inherited = F.when(alone, F.col("nearest.name"))
    return joined.select(
        F.col("id").alias(id_col), "path", F.col("name").alias("own_license"), F.round("score", 6).alias("own_score"), "is_license_file",
        inherited.alias("inherited_license"), F.when(alone, F.col("nearest.above")).alias("inherited_from"), F.coalesce("name", inherited).alias("license"),
    )
