"""License scans: phrase places, and an exact set-similarity join of text blocks with license statements and texts.

DataFrame operations only.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.plans.staging import Staging

#: The phrases of the base scan and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: The identifiers that stand in source files, by label.
IDENTIFIERS = {
    "mit": ("MIT",), "apache": ("Apache-2.0",), "gpl": ("GPL-2.0", "GPL-3.0"), "lgpl": ("LGPL-2.1", "LGPL-3.0"), "agpl": ("AGPL-3.0",), "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "isc": ("ISC",),
    "mpl": ("MPL-2.0",), "epl": ("EPL-2.0",), "zlib": ("Zlib",), "unlicense": ("Unlicense",), "cc-by": ("CC-BY-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",),
}
#: Labels, the words that name the license and must follow one another in a block, and what texts say of it.
#: First statements of one sentence, then the notices and license texts themselves.
TEMPLATES = [
    *[(label, f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', x.lower())}", f"SPDX-License-Identifier: {x}") for label, every in IDENTIFIERS.items() for x in every],
    ("gpl", "gpl v2", "GPL v2 or later"),
    ("gpl", "gpl v3", "GPL v3 or later"),
    ("gpl", "gpl v2", "licensed under GPL v2"),
    ("gpl", "gpl v3", "licensed under GPL v3"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("mit", "mit license", "released under the MIT License"),
    ("mit", "mit license", "this project is licensed under the terms of the MIT license"),
    ("apache", "apache license", "licensed under the Apache License, Version 2.0"),
    ("apache", "apache org licenses license 2 0", "you may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "gnu general public license", "this work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "gnu lesser general public license", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("agpl", "gnu affero general public license", "licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "bsd license", "released under the BSD License"),
    ("mpl", "mozilla public license", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl", "eclipse public license", "licensed under the Eclipse Public License, version 2.0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "creative commons attribution sharealike", "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "creative commons attribution noncommercial", "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "creative commons attribution noderivatives", "this work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike", "this work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives", "this work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by", "cc by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "cc by sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "cc by nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "cc by nd", "licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "cc by nc sa", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "cc by nc nd", "licensed under CC BY-NC-ND 4.0"),
    ("proprietary", "all rights reserved", "all rights reserved no part of this publication may be reproduced without the prior written permission of the publisher"),
    ("mit", "", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
        the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
        USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", "", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", "", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"""),
    ("zlib", "", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
        of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source
        versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source
        distribution."""),
    ("apache", "apache license", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    ("gpl", "gnu general public license", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", "gnu lesser general public license", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
        Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("agpl", "gnu affero general public license", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("mpl", "mozilla public license", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
        one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", "unencumbered software", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]
CONTAINMENT, BLOCKS = 0.8, (64, 512)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """The words of a text: A-Z lower-cased, cut at everything ASCII but digits and letters; null: none."""
    cut = F.split(F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _UPPER, _LOWER), _GAP)
    return F.filter(cut, lambda w: w != "")


def _places(w: str, phrase: tuple[str, ...]) -> Column:
    """Starts of a phrase in the word array, looked for only where its rarest (here the last) word occurs."""
    last = len(phrase) - 1
    there = F.sequence(F.lit(0), F.size(w) - 1)
    hit = lambda i: reduce(lambda p, q: p & q, [F.try_element_at(F.col(w), (i + 1 + k).cast("int")) == x for k, x in enumerate(phrase)])
    none = F.array().cast("array<int>")
    return F.when(F.array_contains(w, phrase[last]) & (F.size(w) > last), F.filter(there, lambda i: F.coalesce(hit(i), F.lit(False)))).otherwise(none)


def tokens_of(statement: str) -> list[str]:
    """The words of a template, as ``words`` finds them."""
    return re.findall(r"[0-9a-z]+", statement.lower())


def template_index(frequency: dict[str, int], templates: list[tuple[str, str, str]], least: float) -> list[tuple[str, int, int, int, list[str], str, str]]:
    """``(token, template, position, size, tokens, name, label)`` for the prefix tokens of each template.

    Tokens are ordered by how often the corpus has them, rarest first. A block that holds ``o = ceil(least *
    size)`` of a template's tokens holds one of its first ``size - o + 1``.
    """
    rows = []
    for k, (label, needs, statement) in enumerate(templates):
        tokens = sorted(set(tokens_of(statement)), key=lambda t: (frequency.get(t, 0), t))
        need = math.ceil(least * len(tokens) - 1e-9)
        rows += [(t, k, i, len(tokens), tokens, needs, label) for i, t in enumerate(tokens[: len(tokens) - need + 1])]
    return rows


def by_block(templates: list[tuple[str, str, str]], blocks: tuple[int, ...]) -> dict[int, list[tuple[str, str, str]]]:
    """Templates by the smallest block of which half holds them."""
    out: dict[int, list[tuple[str, str, str]]] = {}
    for t in templates:
        fit = [b for b in sorted(blocks) if len(tokens_of(t[2])) <= b // 2]
        if not fit:
            raise ValueError("a template must fit into half of the largest block")
        out.setdefault(fit[0], []).append(t)
    return out


def _matches(base: DataFrame, block: int, index: DataFrame, vocabulary: list[str], prefix: list[str], frequency: dict[str, int], least: float) -> DataFrame:
    """``k, h, label, share`` for each block and each template it contains that no other label's explains better."""
    half = block // 2
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - half - 1), F.lit(half))
    held = lambda s: F.array_distinct(F.filter(F.slice("w", s + 1, block), lambda t: t.isin(vocabulary)))
    near = F.filter(F.transform(starts, lambda s: F.struct(s.alias("b"), held(s).alias("set"))), lambda x: F.arrays_overlap(x["set"], F.array(*map(F.lit, prefix))))
    said = F.transform(near, lambda x: F.struct(x["b"], x["set"], F.concat(F.lit(" "), F.array_join(F.slice("w", x["b"] + 1, block), " "), F.lit(" ")).alias("said")))
    blocks = base.where("w is not null").select("k", "h", F.inline(said))
    order = {t: n for n, t in enumerate(sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t)))}
    ranks = F.create_map(*[F.lit(x) for t, n in order.items() for x in (t, n)])
    ordered = F.array_sort(F.transform("set", lambda t: F.struct(F.element_at(ranks, t).alias("rank"), t.alias("t"))))
    blocks = blocks.select("k", "h", "b", "set", "said", F.posexplode(ordered).alias("j", "x"))
    met = blocks.select("k", "h", "b", "set", "said", "j", F.col("x.t").alias("token")).join(F.broadcast(index), "token")
    need = F.ceil(F.col("size") * F.lit(least) - 1e-9)
    met = met.where((F.size("set") >= need) & (F.col("size") - F.col("i") >= need) & (F.size("set") - F.col("j") >= need))
    met = met.select("k", "h", "b", "template", "label", "size", "said", "name", F.array_intersect("tokens", "set").alias("shared")).where(F.size("shared") >= need)
    met = met.where((F.col("name") == "") | F.contains("said", F.concat(F.lit(" "), "name", F.lit(" "))))
    hit = F.struct("label", (F.size("shared") / F.col("size")).alias("share"), "shared")
    of_block = met.groupBy("k", "h", "b").agg(F.collect_set(hit).alias("hits"))
    better = lambda x, y: (y["label"] != x["label"]) & (F.size(y["shared"]) > F.size(x["shared"])) & (F.size(F.array_except(x["shared"], y["shared"])) == 0)
    best = F.filter("hits", lambda x: ~F.exists("hits", lambda y: better(x, y)))
    return of_block.select("k", "h", F.explode(best).alias("x")).select("k", "h", "x.label", "x.share")


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, least: float = CONTAINMENT, blocks: tuple[int, ...] = BLOCKS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Base places and labels of each row of ``docs``, with the labels of all templates it contains.

    Columns ``key, n_words, n_base, first_word, last_word, base_labels, labels, score``. Every text is read
    as overlapping blocks of words, half a block apart, so that each run of half a block lies whole in one; a template
    is looked for in the blocks of ``blocks`` of which half is long enough for it. Template tokens are counted in all
    rows; in that order, rarest first, a block and a template meet over a token of the template's prefix, if the
    block is long enough, and if the tokens left after that position on either side can still reach the threshold; what
    remains is verified by counting the tokens shared. A verified block gets the template's label if the words that name the
    license (the template's second part) follow one another in it, and if no template of another label shares all these
    tokens and more: a share-alike notice is not also a plain one. ``score`` is the largest share of a labelling template's
    tokens found in a block, 1 if there is a base place, else 0.

    Templates are a parameter and of a bounded size. Null and empty texts have no words and empty labels. Very long texts
    are blocks like others. Rows equal in key and text get equal results; rows equal in key alone are told apart by a 64-bit
    hash of the text; other columns aren't read, so none can clash; an empty table gives an empty result.
    """
    stage, classes = Staging(docs.sparkSession, "licenses"), by_block(templates, blocks)
    vocabulary = sorted({t for _, _, s in templates for t in tokens_of(s)})
    tokens = docs.select(F.explode(words(text)).alias("t")).where(F.col("t").isin(vocabulary))
    frequency = {r.t: r.n for r in tokens.groupBy("t").agg(F.count("*").alias("n")).collect()}
    rows = {b: template_index(frequency, t, least) for b, t in classes.items()}
    prefix = {b: sorted({r[0] for r in x}) for b, x in rows.items()}

    base = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), words(text).alias("w"))
    places = [_places("w", p) for p in PHRASES]
    every = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    held = [F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]
    common = F.arrays_overlap("w", F.array(*map(F.lit, sorted(set().union(*prefix.values())))))
    base = base.select("k", "h", F.size("w").cast("long").alias("n_words"), F.when(common, F.col("w")).alias("text_words"), *[p.alias(f"p{i}") for i, p in enumerate(places)])
    base = base.select("k", "h", "n_words", "text_words", every.alias("at"), F.array_sort(F.array_distinct(F.array_compact(F.array(*held)))).alias("own"))
    base = stage.put(base.select("k", "h", "n_words", F.col("text_words").alias("w"), F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"), "own"), "base")

    found = []
    for b, x in rows.items():
        index = docs.sparkSession.createDataFrame(x, "token string, template int, i int, size int, tokens array<string>, name string, label string")
        mine = sorted({t for _, _, s in classes[b] for t in tokens_of(s)})
        found.append(_matches(base, b, index, mine, prefix[b], frequency, least))
    labelled = reduce(DataFrame.unionByName, found).groupBy("k", "h").agg(F.collect_set("label").alias("more"), F.max("share").alias("best"))
    known = stage.put(labelled, "found").withColumnsRenamed({"k": "fk", "h": "fh"})
    out = base.drop("w").join(known, F.col("k").eqNullSafe(F.col("fk")) & (F.col("h") == F.col("fh")), "left")
    both = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(F.col("k").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def op9_query(spark, sf_dir: str) -> DataFrame:
    """Licenses named in all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """DuckDB SQL for the query: every template against every block of its size, without any filter."""
    listed = lambda x: "[" + ", ".join(f"'{t}'" for t in x) + "]"
    rows = ", ".join(f"('{label}', {listed(sorted(set(tokens_of(s))))}, '{needs}', {b})" for b, x in by_block(TEMPLATES, BLOCKS).items() for label, needs, s in x)
    sizes = ", ".join(f"({b})" for b in by_block(TEMPLATES, BLOCKS))
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = " UNION ALL ".join(
        f"SELECT k, pos - 1 AS start, '{label}' AS label FROM positions WHERE " + " AND ".join(f"w[pos + {i}] = '{x}'" for i, x in enumerate(p)) for p, label in PHRASES.items()
    )
    return rf"""
WITH d AS (
  SELECT doc_id AS k, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{gap}'), lambda x: x <> '') AS w FROM documents
), licensed AS (SELECT * FROM d WHERE list_contains(w, 'license')),
positions AS (SELECT k, w, unnest(generate_series(1, len(w))) AS pos FROM licensed),
places AS ({phrases}),
based AS (
  SELECT k, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_distinct(list(label)) AS own FROM places GROUP BY k
), t AS (SELECT label, toks, name, size, len(toks) AS n FROM (VALUES {rows}) AS v(label, toks, name, size)),
blocks AS (
  SELECT k, size, s, w[s + 1 : s + size] AS x, list_distinct(x) AS b FROM (
    SELECT k, w, size, unnest(generate_series(0, greatest(0, len(w) - size // 2 - 1), size // 2)) AS s FROM d, (VALUES {sizes}) AS z(size))
), hits AS (
  SELECT k, size, s, label, n, shared FROM (SELECT k, size, s, x, label, n, name, list_intersect(b, toks) AS shared FROM blocks JOIN t USING (size))
  WHERE len(shared) >= ceil(n * {CONTAINMENT} - 1e-9) AND (name = '' OR contains(' ' || array_to_string(x, ' ') || ' ', ' ' || name || ' '))
), best AS (
  SELECT k, label, len(shared) / n::DOUBLE AS share FROM hits x WHERE NOT EXISTS (
    SELECT 1 FROM hits y WHERE y.k = x.k AND y.size = x.size AND y.s = x.s AND y.label <> x.label AND len(y.shared) > len(x.shared) AND list_has_all(y.shared, x.shared))
), found AS (SELECT k, list_distinct(list(label)) AS more, max(share) AS best FROM best GROUP BY k)
SELECT d.k AS doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN based USING (k) LEFT JOIN found USING (k)
"""


ORACLE = _oracle()
