import math
import random
import re

import pytest

from attesta.llm.licenses import PHRASES, TEMPLATES, by_block, scan_licenses


def split(text):
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]


def slow(text, least=0.8):
    w = split(text)
    starts, own = [], set()
    for p, label in PHRASES.items():
        at = [i for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        starts += at
        own |= {label} if at else set()
    labels, best = set(own), 0.0
    for block, templates in ((64, [t for t in TEMPLATES if len(split(t[2])) <= 32]), (512, [t for t in TEMPLATES if len(split(t[2])) > 32])):
        for s in range(0, max(0, len(w) - block // 2 - 1) + 1, block // 2):
            hits = []
            for label, needs, t in templates:
                t = set(split(t))
                shared = t & set(w[s : s + block])
                if len(shared) >= math.ceil(least * len(t) - 1e-9) and f" {needs} " in (f" {' '.join(w[s : s + block])} " if needs else f" {needs} "):
                    hits.append((label, shared, len(shared) / len(t)))
            for label, shared, share in hits:
                if not any(x != label and shared < other for x, other, _ in hits):
                    labels.add(label)
                    best = max(best, share)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), 1.0 if starts else best


NOTICES = {
    "Licensed under the GNU General Public License, version 3.": "gpl",
    "licensed under the GNU General Public License version 2": "gpl",
    "licensed under the GNU Lesser General Public License, version 2.1": "gpl,lgpl",
    "This is licensed under the GNU Affero General Public License, version 3.": "agpl,gpl",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa",
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under CC BY-SA 4.0": "cc-by-sa",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Licensed under CC BY-NC-ND 4.0": "cc-by-nc-nd",
    "Released under the BSD License": "bsd",
    "Released under the MIT License": "mit",
    "Licensed under the Eclipse Public License version 2.0": "epl",
    "Licensed under the Apache License, Version 2.0": "apache",
    "This is licensed under terms of our own": "",
    "// SPDX-License-Identifier: Apache-2.0": "apache",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl",
    "SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by-sa",
    "This file is GPL v2 or later.": "gpl",
    "Copyright 2020. All rights reserved.": "proprietary",
    "Students at MIT who study under the professor need a license.": "",
    "the bsd socket was released under a driver license the team had": "",
    "the version 2 0 subject to terms of the mozilla public browser": "",
    "the identifier of the license, an mit matter, is spdx": "",
    "all seats reserved, the rights to them too": "",
}


def test_each_notice_gets_its_own_label(spark):
    """The base labels are the contract's: a lesser or Affero notice holds the phrase of the general one."""
    whole = {t: ",".join(sorted({label} | ({"gpl"} if "general public license" in " ".join(split(t)) else set()))) for label, _, t in TEMPLATES}
    wanted = list((NOTICES | whole).items())
    rows = scan_licenses(spark.createDataFrame([(i, "some words before it " * 9 + t) for i, (t, _) in enumerate(wanted)], "doc_id bigint, text string")).collect()
    assert {wanted[r.doc_id][0]: r.labels for r in rows} == dict(wanted)


def test_a_template_too_long_for_the_blocks_is_refused():
    with pytest.raises(ValueError):
        by_block([("x", "", "word " * 300)], (64, 512))


def test_against_brute_force(spark):
    r = random.Random(6)
    vocab = sorted({x for *_, t in TEMPLATES for x in split(t)}) + ["foo", "bar", "é"]
    texts = [None, "", "  ", "MIT license", "the MIT\nLicense. mit-license!", "general public license " * 3, "license", "x " * 20000 + "Licensed under CC BY-NC 4.0.", "É mit license ß"]
    for _, _, t in TEMPLATES:
        x = t.split()
        for drop in (0, 1, 2, 3, 20):
            y = list(x)
            for _ in range(drop):
                y[r.randrange(len(y))] = "zzz"
            texts.append("foo " * r.randint(0, 90) + " ".join(y).upper() + " bar" * r.randint(0, 90))
    texts += [" ".join(r.choice(vocab) for _ in range(r.randint(1, 900))) for _ in range(60)]
    rows = scan_licenses(spark.createDataFrame([(i, x, "w") for i, x in enumerate(texts)], "doc_id bigint, text string, labels string")).collect()
    got = {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score) for x in rows}
    assert got == {i: slow(x) for i, x in enumerate(texts)}


def test_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(None, "mit license"), (1, "mit license"), (1, "mit license"), (1, None)], "doc_id bigint, text string")
    assert sorted(x.labels for x in scan_licenses(df).collect()) == ["", "mit", "mit", "mit"]
    assert scan_licenses(df.limit(0)).count() == 0
