import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import maximal_repeats
from attesta.llm.maximal_repeats import Suffixes, covered, remove_repeats, repeat_groups, stretches


def slow(rows, least):
    data = [(t or "").encode() for _, t in rows]
    seen = defaultdict(int)
    for d in data:
        for i in range(len(d) - least + 1):
            seen[d[i : i + least]] += 1
    out = []
    for (k, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) > 0).sum())
        out.append((k, len(d), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def _places(strings, w):
    return {(u, i) for u, s in enumerate(strings) for i in range(len(s) - len(w) + 1) if s[i : i + len(w)] == w}


strings = st.lists(st.binary(min_size=4, max_size=24).map(lambda b: bytes(x % 3 * 7 for x in b)), min_size=1, max_size=8, unique=True)


@settings(deadline=None, max_examples=300)
@given(strings, st.integers(4, 6))
def test_groups_are_all_maximal_repeats(s, least):
    want = set()
    for w in {x[i:j] for x in s for i in range(len(x)) for j in range(i + least, len(x) + 1)}:
        at = _places(s, w)
        before = {s[u][i - 1] if i else (u, "start") for u, i in at}
        after = {s[u][i + len(w)] if i + len(w) < len(s[u]) else (u, "end") for u, i in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            want.add((len(w), frozenset(at)))
    x = Suffixes(s, least)
    got = [(n, frozenset(zip(x.unit[a : b + 1].tolist(), x.offset[a : b + 1].tolist()))) for n, a, b in x.groups(least)]
    assert len(got) == len(set(got)) and set(got) == want
    unit, lo, hi = covered(s, [1] * len(s), least)
    cover = {(u, i) for n, at in want for u, j in at for i in range(j, j + n)}
    assert {(u, i) for u, a, b in zip(unit.tolist(), lo.tolist(), hi.tolist()) for i in range(a, b)} == cover


def test_equal_strings_are_at_one_place_of_equal_stretches():
    r = random.Random(3)
    x = bytes(r.choice(b"abcd ") for _ in range(3000))
    of = {}
    for part in (x, x[137:], b"q" * 500 + x[50:2000], b"ab" * 900):
        s, n, a = stretches(part, 100)
        assert s[0] == 0 and (s[1:] == s[:-1] + n[:-1]).all() and s[-1] + n[-1] == len(part) - 99 and n.max() <= 100
        for i, k, v in zip(s.tolist(), n.tolist(), a.tolist(), strict=True):
            here = [part[j : j + 100] for j in range(i, i + k)]
            assert len(set(here)) == k
            for w in here:
                assert of.setdefault(w, v) == v


def test_long_texts_are_cut_alike_in_pieces(monkeypatch):
    r = random.Random(3)
    x = bytes(r.choice(b"abcd ") for _ in range(20_000)) + b"a" * 3000
    whole = stretches(x, 100)
    monkeypatch.setattr(maximal_repeats, "PIECE", 700)
    for a, b in zip(whole, stretches(x, 100), strict=True):
        assert (a == b).all()


def _corpus():
    r = random.Random(7)
    word = lambda: r.choice(["ab", "être", "c", "longer", "x" * r.randint(1, 9)]) + str(r.randint(0, 99))
    passage = " ".join(word() for _ in range(200))
    rows = []
    for i in range(90):
        t = " ".join(word() for _ in range(r.randint(0, 150)))
        at = r.randint(0, len(t))
        kind = i % 6
        t = t[:at] + (passage[: r.randint(300, 900)] if kind == 1 else passage[r.randint(0, 300) :] if kind == 2 else "x" * r.randint(1, 1500) if kind == 3 else "") + t[at:]
        rows.append((i, t))
    rows += [(100 + i, passage[:i] + "!" + passage[i + 1 :]) for i in range(0, 900, 37)]
    return rows + [(300, rows[0][1]), (301, rows[7][1]), (302, None), (303, ""), (304, "short"), (305, "long " * 20000), (306, " ".join(f"u{i % 977}" for i in range(3000)))]


def test_against_brute_force(spark):
    rows = _corpus()
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id bigint, text string, spans string, unit int")
    got = remove_repeats(df)
    assert result(got) == slow(rows, 400)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


@pytest.mark.parametrize(("alike", "shard", "rounds"), [(2, 2000, 2), (1, 3, 1), (3, 2000, 12)])
def test_many_alike(spark, monkeypatch, alike, shard, rounds):
    monkeypatch.setattr(maximal_repeats, "ALIKE", alike)
    monkeypatch.setattr(maximal_repeats, "SHARD", shard)
    monkeypatch.setattr(maximal_repeats, "ROUNDS", rounds)
    rows = _corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(remove_repeats(df, with_kept=False)) == slow(rows, 400)


def test_short_repeats(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("abcé") for _ in range(r.randint(0, 40)))) for i in range(60)] + [(None, "aaaaaaaaaaa")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least in (4, 9):
        assert result(remove_repeats(df, least, with_kept=False)) == slow(rows, least)
    with pytest.raises(ValueError):
        remove_repeats(df, 3)


def test_groups_hold_all_occurrences(spark):
    rows = [(k, t) for k, t in _corpus() if k not in (305, 306)]
    texts = {k: (t or "").encode() for k, t in rows}
    groups = defaultdict(set)
    for g in repeat_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        groups[g.group, g.length].add((g.doc_id, g.start))
    cover = {k: np.zeros(len(t), bool) for k, t in texts.items()}
    for (_, n), at in groups.items():
        k, i = next(iter(at))
        w = texts[k][i : i + n]
        want = set()
        for d, t in texts.items():
            j = t.find(w)
            while j >= 0:
                want.add((d, j))
                j = t.find(w, j + 1)
        assert n >= 400 and len(at) > 1 and at == want
        for d, j in at:
            cover[d][j : j + n] = True
    assert sorted((k, int(c.sum())) for k, c in cover.items()) == sorted((k, m) for k, _, m, _, _ in slow(rows, 400))


def test_nulls_ties_and_empty(spark):
    t = "".join(f"a{i} " for i in range(200))
    rows = [(None, t), (1, t), (1, t), (1, None), (1, t + " b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(remove_repeats(df)) == slow(rows, 400)
    assert remove_repeats(df.limit(0)).count() == 0
    assert repeat_groups(df.limit(0)).count() == 0
