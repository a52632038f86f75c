import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import substring_dedup
from attesta.llm.fm_index import Matches, WaveletMatrix
from attesta.llm.substring_dedup import dedup_substrings, stretches


def slow(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=300))
def test_wavelet_rank(x):
    x = np.array(x)
    tree = WaveletMatrix(x, 4)
    for s in set(x.tolist()):
        at = np.arange(len(x) + 1)
        assert tree.rank(np.full(len(at), s), at).tolist() == [int((x[:i] == s).sum()) for i in at]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=14), st.integers(1, 2)), min_size=1, max_size=12), st.integers(2, 4))
def test_intervals_are_the_recurring_windows(rows, window):
    seen = Counter()
    for s, w in rows:
        for i in range(len(s) - window + 1):
            seen[s[i : i + window]] += w
    want = {(k, i) for k, (s, _) in enumerate(rows) for i in range(len(s) - window + 1) if seen[s[i : i + window]] > 1}
    m = Matches([[c.encode() for c in s] for s, _ in rows], [w for _, w in rows], window)
    got = {(int(q), i) for q, lo, hi in zip(*m.intervals()) for i in range(lo, hi - window + 1)}
    assert got == want


def test_equal_windows_have_equal_anchors():
    r = random.Random(4)
    x = [str(r.randint(0, 50)).encode() for _ in range(400)]
    of = {}
    for part in (x, x[37:], [b"q"] * 90 + x[5:300]):
        s, n, a, _, c = stretches(part, 35)
        assert n.max() <= 28 and s[0] == 0 and (s[1:] == s[:-1] + n[:-1]).all() and s[-1] + n[-1] == len(part) - 34
        for i, k, v in zip(s, n, a, strict=True):
            here = [tuple(part[j : j + 35]) for j in range(i, i + k)]
            assert len(set(here)) == len(here) or c[s.tolist().index(i)] == 2
            for j in range(i, i + k):
                assert of.setdefault(tuple(part[j : j + 35]), v) == v


def _corpus():
    r = random.Random(7)
    word = lambda: f"w{r.randint(0, 400)}"
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(90):
        t = [word() for _ in range(r.randint(0, 120))]
        at = r.randint(0, len(t))
        kind = i % 6
        t[at:at] = passage[: r.randint(10, 60)] if kind == 1 else passage[r.randint(0, 30) :] if kind == 2 else ["x"] * r.randint(1, 200) if kind == 3 else []
        rows.append((i, " ".join(t) if kind != 4 else "\n ".join(t) + "  "))
    return rows + [(200, rows[0][1]), (201, rows[7][1]), (202, None), (203, ""), (204, " \t"), (205, "long " * 60000), (206, " ".join(f"u{i % 977}" for i in range(5000)))]


def test_against_brute_force(spark):
    rows = _corpus()
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, spans string")
    got = dedup_substrings(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == slow(rows, 35)
    for r in got:
        assert hashlib.sha256(b" ".join((r.kept_text or "").encode().split())).hexdigest() == r.kept_sha256
        if not r.n_removed:
            assert r.kept_text == dict(rows)[r.doc_id]


def test_many_alike_are_dealt_singly(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ALIKE", 2)
    rows = _corpus()
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), with_text=False).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == slow(rows, 35)


def test_nulls_ties_and_empty(spark):
    t = " ".join(f"a{i}" for i in range(40))
    rows = [(None, t), (1, t), (1, t), (1, None), (1, t + " b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(df, with_text=False).collect()), key=str) == slow(rows, 35)
    assert dedup_substrings(df.limit(0)).count() == 0


def test_windows_that_recur_in_one_stretch_only(spark):
    rows = [(1, "a b " + "w " * 42 + "c d"), (2, " ".join(["p", "q", "r"] * 13)), (3, " ".join(f"u{i}" for i in range(60)))]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), with_text=False).collect()
    want = slow(rows, 35)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == want and [w[2] for w in want] == [42, 39, 0]


def test_texts_of_one_key_whose_32_bit_hashes_are_equal(spark):
    from pyspark.sql import functions as F

    from attesta.llm.stages import drop_repeated_passages

    texts = spark.range(400_000).select(F.concat(F.lit("text "), F.col("id")).alias("text"))
    a, b = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).where("size(t) > 1").first().t[:2]
    docs = spark.createDataFrame([(None, a), (None, b), (1, a), (1, b)], "doc_id bigint, text string")
    assert sorted((r.text, r.doc_id is None) for r in drop_repeated_passages(docs).collect()) == sorted((t, n) for t in (a, b) for n in (True, False))


def test_rows_that_repeat_do_not_lengthen_the_spans(spark):
    from attesta.llm.substring_dedup import repeated_intervals
    from attesta.plans.staging import Staging

    rows = [(1, 7, " ".join(f"a{i}" for i in range(60)))]
    few, many = (repeated_intervals(spark.createDataFrame(rows * n, "k bigint, tag bigint, t string"), 35, Staging(spark, "test")).first().spans for n in (2, 50))
    assert sorted(few) == sorted(many)
