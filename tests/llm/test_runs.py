import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import runs
from attesta.llm.runs import collapsed, find_runs, lyndon_edges, periodic_runs


def slow_runs(w, least_length, least_times):
    out, n = [], len(w)
    for p in range(1, n):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            e = i
            while e + p < n and w[e] == w[e + p]:
                e += 1
            length = e - i + p
            part = w[i : e + p]
            if length >= 2 * p and length >= max(least_length, least_times * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((i, length, p))
            i = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_edges(s):
    after, agree = lyndon_edges(s)
    for i in range(len(s)):
        j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
        assert after[i] == j
        k = 0
        while j + k < len(s) and s[i + k] == s[j + k]:
            k += 1
        assert agree[i] == k


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(0, 8), st.integers(2, 4))
def test_runs_are_those_of_brute_force(s, root, times, least):
    s = s[: len(s) // 2] + root * times + s[len(s) // 2 :]
    assert find_runs(s, 2, least) == slow_runs(s, 2, least)
    words = [str(x).encode() for x in s]
    assert runs.runs_of_words(words, 6, least) == slow_runs(s, 6, least)


class _Counted(list):
    reads = 0

    def __getitem__(self, i):
        _Counted.reads += 1
        return super().__getitem__(i)


@pytest.mark.parametrize("s", [[0] * 4000, [0, 1] * 2000, ([0] * 30 + [1]) * 130, [2, 1, 0] * 1300, [(i ^ (i >> 1)).bit_count() & 1 for i in range(4000)]])
def test_comparisons_are_linear(s):
    for t in (s, [-x for x in s]):
        _Counted.reads = 0
        lyndon_edges(_Counted(t))
        assert _Counted.reads < 12 * len(s)


def _fibonacci(k):
    a, b = [0], [0, 1]
    for _ in range(k):
        a, b = b, b + a
    return b


def test_fibonacci_words():
    s = _fibonacci(11)
    assert find_runs(s, 2, 2) == slow_runs(s, 2, 2)
    _Counted.reads = 0
    lyndon_edges(_Counted(_fibonacci(16)))
    assert _Counted.reads < 12 * len(_fibonacci(16))


def _slow_row(key, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = slow_runs(w, 6, 4)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    milli = 1000 * best[1] // best[2] if best else None
    sha = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
    return (key, len(found), *(best or (None,) * 3), milli, sha, hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for i in range(300):
        t = [r.choice("abcdefgh") for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            t[len(t) // 2 : len(t) // 2] = [r.choice("xyzé") for _ in range(r.randint(1, 4))] * r.randint(2, 9)
        rows.append((i, r.choice([" ", "\n ", "\x0b\t"]).join(t)))
    rows += [(None, "a " * 30), (7, None), (7, "a b " * 40), (7, "a b " * 40), (500, ""), (501, " \t "), (502, "x y " * 9), (503, " ".join(f"w{i % 997}" for i in range(9000)))]
    spark.createDataFrame([(*x, "c") for x in rows], "doc_id bigint, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op11_query(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(_slow_row(*x)) for x in rows)
    assert sum(x[1] > 0 for x in map(tuple, got.collect())) > 50


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "a " * 200_000, "x"), (None, None, "y")], "doc_id bigint, text string, runs string")
    got = {r.doc_id: r for r in periodic_runs(df).collect()}
    assert got[1].runs[0].asDict() == {"start": 0, "length": 200_000, "period": 1} and got[1].kept_text == "a"
    assert got[None].n_words == 0 and got[None].runs == [] and got[None].kept_text == ""
    assert periodic_runs(df.limit(0)).count() == 0
    assert collapsed([b"a", b"b", b"a", b"b"], [(0, 4, 2)]) == b"a b"
    with pytest.raises(ValueError):
        periodic_runs(df, least_times=1)
