import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from attesta.llm import collocations as c


def slow(rows, least=10, keep=2000, longest=3):
    f, n = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for p in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", p)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, g in f.items():
        cand = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(100 * b >= 50 * a for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, left, right = min((1000000 * a * a // (g[p[:k]] * g[p[k:]]), k, g[p[:k]], g[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:keep], 1)]
    return sorted(out)


def _rows():
    r = random.Random(3)
    base = ["new york city", "of the", "in the house", "a b c d", "Été à la", "ÀB x"]
    rows = []
    for i in range(250):
        t = []
        for _ in range(r.randint(0, 40)):
            t.append(r.choice(base) if r.random() < 0.4 else f"w{r.randint(0, 30)}")
            t.append(r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " - "]))
        rows.append((r.choice(["en", "de", None, "und"]), "".join(t)))
    return rows + [("en", None), ("en", ""), (None, " . ; "), ("fr", "long text " * 30_000), ("de", rows[3][1]), ("de", rows[3][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, *x, "s", 1) for i, x in enumerate(rows)], "doc_id bigint, lang string, text string, phrase string, f int")


@pytest.mark.parametrize(("least", "keep", "longest", "at_once"), [(10, 2000, 3, 4_000_000), (10, 7, 3, 500), (3, 2000, 4, 4_000_000), (12, 50, 2, 100)])
def test_against_brute_force(spark, monkeypatch, least, keep, longest, at_once):
    monkeypatch.setattr(c, "AT_ONCE", at_once)
    rows = _rows()
    got = c.collocations(frame(spark, rows), longest, least, keep)
    want = slow(rows, least, keep, longest)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_query_and_sql(spark, tmp_path):
    frame(spark, _rows()).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(c.ORACLE).fetchall())
    assert sorted(map(tuple, c.op12_query(spark, str(tmp_path)).collect())) == want == slow(_rows())


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 9_000_000_000, 1), ("en", "b", 8_999_999_999, 1), ("en", "a b", 8_999_999_998, 2)], "lang string, gram string, f bigint, size int")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(c, "frequent_grams", lambda *a: counts)
        got = c.collocations(frame(spark, [("en", "a b")])).first()
    assert got.score == 1000000 * 8_999_999_998**2 // (9_000_000_000 * 8_999_999_999)


def test_empty(spark):
    none = frame(spark, [("en", "a")]).limit(0)
    assert c.collocations(none).count() == 0
    assert c.collocations(frame(spark, [(None, None), ("en", "a b c")])).count() == 0
    with pytest.raises(ValueError):
        c.collocations(none, longest=1)


def test_scratch_is_deleted(spark, tmp_path, monkeypatch):
    import tempfile

    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    reader = c.frequent_grams(c.distinct_pieces(frame(spark, [("en", "a b " * 40)])))
    assert {(r.gram, r.f) for r in reader.collect()} >= {("a b", 40), ("a", 40)}
    assert not list(tmp_path.iterdir())
