import hashlib
import random

from attesta.llm.spotsigs import as_text, compare_with_edits, from_text, likeness, near_pairs, signatures


def test_signatures_follow_common_words():
    assert len(signatures("the cat of sat on mat far")) == 3
    assert signatures("The CAT, sat!").tolist() == signatures("the cat sat").tolist()
    assert len(signatures(None)) == len(signatures("")) == 0 and len(signatures("!!")) == len(signatures("xyz")) == 1
    a, b = signatures("the cat sat on mat far away"), signatures("the cat sat on red far away")
    assert likeness(a, b) == 1 / 3 and likeness(a, a) == 1 and from_text(as_text(a)).tolist() == a.tolist()


def test_texts_without_common_words_survive_an_edit():
    r = random.Random(4)
    code = [f"fn{r.randint(0, 999)}(x{r.randint(0, 99)});" for _ in range(200)]
    a = signatures(" ".join(code))
    code[100] = "changed();"
    assert 0.9 < likeness(a, signatures(" ".join(code))) < 1
    greek = "ο σκύλος τρέχει στον κήπο και η γάτα κοιμάται στο σπίτι όλη μέρα"
    assert likeness(signatures(greek), signatures(greek + " σήμερα")) > 0.8


def test_keys_of_other_types(spark):
    rows = [("b", "the big house is red"), (None, "x"), ("a", "the small house"), ("b", "the big house is red")]
    got = compare_with_edits(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted((r.doc_id or "", r.n_chars) for r in got.collect()) == [("", 1), ("a", 15), ("b", 20), ("b", 20)]
    assert compare_with_edits(got.limit(0).selectExpr("doc_id", "'' text")).count() == 0


def test_edits_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: r.choice(["the", "of", "and", "in", "é" * 3, *[f"w{r.randint(0, 300)}" for _ in range(9)]])
    rows = [(i * 7 % 997, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(150)] + [(1000, None), (1001, ""), (1002, "the big " * 40000), (-5, "x")]
    r.shuffle(rows)
    got = {x.doc_id: x for x in compare_with_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    rows = sorted((k, t or "") for k, t in rows)
    assert len(got) == len(rows)
    for (k, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        x = got[k]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert x.fingerprint == as_text(signatures(t)) and x.edited_fingerprint == as_text(signatures(e))
        sets = [set(signatures(y).tolist()) for y in (t, e, n)]
        jac = lambda p, q: len(p & q) / len(p | q) if p and q else float(p == q)
        assert (x.near_edited, x.near_next) == (jac(sets[0], sets[1]), jac(sets[0], sets[2]))


def test_nulls_ties_single_and_empty(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, "a b", 2), (1, "a b", 3), (1, "c", 4)], "doc_id bigint, text string, bucket int")
    assert compare_with_edits(df).count() == 4
    one = compare_with_edits(df.where("bucket = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert compare_with_edits(df.limit(0)).count() == 0


def test_pairs_against_brute_force(spark):
    r = random.Random(8)
    base = [[r.choice(["the", "of", f"w{r.randint(0, 500)}", f"v{r.randint(0, 500)}"]) for _ in range(120)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(5):
            c = list(b)
            for _ in range(r.randint(0, 6)):
                c[r.randrange(len(c))] = f"z{r.randint(0, 99)}"
            texts.append(" ".join(c[: r.randint(100, 120)]))
    texts += [texts[0], "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, sigs string")
    df = df.unionByName(df.where("doc_id < 3"))  # repeated rows
    members, pairs = near_pairs(df)
    assert members.count() == len(texts) + 3
    cls = {x.doc_id: x.class_id for x in members.collect()}
    sets = {cls[i]: set(signatures(t).tolist()) for i, t in enumerate(texts)}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = [frozenset((x.a, x.b)) for x in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    members, pairs = near_pairs(df.limit(0))
    assert members.count() == 0 and pairs.count() == 0


def test_pairs_query_against_brute_force(spark, tmp_path):
    from attesta.llm.spotsigs import spotsigs_pairs_query

    r = random.Random(3)
    base = [[r.choice(["the", "of", f"w{r.randint(0, 300)}", f"v{r.randint(0, 300)}"]) for _ in range(90)] for _ in range(8)]
    texts = []
    for b in base:
        for _ in range(4):
            c = list(b)
            for _ in range(r.randint(0, 5)):
                c[r.randrange(len(c))] = f"z{r.randint(0, 99)}"
            texts.append(" ".join(c))
    texts += [texts[0], texts[5], "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_equal, x.n_near) for x in spotsigs_pairs_query(spark, str(tmp_path)).collect()}
    sets = [frozenset(signatures(t).tolist()) for t in texts]
    like = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.8
    want = {i: (sets.count(s), sum(like(s, o) for o in set(sets) if o != s)) for i, s in enumerate(sets)}
    assert got == want and sum(n for _, n in want.values()) > 4


def test_posts_carry_no_sets(spark, monkeypatch):
    from attesta.llm import spotsigs

    r = random.Random(6)
    base = [f"the w{r.randint(0, 40)} v{r.randint(0, 40)}" for _ in range(60)]
    texts = [" ".join(base[:20] + r.sample(base, 40)) for _ in range(5)] + [" ".join([*base, "the last one"][i:]) for i in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plans, put = {}, spotsigs.Staging.put
    monkeypatch.setattr(spotsigs.Staging, "put", lambda self, d, name: plans.update({name: d._jdf.queryExecution().executedPlan().toString()}) or put(self, d, name))
    found = lambda: sorted(map(tuple, near_pairs(df)[1].collect()))
    some = found()
    joined = plans["met"]
    assert "Join" in joined and not any("sigs" in line for line in joined.splitlines() if "Exchange" in line or "Sort" in line)
    monkeypatch.setattr(spotsigs, "KINDS", 3)  # any order of the signatures gives the same pairs
    assert len(some) > 5 and found() == some
