import random
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import simhash
from attesta.llm.simhash import fingerprint, links, near_duplicates, near_groups, sketch


def slow_fingerprint(text, shingle=3):
    words = [w for w in (text or "").encode().lower().split() if w]
    if not words:
        return 0
    k = min(shingle, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    got = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return got - (1 << 64) if got >> 63 else got


@settings(deadline=None, max_examples=60)
@given(st.text("ab éÉA\n\t ", max_size=60))
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_links_are_all_pairs_within_three_bits(spark):
    import random

    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(8)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    df = spark.createDataFrame([(f,) for f in [*fps, *fps[:5], None]], "fp bigint")
    got = [tuple(x) for x in links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    want5 = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 5}
    assert {tuple(x) for x in links(df, 5).collect()} == want5


def test_components_nulls_ties_empty_and_clashing_columns(spark):
    rows = [(4, "a b c d", "x"), (2, "a b c d", "y"), (7, None, "z"), (9, "  ", "z"), (None, "a b c d", "q"), (11, "w " * 30000, "fp"), (2, "a b c d", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = {(r.doc_id, r.fp, r.component_id) for r in near_duplicates(df).collect()}
    f = fingerprint("a b c d")
    assert got == {(4, f, 2), (2, f, 2), (None, f, 2), (7, 0, 7), (9, 0, 7), (11, fingerprint("w w w"), 11)}
    assert near_duplicates(df).count() == len(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_groups_keep_one_of_each(spark):
    import random

    r = random.Random(12)
    rows, of = [], {}
    for g in range(30):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(300)]
        for _ in range(r.randint(1, 4)):
            copy = list(words)
            if r.random() < 0.5:
                copy[r.randrange(300)] = "edited"
            of[len(rows)] = g
            rows.append((len(rows), " ".join(copy), "x"))
    rows += [(900, "", "x"), (901, None, "x"), (902, "short text", "x"), (902, "short text", "x"), (None, "short text", "x")]
    got = near_groups(spark.createDataFrame(rows, "doc_id bigint, text string, first string")).collect()
    assert len(got) == len(rows)
    kept = [x.doc_id for x in got if x.first and x.doc_id is not None and x.doc_id < 900]
    assert sorted(of[k] for k in kept) == list(range(30)) and all(k == min(i for i in of if of[i] == of[k]) for k in kept)
    rest = [x.doc_id for x in got if x.first and (x.doc_id is None or x.doc_id >= 900)]
    assert rest == [900, None] or rest == [None, 900]
    assert sketch("a b c d e f", 5, 3)[0] == fingerprint("a b c d e f", 5)


def planted(r, likeness, n, size):
    """Pairs of texts of unrelated words whose sets of five-word shingles have about a likeness."""
    out = []
    for _ in range(n):
        words = [f"q{r.randint(0, 10**9)}" for _ in range(size)]
        copy, total = list(words), size - 4
        # shared share of 2J / (1 + J): a run of other words at the end takes one shingle a word
        other = round(total * (1 - likeness) / (1 + likeness))
        copy[size - other :] = [f"q{r.randint(0, 10**9)}" for _ in range(other)]
        out.append((" ".join(words), " ".join(copy)))
    return out


def jaccard(a, b):
    x, y = (set(zip(*[t.split()[i:] for i in range(5)])) for t in (a, b))
    return len(x & y) / len(x | y)


def test_groups_find_pairs_of_the_likeness_and_no_others(spark):
    import random

    r = random.Random(31)
    pairs = [p for like in (0.75, 0.78, 0.8, 0.81, 0.82, 0.85) for size in (40, 300) for p in planted(r, like, 40, size)]
    rows = [(i, t) for i, t in enumerate(t for p in pairs for t in p)]
    got = {x.doc_id for x in near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if x.first}
    want = [jaccard(*p) >= 0.8 for p in pairs]
    joined = [2 * i + 1 not in got for i in range(len(pairs))]
    assert all(2 * i in got for i in range(len(pairs)))
    assert not any(j and not w for j, w in zip(joined, want))
    assert sum(want) > 200 and sum(j and w for j, w in zip(joined, want)) >= 0.97 * sum(want)


def test_groups_look_at_the_text_where_fingerprints_are_equal(spark):
    tail = lambda k: " ".join(f"t{k}x{i}" for i in range(12))
    rows = [(1, "same " * 60 + tail(1)), (2, "same " * 60 + tail(2)), (3, "same " * 60 + tail(1)), (4, "a b c d e f g h"), (5, "a b c d e f g h i")]
    got = {x.doc_id for x in near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if x.first}
    assert got == {1, 2, 4}


def test_sketch_is_the_majority_of_distinct_shingles():
    for n in (1, 2, 3, 6, 40, 1000):
        text = " ".join(f"w{i}" for i in range(n))
        assert sketch(text, 3, 4)[0] == slow_fingerprint(text) and len(set(sketch(text, 3, 40))) == 40


def test_the_query_against_all_pairs(spark):
    """Fingerprints and components of a whole table: every pair of fingerprints compared, reachability by union."""
    import pyarrow.parquet as pq

    from attesta.llm.simhash import op6_query

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) & (1 << 64) - 1 for r in rows}
    group = {k: k for k in prints}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((root(a), root(b)))
                group[high] = low
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in op6_query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {(k, f"{prints[k]:016x}", root(k)) for k in keys}
    assert any(root(k) != k for k in keys)


def test_texts_that_meet_by_chance_are_no_rows(spark, monkeypatch):
    r, put, rows = random.Random(12), simhash.Staging.put, []

    def seen(self, df, name):
        got = put(self, df, name)
        rows.extend(got.select("post", "id", "rest").collect() if name.startswith("posts") else [])
        return got

    monkeypatch.setattr(simhash.Staging, "put", seen)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(900)]
    texts += [x + " end" for x in texts[:20]]
    kept = simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).where("first").count()
    lists = {}
    for x in rows:
        lists.setdefault(x.post, []).append(x)
    assert kept == 900 and lists
    assert all(any(y.id != x.id and (x.rest ^ y.rest).bit_count() <= simhash.OTHER for y in posts) for posts in lists.values() for x in posts)
