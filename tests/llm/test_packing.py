import random
import tracemalloc
import zlib
from functools import cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attesta.llm import byte_bpe, packing
from attesta.llm.packing import fullest, pack_documents, plan
from attesta.llm.token_counts import Rollup, count_tokens, deletes, inserts, revisions

tokenizer = cache(Tokenizer.from_file)
TEXTS = [
    None, "", " ", "a", "a b", " a  b ", "a\nb c\n\n d", "x" * 5000, "word " * 3000, "it's I'll 12 3,4  ...\t\t x", "é ü ñ 　z", "a<|endoftext|>b c",
    "\x1f a \x1f b", "a \x85 b", "end ", "\n a", "emoji 😀 😀x", "tab\t x", "a \n b",
]


def test_ids_equal_those_of_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, bpe, r = Tokenizer.from_file(path), byte_bpe.load(path), random.Random(3)
    texts = [x or "" for x in TEXTS] + ["".join(r.choice("ab '.\n\t 1é \x1c") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for x in texts:
        assert np.frombuffer(bpe.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_ids_of_whole_tables_equal_those_of_tokenizers():
    """Every text of the documents, pages and conversations of one table size."""
    import pyarrow.parquet as pq

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, bpe = Tokenizer.from_file(path), byte_bpe.load(path)
    for name, column in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
        texts = [x for x in pq.read_table(f"/root/testdata/sf0.01/{name}.parquet", columns=[column]).column(0).to_pylist() if x is not None]
        for x, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(bpe.ids(x), "<u4").tolist() == want.ids


def test_pieces_that_come_once_are_not_kept():
    path = public_tokenizers.path("byte_bpe_50k.json")
    bpe, t = byte_bpe.ByteBpe(path), Tokenizer.from_file(path)
    tracemalloc.start()
    for at in range(0, 400_000, 1000):
        bpe.ids("begin " + " ".join(f"q{i}z often" for i in range(at, at + 1000)))
    grown = tracemalloc.get_traced_memory()[0] / 1e6
    tracemalloc.stop()
    assert grown < 30 and "often" in bpe
    text = " ".join(f"q{i}z" for i in [0, 399_999, 399_999, 380_000, 0, 399_999])  # forgotten, young and kept ones
    assert np.frombuffer(bpe.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_texts_of_new_pieces_are_encoded_whole(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    bpe, t, calls = byte_bpe.ByteBpe(path), tokenizer(path), []
    monkeypatch.setattr(byte_bpe, "TRIAL", 20)
    monkeypatch.setattr(byte_bpe, "WHOLE", 300)
    raw = bpe._raw
    monkeypatch.setattr(bpe, "_raw", lambda text: calls.append(text) or raw(text))
    texts = ["begin\n " + " ".join(f"q{i}z \tand\n" for i in range(50))] + ["begin " + " ".join(f"q{i}z" for i in range(at, at + 50)) for at in range(0, 15_000, 50)]
    texts += ["begin again and again"] * 100 + [texts[1]] * 100
    for x in texts:
        assert np.frombuffer(bpe.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert len(calls) < 3000 and "again" in bpe  # 15,000 new pieces
    long = "word  x" * 40 + "y"
    monkeypatch.setattr(byte_bpe, "LONG", 100)
    assert np.frombuffer(raw(long), "<u4").tolist() == t.encode(long, add_special_tokens=False).ids


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert np.frombuffer(byte_bpe.load(path).ids(text), "<u4").tolist() == tokenizer(path).encode(text, add_special_tokens=False).ids


def test_fullest_is_the_best_subset_with_the_largest():
    from itertools import product

    r = random.Random(4)
    for _ in range(200):
        counts = {x: r.randint(1, 3) for x in r.sample(range(1, 21), 4)}
        take, top = fullest(counts, 20), max(counts)
        assert all(k <= counts[x] for x, k in take.items()) and take[top] >= 1
        best = max(s for c in product(*[range(n + 1) for n in counts.values()]) if (s := sum(x * k for x, k in zip(counts, c))) <= 20 and dict(zip(counts, c))[top])
        assert sum(x * k for x, k in take.items()) == best


def test_packing_is_a_gapless_exact_cover(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, r = Tokenizer.from_file(path), random.Random(9)
    texts = TEXTS + ["the " * r.randint(1, 900) for _ in range(150)] + ["same"] * 40 + ["very long " * 60000]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)], "doc_id bigint, text string, length string")
    rows = pack_documents(df).collect()
    by_doc, by_seq = {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_seq.setdefault(x.sequence_id, []).append(x)
    assert sorted(by_doc) == list(range(len(texts)))
    for d, xs in by_doc.items():
        ids = t.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        xs.sort(key=lambda x: x.piece)
        assert [x.piece for x in xs] == list(range(len(xs))) and sum(x.length for x in xs) == len(ids)
        assert all(x.length == 2048 for x in xs[1:]) and (len(ids) > 2048 or len(xs) == 1)
        at = 0
        for x in xs:
            assert x.start == at and x.ids_crc32 == zlib.crc32(np.array(ids[at : at + x.length], "<u4").tobytes())
            at += x.length
    for xs in by_seq.values():
        at = 0
        for x in sorted(xs, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048
    total = sum(x.length for x in rows)
    assert len(by_seq) <= -(-total // 2048) + 1
    assert pack_documents(df.limit(0)).count() == 0


def test_a_plan_has_about_a_step_for_each_length():
    counts = {x: 1 + x * 7919 % 10**9 for x in range(1, 2049)}
    steps = plan(counts)
    assert len(steps) <= 2 * 2048
    assert {x: sum(n * c.get(x, 0) for n, c in steps) for x in counts} == counts


def test_rollup_signs_revisions_and_replays(spark, tmp_path):
    rows = [(1, "a b", "s", "en"), (2, "c d e", "s", None), (3, None, None, "de"), (4, "", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    counts = count_tokens(docs)
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == {1: 2, 2: 3, 3: 0, 4: 0}
    rollup = Rollup(spark, f"file://{tmp_path}/r")
    got = lambda: {(r.source, r.lang, r.docs, r.tokens) for r in rollup.totals().collect()}
    assert got() == set()
    assert rollup.commit("b1", inserts(counts)) and not rollup.commit("b1", inserts(counts))
    assert got() == {("s", "en", 2, 2), ("s", None, 1, 3), (None, "de", 1, 0)}
    new = counts.where("doc_id = 1").selectExpr("doc_id", "'t' source", "lang", "version", "n_tokens + 5 n_tokens")
    assert rollup.commit("b2", revisions(counts.where("doc_id = 1"), new))
    assert rollup.commit("b3", deletes(counts.where("doc_id = 2")))
    assert got() == {("s", "en", 1, 0), ("t", "en", 1, 7), (None, "de", 1, 0)}


def test_counts_of_repeats_nulls_and_clashing_columns(spark):
    rows = [(None, "a b", "s", "en", "v"), (1, "a b", "s", "en", "v"), (1, "a b", "s", "en", "v"), (2, "word " * 200000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, version string")
    assert sorted((r.doc_id or 0, r.version, r.n_tokens) for r in count_tokens(docs).collect()) == [(0, "byte_bpe_50k", 2), (1, "byte_bpe_50k", 2), (1, "byte_bpe_50k", 2), (2, "byte_bpe_50k", 200001)]
    assert count_tokens(docs.limit(0)).count() == 0


def test_the_query_equals_one_grouping(spark):
    import pyarrow.parquet as pq

    from attesta.llm.token_counts import op4_query

    t, want = tokenizer(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist():
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        docs, tokens = want.get((r["source"], r["lang"]), (0, 0))
        want[r["source"], r["lang"]] = (docs + 1, tokens + n)
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in op4_query(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_of_two_commits_at_a_time_one_counts(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    docs = spark.createDataFrame([(1, "a b", "s", "en")], "doc_id bigint, text string, source string, lang string")
    rollup, rows = Rollup(spark, f"file://{tmp_path}/r"), inserts(count_tokens(docs))
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: rollup.commit("b", rows), range(4)))
    assert sum(done) == 1 and [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(1, 2)]


def test_null_keys_and_repeated_rows_are_packed(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c"), (1, None)], "doc_id bigint, text string")
    rows = pack_documents(df).collect()
    assert len(rows) == 5 and sum(x.doc_id is None for x in rows) == 2 and len({(x.sequence_id, x.offset) for x in rows}) == 5


def test_an_empty_batch_is_committed_and_adds_nothing(spark, tmp_path):
    from attesta.llm.token_counts import Rollup, count_tokens, inserts

    docs = spark.createDataFrame([(1, "a b", "s", None), (1, "a b", "s", None), (None, None, None, "en")], "doc_id bigint, text string, source string, lang string")
    counts, rollup = count_tokens(docs), Rollup(spark, f"{tmp_path}/r")
    assert rollup.totals().count() == 0
    assert rollup.commit("none", inserts(counts.limit(0))) and not rollup.commit("none", inserts(counts)) and rollup.totals().count() == 0
    assert rollup.commit("some", inserts(counts))
    got = {(x.source, x.lang): (x.docs, x.tokens > 0) for x in rollup.totals().collect()}
    assert got == {("s", None): (2, True), (None, "en"): (1, False)}
