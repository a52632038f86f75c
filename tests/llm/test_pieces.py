import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm.pieces import decode_documents, encode_documents, load

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [None, "", " ", "  ", "a", " a", "a  b ", "x▁y", "tab\tnew\nline", "é ü 😀 汉字 ́", "<s> </s> <0x41> <unk>", "aaaaaaaaaaaa bbbbbb", "1234567 89", "    code\n        more", "\x00\x01"]


def ids(texts):
    return [None if x is None else np.frombuffer(x, "<i4").tolist() for x in load(PATH).encode(texts)]


def test_ids_equal_the_librarys():
    r = random.Random(5)
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    texts = ODD + docs + ["".join(r.choice("abcdeiou  nrst\n.,▁éß0") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    for t, got in zip(texts, ids(texts), strict=True):
        assert got == (None if t is None else SP.encode(t)), repr(t)


@settings(deadline=None, max_examples=150)
@given(st.text(max_size=40))
def test_round_trip(text):
    text = text.replace("▁", " ")
    assert load(PATH).decode(ids([text])[0]) == text


def test_prefixes_are_shared_without_effect():
    p = load(PATH)
    words = ["▁the", "▁them", "▁theme", "▁thermal", "▁zebra", "zebra", "▁"]
    together = dict(p.search(words))
    assert all(dict(p.search([w]))[w] == together[w] for w in words)


def test_nulls_long_ties_empty_and_clashing_columns(spark):
    texts = [*ODD, "long " * 30000, "w" * 30000, "a", "a"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    enc = encode_documents(df)
    got = {r.doc_id: r.ids for r in enc.collect()}
    assert got == {i: None if t is None else SP.encode(t) for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in decode_documents(enc).collect()}
    assert back == {i: None if t is None else t.replace("▁", " ") for i, t in enumerate(texts)}
    assert encode_documents(df.limit(0)).count() == 0


def test_one_worker_encodes_and_decodes_within_its_bounds(spark, monkeypatch):
    from attesta.llm import pieces

    r = random.Random(9)
    texts = [*ODD, "", "lang " * 50000, *[" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(300)) for _ in range(40)]]
    monkeypatch.setattr(pieces, "_BYTES", 20_000)
    monkeypatch.setattr(pieces, "_STEPS", 500)
    monkeypatch.setattr(pieces, "_FLUSH", 3000)
    small = pieces.Pieces(PATH)
    got = [small.encode([t])[0] for t in texts]
    assert [None if x is None else np.frombuffer(x, "<i4").tolist() for x in got] == [None if t is None else SP.encode(t) for t in texts]
    assert len(small.steps) <= 500 and small.held < 200_000
    df = spark.createDataFrame([(i % 7, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, decoded int")
    rows = pieces.round_trip(df).collect()
    assert sorted((r.doc_id, r.decoded or "") for r in rows) == sorted((i % 7, (t or "").replace("▁", " ")) for i, t in enumerate(texts))
    assert sum(r.ids is None for r in rows) == 1 and pieces.round_trip(df.limit(0)).count() == 0
