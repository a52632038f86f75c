import numpy as np

from attesta.llm import language_id
from attesta.llm.language_id import Network, Rows, identify, label, labelled_sample, predict, totals, train


def rows_of(texts):
    size = np.array([len(t) for t in texts])
    return Rows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size)


def test_gradients_match_differences():
    net = Network(["a", "b", "c"], hidden=3, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(2)
    texts = [bytes(r.integers(97, 101, n).astype(np.uint8)) for n in (5, 2, 4, 1)]
    rows = rows_of(texts)
    y = r.integers(0, 3, 4)
    _, g = net.gradients(rows, y)
    for name, w in net.w.items():
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in w.shape) if not name.startswith("x") else (int(r.integers(0, 9)), int(rows.data[0, 0]))
            old = w[at]
            w[at] = old + 1e-4
            up = net.gradients(rows, y)[0]
            w[at] = old - 1e-4
            down = net.gradients(rows, y)[0]
            w[at] = old
            assert abs((up - down) / 2e-4 - g[name][at]) < 1e-3, name


def slow(net, data):
    """Log probabilities of each position of one byte string, one byte and one unit at a time."""
    m, w = net.hidden, net.w

    def states(data, d):
        h, out = np.zeros(m), []
        for byte in data:
            x, g = w["x" + d][:, byte].astype(float), w["h" + d].astype(float) @ h
            z, r = (1 / (1 + np.exp(-(x[i * m : (i + 1) * m] + g[i * m : (i + 1) * m]))) for i in (0, 1))
            new = np.tanh(x[2 * m :] + r * (g[2 * m :] + w["c" + d][:, 0]))
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    s = np.array([w["of"] @ f + w["ob"] @ b + w["b"][:, 0] for f, b in zip(states(data, "f"), states(data[::-1], "b")[::-1], strict=True)])
    return s - np.log(np.exp(s).sum(1, keepdims=True))


def test_whole_texts_against_a_slow_network(monkeypatch):
    monkeypatch.setattr(language_id, "STRETCH", 7)
    monkeypatch.setattr(language_id, "CONTEXT", 3)
    monkeypatch.setattr(language_id, "TOGETHER", 4)
    net = Network(["a", "b", "c"], hidden=4, seed=3)
    r = np.random.default_rng(4)
    texts = [bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (1, 2, 6, 7, 8, 14, 15, 40, 100)]
    got = totals(net, texts)
    for t, row in zip(texts, got, strict=True):
        want = np.zeros(3)
        for s in range(0, len(t), 7):
            low, high = max(0, s - 3), min(len(t), s + 10)
            want += slow(net, t[low:high])[s - low : min(s + 7, len(t)) - low].sum(0)
        assert np.abs(row - want).max() < 1e-3 * len(t)
    names, scores = predict(net, ["ab cd", None, "12 34", "", "\u00e9"])
    assert [n == "und" for n in names] == [False, True, True, True, False] and scores[1:4] == [0, 0, 0]
    mean = slow(net, b"ab cd").mean(0)
    assert abs(scores[0] - np.exp(mean.max()) / np.exp(mean).sum()) < 1e-4


def test_a_run_up_is_as_good_as_the_whole_text():
    texts = ["the quick brown fox and the lazy dog " * 40, "der schnelle braune Fuchs und der faule Hund " * 40]
    net = train([("en", texts[0]), ("de", texts[1])], steps=80)
    raw = [t.encode() for t in texts]
    whole = np.array([slow(net, t).sum(0) for t in raw])
    assert np.abs(totals(net, raw) - whole).max() / min(map(len, raw)) < 0.02
    assert predict(net, texts)[0] == ["en", "de"]


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "the house is old " * 60000, "en"), (2, "das Haus ist alt " * 60000, "de"), (3, "the house", "en"), (4, "das Haus", "de")], "doc_id bigint, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in identify(docs).collect()} == {1: "en", 2: "de", 3: "en", 4: "de"}


def test_the_sample_is_bounded_whatever_repeats(spark):
    rows = [(None, "same words again", "en")] * 300 + [(7, f"text number {i}", "de") for i in range(300)] + [(i, "uno dos", "es") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = labelled_sample(docs, rows=40)
    assert sum(x == "en" for x, _ in got) == 40 and sum(x == "de" for x, _ in got) <= 40 and sum(x == "es" for x, _ in got) <= 5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert len(rows) == docs.count() and len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(None, "hello there", None, "t"), (1, None, "en", "t"), (2, "", "en", "t"), (3, "one two", "en", "t"), (3, "one two", "en", "t"), (4, "!! 12", "en", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    got = {(r.doc_id, r.held_out, r.lang_pred) for r in identify(df).collect()}
    assert {x[2] for x in got if x[0] in (1, 2, 4)} == {"und"} and {x[2] for x in got if x[0] in (None, 3)} == {"en"}
    assert identify(df).count() == 6 and identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in label(df, train([])).collect()} == {"und"}
