"""Language identification by a bidirectional gated recurrent network over the bytes of whole documents.

The network reads a document's bytes from either side and labels every position; a document's probabilities are the
geometric mean over all of them. Long texts are read in stretches, each with the bytes around it as a run-up for the
states, so that a worker reads many stretches in step and a very long text needs no long chain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.plans.staging import bounded_batches

HELD_OUT = 2
#: The network learns from the whole texts of at most so many rows of each language.
SAMPLE_ROWS = 400
#: Languages up to which their counts are broadcast.
FEW = 50_000
#: Units in each direction; steps of learning, windows in each and their bytes.
HIDDEN, STEPS, BATCH, SPAN, SEED = 12, 400, 192, 80, 11
#: Positions that a stretch labels, bytes of run-up on either side, and stretches read in step.
STRETCH, CONTEXT, TOGETHER = 256, 32, 2048
_FLUSH = 2_000_000
_ASCII, _ANY = re.compile("[A-Za-z]"), regex.compile(r"\p{L}")


def has_letter(text: str) -> bool:
    """Whether a text has a letter of any script."""
    return bool(_ASCII.search(text) or _ANY.search(text))


class Rows:
    """Byte sequences side by side, longest first: ``data[t]`` holds byte t of the first ``live[t]`` of them."""

    def __init__(self, buffer: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.order = np.argsort(-length, kind="stable")
        begin, length = begin[self.order], length[self.order]
        steps = np.arange(int(length[0]) if len(length) else 0)
        self.live = np.searchsorted(-length, -steps, "left")
        self.data = buffer[np.minimum(begin + steps[:, None], len(buffer) - 1)].astype(np.intp)
        self.n = len(length)


class Network:
    """Two gated recurrent layers over bytes, one in each direction, and a softmax at each position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        r, k = np.random.default_rng(seed), len(labels)
        small = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.w = {f"{p}{d}": v for d in "fb" for p, v in (("x", small(3 * hidden, 256)), ("h", small(3 * hidden, hidden)), ("c", np.zeros((hidden, 1), np.float32)), ("o", small(k, hidden)))}
        self.w["b"] = np.zeros((k, 1), np.float32)

    def _walk(self, rows: Rows, d: str) -> Iterator[tuple]:
        """Position by position in one direction: the state before and after, the gates, the new part and what the reset gate scales."""
        m, (wx, wh, c) = self.hidden, (self.w[p + d] for p in "xhc")
        h = np.zeros((m, rows.n), wh.dtype)
        for t in range(len(rows.live)) if d == "f" else range(len(rows.live) - 1, -1, -1):
            k = rows.live[t]
            old = h[:, :k]
            x, g = np.take(wx, rows.data[t, :k], axis=1, mode="clip"), wh @ old
            gates = x[: 2 * m]
            gates += g[: 2 * m]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            inner = g[2 * m :]
            inner += c
            new = x[2 * m :]
            new += gates[m:] * inner
            np.tanh(new, out=new)
            after = old - new
            after *= gates[:m]
            after += new
            yield t, k, old, after, gates, new, inner
            h[:, :k] = after

    def log_probabilities(self, rows: Rows, own: np.ndarray) -> np.ndarray:
        """For each sequence the sum of the labels' log probabilities over the positions where ``own`` is 1."""
        k = len(self.labels)
        scores = np.zeros((len(rows.live), k, rows.n), np.float32)
        for t, n, _, h, *_ in self._walk(rows, "f"):
            np.matmul(self.w["of"], h, out=scores[t, :, :n])
        for t, n, _, h, *_ in self._walk(rows, "b"):
            s = scores[t, :, :n]
            s += self.w["ob"] @ h
            s += self.w["b"]
            s -= s.max(0)
            s -= np.log(np.exp(s).sum(0))
        return np.einsum("tkn,tn->kn", scores, own)

    def gradients(self, rows: Rows, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of all positions, and its gradients by backpropagation through time."""
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        ways = {d: {x[0]: (x[1], x[2].copy(), *x[3:]) for x in self._walk(rows, d)} for d in "fb"}
        places, loss, back = int(rows.live.sum()), 0.0, {"f": {}, "b": {}}
        for t, k in enumerate(rows.live):
            s = sum(self.w["o" + d] @ ways[d][t][2] for d in "fb") + self.w["b"]
            p = np.exp(s - s.max(0))
            p /= p.sum(0)
            loss -= float(np.log(p[label[:k], np.arange(k)] + 1e-12).sum())
            p[label[:k], np.arange(k)] -= 1
            p /= places
            g["b"] += p.sum(1, keepdims=True)
            for d in "fb":
                g["o" + d] += p @ ways[d][t][2].T
                back[d][t] = self.w["o" + d].T @ p
        m, read = self.hidden, np.concatenate([rows.data[t, :k] for t, k in enumerate(rows.live)])
        by_byte = np.argsort(read, kind="stable")
        seen, starts = np.unique(read[by_byte], return_index=True)
        for d in "fb":
            dh, wh, inputs = np.zeros((m, rows.n), self.w["b"].dtype), self.w["h" + d], [None] * len(rows.live)
            for t in reversed(ways[d]):
                k, old, _, gates, new, inner = ways[d][t]
                z, r = gates[:m], gates[m:]
                to = dh[:, :k] + back[d][t]
                dn = to * (1 - z) * (1 - new * new)
                dz, dr = to * (old - new) * z * (1 - z), dn * inner * r * (1 - r)
                inputs[t], dg = np.concatenate([dz, dr, dn]), np.concatenate([dz, dr, dn * r])
                g["h" + d] += dg @ old.T
                g["c" + d] += (dn * r).sum(1, keepdims=True)
                dh[:, :k] = to * z + wh.T @ dg
            g["x" + d][:, seen] = np.add.reduceat(np.concatenate(inputs, 1)[:, by_byte], starts, 1)
        return loss / places, g


def train(sample: list[tuple[str, str]], steps: int = STEPS, hidden: int = HIDDEN, seed: int = SEED) -> Network | None:
    """A network from ``(language, text)`` rows by Adam over random windows of the whole texts; None without any text."""
    labels = sorted({lang for lang, text in sample if text})
    if not labels:
        return None
    texts = {x: [t.encode("utf-8", "surrogatepass") for lang, t in sorted(sample) if lang == x and t] for x in labels}
    buffers = {x: np.frombuffer(b"".join(v), np.uint8) for x, v in texts.items()}
    ends = {x: np.cumsum([len(t) for t in v]) for x, v in texts.items()}
    net, r = Network(labels, hidden, seed), np.random.default_rng(seed)
    one = {k: np.zeros_like(v) for k, v in net.w.items()}
    two = {k: np.zeros_like(v) for k, v in net.w.items()}
    every, shift = np.concatenate([buffers[x] for x in labels]), np.cumsum([0, *(len(buffers[x]) for x in labels)])
    for step in range(1, steps + 1):
        label = np.arange(BATCH) % len(labels)  # languages count alike, and so do the bytes of each
        begin, length = np.zeros(BATCH, np.int64), np.zeros(BATCH, np.int64)
        for k, x in enumerate(labels):
            at = r.integers(0, len(buffers[x]), int((label == k).sum()))
            length[label == k] = np.minimum(SPAN, ends[x][np.searchsorted(ends[x], at, "right")] - at)
            begin[label == k] = shift[k] + at
        rows = Rows(every, begin, length)
        _, grads = net.gradients(rows, label[rows.order])
        rate = 0.02 * (1 - step / (steps + 1)) + 1e-4
        for name, grad in grads.items():
            one[name] += 0.1 * (grad - one[name])
            two[name] += 0.01 * (grad * grad - two[name])
            net.w[name] -= rate * (one[name] / (1 - 0.9**step)) / (np.sqrt(two[name] / (1 - 0.99**step)) + 1e-8)
    return net


def totals(net: Network, texts: list[bytes]) -> np.ndarray:
    """For each text the sum of its positions' log probabilities, a row a text.

    A text is cut into stretches of ``STRETCH`` bytes; each is read with ``CONTEXT`` bytes before and after it, as far as
    the text has them, and labels its own positions alone.
    """
    size = np.array([len(t) for t in texts], np.int64)
    many = -(-size // STRETCH)
    of = np.repeat(np.arange(len(texts)), many)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * STRETCH
    low, high = np.maximum(start - CONTEXT, 0), np.minimum(start + STRETCH + CONTEXT, size[of])
    first, last = start - low, np.minimum(start + STRETCH, size[of]) - low
    begin, buffer = (np.cumsum(size) - size)[of] + low, np.frombuffer(b"".join(texts), np.uint8)
    out, long_first = np.zeros((len(texts), len(net.labels))), np.argsort(low - high, kind="stable")
    for at in range(0, len(of), TOGETHER):
        mine = long_first[at : at + TOGETHER]
        rows = Rows(buffer, begin[mine], (high - low)[mine])
        mine = mine[rows.order]
        step = np.arange(len(rows.live))[:, None]
        own = ((step >= first[mine]) & (step < last[mine])).astype(np.float32)
        np.add.at(out, of[mine], net.log_probabilities(rows, own).T)
    return out


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and its probability for each text; ``und`` and 0 for null, without a letter, or without a network."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
    raw = [texts[i].encode("utf-8", "surrogatepass") for i in known]
    if not known:
        return names, scores
    for i, t, total in zip(known, raw, totals(net, raw), strict=True):
        p = np.exp((total - total.max()) / len(t))
        names[i], scores[i] = net.labels[int(p.argmax())], float(p.max() / p.sum())
    return names, scores


def predictions(net: Network | None, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """``predict`` for a column, some ``_FLUSH`` bytes at a time."""
    names, scores, at = [], [], 0
    before = np.cumsum([0, *pc.fill_null(pc.binary_length(texts), 0).to_pylist()])
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(before, before[at] + _FLUSH, "right")) - 1)
        n, s = predict(net, texts.slice(at, to - at).to_pylist())
        names, scores, at = names + n, scores + s, to
    return pa.array(names, pa.string()), pa.array(scores, pa.float64())


def held_out(key: str = "doc_id"):
    """Whether a row is kept from learning: CRC-32 of the key as text leaves 2 by 4. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """``(language, whole text)`` of at most ``rows`` rows of each language, those of the smallest hashes.

    Rows are counted by language; a few more than wanted pass by their hash of key and text, and the rest is cut off
    exactly, whatever keys and texts repeat. Held-out rows, null languages and null texts are not looked at.
    """
    usable = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit("sample"), key, text).alias("h"))
    found = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()
    counts = pa.table({"lang": pa.array([r.lang for r in found], pa.string()), "n": pa.array([r.n for r in found], pa.int64())})
    counts = docs.sparkSession.createDataFrame(counts, "lang string, n bigint")  # from Arrow: a list would start Python workers of another kind
    if len(found) <= FEW:
        counts = F.broadcast(counts)  # else rows would be dealt by language, of which one may have most
    some = usable.join(counts, "lang").where(F.pmod("h", F.lit(1 << 30)) * F.col("n") <= float(1 << 30) * (1.5 * rows + 50))
    first = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("at") <= rows)
    return [(r.lang, r.text) for r in first.select("lang", "text").collect()]


def label(docs: DataFrame, net: Network | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score`` for each row of ``docs``, from its whole text alone.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Rows don't affect each other:
    repeated rows and keys, null keys and an empty table need nothing special; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), *predictions(net, b.column("t"))], ["k", "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double")
    return got.withColumnRenamed("k", key)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """``key, held_out, lang_pred, score`` for each row, after learning from the rows that aren't held out.

    Nulls in any column, repeated rows and keys, other columns of whatever names and an empty table are fine. A text's
    probabilities come from all its bytes; a very long one is read in stretches by the task that holds it.
    """
    got = label(docs, train(labelled_sample(docs, text, lang, key)), text, key)
    return got.select(key, held_out(key).alias("held_out"), "lang_pred", "score")


def op2_query(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
