"""Removal of word sequences that occur more than once in the corpus, by FM-indexes over content-defined shards.

Every window of words is dealt to a shard by the smallest hash among its word 8-grams, so equal windows meet in
one shard whatever stands around them. Stretches whose smallest hash is unique in the corpus can't recur and go
nowhere. Each shard indexes its distinct stretches once, with their numbers of places as weights, and streams
them through the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.fm_index import Matches
from attesta.plans.staging import Staging, bounded_batches

GRAM = 8
#: Stretches of one smallest hash above which its windows are dealt singly, and stretches in a shard.
ALIKE, SHARD = 128, 6000
_A = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]:
    """``(first word, windows, anchor, hash, places)`` for runs of consecutive windows with one anchor.

    A window's anchor is the smallest hash among its word 8-grams; a run ends after at most
    ``window - GRAM + 1`` windows. Each window is in one run. ``places`` is 2 if the anchor's words stand in the run
    more than once, as they do if two of its own windows are equal, else 1.
    """
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), [], np.zeros(0, np.int8)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    g, a, width = h, _A, 1
    while width < GRAM:
        g = g[:-width] * a + g[width:]
        a, width = np.uint64(int(a) ** 2 % (1 << 64)), width * 2
    grams = _mix(g)
    low, span, wide = grams, 1, window - GRAM + 1
    while 2 * span <= wide:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    starts = np.concatenate([[0], cut])
    sizes = np.diff(np.concatenate([starts, [n]]))
    if sizes.max() > wide:
        pieces = -(-sizes // wide)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sizes, starts = np.minimum(wide, np.repeat(sizes, pieces) - wide * k), np.repeat(starts, pieces) + wide * k
    raw, digest = h.tobytes(), xxhash.xxh3_64_intdigest
    ends, places = starts + sizes + window - 1, np.ones(len(starts), np.int8)
    ordered = np.sort(grams)
    if (ordered[1:] == ordered[:-1]).any():
        held = sizes + wide - 1  # grams of each run
        run = np.repeat(np.arange(len(starts)), held)
        at = starts[run] + np.arange(held.sum()) - (np.cumsum(held) - held)[run]
        places += np.bincount(run[grams[at] == low[starts][run]], minlength=len(starts)) > 1
    return starts, sizes, low[starts], [digest(raw[8 * s : 8 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], places


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _all_stretches(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, parts = [], ([], [], [], [], [])
            for i, t in enumerate(b.column("t")):
                got = stretches(_split(t.as_py()), window)
                at += [i] * len(got[3])
                for p, x in zip(parts, got, strict=True):
                    p.append(np.array(x, np.uint64) if p is parts[3] else x)
            none = np.zeros(0, np.uint64)
            s, n, a, h, c = (np.concatenate(p) if p else none for p in parts)
            at = pa.array(np.array(at, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("k").take(at), b.column("tag").take(at), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int8))],
                ["k", "tag", "start", "n", "anchor", "hash", "c"],
            )

    return docs.mapInArrow(run, f"k {docs.schema['k'].dataType.simpleString()}, tag bigint, start int, n int, anchor bigint, hash bigint, c tinyint")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            t = pa.array([None if x is None else z.compress(x.encode("utf-8", "surrogatepass")) for x in b.column("t").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("tag"), t], ["k", "tag", "z"])

    return docs.mapInArrow(run, f"k {docs.schema['k'].dataType.simpleString()}, tag bigint, z binary")


def _same(a: str, b: str):
    """Rows of one text: equal keys, null included, and equal hashes of the text."""
    return F.col(f"{a}.k").eqNullSafe(F.col(f"{b}.k")) & (F.col(f"{a}.tag") == F.col(f"{b}.tag"))


def _contents(asked: DataFrame, window: int) -> DataFrame:
    """The words of the stretches that stand for all equal ones; windows singly where too many are alike.

    ``asked``: ``z`` and ``want``, an array of ``start, n, anchor, hash, places, single``. Returns ``unit`` (hash
    of the words), ``shard`` (hash to deal by), ``anchor, hash, offset, places, words``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, names = zstandard.ZstdDecompressor(), ["unit", "shard", "anchor", "hash", "offset", "places", "words"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            rows: list[tuple] = []
            for z, want in zip(b.column("z"), b.column("want"), strict=True):
                words = d.decompress(z.as_py()).split()
                for x in want.as_py():
                    s, e = x["start"], x["start"] + x["n"] + window - 1
                    for at, to in ((i, i + window) for i in range(s, s + x["n"])) if x["single"] else ((s, e),):
                        line = b" ".join(words[at:to])
                        unit = xxhash.xxh3_64_intdigest(line) - (1 << 63)
                        rows.append((unit, unit if x["single"] else x["anchor"], x["anchor"], x["hash"], at - s, x["places"], line))
            got = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(got, kinds, strict=True)], names)

    return asked.select("z", "want").mapInArrow(run, "unit bigint, shard bigint, anchor bigint, hash bigint, offset int, places bigint, words binary")


def repeated_intervals(docs: DataFrame, window: int, stage: Staging) -> DataFrame:
    """``k, tag, spans``: word intervals (from, to) of each text in which every window also starts elsewhere.

    ``docs`` has ``k, tag, t``. Smallest hashes are counted over the corpus and only those that occur twice, be it in
    one stretch, are followed; equal stretches are one row with a count; the texts move once, compressed, to hand out
    the words of one stretch of each kind.
    """
    each = stage.put(_all_stretches(docs, window), "each")
    twice = stage.put(each.groupBy("anchor").agg(F.sum("c").alias("c")).where("c > 1").select("anchor"), "twice")
    found = stage.put(each.drop("c").join(twice, "anchor"), "found")
    stage.drop("each", "twice")
    kinds = found.groupBy("anchor", "hash", "n").agg(F.count("*").alias("places"), F.min(F.struct("k", "tag", "start")).alias("at"))
    kinds = stage.put(kinds, "kinds")
    alike = stage.put(kinds.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > ALIKE).select("anchor", F.lit(True).alias("single")), "alike")
    want = kinds.join(alike, "anchor", "left").select(
        "at.k", "at.tag", F.struct("at.start", "n", "anchor", "hash", "places", F.coalesce("single", F.lit(False)).alias("single")).alias("w")
    )
    want = want.groupBy("k", "tag").agg(F.collect_list("w").alias("want")).alias("w")
    asked = _packed(docs).dropDuplicates(["k", "tag"]).alias("d").join(want, _same("d", "w"))
    units = stage.put(_contents(asked, window), "units")
    distinct = units.groupBy("unit", "shard").agg(F.sum("places").alias("places"), F.first("words").alias("words"))
    shards = max(64, -(-kinds.count() // SHARD))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        m = Matches([w.split(b" ") for w in pdf["words"]], pdf["places"].tolist(), window)
        seq, lo, hi = m.intervals()
        return pd.DataFrame({"unit": pdf["unit"].to_numpy()[seq], "shard": pdf["shard"].to_numpy()[seq], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    dealt = distinct.withColumn("deal", F.pmod(F.xxhash64("shard"), F.lit(shards)))
    hits = stage.put(dealt.groupBy("deal").applyInPandas(match, "unit bigint, shard bigint, lo int, hi int"), "hits")
    spans = units.select("unit", "shard", "anchor", "hash", "offset").join(hits, ["unit", "shard"])
    spans = spans.select("anchor", "hash", (F.col("lo") + F.col("offset")).alias("lo"), (F.col("hi") + F.col("offset")).alias("hi"))
    spans = stage.put(spans.groupBy("anchor", "hash").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    placed = found.join(spans, ["anchor", "hash"]).select("k", "tag", F.transform("spans", lambda x: F.struct((x["lo"] + F.col("start")).alias("lo"), (x["hi"] + F.col("start")).alias("hi"))).alias("spans"))
    return placed.groupBy("k", "tag").agg(F.flatten(F.collect_set("spans")).alias("spans"))  # a set: rows that repeat have the same spans


def _without(text: str | None, spans: list[dict] | None) -> tuple[int, int, str, str | None]:
    """Words, words removed, SHA-256 of the kept words, and the text with the intervals' words cut out."""
    words = _split(text)
    if not spans:
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), text
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["lo"]] += 1
        gone[s["hi"]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    raw, at, lines = text.encode("utf-8", "surrogatepass"), 0, []
    for i, w in enumerate(words):
        s = raw.index(w, at)
        at = s + len(w)
        if not gone[i]:
            if i and not gone[i - 1]:
                lines[-1][1] = at
            else:
                lines.append([s, at])
    new = b"\n".join(raw[s:e] for s, e in lines).decode("utf-8", "surrogatepass")
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), new


def dedup_substrings(docs: DataFrame, window: int = 35, text: str = "text", key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """``key, tag, n_words, n_removed, kept_sha256`` (and ``kept_text``) for each row of ``docs``.

    Words are cut at ASCII white space and compared unchanged. A word goes if a window of ``window`` words that
    covers it also starts anywhere else in the corpus, the same text included. ``kept_text`` has the kept
    runs of words with the white space inside them, joined by line feeds; without removals it is the text itself.
    Null and empty texts have no words; rows that repeat key and text are places of their own; an empty table
    gives an empty result; a very long text is cut into stretches by one task and dealt; other columns aren't read, whatever their
    names. ``tag`` is a 64-bit hash of the text that tells rows of one key apart.
    """
    if window < GRAM:
        raise ValueError(f"a window must hold at least {GRAM} words")
    bounded_batches(docs.sparkSession)
    stage = Staging(docs.sparkSession, "substrings")
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("tag"), F.col(text).alias("t"))
    spans = repeated_intervals(rows, window, stage)
    joined = _packed(rows).alias("d").join(spans.alias("s"), _same("d", "s"), "left").select("d.k", "d.tag", "d.z", "s.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            got = [_without(None if z.as_py() is None else d.decompress(z.as_py()).decode("utf-8", "surrogatepass"), s.as_py()) for z, s in zip(b.column("z"), b.column("spans"), strict=True)]
            n, r, sha, t = zip(*got, strict=True) if got else [()] * 4
            cols = [b.column("k"), b.column("tag"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(t, pa.string())] if with_text else [])], ["k", "tag", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    schema = f"k {rows.schema['k'].dataType.simpleString()}, tag bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(run, schema).withColumnRenamed("k", key)


def op3_query(spark, sf_dir: str) -> DataFrame:
    """All documents without the words of 35-word windows that occur more than once."""
    got = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return got.select("doc_id", "n_words", "n_removed", "kept_sha256")
