"""Groups of maximal repeats of bytes, by interval trees over enhanced suffix arrays of content-defined shards.

A string of ``least`` bytes is dealt by the leftmost smallest hash among its grams, so that equal strings meet whatever
stands around them. Strings that follow one another and have the same gram at the same place are one stretch; it holds no
two equal strings, and a repeat inside it is inside one stretch wherever it stands. Stretches whose gram is unique in the
corpus go nowhere. Equal ones are one row with a number of places. Each shard sorts the suffixes of its stretches and
scans their common prefixes with a stack; an interval whose suffixes differ in the byte before them is a maximal repeat,
and all suffixes in it are its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.plans.staging import Staging

#: Stretches of one gram above which they are cut further, and stretches in a shard, about.
ALIKE, SHARD = 500, 2000
#: Rounds in which the stretches of a gram with more are cut further, and the orders of grams that each takes.
ROUNDS, ORDERS = 12, 4
#: Strings of a text that are looked at together.
PIECE = 1 << 20
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, 1 + ROUNDS * ORDERS, np.uint64)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _gram(least: int) -> int:
    """Bytes of a gram: 64 where they fit, so that chance and common phrases seldom make two stretches alike."""
    return max(1, min(64, 1 << max(0, (least // 4).bit_length() - 1)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _string_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each string of ``width`` bytes, put together from those of powers of two."""
    parts, power, size, n = _BYTES[data], 0x9E3779B97F4A7C15, 1, len(data) - width + 1
    got, have = np.zeros(n, np.uint64), 0
    while True:
        if width & size:
            got = got * np.uint64(power) + parts[have : have + n]
            have += size
        if 2 * size > width:
            return _mix(got)
        parts = parts[:-size] * np.uint64(power) + parts[size:]
        power, size = power * power % (1 << 64), size * 2


def stretches(data: bytes, least: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first string, strings, anchor)`` of runs of consecutive strings of ``least`` bytes with one anchor gram.

    The anchor of a string is the leftmost of its grams of the smallest hash; a run ends where that gram does. A long
    text is read in pieces of ``PIECE`` strings, each from the start of the last run of the one before.
    """
    whole, gram, begin, got = np.frombuffer(data, np.uint8), _gram(least), 0, []
    wide = least - gram + 1
    while len(data) - begin >= least:
        piece = whole[begin : begin + max(PIECE, 2 * wide) + least - 1]
        n = len(piece) - least + 1
        grams = _mix(_string_hashes(piece, gram) ^ _SEEDS[seed])
        low, span = grams, 1
        while 2 * span <= wide:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        if span < wide:
            low = np.minimum(low[:n], low[wide - span :])
        starts = np.concatenate([[0], np.flatnonzero((low[1:] != low[:-1]) | (grams[: n - 1] == low[:-1])) + 1])
        sizes = np.diff(np.append(starts, n))
        last = begin + len(piece) == len(data)
        if not last:
            starts, sizes, n = starts[:-1], sizes[:-1], int(starts[-1])
        got.append((starts + begin, sizes, low[starts].view(np.int64)))
        begin = len(data) if last else begin + n
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (none, none, none)


class Suffixes:
    """The suffixes of at least ``least`` bytes of some distinct byte strings, sorted, with common prefixes and left bytes.

    Ranks of prefixes of 8, 24, 72, ... bytes are made by sorting triples of the ranks before; what is beyond a string's
    end counts as zeros, and of suffixes equal but for that the shorter one comes first.
    """

    def __init__(self, strings: list[bytes], least: int):
        sizes = np.array([len(s) for s in strings], np.int64)
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        first = np.cumsum(sizes + 1) - sizes - 1
        unit = np.repeat(np.arange(len(strings)), sizes + 1)
        end = (first + sizes)[unit]
        at = np.arange(len(data))
        key = data.astype(np.uint64)
        for t in (1, 2, 4):
            key = (key << np.uint64(8 * t)) | key[np.minimum(at + t, end)]
        ranks, width, longest = [(8, self._ranked(key))], 8, int(sizes.max())
        while 4 * width < longest:
            r = ranks[-1][1].astype(np.int64)
            many = int(r.max()) + 1
            if many < 1 << 21:
                ranks.append((3 * width, self._ranked((r * many + r[np.minimum(at + width, end)]) * many + r[np.minimum(at + 2 * width, end)])))
            else:
                ranks.append((2 * width, self._ranked(r * many + r[np.minimum(at + width, end)])))
            width = ranks[-1][0]
        rest = end - at
        sa = np.flatnonzero(rest >= least)
        r = ranks[-1][1].astype(np.int64)
        many, stop = int(r.max()) + 1, end[sa]
        four = [r[np.minimum(sa + k * width, stop)] for k in range(4)]
        sa = sa[np.lexsort((rest[sa], four[2] * many + four[3], four[0] * many + four[1]))]
        i, j = sa[:-1], sa[1:]
        same, ends = np.zeros(len(i), np.int64), (end[i], end[j])
        for width, r in reversed(ranks):
            for _ in range(4 if r is ranks[-1][1] else 2):
                same += width * (r[np.minimum(i + same, ends[0])] == r[np.minimum(j + same, ends[1])])
        x = key[np.minimum(i + same, ends[0])] ^ key[np.minimum(j + same, ends[1])]
        same += sum((x >> np.uint64(56 - 8 * t) == 0).astype(np.int64) for t in range(8)) * (x != 0)
        self.unit, self.offset = unit[sa], sa - first[unit[sa]]
        none = np.zeros(min(1, len(sa)), np.int64)
        self.common = np.concatenate([none, np.minimum(same, np.minimum(rest[i], rest[j]))])
        left = np.where(self.offset > 0, data[sa - 1].astype(np.int64), -1)
        self.differs = np.concatenate([none > 0, (left[1:] != left[:-1]) | (left[1:] < 0)])

    @staticmethod
    def _ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        return rank

    def groups(self, least: int) -> list[tuple[int, int, int]]:
        """``(length, first, last)`` of the left-diverse intervals of common prefixes of ``least`` bytes or more, inner ones first."""
        fresh = self.common < least
        block = np.cumsum(fresh) - 1
        diverse = np.bincount(block, self.differs & ~fresh) > 0 if len(block) else np.zeros(0, bool)
        at = np.flatnonzero(diverse[block])
        common, seen = np.where(fresh[at], 0, self.common[at]).tolist(), np.cumsum(self.differs[at]).tolist()
        where, out, stack = at.tolist(), [], [(0, 0)]
        for i in range(1, len(where) + 1):
            h, left = common[i] if i < len(where) else 0, i - 1
            while stack[-1][0] > h:
                length, left = stack.pop()
                if seen[i - 1] > seen[left]:
                    out.append((length, where[left], where[i - 1]))
            if stack[-1][0] < h:
                stack.append((h, left))
        return out


def covered(strings: list[bytes], places: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(string, from, to)``: the parts of distinct strings that maximal repeats cover, those that touch as one."""
    s = Suffixes(strings, least)
    far = np.zeros(len(s.unit), np.int64)
    for length, first, last in reversed(s.groups(least)):
        far[first : last + 1] = length
    hit = np.flatnonzero(far)
    twice = np.flatnonzero(np.array(places) > 1)
    unit = np.concatenate([s.unit[hit], twice])
    lo = np.concatenate([s.offset[hit], np.zeros(len(twice), np.int64)])
    hi = np.concatenate([s.offset[hit] + far[hit], np.array([len(strings[u]) for u in twice], np.int64)])
    if not len(unit):
        return unit, lo, hi
    order = np.lexsort((lo, unit))
    unit, lo, hi = unit[order], lo[order], hi[order]
    big = int(hi.max()) + 1
    reach = np.maximum.accumulate(unit * big + hi) - unit * big
    first = np.concatenate([[True], (unit[1:] != unit[:-1]) | (lo[1:] > reach[:-1])])
    last = np.append(first[1:], True)
    return unit[first], lo[first], reach[last]


def _occurrences(strings: list[bytes], places: list[int], least: int) -> pd.DataFrame:
    """``u, lo, hi, group``: all occurrences of all maximal repeats; ``group`` is a hash of the repeat."""
    s, parts = Suffixes(strings, least), []
    for length, first, last in s.groups(least):
        u, lo = s.unit[first : last + 1], s.offset[first : last + 1]
        group = xxhash.xxh3_64_intdigest(strings[u[0]][lo[0] : lo[0] + length]) - (1 << 63)
        parts.append(pd.DataFrame({"u": u, "lo": lo, "hi": lo + length, "group": np.int64(group)}))
    twice = [i for i, p in enumerate(places) if p > 1]
    parts.append(pd.DataFrame({"u": twice, "lo": 0, "hi": [len(strings[i]) for i in twice], "group": np.array([xxhash.xxh3_64_intdigest(strings[i]) - (1 << 63) for i in twice], np.int64)}))
    return pd.concat(parts).drop_duplicates()


def _batch(columns: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)


def _all_stretches(rows: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            at, parts = [], ([], [], [], [])
            for i, t in enumerate(b.column("t")):
                data = t.as_py() or b""
                s, n, a = stretches(data, least)
                at.append(np.full(len(s), i))
                h = np.array([digest(data[x:y]) for x, y in zip(s.tolist(), (s + n + least - 1).tolist(), strict=True)], np.uint64)
                for p, x in zip(parts, (s, n, a, h.view(np.int64)), strict=True):
                    p.append(x)
            s, n, a, h = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
            at = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
            yield _batch([b.column("k").take(at), b.column("tag").take(at), s, n, a, h], ["k", "tag", "start", "n", "anchor", "hash"], [None, None, pa.int32(), pa.int32(), pa.int64(), pa.int64()])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, tag bigint, start int, n int, anchor bigint, hash bigint")


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield _batch([b.column("k"), b.column("tag"), [z.compress(x.as_py()) if x.is_valid else None for x in b.column("t")]], ["k", "tag", "z"], [None, None, pa.binary()])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, tag bigint, z binary")


def _same(a: str, b: str):
    """Rows of one text: equal keys, null included, and equal hashes of the text."""
    return F.col(f"{a}.k").eqNullSafe(F.col(f"{b}.k")) & (F.col(f"{a}.tag") == F.col(f"{b}.tag"))


_UNIT = "unit bigint, deal bigint, anchor bigint, hash bigint, off int, places bigint, bytes binary"
_UNIT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
_GIVEN = ("deal", "anchor", "hash", "off", "places", "bytes")
#: Units in a batch.
TOGETHER = 4000


def _units(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of ``deal, anchor, hash, offset, places, bytes[, many]`` with a hash of the bytes before them."""
    held: list[tuple] = []
    names, kinds = ["unit", "deal", "anchor", "hash", "off", "places", "bytes", "many"], [*_UNIT_KINDS, pa.bool_()]
    batch = lambda: _batch(list(zip(*held, strict=True)), names[: len(held[0])], kinds[: len(held[0])])
    for r in rows:
        held.append((xxhash.xxh3_64_intdigest(r[5]) - (1 << 63), *r))
        if len(held) == TOGETHER:
            yield batch()
            held = []
    if held:
        yield batch()


def _parts(asked: DataFrame, least: int) -> DataFrame:
    """The stretches that stand for all equal ones as units, from texts with what is wanted of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            for z, want in zip(b.column("z"), b.column("want"), strict=True):
                data = d.decompress(z.as_py())
                for x in want.as_py():
                    yield x["anchor"], x["anchor"], x["hash"], 0, x["places"], data[x["start"] : x["start"] + x["n"] + least - 1], x["many"]

    return asked.select("z", "want").mapInArrow(lambda batches: _units(cut(batches)), _UNIT + ", many boolean")


def _joint(data: bytes, least: int, seeds: range) -> Iterator[tuple[int, int, int]]:
    """``(first string, strings, hash of the anchors)`` of the runs that have one anchor in each of several orders."""
    by = [stretches(data, least, seed) for seed in seeds]
    starts = np.unique(np.concatenate([s for s, _, _ in by]))
    key = np.zeros(len(starts), np.uint64)
    for s, _, a in by:
        key = _mix(key + a[np.searchsorted(s, starts, "right") - 1].view(np.uint64))
    sizes = np.diff(np.append(starts, len(data) - least + 1))
    return zip(starts.tolist(), sizes.tolist(), key.view(np.int64).tolist(), strict=True)


def _split_further(units: DataFrame, least: int, stage: Staging) -> DataFrame:
    """Units that ``ALIKE`` others at most are dealt with, from those of hot grams.

    Each round cuts what is left by the smallest grams of ``ORDERS`` more orders, so that equal strings meet again and
    variants of one passage part: what holds a variant's own bytes soon has a gram of its own and goes, what doesn't is
    equal and one. After ``ROUNDS``, single strings are dealt by their hash.
    """
    done = []
    for k in range(ROUNDS):

        def cut(batches: Iterator[pa.RecordBatch], seeds: range = range(1 + k * ORDERS, 1 + (k + 1) * ORDERS)) -> Iterator[pa.RecordBatch]:
            rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in _GIVEN), strict=True))
            yield from _units((deal ^ key, anchor, h, off + s, p, x[s : s + n + least - 1]) for deal, anchor, h, off, p, x in rows for s, n, key in _joint(x, least, seeds))

        pieces = stage.put(units.mapInArrow(cut, _UNIT), f"pieces{k}")
        kinds = pieces.groupBy("deal", "unit").agg(F.sum("places").alias("places"))
        deals = stage.put(kinds.groupBy("deal").agg(F.sum("places").alias("c"), F.count("*").alias("u")).where("c > 1"), f"deals{k}")
        done.append(pieces.join(deals.where(F.col("u") <= ALIKE).select("deal"), "deal", "left_semi"))
        units = pieces.join(deals.where(F.col("u") > ALIKE).select("deal"), "deal", "left_semi")
        if deals.where(F.col("u") > ALIKE).isEmpty():
            break
    else:

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in _GIVEN), strict=True))
            strings = ((anchor, h, off + i, p, x[i : i + least]) for _, anchor, h, off, p, x in rows for i in range(len(x) - least + 1))
            yield from _units((xxhash.xxh3_64_intdigest(r[-1], 1) - (1 << 63), *r) for r in strings)

        done.append(units.mapInArrow(single, _UNIT))
    return reduce(DataFrame.unionByName, done)


def _matched(docs: DataFrame, least: int, text: str, key: str, stage: Staging, each_group: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows ``k, tag, t``, their stretches that may repeat, and ``anchor, hash, lo, hi[, group]`` of what repeats in those."""
    if least < 4:
        raise ValueError("a repeat must hold at least 4 bytes")
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("tag"), F.col(text).cast("binary").alias("t"))
    each = stage.put(_all_stretches(rows, least), "each")
    twice = stage.put(each.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "twice")
    found = stage.put(each.join(twice, "anchor"), "found")
    stage.drop("each", "twice")
    kinds = stage.put(found.groupBy("anchor", "hash", "n").agg(F.count("*").alias("places"), F.min(F.struct("k", "tag", "start")).alias("at")), "kinds")
    many = stage.put(kinds.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > ALIKE).select("anchor", F.lit(True).alias("many")), "many")
    want = kinds.join(many, "anchor", "left").select("at.k", "at.tag", F.struct("at.start", "n", "anchor", "hash", "places", F.coalesce("many", F.lit(False)).alias("many")).alias("w"))
    want = want.groupBy("k", "tag").agg(F.collect_list("w").alias("want")).alias("w")
    asked = _packed(rows).dropDuplicates(["k", "tag"]).alias("d").join(want, _same("d", "w"))
    parts = stage.put(_parts(asked, least), "parts")

    few, hot = parts.where("not many").drop("many"), parts.where("many").drop("many")
    units = stage.put(few if many.isEmpty() else few.unionByName(_split_further(hot, least, stage)), "units")
    distinct = units.groupBy("unit", "deal").agg(F.sum("places").alias("places"), F.first("bytes").alias("bytes"))
    shards = max(64, -(-kinds.count() // SHARD))
    names = "unit bigint, deal bigint, lo int, hi int" + ", group bigint" * each_group

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        strings, places = pdf["bytes"].tolist(), pdf["places"].tolist()
        if each_group:
            got = _occurrences(strings, places, least)
            u, rest = got["u"].to_numpy(np.int64), {"lo": got["lo"].to_numpy(np.int32), "hi": got["hi"].to_numpy(np.int32), "group": got["group"].to_numpy()}
        else:
            u, lo, hi = covered(strings, places, least)
            rest = {"lo": lo.astype(np.int32), "hi": hi.astype(np.int32)}
        return pd.DataFrame({"unit": pdf["unit"].to_numpy()[u], "deal": pdf["deal"].to_numpy()[u], **rest})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)))
    hits = stage.put(dealt.groupBy("shard").applyInPandas(match, names), "hits")
    placed = units.select("unit", "deal", "anchor", "hash", "off").join(hits, ["unit", "deal"])
    return rows, found, placed.select("anchor", "hash", (F.col("lo") + F.col("off")).alias("lo"), (F.col("hi") + F.col("off")).alias("hi"), *["group"] * each_group)


def repeat_groups(docs: DataFrame, least: int = 400, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``group, length, key, tag, start``: all occurrences, in bytes, of the maximal repeats of at least ``least`` bytes.

    A repeat is judged inside stretches, so one longer than about two ``least`` is given in parts that overlap; each part
    is whole wherever it stands. ``group`` is a hash of its bytes. Nulls and the like: see ``remove_repeats``.
    """
    stage = Staging(docs.sparkSession, "repeat-groups")
    _, found, hits = _matched(docs, least, text, key, stage, True)
    got = found.join(hits, ["anchor", "hash"]).select("group", (F.col("hi") - F.col("lo")).alias("length"), "k", "tag", (F.col("start") + F.col("lo")).alias("start"))
    spread = got.groupBy(*got.columns).agg(F.lit(1).alias("one")).drop("one")  # one place may be found over several stretches
    return spread.withColumnRenamed("k", key)


def _without(data: bytes | None, spans: list[dict] | None) -> tuple[int, int, int, bytes]:
    """Bytes, bytes removed, maximal removed runs, and what is left."""
    data = data or b""
    if not spans:
        return len(data), 0, 0, data
    kept, end, runs = [], 0, 0
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if lo > end or not runs:
            kept.append(data[end:lo])
            runs += 1
        end = max(end, hi)
    kept.append(data[end:])
    left = b"".join(kept)
    return len(data), len(data) - len(left), runs, left


def remove_repeats(docs: DataFrame, least: int = 400, text: str = "text", key: str = "doc_id", with_kept: bool = True) -> DataFrame:
    """``key, tag, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``) for each row of ``docs``.

    A byte of a text's UTF-8 goes if a string of ``least`` bytes that covers it also starts anywhere else, the same text
    included, judged on the input. ``kept`` is binary: a cut may split a character. Null and empty texts have no bytes;
    rows that repeat key and text are places of their own; null keys are keys; a very long text is cut into stretches by
    one task and dealt; other columns aren't read, whatever their names; an empty table gives an empty result. ``tag`` is a
    64-bit hash of the text that tells rows of one key apart.
    """
    stage = Staging(docs.sparkSession, "repeats")
    rows, found, hits = _matched(docs, least, text, key, stage, False)
    spans = stage.put(hits.groupBy("anchor", "hash").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    placed = found.join(spans, ["anchor", "hash"]).select("k", "tag", F.transform("spans", lambda x: F.struct((x["lo"] + F.col("start")).alias("lo"), (x["hi"] + F.col("start")).alias("hi"))).alias("spans"))
    placed = placed.groupBy("k", "tag").agg(F.flatten(F.collect_set("spans")).alias("spans"))  # a set: rows that repeat have the same spans
    joined = _packed(rows).alias("d").join(placed.alias("s"), _same("d", "s"), "left").select("d.k", "d.tag", "d.z", "s.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            got = []
            for z, s in zip(b.column("z"), b.column("spans"), strict=True):
                *numbers, left = _without(d.decompress(z.as_py()) if z.is_valid else None, s.as_py())
                got.append((*numbers, hashlib.sha256(left).hexdigest(), *[left] * with_kept))
            cols = [b.column("k"), b.column("tag"), *(zip(*got, strict=True) if got else [()] * (4 + with_kept))]
            yield _batch(cols, ["k", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept], [None, None, pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_kept])

    schema = f"k {rows.schema['k'].dataType.simpleString()}, tag bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept
    return joined.mapInArrow(run, schema).withColumnRenamed("k", key)


def op13_query(spark, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that occur more than once."""
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
