"""Packing documents into fixed-length sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm import byte_bpe
from attesta.plans.staging import Staging, bounded_batches

SEPARATOR = 0
#: Pieces of one length that are ranked together, about.
BUCKET = 20_000


def pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, piece, start, length, ids_crc32``: each document's ids and a closing 0, cut only if over ``capacity``.

    The first piece takes what is over after full pieces, so at most one piece of a document isn't full.
    A null or empty text is the closing 0 alone. A very long text is encoded whole by the task that holds it; repeated rows
    give their pieces again; null keys are keys; other columns aren't read; an empty table gives no pieces.
    """
    path = path or byte_bpe.default_path()
    end = np.array([SEPARATOR], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(path)
        for b in batches:
            rows: list[tuple] = []
            for i, t in enumerate(b.column("t")):
                ids = bpe.ids(t.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(i, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            at, k, s, n, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            keys = b.column("k").take(pa.array(at))
            yield pa.RecordBatch.from_arrays([keys, pa.array(k, pa.int32()), pa.array(s), pa.array(n), pa.array(crc)], ["k", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return got.withColumnRenamed("k", key)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``capacity``, as length -> how many.

    The largest length left is always in. Bit s of a Python integer says whether the lengths seen so far
    can sum to s; a length that is there c times is added as 1, 2, 4, ... copies. Longer ones come first and
    are taken first, and it ends as soon as the bin can be filled.
    """
    lengths = sorted((x for x, c in counts.items() if c), reverse=True)
    room = capacity - lengths[0]
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for x in lengths:
        left = min(counts[x] - (x == lengths[0]), room // x)
        copies = 1
        while left > 0:
            k = min(copies, left)
            steps.append((x, k, reach))
            reach |= reach << x * k & mask
            left, copies = left - k, copies * 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {lengths[0]: 1}
    for x, k, before in reversed(steps):
        if not before >> total & 1:
            taken[x] = taken.get(x, 0) + k
            total -= x * k
    return taken


def plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[int, dict[int, int]]]:
    """``(repeats, combination)``: each fullest combination is used until one of its lengths has too few left.

    So the steps number about as many as the distinct lengths, however many pieces there are.
    """
    left, steps = {x: c for x, c in counts.items() if c}, []
    while left:
        take = fullest(left, capacity)
        repeats = min(left[x] // k for x, k in take.items())
        steps.append((repeats, take))
        for x, k in take.items():
            left[x] -= k * repeats
            if not left[x]:
                del left[x]
    return steps


def _places(steps: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length the runs of its pieces, by rank: first rank, first sequence, pieces a sequence, offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for repeats, take in steps:
        offset = 0
        for x, k in sorted(take.items(), reverse=True):
            runs.setdefault(x, []).append((used.get(x, 0), sequence, k, offset))
            used[x] = used.get(x, 0) + k * repeats
            offset += x * k
        sequence += repeats
    return {x: np.array(r, np.int64) for x, r in runs.items()}


def pack(cut: DataFrame, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """``cut`` (``key, piece, start, length, ids_crc32``) with ``sequence_id`` and ``offset`` for each piece.

    Only the histogram of lengths, at most ``capacity`` numbers, comes to the driver, and as many go to the tasks. A
    piece's place follows from its rank among those of its length: each length has hash buckets in proportion to its
    pieces, a count for each of them gives the bucket's first rank, and the rest is ranked within the bucket, so a frequent
    length is spread over many tasks. Null keys are keys; repeated rows are pieces of their own; other columns of ``cut`` are
    dropped; an empty table gives an empty result.
    """
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = pa.table({"length": pa.array(list(counts), pa.int64()), "__m": pa.array([-(-n // BUCKET) for n in counts.values()], pa.int64())})
    buckets = cut.sparkSession.createDataFrame(buckets, "length bigint, __m bigint")  # from Arrow: a list would start Python workers of another kind
    salted = cut.select(key, "piece", "start", "length", "ids_crc32").join(F.broadcast(buckets), "length")
    salted = salted.withColumn("__b", F.pmod(F.xxhash64(key, "piece", "start", "ids_crc32"), F.col("__m"))).drop("__m")
    sizes = salted.groupBy("length", "__b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    places = cut.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity)))
    within = Window.partitionBy("length", "__b").orderBy(key, "piece", "start", "ids_crc32")
    ranked = salted.withColumn("__r", F.row_number().over(within) - 1).join(first, ["length", "__b"])

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"sequence_id": np.zeros(len(length), np.int64), "offset": np.zeros(len(length), np.int64)})
        for x, at in pd.Series(np.arange(len(length))).groupby(length.to_numpy()):
            runs, r = places.value[x], rank.to_numpy()[at]
            run = runs[np.searchsorted(runs[:, 0], r, side="right") - 1]
            k = r - run[:, 0]
            out.iloc[at, 0] = run[:, 1] + k // run[:, 2]
            out.iloc[at, 1] = run[:, 3] + k % run[:, 2] * x
        return out

    return ranked.withColumn("__p", place("length", F.col("__first") + F.col("__r"))).select(key, "piece", "start", "length", "ids_crc32", "__p.sequence_id", "__p.offset")


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Cuts and packs all ``docs``; the cut table is written once, so that ids are made once."""
    return pack(Staging(docs.sparkSession, "packing").put(pieces(docs, capacity, path, text, key), "pieces"), capacity, key)


def op5_query(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
