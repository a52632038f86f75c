"""Exact top-k inner products: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.plans.staging import Staging

#: Queries in a block that goes to all tasks, rows that seed the thresholds, and the blocks of a product.
QUERY_BLOCK, HEAD, ROWS, COLUMNS = 8192, 2048, 1024, 2048
#: Share of the vectors' energy that the first rotated components hold.
ENERGY = 0.7


def whole_numbers(vector: str | Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component; null if the vector or a component is null or not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Rotation:
    """Orthogonal axes of all vectors by singular values, largest first, and how many make the partial sums."""

    def __init__(self, gram: np.ndarray):
        values, axes = np.linalg.eigh(gram)
        self.axes = axes[:, ::-1]
        held = np.cumsum(np.maximum(values[::-1], 0))
        self.first = int(np.searchsorted(held, ENERGY * held[-1]) + 1) if held[-1] > 0 else 1
        self.first = min(max(self.first, min(8, len(gram))), len(gram))

    def split(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first components and the length of the rest."""
        turned = vectors @ self.axes
        return np.ascontiguousarray(turned[:, : self.first]), np.linalg.norm(turned[:, self.first :], axis=1)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers, shorter ones filled up with zeros."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    lengths = np.diff(column.offsets.to_numpy())
    if n and (lengths == size).all():
        return flat.reshape(n, size)
    out = np.zeros((n, size), np.int64)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def gram_matrix(rows: DataFrame, size: int) -> np.ndarray:
    """Sum over all rows of the outer product of ``v`` with itself: ``size`` squared numbers from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            x = _matrix(b.column("v"), size).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size, dtype=np.int32)), pa.array(total.ravel())], ["at", "s"])

    sums = rows.select("v").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(size * size)
    for r in sums:
        out[r.at] = r.s
    return out.reshape(size, size)


class _Best:
    """The k best scores of each query so far, ties to smaller ids, a null id after all others."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.q, self.s, self.i = (np.zeros(0, np.int64) for _ in range(3))
        self.none = np.zeros(0, bool)
        self.least = floor.astype(np.float64).copy()

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray, none: np.ndarray, times: np.ndarray) -> None:
        """Scores of candidates that stand for ``times`` rows each."""
        q, s, i, none = (np.concatenate([old, np.repeat(x, np.minimum(times, self.k))]) for old, x in ((self.q, q), (self.s, s), (self.i, i), (self.none, none)))
        order = np.lexsort((i, none, -s, q))
        q, s, i, none = q[order], s[order], i[order], none[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.s, self.i, self.none = q[keep], s[keep], i[keep], none[keep]
        full = rank == self.k - 1
        self.least[q[full]] = np.maximum(self.floor[q[full]], s[full])


class Vectors:
    """Distinct vectors with their ids: which ids are null, how many rows are equal, and a hash that with the id names the row."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, rows: np.ndarray, same: np.ndarray, hashes: np.ndarray):
        self.ids, self.none, self.rows, self.same, self.hashes = ids, none, rows, same, hashes

    @classmethod
    def of(cls, b: pa.RecordBatch, size: int) -> Vectors:
        ids = b.column("id")
        return cls(pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), _matrix(b.column("v"), size), b.column("n").to_numpy(), b.column("h").to_numpy())

    def part(self, at: slice) -> Vectors:
        return Vectors(self.ids[at], self.none[at], self.rows[at], self.same[at], self.hashes[at])


def search(asked: Vectors, batches: Iterator[Vectors], turn: Rotation, k: int, floor: np.ndarray) -> _Best:
    """The k best of the candidates in ``batches`` for each query, the query's own row left out.

    Candidates below ``floor`` are not wanted. A query is passed over for a block if the product of lengths
    can't reach its k-th score, a pair if its partial sum plus the product of the residual lengths can't; what
    is left is scored in integers.
    """
    best, queries = _Best(len(asked.ids), k, floor), asked.rows
    exact = queries.astype(np.float64)
    length, (part, rest) = np.linalg.norm(exact, axis=1), turn.split(exact)
    for got in batches:
        for at in range(0, len(got.ids), COLUMNS):
            c = got.part(slice(at, at + COLUMNS))
            whole = c.rows.astype(np.float64)
            c_part, c_rest = turn.split(whole)
            longest = np.sqrt((whole**2).sum(1)).max()
            live = np.flatnonzero(length * longest * (1 + 1e-9) + 1e-6 >= best.least)
            for lo in range(0, len(live), ROWS):
                q = live[lo : lo + ROWS]
                bound = part[q] @ c_part.T + rest[q][:, None] * c_rest
                slack = 1e-6 + 1e-9 * (length[q] * longest)
                a, b = np.nonzero(bound >= (best.least[q] - slack)[:, None])
                a = q[a]
                own = (asked.ids[a] == c.ids[b]) & (asked.none[a] == c.none[b]) & (asked.hashes[a] == c.hashes[b])
                times = c.same[b] - own
                a, b, times = a[times > 0], b[times > 0], times[times > 0]
                score = np.empty(len(a), np.int64)
                for x in range(0, len(a), 1 << 16):
                    score[x : x + (1 << 16)] = np.einsum("ij,ij->i", queries[a[x : x + (1 << 16)]], c.rows[b[x : x + (1 << 16)]])
                good = score >= best.least[a]
                best.add(a[good], score[good], c.ids[b[good]], c.none[b[good]], times[good])
    return best


def top_k(vectors: DataFrame, queries: Column, k: int = 10, vector: str = "embedding", key: str = "vec_id", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which ``queries`` holds, its ``k`` best other rows.

    The score is the inner product of the whole numbers ``floor(scale * x)``, exact as long as it fits
    64 bits; ties go to smaller ids, a null id after all others. Vectors null or holding null or non-finite
    components take no part; a shorter vector counts as filled up with zeros. Every row but the query's own is a
    candidate: rows of the same id, and rows that are equal, are rows of their own, as queries and as candidates.
    Fewer candidates than ``k`` give them all; an empty table gives no rows; other columns aren't read.

    All vectors are ranged by descending length over the tasks. Queries go to the tasks in blocks of about
    ``QUERY_BLOCK``, a size that doesn't grow with the data, each with thresholds from the ``HEAD`` longest rows. One
    block after the other is broadcast, searched, written and forgotten.
    """
    spark, stage = vectors.sparkSession, Staging(vectors.sparkSession, "topk")
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_numbers(vector, scale).alias("v"), queries.alias("asks")).where("v is not null")
    rows = rows.groupBy("id", "v").agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = rows.select("id", "v", "n", "asks", F.xxhash64("v").alias("h"), length.alias("n2"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage.put(rows.repartitionByRange(parts, F.col("n2").desc(), "id").sortWithinPartitions(F.col("n2").desc(), "id"), "rows")
    facts = rows.agg(F.max(F.size("v")).alias("size"), F.count_if(F.col("asks") > 0).alias("asks")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not facts["asks"]:
        return spark.createDataFrame([], schema)
    size, blocks = facts["size"] or 1, -(-facts["asks"] // QUERY_BLOCK)
    turn = Rotation(gram_matrix(rows, size))

    def here(some: DataFrame) -> tuple[Vectors, np.ndarray]:
        got = some.select("id", "v", "n", "h", "asks").toArrow().combine_chunks()
        got = pa.RecordBatch.from_arrays([c.combine_chunks() for c in got.columns], got.schema.names)
        return Vectors.of(got, size), got.column("asks").to_numpy()

    head, _ = here(rows.orderBy(F.col("n2").desc(), "id", "h").limit(HEAD))
    order, found = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()), []
    for block in range(blocks):
        mine, asks = here(rows.where("asks > 0").where(F.pmod(F.xxhash64("id", "h"), F.lit(blocks)) == block))
        if not len(asks):
            continue
        none = np.full(len(asks), np.iinfo(np.int64).min)
        first = search(mine, iter([head]), turn, k, none)
        shared = spark.sparkContext.broadcast((mine, asks, np.where(np.isfinite(first.least), first.least, none).astype(np.int64), turn))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine, asks, floor, turn = shared.value
            best = search(mine, (Vectors.of(b, size) for b in batches), turn, k, floor)
            ids = pa.array(mine.ids[best.q], mask=mine.none[best.q])
            yield pa.RecordBatch.from_arrays([pa.array(best.q), ids, pa.array(best.i, mask=best.none), pa.array(best.s), pa.array(asks[best.q])], ["q", "query_id", "vec_id", "score", "asks"])

        near = rows.select("id", "v", "n", "h").mapInArrow(run, "q bigint, query_id bigint, vec_id bigint, score bigint, asks bigint")
        best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        kind = stage.put(best.select("query_id", "rank", "vec_id", "score", "asks"), f"block{block}").schema
        found.append(f"{stage.root}/block{block}")
        shared.destroy()
    every = spark.read.schema(kind).parquet(*found)
    return every.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), "asks"))).drop("col")


def op10_query(spark, sf_dir: str) -> DataFrame:
    """The ten best other rows for each row of ``embeddings`` whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""
