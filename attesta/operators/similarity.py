"""Set and vector similarity: shared-member joins, blocked top-k, an applicability domain."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.operators.metrics import lower_quantile
from attesta.plans.staging import Staging

QUERY_BLOCK = 4096
#: Scores that a task holds at once.
SCORES = 1 << 21


def tanimoto_pairs(rows: DataFrame, id_column: str, members: str, least: float = 0.0) -> DataFrame:
    """``a, b, tanimoto`` of every pair of sets that share a member and are alike by ``least`` or more, a < b.

    Members are ordered by how many sets have them, rarest first; two sets that are alike enough share one of the first
    ``n - ceil(least * n) + 1`` of each, so frequent members pair nothing once ``least`` is above 0. A pair counts at the
    first member it shares, its sizes and then its shared members are conditions of the join. ``least`` of 0 asks for all
    pairs with a common member, whose number grows with the square of a member's sets.
    """
    sets = rows.select(F.col(id_column).alias("i"), F.array_distinct(members).alias("s")).where(F.size("s") > 0)
    often = sets.select(F.explode("s").alias("m")).groupBy("m").agg(F.count("*").alias("often"))
    held = sets.select("i", F.explode("s").alias("m")).join(often, "m").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("often", "m"))).alias("r"))
    n = F.size("r")
    keep = F.when(F.lit(least) > 0, n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1).otherwise(n)
    ranked = held.select("i", n.alias("n"), F.transform("r", lambda x: x["m"]).alias("s"), keep.alias("keep"))
    posts = ranked.select("*", F.posexplode(F.slice("s", F.lit(1), F.col("keep"))).alias("at", "m"))
    a, b = posts.alias("a"), posts.alias("b")
    both = F.array_intersect("a.s", "b.s")
    shared = F.size(both)
    like = shared / (F.col("a.n") + F.col("b.n") - shared)
    on = (F.col("a.m") == F.col("b.m")) & (F.col("a.i") < F.col("b.i")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * (least - 1e-9)) & (F.get(both, F.lit(0)) == F.col("a.m")) & (like >= least - 1e-12)
    return a.join(b, on).select(F.col("a.i").alias("a"), F.col("b.i").alias("b"), like.alias("tanimoto"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of the k largest scores, ties to smaller ids; whoever ties with the k-th is looked at."""
    k = min(k, score.shape[1])
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    out = np.zeros((len(score), k), np.int64)
    for i, (row, limit) in enumerate(zip(score, least, strict=True)):
        some = np.flatnonzero(row >= limit)
        out[i] = some[np.lexsort((ids[some], -row[some]))[:k]]
    return out


def cosine_top_k(queries: DataFrame, references: DataFrame, k: int, id_column: str, vector: str, group: str | None = None) -> DataFrame:
    """``query_id, rank, ref_id, cosine`` of the ``k`` nearest references of each query; ties to smaller ids.

    References of the query's own id, or its own ``group`` if given, don't count. Queries are a stated set: they go out
    in blocks of about ``QUERY_BLOCK`` rows, one after the other; a block's result is written and its broadcast freed
    before the next one goes. Each task keeps k of its references for each query, and only those are merged.
    """
    spark, stage, g = queries.sparkSession, Staging(queries.sparkSession, "cosine"), F.col(group or id_column).cast("string")
    asked = queries.select(F.col(id_column).cast("long").alias("id"), g.alias("g"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    rows = references.select(F.col(id_column).cast("long").alias("id"), g.alias("g"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    blocks, found = max(1, -(-asked.count() // QUERY_BLOCK)), []
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "ref_id")
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        if not mine:
            continue
        shared = spark.sparkContext.broadcast((np.array([r.id for r in mine]), np.array([r.g for r in mine], object), _unit(np.array([r.v for r in mine], float))))

        def near(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, groups, q = shared.value
            step = max(1, SCORES // len(ids))
            for pdf in (b.iloc[at : at + step] for b in batches for at in range(0, len(b), step)):
                score = q @ _unit(np.array(pdf["v"].tolist(), float)).T
                score[groups[:, None] == pdf["g"].to_numpy(object)[None, :]] = -np.inf
                r = pdf["id"].to_numpy()
                top = _nearest(score, r, k)
                out = pd.DataFrame({"query_id": np.repeat(ids, top.shape[1]), "ref_id": r[top].ravel(), "cosine": np.take_along_axis(score, top, 1).ravel()})
                yield out[np.isfinite(out["cosine"])]

        got = rows.mapInPandas(near, "query_id bigint, ref_id bigint, cosine double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        found.append(stage.put(got.select("query_id", "rank", "ref_id", "cosine"), f"block{block}"))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, ref_id bigint, cosine double")
    return reduce(DataFrame.unionByName, found)


def knn_mean(near: DataFrame, k: int) -> DataFrame:
    """Mean of the ``k`` best of each query."""
    return near.where(F.col("rank") <= k).groupBy("query_id").agg(F.avg("cosine").alias("score"))


def domain_cutoff(references: DataFrame, k: int, id_column: str, vector: str, group: str, q: float, judged: Column | None = None) -> float | None:
    """The lower order statistic at ``q`` of the references' own scores, each judged without its group.

    ``judged`` states which references are judged; all of them, against all, is work in proportion to their square.
    """
    asked = references if judged is None else references.where(judged)
    scores = knn_mean(cosine_top_k(asked, references, k, id_column, vector, group), k)
    got = lower_quantile(scores, [], "score", q).first()
    return None if got is None else got["quantile"]


def in_domain(scores: DataFrame, queries: DataFrame, id_column: str, cutoff: float | None) -> DataFrame:
    """``id, score, in_domain``: null for a query without a score, or without a cutoff: it abstains."""
    verdict: Column = F.col("score") >= F.lit(cutoff)
    return queries.select(F.col(id_column).cast("long").alias("query_id")).join(scores, "query_id", "left").select(F.col("query_id").alias(id_column), "score", verdict.alias("in_domain"))
