"""Ordered digests, snapshot deltas, upserts and exactly-once checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: JSON of the columns in the order of their names, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def ordered_digest(rows: DataFrame, keys: list[str], member: Column, order: list[str], block: int = 100_000) -> DataFrame:
    """``keys, digest, n``: one hash over each group's members in order.

    Members are dealt to buckets by a hash of their order columns; a bucket's hashes are joined in order, then the
    buckets' in theirs. A group has a bucket for each ``block`` rows, so that no task holds more than about as many hashes. The
    digest depends on the rows and ``block`` alone, not on how Spark deals them.
    """
    fan = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("__fan")).where("__fan > 1")  # at most a row for each ``block`` of them
    hashed = rows.select(*keys, F.struct(*order).alias("__o"), F.xxhash64(*order).alias("__x"), F.sha2(member, 256).alias("__h")).dropna(subset=keys)
    hashed = hashed.join(F.broadcast(fan), keys, "left").withColumn("__b", F.pmod("__x", F.coalesce("__fan", F.lit(1))))
    parts = hashed.groupBy(*keys, "__b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__h"))), lambda x: x["__h"]), "\n"), 256).alias("__p"), F.count("*").alias("__n"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "__p"))), lambda x: x["__p"]), "\n"), 256)
    return parts.groupBy(*keys).agg(whole.alias("digest"), F.sum("__n").alias("n"))


def rolling_digest(rows: DataFrame, keys: list[str], member: Column, order: Column, head: str = "", between: str = "\n", tail: str = "\n") -> DataFrame:
    """``keys, digest, n``: SHA-256 of ``head``, a group's members in order with ``between`` between them, and ``tail``, as one stream.

    Such a hash is made of one member after the other, so a group's rows pass through one task, sorted; the task holds
    the hash's state, not the rows. For groups without bound ``ordered_digest`` is the one that spreads.
    """
    n = len(keys)
    dealt = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], order.alias("o"), member.alias("m"))
    names = [f"k{i}" for i in range(n)]
    dealt = dealt.repartition(*names).sortWithinPartitions(*names, "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, count, out = None, None, 0, []
        for b in batches:
            for *key, m in zip(*[b.column(c).to_pylist() for c in (*names, "m")], strict=True):
                if state is None or key != at:
                    if state is not None:
                        state.update(tail.encode())
                        out.append((*at, state.hexdigest(), count))
                    at, state, count = key, hashlib.sha256(head.encode()), 0
                state.update(((between if count else "") + (m or "")).encode())
                count += 1
        if state is not None:
            state.update(tail.encode())
            out.append((*at, state.hexdigest(), count))
        columns = list(zip(*out, strict=True)) if out else [()] * (n + 2)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    kinds = StructType([*[dealt.schema[c] for c in names], StructField("digest", StringType()), StructField("n", LongType())])
    arrow = to_arrow_schema(kinds)
    return dealt.select(*names, "m").mapInArrow(run, kinds).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "digest", "n")


def snapshot_delta(old: DataFrame, new: DataFrame, key: str, roles: dict[str, str]) -> DataFrame:
    """``(key, change, role, old, new)``: added and removed rows, and each changed cell by the role of its column.

    Cells are compared as exact strings, null and empty apart; columns without a role have role ``other``.
    Columns that only one side has are not compared; see ``changed_columns``.
    """
    common = [c for c in old.columns if c in new.columns and c != key]
    pack = lambda df, name: df.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in common]).alias(name))
    both = pack(old, "__old").join(pack(new, "__new"), key, "full_outer")
    lone = F.array(F.struct(F.when(F.col("__old").isNull(), "added").otherwise("removed").alias("change"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    cells = F.array(*[F.struct(F.lit("changed").alias("change"), F.lit(roles.get(c, "other")).alias("role"), F.col(f"__old.{c}").alias("old"), F.col(f"__new.{c}").alias("new")) for c in common])
    lines = both.select(key, F.inline(F.when(F.col("__old").isNull() | F.col("__new").isNull(), lone).otherwise(cells)))
    return lines.where((F.col("change") != "changed") | ~F.col("old").eqNullSafe(F.col("new")))


def changed_columns(old: DataFrame, new: DataFrame) -> tuple[list[str], list[str]]:
    """Columns that were added and removed."""
    return sorted(set(new.columns) - set(old.columns)), sorted(set(old.columns) - set(new.columns))


def union_reasons(rows: DataFrame, keys: list[str], reasons: str = "reasons") -> DataFrame:
    """All distinct reasons of each key, sorted; exploded first, so that the aggregate starts before the shuffle."""
    one = rows.select(*keys, F.explode_outer(reasons).alias("__r"))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_set("__r")).alias(reasons))


def upsert(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The first non-null value of each column by ``order``, and how many rows there were."""
    first = [F.min(F.when(F.col(v).isNotNull(), F.struct(order, v)))[v].alias(v) for v in values]
    return rows.groupBy(*keys).agg(*first, F.count("*").alias("times"))


def membership_problems(universe: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """``(key, problem)`` for keys that are in no part, in more than one, or outside the universe."""
    counts = universe.select(key, F.lit(1).alias("__u"), F.lit(0).alias("__p")).unionByName(parts.select(key, F.lit(0).alias("__u"), F.lit(1).alias("__p")))
    counts = counts.groupBy(key).agg(F.sum("__u").alias("__u"), F.sum("__p").alias("__p"))
    problem = F.when(F.col("__u") == 0, "outside").when(F.col("__p") == 0, "missing").when(F.col("__p") > 1, "repeated").when(F.col("__u") > 1, "universe_repeated")
    return counts.select(key, problem.alias("problem")).where("problem is not null")


def fail_on(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Raises with the first few violations if there are any: the closed-world default."""
    if found := violations.limit(shown).collect():
        raise ValueError(f"{what}: {[r.asDict(recursive=True) for r in found]}")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first by ``order``: what an insert that ignores known keys leaves. ``order`` must be total."""
    rest = [c for c in rows.columns if c not in keys]
    ahead = [*order, *[c for c in rest if c not in order]]
    return rows.groupBy(*keys).agg(F.min(F.struct(*ahead)).alias("__f")).select(*keys, *[F.col(f"__f.{c}").alias(c) for c in rest])


def stacked(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of the same columns, one below the other, with ``origin``."""
    return reduce(DataFrame.unionByName, [p.withColumn("origin", F.lit(name)) for name, p in parts.items()])


def canonical_order(rows: DataFrame, keys: list[str], columns: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, within ``keys`` by the JSON of ``columns``, names in order."""
    spelled = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(spelled)))


def with_match(rows: DataFrame, other: DataFrame, on: list[str], name: str = "known") -> DataFrame:
    """``rows`` with whether ``other`` has any row of their key."""
    return rows.join(other.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").na.fill(False, [name])
