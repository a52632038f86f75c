"""An append-only ledger: rows are written once, flags come later as rows of their own and are laid over when it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task of ``ledger_problems`` takes, about, and parts that a key with very many is summed up in.
PART, SALTS = 500_000, 16


def laid_over(rows: DataFrame, flags: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` as first written, one for each key, with the flags' ``columns`` laid over and ``revisions``, how many flags spoke.

    A flag row says something of the columns that aren't null in it; for each column the latest word by ``order`` wins, and
    a column that no flag speaks of keeps what the row has. ``order`` must be there in both and tell all writings of a key apart. Maxima by
    key are partial sums, so a key that was flagged a million times is one row before anything is joined.
    """
    rest = [c for c in rows.columns if c not in (key, *order)]
    at = F.struct(*order)
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), at).alias("r"))
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"__{c}") for c in columns]
    said = flags.groupBy(key).agg(*latest, F.count("*").alias("revisions"))
    own = lambda c: F.coalesce(F.col(f"__{c}"), F.col(f"r.{c}")) if c in rest else F.col(f"__{c}")
    out = first.join(said, key, "left")
    return out.select(key, *[(own(c) if c in columns else F.col(f"r.{c}")).alias(c) for c in dict.fromkeys([*rest, *columns])], F.coalesce("revisions", F.lit(0).cast("long")).alias("revisions"))


def ledger_problems(rows: DataFrame, flags: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, problem``: ``rewritten`` rows whose writings differ, ``flag_without_row``, and ``contradicted:column`` where flags disagree.

    Rows and flags are dealt by key before they are summed up, about ``PART`` to a task however many there are, so no task holds
    more keys as the ledger grows. What a key has more than once is first summed up in ``SALTS`` parts by its contents. Flags of a null key have no row.
    """
    rest = [c for c in rows.columns if c in columns or c not in flags.columns]
    hashed = F.xxhash64(*[c for c in rest if c != key])
    written = rows.select(key, hashed.alias("__h"), *[F.lit(None).cast(flags.schema[c].dataType).alias(c) for c in columns])
    both = written.unionByName(flags.select(key, F.lit(None).cast("long").alias("__h"), *columns))
    tasks = 1 + (rows.count() + flags.count()) // PART
    salted = both.withColumn("__s", F.pmod(F.xxhash64("__h", *columns), F.lit(SALTS))).repartition(tasks, key, "__s")
    ends = [f(c).alias(f"__{n}{i}") for i, c in enumerate(columns) for n, f in (("min", F.min), ("max", F.max))]
    parts = salted.groupBy(key, "__s").agg(F.min("__h").alias("__a"), F.max("__h").alias("__b"), F.bool_or(F.col("__h").isNull()).alias("__f"), *ends)
    differ = [F.when(F.min(f"__min{i}") < F.max(f"__max{i}"), F.lit(f"contradicted:{c}")) for i, c in enumerate(columns)]
    rewritten = F.when(F.min("__a") < F.max("__b"), F.lit("rewritten"))
    lone = F.when(F.bool_or("__f") & (F.max("__b").isNull() | F.max(F.col(key).isNull())), F.lit("flag_without_row"))
    found = parts.repartition(tasks, key).groupBy(key).agg(F.array_compact(F.array(rewritten, lone, *differ)).alias("__p"))
    return found.select(key, F.explode("__p").alias("problem"))
