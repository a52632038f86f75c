"""Running sums over a total order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.plans.staging import Staging


def running_sums(rows: DataFrame, keys: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """``rows`` with, for each ``name: column`` of ``sums``, the sum of the column over the rows before it.

    Rows are ranged over partitions by keys and order; windows run inside a partition, and each partition's
    totals (one row a key and partition) give what came before it. ``order`` must be total within a key.
    """
    stage = Staging(rows.sparkSession, "running")
    ordered = rows.repartitionByRange(*[F.col(k) for k in keys], *order)
    parts = stage.put(ordered.withColumn("__running_part", F.spark_partition_id()), "parts")
    local = Window.partitionBy("__running_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__running_part").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("__running_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__running_part", *keys).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    totals = totals.select("__running_part", *keys, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    out = parts.withColumns({f"__l_{n}": F.coalesce(F.sum(c).over(local), F.lit(0)) for n, c in sums.items()}).join(totals, ["__running_part", *keys])
    return out.select(*rows.columns, *[(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])
