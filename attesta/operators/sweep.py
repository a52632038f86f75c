"""Intervals by a sweep over their ends: how many overlap, and how deep, without making their pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.ordered import running_sums
from attesta.plans.staging import Staging


def _points(rows: DataFrame, group: list[str], start: str, end: str, times: str) -> DataFrame:
    """``group, at, starts, ends`` with ``starts_before`` and ``ends_before``: one row for each place where an interval starts or ends."""
    ends = F.explode(F.array(F.struct(F.col(start).alias("at"), F.col(times).alias("starts"), F.lit(0).cast("long").alias("ends")), F.struct(F.col(end).alias("at"), F.lit(0).cast("long").alias("starts"), F.col(times).alias("ends"))))
    at = rows.select(*group, ends.alias("e")).select(*group, "e.*").groupBy(*group, "at").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    return running_sums(at, group, [F.col("at")], {"starts_before": "starts", "ends_before": "ends"})


def _distinct(rows: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    return rows.where(F.col(start) < F.col(end)).groupBy(*group, F.col(start).alias("s"), F.col(end).alias("e")).agg(F.count("*").alias("times"))


def overlap_counts(rows: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """``group, s, e, times, others``: each distinct half-open interval, how often it is there, and how many others overlap one of it.

    Those that start before its end, less those that ended by its start, are the ones that overlap it, itself among them;
    both are running counts over the places in order. So n intervals over one place cost n, not n squared. Empty and
    reversed intervals, and those with a null, overlap nothing and aren't listed.
    """
    stage = Staging(rows.sparkSession, "sweep")
    own = stage.put(_distinct(rows, group, start, end), "distinct")
    points = stage.put(_points(own, group, "s", "e", "times"), "points")
    begun = points.select(*group, F.col("at").alias("e"), F.col("starts_before").alias("begun"))
    over = points.select(*group, F.col("at").alias("s"), (F.col("ends_before") + F.col("ends")).alias("over"))
    met = own.join(begun, [*group, "e"]).join(over, [*group, "s"])
    return met.select(*group, "s", "e", "times", (F.col("begun") - F.col("over") - 1).alias("others"))


def overlapping_pairs(rows: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """``group, pairs``: how many pairs of each group's intervals overlap; see ``joins.overlaps`` for the pairs themselves."""
    return overlap_counts(rows, group, start, end).groupBy(*group).agg((F.sum(F.col("times").cast("decimal(38,0)") * F.col("others")) / 2).cast("decimal(38,0)").alias("pairs"))


def depth_profile(rows: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """``group, at, depth``: the places where the number of open intervals changes, and how many are open from there on."""
    points = _points(_distinct(rows, group, start, end), group, "s", "e", "times")
    return points.where("starts <> ends").select(*group, "at", (F.col("starts_before") + F.col("starts") - F.col("ends_before") - F.col("ends")).alias("depth"))


def deepest(rows: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """``group, depth, at``: the most intervals that are open at one place, and the first such place."""
    most = F.max(F.struct("depth", (-F.col("at")).alias("before"))).alias("m")
    return depth_profile(rows, group, start, end).groupBy(*group).agg(most).select(*group, "m.depth", (-F.col("m.before")).alias("at"))
