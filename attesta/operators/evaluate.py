"""Evaluation of saved predictions: exact coverage, replay, baselines, leakage, rule bases and accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import range_bin
from attesta.operators import metrics
from attesta.operators.reconcile import membership_problems


def coverage_problems(expected: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, problem`` where predictions and expected rows are not one to one, or a prediction is no finite number."""
    p = predictions.groupBy(*keys).agg(F.count("*").alias("__n"), F.bool_or(F.col("prediction").isNull() | F.isnan("prediction") | (F.abs("prediction") == float("inf"))).alias("__odd"))
    both = expected.select(*keys, F.lit(True).alias("__e")).join(p, keys, "full_outer")
    problem = F.when(F.col("__e").isNull(), "unexpected").when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "repeated").when(F.col("__odd"), "not_finite")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def replay_problems(saved: DataFrame, replayed: DataFrame, key: str, relative: float = 1e-7, absolute: float = 1e-9) -> DataFrame:
    """Rows whose replayed prediction is not the saved one within tolerance."""
    j = saved.select(key, F.col("prediction").alias("a")).join(replayed.select(key, F.col("prediction").alias("b")), key, "full_outer")
    close = F.abs(F.col("a") - F.col("b")) <= absolute + relative * F.abs("b")
    return j.where(~F.coalesce(close, F.lit(False))).select(key, "a", "b")


def label_problems(rows: DataFrame, key: str) -> DataFrame:
    """``key, problem`` of labels that aren't 0 or 1, and of probabilities and thresholds outside 0 to 1."""
    unit = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) <= 1), F.lit(False))
    problem = F.when(~F.coalesce(F.col("y").isin(0, 1), F.lit(False)), "label").when(~unit("prediction"), "probability").when(~unit("threshold"), "threshold")
    return rows.select(key, problem.alias("problem")).where("problem is not null")


def fold_baseline(rows: DataFrame, fold: str, folds: int, y: str) -> DataFrame:
    """``fold, baseline``: mean target of all rows outside each fold, from each fold's sum and count."""
    sums = rows.groupBy(fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    every = sums.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    return sums.join(F.broadcast(every)).select(fold, F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")).alias("baseline"))


def evaluate(rows: DataFrame, predictions: DataFrame, row_id: str, fold: str, folds: int, y: str) -> DataFrame:
    """Metrics of each candidate and of the fold means as ``baseline``, over all out-of-fold rows."""
    base = fold_baseline(rows, fold, folds, y)
    truth = rows.select(row_id, fold, y)
    own = predictions.select("candidate_id", row_id, "prediction").join(truth, row_id)
    mean = truth.join(F.broadcast(base), fold).select(F.lit("baseline").alias("candidate_id"), row_id, F.col("baseline").alias("prediction"), fold, y)
    return metrics.regression(own.unionByName(mean), ["candidate_id"], y, "prediction")


def leaks(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """``key, value`` that training and test rows share, over any of several keys."""
    side = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")).select("x.*").where("value is not null").distinct()
    return side(train).join(side(test), ["key", "value"], "left_semi")


def fit_ranges(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each column in the training rows: two numbers a column."""
    r = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (r[f"lo_{c}"], r[f"hi_{c}"]) for c in columns}


def contributions(rows: DataFrame, key: str, ranges: dict[str, tuple[float, float]], bins: int, weights: dict[tuple[str, int], float], intercept: float) -> DataFrame:
    """``key, feature, bin, contribution``: each descriptor's bin and weight; they add up to the score."""
    cells = []
    for c, (lo, hi) in ranges.items():
        scaled, b = range_bin(c, F.lit(float(lo)), F.lit(float(hi)), bins)
        w = F.create_map(*[F.lit(x) for k in range(bins) for x in (k, float(weights.get((c, k), 0.0)))])
        cells.append(F.struct(F.lit(c).alias("feature"), b.alias("bin"), w[b].alias("contribution")))
    cells.append(F.struct(F.lit("intercept").alias("feature"), F.lit(None).cast("int").alias("bin"), F.lit(float(intercept)).alias("contribution")))
    return rows.select(key, F.inline(F.array(*cells)))


def fix_terms(rows: DataFrame, key: str, columns: list[str], fixes: DataFrame) -> DataFrame:
    """``key, field, term, fixed``: all replacements that a dictionary (``field, term, fixed``) has for each cell, sorted."""
    long = rows.unpivot(key, columns, "field", "term").where("term is not null")
    return long.join(fixes, ["field", "term"]).groupBy(key, "field", "term").agg(F.array_sort(F.collect_set("fixed")).alias("fixed"))


def accounting_problems(claimed: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, claimed, counted`` wherever a manifest's counts differ from the rows', absent ones counting as 0."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("counted"))
    both = claimed.select(*keys, F.col("n").cast("long").alias("claimed")).join(counted, keys, "full_outer")
    return both.na.fill(0, ["claimed", "counted"]).where("claimed <> counted")


def lineage_problems(ledgers: list[DataFrame], key: str, digest: str) -> DataFrame:
    """Keys whose digest is not the same in all ledgers that have it."""
    every = reduce(DataFrame.unionByName, [d.select(key, digest) for d in ledgers])
    return every.groupBy(key).agg(F.count_distinct(digest).alias("kinds")).where("kinds > 1")


def formula_references(formula: str | Column) -> Column:
    """``sheets, external, broken, indirect`` of a formula: the sheets of its own workbook that it names, sorted, and what else it leans on.

    Texts in double quotes count for nothing; then an odd number of single quotes opens a quoted name, in which two stand
    for one. The parts of a range over sheets count each; a name with a workbook in brackets is external. ``broken`` is a lost
    reference (``#REF!``), ``indirect`` a call whose target only shows when it is computed.
    """
    f = F.col(formula) if isinstance(formula, str) else formula
    bare = F.regexp_replace(f, r'"[^"]*"', '""')
    parts = F.split(F.replace(bare, F.lit("''"), F.lit("\0")), "'")
    quoted = F.transform(F.filter(parts, lambda x, i: (i % 2 == 1) & F.coalesce(F.get(parts, i + 1), F.lit("")).startswith("!")), lambda x: F.replace(x, F.lit("\0"), F.lit("'")))
    plain = F.filter(parts, lambda x, i: i % 2 == 0)
    outside = F.flatten(F.transform(plain, lambda x: F.regexp_extract_all(x, F.lit(r"(?:^|[^\w.:\]#])([A-Za-z_][\w.]*(?::[A-Za-z_][\w.]*)?)!"), 1)))
    names = F.flatten(F.transform(F.concat(F.filter(quoted, lambda x: ~F.contains(x, F.lit("["))), outside), lambda x: F.split(x, ":")))
    external = F.exists(quoted, lambda x: F.contains(x, F.lit("["))) | F.exists(plain, lambda x: x.rlike(r"\[[^\]]+\][^!]*!"))
    calls = F.regexp_extract_all(F.upper(bare), F.lit(r"([\w.]+)\s*\("), 1)
    indirect = F.exists(calls, lambda c: c.isin("INDIRECT", "_XLFN.INDIRECT"))
    return F.struct(F.array_sort(F.array_distinct(F.filter(names, lambda n: n != ""))).alias("sheets"), external.alias("external"), F.contains(F.upper(f), F.lit("#REF!")).alias("broken"), indirect.alias("indirect"))


def sheet_references(formula: str | Column) -> Column:
    """Distinct sheets of its own workbook that a formula names; see ``formula_references``."""
    return formula_references(formula)["sheets"]


def probability_problems(rows: DataFrame, key: str, classes: str, probabilities: str, positive: str | int, out: str = "probability") -> tuple[DataFrame, DataFrame]:
    """``key`` with the positive class's probability, found by its name and not by its place, and ``key, problem``.

    A row's classes and probabilities must be as many, each class once, the positive one among them, and sum to 1.
    """
    p = F.col(probabilities)
    at = F.array_position(classes, positive)
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    problem = (
        F.when(F.size(classes) != F.size(p), "lengths_differ").when(F.size(F.array_distinct(classes)) < F.size(classes), "class_repeated").when(F.coalesce(at, F.lit(0)) == 0, "positive_class_missing")
        .when(F.exists(p, lambda x: ~F.coalesce((x >= 0) & (x <= 1), F.lit(False))), "outside_unit").when(F.abs(total - 1) > 1e-6, "sum_is_not_one")
    )
    judged = rows.select(key, F.get(p, (at - 1).cast("int")).alias(out), problem.alias("problem"))
    return judged.where("problem is null").select(key, out), judged.where("problem is not null").select(key, "problem")


def study_problems(planned: DataFrame, ledger: DataFrame, keys: list[str], context: list[str]) -> DataFrame:
    """``keys, problem``: fits that were planned and not made, made and not planned, made twice, or made in another context."""
    made = ledger.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(F.struct(*context)).alias("__lo"), F.max(F.struct(*context)).alias("__hi"))
    j = planned.select(*keys, F.struct(*context).alias("__w")).join(made, keys, "full_outer")
    differ = (F.col("__lo") != F.col("__w")) | (F.col("__hi") != F.col("__w"))
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__w").isNull(), "unplanned").when(F.col("__n") > 1, "repeated").when(differ, "context_differs")
    return j.select(*keys, problem.alias("problem")).where("problem is not null")


def axis_problems(rows: DataFrame, axes: dict[str, DataFrame], key: str) -> DataFrame:
    """``axis, key, problem``: each axis (features, scores, partitions) must have every row once and no other."""
    found = [membership_problems(rows.select(key), a.select(key), key).select(F.lit(name).alias("axis"), key, "problem") for name, a in axes.items()]
    return reduce(DataFrame.unionByName, found)
