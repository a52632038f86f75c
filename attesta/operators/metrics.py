"""Regression and classification metrics with reasons where undefined; slices, bootstrap, thresholds, quantiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.ordered import running_sums
from attesta.plans.staging import Staging


def regression(rows: DataFrame, keys: list[str], y: str, p: str, weight: str | None = None) -> DataFrame:
    """``n, mae, rmse, sse, sst, r2, r2_undefined_reason, target_mean, target_population_sd`` of each group.

    One pass of partial sums; the centred sum of squares comes from the variance, which Spark merges stably.
    With ``weight`` each row counts that often; the squares are then taken around the groups' means, by a pass before.
    """
    w = F.col(weight) if weight else F.lit(1)
    res = F.col(y) - F.col(p)
    if weight:
        rows = rows.withColumn("__all", F.lit(0))
        means = rows.groupBy("__all", *keys).agg((F.sum(w * F.col(y)) / F.sum(w)).alias("__mean")).alias("m")
        same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in ["__all", *keys]])
        rows = rows.alias("r").join(means, same).select("r.*", "m.__mean")
        mean, sst = F.first("__mean"), F.sum(w * (F.col(y) - F.col("__mean")) ** 2)
    else:
        mean, sst = F.avg(y), F.var_pop(y) * F.count("*")
    out = rows.groupBy(*keys).agg(F.sum(w).cast("long").alias("n"), (F.sum(w * F.abs(res)) / F.sum(w)).alias("mae"), F.sum(w * res * res).alias("sse"), sst.alias("sst"), mean.alias("target_mean"), (F.min(F.when(w > 0, F.col(y))) < F.max(F.when(w > 0, F.col(y)))).alias("__d"))
    defined = F.coalesce(F.col("__d"), F.lit(False)) & (F.col("n") > 1)
    return out.select(
        *keys, "n", "mae", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "sse", "sst", F.when(defined, 1 - F.try_divide("sse", "sst")).alias("r2"),
        F.when(~defined, "constant_target_or_single_row").alias("r2_undefined_reason"), "target_mean", F.sqrt(F.col("sst") / F.col("n")).alias("target_population_sd"),
    )


def confusion(rows: DataFrame, keys: list[str], y: str, p: str, threshold: str | Column) -> DataFrame:
    """Counts, sensitivity, specificity, balanced accuracy, accuracy and mcc, each with its reason if undefined."""
    t = F.col(threshold) if isinstance(threshold, str) else threshold
    hit, pos = F.col(p) >= t, F.col(y) == 1
    c = rows.groupBy(*keys).agg(F.count_if(hit & pos).alias("tp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    single = (F.col("tp") + F.col("fn") == 0) | (F.col("tn") + F.col("fp") == 0)
    return c.select(
        *keys, (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n"), "tp", "tn", "fp", "fn",
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        sens.alias("sensitivity"), F.when(F.col("tp") + F.col("fn") == 0, "no_positive_targets").alias("sensitivity_undefined_reason"),
        spec.alias("specificity"), F.when(F.col("tn") + F.col("fp") == 0, "no_negative_targets").alias("specificity_undefined_reason"),
        ((sens + spec) / 2).alias("balanced_accuracy"), F.when(single, "single_class_target").alias("balanced_accuracy_undefined_reason"),
        F.try_divide(tp * tn - fp * fn, F.sqrt(product)).alias("mcc"),
        F.when(product == 0, F.when(single, "single_class_target").otherwise("single_class_prediction")).alias("mcc_undefined_reason"),
    )


def ranking(rows: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """``roc_auc`` and ``average_precision`` of each group; null and a reason if it has one class only.

    Rows are summed by score first; ties count half in the area, and a precision step is taken at each score.
    """
    by = rows.groupBy(*keys, F.col(p).cast("double").alias("__s")).agg(F.count_if(F.col(y) == 1).cast("double").alias("__p"), F.count_if(F.col(y) != 1).cast("double").alias("__n"))
    run = running_sums(by, keys, [F.col("__s").desc()], {"__bp": "__p", "__bn": "__n"})
    precision = (F.col("__bp") + F.col("__p")) / (F.col("__bp") + F.col("__p") + F.col("__bn") + F.col("__n"))
    out = run.groupBy(*keys).agg(F.sum("__p").alias("P"), F.sum("__n").alias("N"), F.sum(F.col("__n") * (F.col("__bp") + F.col("__p") / 2)).alias("a"), F.sum(F.col("__p") * precision).alias("b"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return out.select(*keys, F.when(both, F.try_divide("a", F.col("P") * F.col("N"))).alias("roc_auc"), F.when(both, F.try_divide("b", "P")).alias("average_precision"), F.when(~both, "single_class_target").alias("ranking_undefined_reason"))


def slices(rows: DataFrame, levels: list[list[str]], measures: list[Column]) -> DataFrame:
    """Measures over several groupings in one pass: a row's ``level`` names its columns, others are null."""
    every = list(dict.fromkeys(c for level in levels for c in level))
    held = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in every])
    got = rows.groupingSets([[F.col(c) for c in level] for level in levels], *every).agg(*measures, held.alias("level"))
    return got.select("level", *every, *[c for c in got.columns if c not in (*every, "level")])


def draws(groups: list[str], repetitions: int, seed: int) -> list[tuple[int, str, int]]:
    """``(repetition, group, times)`` of a bootstrap over groups, by NumPy's generator on the sorted groups."""
    names, rng, out = sorted(groups), np.random.default_rng(seed), []
    for k in range(repetitions):
        got, times = np.unique(rng.choice(len(names), size=len(names), replace=True), return_counts=True)
        out += [(k, names[i], int(t)) for i, t in zip(got, times, strict=True)]
    return out


def draw_multiplicities(groups: DataFrame, group: str, repetitions: int, seed: int, block: int = 4096) -> DataFrame:
    """``rep, group, times``: bootstraps over groups, drawn in tasks: how often each group is in each repetition, if it is.

    The groups are numbered in hash order and put in blocks. A repetition's draws are split over the blocks by halves, with
    binomial counts from generators that are keyed by the seed, the repetition and the node of that tree, so each task finds its
    block's count without any other; inside a block the draws are multinomial. The driver sees one number, the count of groups.
    """
    stage = Staging(groups.sparkSession, "draws")
    names = groups.select(group).distinct().withColumns({"__h": F.sha2(F.concat(F.lit(f"{seed},"), F.col(group).cast("string")), 256), "__one": F.lit(1).cast("long")})
    ranked = stage.put(running_sums(names, [], [F.col("__h"), F.col(group)], {"rank": "__one"}).select(group, "rank"), "ranked")
    total = ranked.count()
    blocks = max(1, -(-total // block))
    size = lambda lo, hi: min(hi * block, total) - lo * block

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k in pdf["id"].tolist():
                rep, own = divmod(k, blocks)
                lo, hi, n = 0, blocks, total
                while hi - lo > 1 and n:
                    mid = (lo + hi) // 2
                    left = int(np.random.default_rng([seed, rep, lo, hi]).binomial(n, size(lo, mid) / size(lo, hi)))
                    lo, hi, n = (lo, mid, left) if own < mid else (mid, hi, n - left)
                if not n:
                    continue
                many = size(own, own + 1)
                times = np.random.default_rng([seed, rep, own, own + 1]).multinomial(n, np.full(many, 1 / many))
                at = np.flatnonzero(times)
                yield pd.DataFrame({"rep": np.full(len(at), rep), "rank": own * block + at, "times": times[at]})

    drawn = groups.sparkSession.range(repetitions * blocks if total else 0).mapInPandas(run, "rep bigint, rank bigint, times bigint")
    return drawn.join(ranked, "rank").select("rep", group, "times")


def group_statistics(rows: DataFrame, group: str, y: str, p: str) -> DataFrame:
    """What a regression metric needs of each group, so that a repetition only sums groups; targets are taken around their mean."""
    r = F.col(y) - F.col(p)
    centre = rows.agg(F.avg(y)).first()[0]
    rows, y = rows.withColumn("__y", F.col(y) - F.lit(centre)), "__y"
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.abs(r)).alias("sae"), F.sum(r * r).alias("sse"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"))


def bootstrap_intervals(rows: DataFrame, group: str, y: str, p: str, multiplicities: DataFrame) -> DataFrame:
    """``metric, lower, upper, valid`` over repetitions given as ``(rep, group, times)``: 2.5 and 97.5 percentiles."""
    stats = group_statistics(rows, group, y, p).join(multiplicities, group)
    s = lambda c: F.sum(F.col("times") * F.col(c))
    reps = stats.groupBy("rep").agg(s("n").alias("n"), s("sae").alias("sae"), s("sse").alias("sse"), s("sy").alias("sy"), s("syy").alias("syy"))
    sst = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    reps = reps.select(F.try_divide("sae", "n").alias("mae"), F.sqrt(F.try_divide("sse", "n")).alias("rmse"), F.when(sst > 1e-12, 1 - F.try_divide(F.col("sse"), sst)).alias("r2"))
    long = reps.unpivot([], ["mae", "rmse", "r2"], "metric", "value")
    return long.groupBy("metric").agg(F.percentile("value", F.lit(0.025)).alias("lower"), F.percentile("value", F.lit(0.975)).alias("upper"), F.count("value").alias("valid"))


def threshold_sweep(rows: DataFrame, y: str, p: str, thresholds: list[float], metric: str = "mcc", min_sensitivity: float = 0.0, min_specificity: float = 0.0, max_gap: float = 1.0) -> DataFrame:
    """``threshold, score, selection_eligible`` on a grid, and ``best``: the first best of those eligible (of all, if none is).

    Every row is put once into the grid by how many thresholds it reaches; the sweep then works on the grid.
    """
    grid = sorted(thresholds)
    reach = reduce(lambda a, b: a + b, [(F.col(p) >= t).cast("int") for t in grid])
    cells = rows.groupBy(reach.alias("r"), (F.col(y) == 1).alias("pos")).agg(F.count("*").alias("k"))
    table = cells.select("r", "pos", "k", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(grid)])).alias("t"))
    hit = F.col("r") >= F.col("t.i")
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0)).cast("double")
    c = table.groupBy(F.col("t.threshold").alias("threshold")).agg(s(hit & F.col("pos")).alias("tp"), s(~hit & ~F.col("pos")).alias("tn"), s(hit & ~F.col("pos")).alias("fp"), s(~hit & F.col("pos")).alias("fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    scores = {"mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0)), "balanced_accuracy": (sens + spec) / 2, "accuracy": (tp + tn) / (tp + tn + fp + fn)}
    ok = F.coalesce((sens >= min_sensitivity) & (spec >= min_specificity) & (F.abs(sens - spec) <= max_gap), F.lit(False))
    scored = c.select("threshold", scores[metric].alias("score"), ok.alias("selection_eligible"))
    top = scored.agg(F.max(F.struct("selection_eligible", "score", (-F.col("threshold")).alias("t"))).alias("b"))
    return scored.join(F.broadcast(top)).select("threshold", "score", "selection_eligible", (F.col("threshold") == -F.col("b.t")).alias("best"))


def lower_quantile(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The order statistic at ``floor((n - 1) q)`` of each group, found by running counts over distinct values."""
    by = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    run = running_sums(by, keys, [F.col(value)], {"__b": "__c"})
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__n"))
    at = F.floor((F.col("__n") - 1) * F.lit(q))
    joined = run.join(n, keys) if keys else run.join(F.broadcast(n))
    return joined.where((F.col("__b") <= at) & (at < F.col("__b") + F.col("__c"))).select(*keys, F.col(value).alias("quantile"))


def pooled_scores(rows: DataFrame, trial: str, fold: str, y: str, p: str) -> DataFrame:
    """Root mean square error of each trial over all folds' residuals, and of each fold."""
    r2 = (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    folds = rows.groupBy(trial, fold).agg(F.sum(r2).alias("sse"), F.count("*").alias("n"))
    whole = folds.groupBy(trial).agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("score"))
    return whole.select(trial, F.lit(None).cast("long").alias(fold), "score").unionByName(folds.select(trial, F.col(fold).cast("long").alias(fold), F.sqrt(F.col("sse") / F.col("n")).alias("score")))


def best_candidate(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The smallest of each group by the given columns."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("b")).select(*keys, "b.*")


def coverage(expected: DataFrame, ledger: DataFrame, keys: list[str], status: str = "status", config: str = "config") -> DataFrame:
    """Attempted, complete, failed, pending and distinct configurations of each expected cell, zeros included."""
    got = ledger.groupBy(*keys).agg(F.count("*").alias("attempted"), F.count_if(F.col(status) == "complete").alias("complete"), F.count_if(F.col(status) == "failed").alias("failed"), F.count_distinct(config).alias("configs"))
    out = expected.join(got, keys, "left").na.fill(0, ["attempted", "complete", "failed", "configs"])
    return out.withColumn("pending", F.greatest(F.col("expected") - F.col("complete") - F.col("failed"), F.lit(0)))


def may_stop(cells: DataFrame) -> DataFrame:
    """One row: whether every expected cell is complete and none failed."""
    return cells.agg(F.coalesce(F.bool_and((F.col("failed") == 0) & (F.col("complete") == F.col("expected"))), F.lit(False)).alias("stop"))


def counts_by(rows: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """``keys, n`` for each expected group, zeros included; groups that aren't expected are counted too."""
    return expected.select(*keys).distinct().join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys, "full_outer").na.fill(0, ["n"])


def tally(rows: DataFrame, keys: list[str], conditions: dict[str, Column], distinct: dict[str, str] | None = None) -> DataFrame:
    """``n`` and how many rows of each group meet each condition (0 if none), and distinct values of some columns, in one pass."""
    counts = [F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()]]
    return rows.groupBy(*keys).agg(*counts, *[F.count_distinct(c).alias(name) for name, c in (distinct or {}).items()])
