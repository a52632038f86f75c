"""Group-safe splits: connected groups, hash order, a terminal holdout and nested folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.components import connected_components
from attesta.operators.ordered import running_sums
from attesta.operators.reconcile import rolling_digest
from attesta.plans.staging import Staging


class InfeasibleSplit(ValueError):
    """Too few groups for the folds asked for."""


def hash_key(seed: int, scope: str, group: str | Column) -> Column:
    """SHA-256 of the JSON list ``[seed, scope, group]``, which orders groups without regard to input order."""
    g = F.col(group) if isinstance(group, str) else group
    escaped = F.to_json(F.array(g.cast("string")))
    return F.sha2(F.concat(F.lit(f'[{seed},"{scope}",'), F.substring(escaped, F.lit(2), F.length(escaped) - 1)), 256)


def connected_groups(rows: DataFrame, policy: str, row_id: str, declared: str, key: str) -> DataFrame:
    """``row_id, effective_group_id``: declared groups joined wherever they share a key.

    Under policy ``declared`` groups stay as they are. Otherwise a component of the graph of groups and keys is
    named by the hash of its sorted keys, so the name depends on neither row order nor the component's root.
    """
    if policy == "declared":
        return rows.select(row_id, F.col(declared).alias("effective_group_id"))
    stage = Staging(rows.sparkSession, "groups")
    pairs = stage.put(rows.select(F.concat(F.lit("g:"), declared).alias("g"), F.concat(F.lit("k:"), key).alias("k"), F.col(key).alias("raw")).distinct(), "pairs")
    roots = stage.put(connected_components(pairs, "g", "k"), "roots")
    of_group = pairs.join(roots.withColumnRenamed("node", "g"), "g")
    spelled = F.to_json(F.array("raw"))
    quoted = F.substring(spelled, F.lit(2), F.length(spelled) - 2)
    names = rolling_digest(of_group.select("root", "raw").distinct(), ["root"], quoted, F.col("raw"), "[", ",", "]").select("root", F.concat(F.lit(policy + ":"), "digest").alias("effective_group_id"))
    named = of_group.select("g", "root").distinct().join(stage.put(names, "names"), "root").select("g", "effective_group_id")
    return rows.select(row_id, F.concat(F.lit("g:"), declared).alias("g")).join(named, "g").select(row_id, "effective_group_id")


def ranked_groups(rows: DataFrame, keys: list[str], group: str, seed: int, scope: str) -> DataFrame:
    """``keys, group, position, groups``: each distinct group's place, from 0, in hash order."""
    groups = rows.select(*keys, group).distinct().withColumn("__h", hash_key(seed, scope, group)).withColumn("__one", F.lit(1))
    ranked = running_sums(groups, keys, [F.col("__h"), F.col(group)], {"position": "__one"})
    n = groups.groupBy(*keys).agg(F.count("*").alias("groups"))
    joined = ranked.join(n, keys) if keys else ranked.join(F.broadcast(n))
    return joined.select(*keys, group, "position", "groups")


def terminal_holdout(rows: DataFrame, group: str, seed: int, fraction: float, scope: str = "terminal") -> DataFrame:
    """``rows`` with ``partition``: the first ``ceil(groups * fraction)`` groups in hash order are ``terminal``."""
    ranked = ranked_groups(rows, [], group, seed, scope)
    part = F.when(F.col("position") < F.ceil(F.col("groups") * F.lit(float(fraction)) - 1e-12), "terminal").otherwise("development")
    return rows.join(ranked.select(group, part.alias("partition")), group)


def fold_of(rows: DataFrame, group: str, count: int, seed: int, scope: str) -> DataFrame:
    """``group, fold``: groups in hash order dealt round robin. Too few groups fail."""
    ranked = ranked_groups(rows, [], group, seed, scope)
    n = ranked.agg(F.max("groups").alias("n")).first()["n"] or 0
    if n < count:
        raise InfeasibleSplit(f"{scope}: {n} groups for {count} folds")
    return ranked.select(group, (F.col("position") % count).cast("int").alias("fold"))


def nested_folds(rows: DataFrame, group: str, outer: int, inner: int, seed: int, task: str) -> DataFrame:
    """``group, outer_fold, inner_of, inner_fold``: outer folds, and inner folds of what each leaves for training."""
    first = Staging(rows.sparkSession, "folds").put(fold_of(rows, group, outer, seed, f"{task}/outer"), "outer")
    out = first.select(group, F.col("fold").alias("outer_fold"), F.lit(None).cast("int").alias("inner_of"), F.lit(None).cast("int").alias("inner_fold"))
    for k in range(outer):
        train = first.where(F.col("fold") != k)
        own = fold_of(train, group, inner, seed, f"{task}/inner/{k}").join(first.withColumnRenamed("fold", "outer_fold"), group)
        out = out.unionByName(own.select(group, "outer_fold", F.lit(k).alias("inner_of"), F.col("fold").alias("inner_fold")))
    return out


def prepare_splits(rows: DataFrame, row_id: str, group: str, task: str, tasks: list[str], seed: int, fraction: float, outer: int, inner: int) -> DataFrame:
    """``row_id, task, partition, outer_fold, inner_of, inner_fold``: a terminal holdout over all rows, folds of each task's rest.

    A task without development or terminal rows, or with too few groups, fails.
    """
    held = Staging(rows.sparkSession, "splits").put(terminal_holdout(rows.select(row_id, group, task), group, seed, fraction), "held")
    counts = {(r[0], r[1]): r[2] for r in held.groupBy(task, "partition").agg(F.count("*")).collect()}
    none = F.lit(None).cast("int")
    out = held.where("partition = 'terminal'").select(row_id, task, "partition", none.alias("outer_fold"), none.alias("inner_of"), none.alias("inner_fold"))
    for t in tasks:
        if not counts.get((t, "terminal")) or not counts.get((t, "development")):
            raise InfeasibleSplit(f"{t}: no development or terminal rows")
        own = held.where((F.col(task) == t) & (F.col("partition") == "development"))
        folds = nested_folds(own, group, outer, inner, seed, t)
        out = out.unionByName(own.join(folds, group).select(row_id, task, "partition", "outer_fold", "inner_of", "inner_fold"))
    return out


def stratified_folds(histogram: list[tuple[str, int, int]], count: int, seed: int) -> dict[str, int]:
    """Folds for ``(group, negatives, positives)``, large and uneven groups first, each to the fold it balances best.

    For group tables small enough for the driver, and the measure of ``stratified_fold_of``; ties go by hash order, so the
    result doesn't depend on input order.
    """
    import hashlib

    for label, have in (("0", sum(n > 0 for _, n, _ in histogram)), ("1", sum(p > 0 for _, _, p in histogram))):
        if have < count:
            raise InfeasibleSplit(f"class {label} is in {have} groups for {count} folds")
    order = sorted(histogram, key=lambda g: (-abs(g[1] - g[2]), -(g[1] + g[2]), g[1], hashlib.sha256(f"{seed},{g[0]}".encode()).hexdigest()))
    load, out = [[0, 0] for _ in range(count)], {}
    total = [sum(g[1] for g in histogram) or 1, sum(g[2] for g in histogram) or 1]
    for name, neg, pos in order:
        spread = lambda k: sum((max(x) - min(x)) / t for x, t in zip(zip(*[[a + (neg if i == k else 0), b + (pos if i == k else 0)] for i, (a, b) in enumerate(load)], strict=True), total, strict=True))  # noqa: B023, E731
        k = min(range(count), key=lambda k: (round(spread(k), 12), sum(load[k]), k))
        load[k][0] += neg
        load[k][1] += pos
        out[name] = k
    return out


def terminal_size(groups: int, fraction: float) -> int:
    """How many groups a holdout of ``fraction`` takes."""
    return math.ceil(groups * fraction)


def _dealt(classes: list[tuple[int, int, int]], count: int) -> list[tuple[int, int, list[int], list[int]]]:
    """``(negatives, positives, first, cycle)`` for classes of groups given as ``(negatives, positives, how many)``.

    The groups of a class go one after another to the fold that they balance best, as ``stratified_folds`` deals them: the
    first to the folds in ``first``, all after these round and round through ``cycle``. Once each fold has had one in turn, the
    folds stand to each other as before, so all rounds are alike and needn't be played out.
    """
    load = [[0, 0] for _ in range(count)]
    total = [sum(n * c for n, _, c in classes) or 1, sum(p * c for _, p, c in classes) or 1]
    out = []
    for neg, pos, many in sorted(classes, key=lambda g: (-abs(g[0] - g[1]), -(g[0] + g[1]), g[0])):
        first: list[int] = []
        cycle: list[int] = []
        while len(first) < many and not cycle:

            def spread(k: int) -> tuple:
                tried = [[a + neg * (i == k), b + pos * (i == k)] for i, (a, b) in enumerate(load)]
                return round(sum((max(x) - min(x)) / t for x, t in zip(zip(*tried, strict=True), total, strict=True)), 12), sum(load[k]), k

            k = min(range(count), key=spread)
            load[k][0] += neg
            load[k][1] += pos
            first.append(k)
            if len(first) >= count and len(set(first[-count:])) == count:
                cycle = first[-count:]
        left = many - len(first)
        for i in range(count):
            more = left // count + (i < left % count)
            if cycle:
                load[cycle[i]][0] += neg * more
                load[cycle[i]][1] += pos * more
        out.append((neg, pos, first, cycle))
    return out


def stratified_fold_of(rows: DataFrame, group: str, label: str, count: int, seed: int) -> DataFrame:
    """``group, negatives, positives, fold``: whole groups dealt so that the folds are alike in both classes.

    Groups of equal counts are one class; the driver sees classes, with how many groups each has, and deals those. A group's
    turn in its class goes by a hash of the seed and its name, in ranges, so neither a large class nor many groups need one task.
    Fails if a class of the label is in fewer groups than there are folds.
    """
    positive = F.count_if(F.col(label) == 1)
    groups = Staging(rows.sparkSession, "stratified").put(rows.groupBy(group).agg((F.count("*") - positive).alias("negatives"), positive.alias("positives")), "groups")
    classes = [(r.negatives, r.positives, r.n) for r in groups.groupBy("negatives", "positives").agg(F.count("*").alias("n")).collect()]
    for name, have in (("0", sum(c for n, _, c in classes if n)), ("1", sum(c for _, p, c in classes if p))):
        if have < count:
            raise InfeasibleSplit(f"class {name} is in {have} groups for {count} folds")
    turns = [(n, p, first, cycle or [0]) for n, p, first, cycle in _dealt(classes, count)]
    plan = rows.sparkSession.createDataFrame(turns, "negatives bigint, positives bigint, first array<int>, cycle array<int>")
    hashed = groups.withColumns({"__h": F.sha2(F.concat(F.lit(f"{seed},"), F.col(group).cast("string")), 256), "__one": F.lit(1).cast("long")})
    ranked = running_sums(hashed, ["negatives", "positives"], [F.col("__h")], {"turn": "__one"})
    later = F.col("turn") - F.size("first")
    fold = F.when(later < 0, F.get("first", F.col("turn").cast("int"))).otherwise(F.get("cycle", F.pmod(later, F.size("cycle")).cast("int")))
    return ranked.join(plan, ["negatives", "positives"]).select(group, "negatives", "positives", fold.alias("fold"))
