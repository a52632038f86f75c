"""What leaves with a release: redaction of row data, flat facts, evidence routing, poses and gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.canon import canonical, strict_loads
from attesta.operators.documents import json_facts

#: Keys whose values are data of single rows.
ROW_KEYS = frozenset({"rows", "row_ids", "records", "predictions", "fold_predictions", "smiles", "structures", "labels", "targets"})
LONGEST = 50


def redacted(value: object, found: list[str] | None = None, path: str = "") -> object:
    """A JSON value without row data: values of telling keys, and lists too long to be a summary, are replaced."""
    found = [] if found is None else found
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            at = f"{path}/{k}"
            if k.lower() in ROW_KEYS and v not in (None, [], {}):
                found.append(at)
                out[k] = "[redacted]"
            else:
                out[k] = redacted(v, found, at)
        return out
    if isinstance(value, list):
        if len(value) > LONGEST:
            found.append(path)
            return f"[redacted {len(value)} items]"
        return [redacted(v, found, f"{path}/{i}") for i, v in enumerate(value)]
    return value


def redact(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the JSON column redacted, and ``redactions``, the paths that were replaced."""

    @F.pandas_udf("text string, redactions array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found: list[str] = []
            out.append((None if t is None else canonical(redacted(strict_loads(t), found)), found))
        return pd.DataFrame(out, columns=["text", "redactions"])

    return rows.withColumn("__r", run(column)).withColumns({column: F.col("__r.text"), "redactions": F.col("__r.redactions")}).drop("__r")


def scalar_facts(rows: DataFrame, key: str, column: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """``key, path, value`` of all scalars of a JSON column, at any depth, as ``a.b[0]``; members named in ``skip`` go with all they hold."""
    facts = json_facts(rows, [key], column, skip, dotted=True, raw=True, strict=True)
    return facts.where(~F.col("kind").isin("object", "array")).select(key, "path", "value")


def routed(facts: DataFrame, routes: DataFrame) -> DataFrame:
    """Facts with the section that their stage and file belong to, ``unrouted`` for none."""
    return facts.join(routes, ["stage", "file"], "left").withColumn("section", F.coalesce("section", F.lit("unrouted")))


def read_poses(lines: DataFrame, key: list[str], column: str = "value") -> DataFrame:
    """``key, mode, affinity, intramol, pose_score, cnn_affinity`` of pose logs; other lines are passed over."""
    p = F.split(F.btrim(column), r"\s+")
    rows = lines.where(F.col(column).rlike(r"^\s*\d+(\s+[+-]?\d+(\.\d+)?){4}\s*$")).withColumn("p", p)
    return rows.select(*key, F.col("p")[0].cast("int").alias("mode"), *[F.col("p")[i].cast("double").alias(n) for i, n in enumerate(("affinity", "intramol", "pose_score", "cnn_affinity"), 1)])


def select_poses(poses: DataFrame, keys: list[str], at_least: float) -> DataFrame:
    """Affinity by three rules for each pair, and whether only the first rule passes (``fragile``).

    The best pose by score, the best affinity of any pose, and the affinity of the pose with the best energy.
    """
    got = poses.groupBy(*keys).agg(F.max_by("cnn_affinity", F.struct("pose_score", -F.col("mode"))).alias("m1"), F.max("cnn_affinity").alias("m2"), F.min_by("cnn_affinity", F.struct("affinity", "mode")).alias("m3"))
    return got.withColumn("fragile", (F.col("m1") >= at_least) & (F.col("m3") < at_least))


def box_centre(atoms: DataFrame, keys: list[str]) -> DataFrame:
    return atoms.groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))


def judged(anchors: DataFrame, criteria: DataFrame) -> DataFrame:
    """``metric, value, verdict`` against ``metric, direction, limit, tolerance, hard``: pass, warn or fail."""
    c = anchors.join(criteria, "metric")
    short = F.when(F.col("direction") == "min", F.col("limit") - F.col("value")).otherwise(F.col("value") - F.col("limit"))
    verdict = F.when(short <= 0, "pass").when((short <= F.col("tolerance")) | ~F.col("hard"), "warn").otherwise("fail")
    return c.select("metric", "value", verdict.alias("verdict"))


def endpoint_table(facts: DataFrame, keys: list[str], name: str, value: str, columns: list[str]) -> DataFrame:
    """A row a key with the facts named in ``columns`` side by side; a fact given twice with two values is ``conflict``."""
    one = facts.where(F.col(name).isin(columns)).groupBy(*keys, name).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    said = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise("conflict")
    return one.groupBy(*keys).pivot(name, columns).agg(F.first(said))
