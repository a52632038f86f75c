"""Material identity of staged observations: slots, resolutions, routing and exactly-once accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.joins import keys_of
from attesta.operators.reconcile import membership_problems

OUTCOMES = ("match", "different", "unresolved")


def digest_problems(records: DataFrame, key: str, body: list[str], digest: str) -> DataFrame:
    """``key, problem``: records whose digest is not that of their body (JSON of the columns in order of their names)."""
    own = F.sha2(F.to_json(F.struct(*sorted(body)), {"ignoreNullFields": "false"}), 256)
    problem = F.when(F.col(digest).isNull(), "no_digest").when(~F.col(digest).rlike("^[0-9a-f]{64}$"), "invalid_digest").when(F.col(digest) != own, "digest_mismatch")
    return records.select(key, problem.alias("problem")).where("problem is not null")


def slot_problems(rows: DataFrame, slot: list[str], body: str) -> DataFrame:
    """``slot, bodies``: places that were staged with more than one body; bodies are compared by their hash."""
    return rows.groupBy(*slot).agg(F.count_distinct(F.sha2(F.col(body), 256)).alias("bodies")).where("bodies > 1")


def support_matches(observations: DataFrame, support: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``observation_id, structures, n_support``: distinct structures and rows of support that share any key of a kind.

    Both sides are keys of a kind and a value; support is summed by key and structure before the join.
    """
    asked = keys_of(observations, "observation_id", keys).distinct()
    held = keys_of(support, "structure", {k: k for k in keys}).groupBy("kind", "value", "structure").agg(F.count("*").alias("__n"))
    met = asked.join(held, ["kind", "value"])
    return met.groupBy("observation_id").agg(F.array_sort(F.collect_set("structure")).alias("structures"), F.sum("__n").alias("n_support"))


def resolution_problems(resolutions: DataFrame) -> DataFrame:
    """``material_id, problem`` of resolutions (``material_id, outcome, reviewer, producer, evidence, rationale``)."""
    blank = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    problem = (
        F.when(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)), "unknown_outcome").when(F.coalesce(F.size("evidence"), F.lit(0)) == 0, "no_evidence")
        .when(blank("rationale"), "no_rationale").when(blank("reviewer") | (F.lower("reviewer") == F.lower("producer")), "not_independent")
    )
    return resolutions.select("material_id", problem.alias("problem")).where("problem is not null")


def material_status(observations: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``observation_id, status``: ``verified``, ``hold`` or ``pending``.

    Verified needs one sound resolution that says match; a different or unresolved one, or several that disagree, hold the
    observation; without any it is pending. A resolution with a problem counts as none.
    """
    sound = resolutions.join(resolution_problems(resolutions).select("material_id").distinct(), "material_id", "left_anti")
    said = sound.groupBy("material_id").agg(F.min("outcome").alias("__lo"), F.max("outcome").alias("__hi"))
    status = F.when(F.col("__lo").isNull(), "pending").when((F.col("__lo") == "match") & (F.col("__hi") == "match"), "verified").otherwise("hold")
    return observations.select("observation_id", "material_id").join(said, "material_id", "left").select("observation_id", status.alias("status"))


def routed(observations: DataFrame, statuses: DataFrame) -> DataFrame:
    """``observation_id, disposition, reason``: verified rows without reasons of their own are retained, held ones quarantined.

    ``observations`` has ``observation_id, reasons``; a row with reasons is excluded whatever its material; pending ones wait.
    """
    own = F.coalesce(F.size("reasons"), F.lit(0)) > 0
    disposition = F.when(own, "excluded").when(F.col("status") == "verified", "retained").when(F.col("status") == "hold", "quarantined").otherwise("pending")
    reason = F.when(own, F.array_join("reasons", ",")).when(F.col("status") == "hold", "material_on_hold").when(F.coalesce(F.col("status") != "verified", F.lit(True)), "material_pending")
    return observations.join(statuses, "observation_id", "left").select("observation_id", disposition.alias("disposition"), reason.alias("reason"))


def seal_problems(expected: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """``key, problem``: the native universe is staged completely, once each, and nothing else is."""
    return membership_problems(expected.select(key), staged.select(key), key)


def finish(staged: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(disposition, n)`` and the problems of a batch: every staged observation leaves by one route."""
    counts = routes.groupBy("disposition").agg(F.count("*").alias("n"))
    return counts, seal_problems(staged, routes, "observation_id")


def packet_conflicts(packets: DataFrame) -> DataFrame:
    """``path, problem`` of dependency maps (``packet, alias, path, sha256``): one path with two hashes, or one alias for two paths."""
    hashes = packets.groupBy("path").agg(F.count_distinct("sha256").alias("n")).where("n > 1").select("path", F.lit("digest_conflict").alias("problem"))
    aliases = packets.groupBy("packet", "alias").agg(F.min("path").alias("path"), F.max("path").alias("other")).where("path <> other")
    return hashes.unionByName(aliases.select("path", F.lit("alias_conflict").alias("problem")).distinct())


def attach_metadata(fields: DataFrame, packets: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``fields`` with ``packet`` and ``metadata`` of the packet rows for them, and the packet rows left over or repeated."""
    own = packets.groupBy(key).agg(F.count("*").alias("__n"), F.min(F.struct("packet", "metadata")).alias("__p"))
    out = fields.join(own.where("__n = 1").select(key, "__p.packet", "__p.metadata"), key, "left")
    lone = own.join(fields.select(key).distinct().withColumn("__f", F.lit(True)), key, "left")
    problem = F.when(F.col("__f").isNull(), "unaccounted").when(F.col("__n") > 1, "repeated")
    return out, lone.select(key, problem.alias("problem")).where("problem is not null")
