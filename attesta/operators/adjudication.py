"""Observations read from narrative fields: anchored quotes, identities, conflicts, decisions and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import span_holds, strict_utc
from attesta.operators.joins import overlaps
from attesta.operators.reconcile import membership_problems

ACTIONS = ("parser", "observations", "excluded", "unresolved")
#: Words for a population that say nothing.
NO_POPULATION = ("", "unknown", "unspecified", "not reported", "not specified", "n/a", "na")


def population(c: str | Column) -> Column:
    """A named population in lower case; null if the word says nothing."""
    p = F.lower(F.btrim(F.col(c) if isinstance(c, str) else c))
    return F.when(~p.isin(*NO_POPULATION), p)


def disjoint(a: Column, b: Column) -> Column:
    """Two populations that can't share a member: one male, one female."""
    return F.coalesce(((a == "male") & (b == "female")) | ((a == "female") & (b == "male")), F.lit(False))


def anchored_id(*anchors: str) -> Column:
    """An identity that follows from what an observation is anchored to, and nothing else."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(a).cast("string"), F.lit("")) for a in anchors])), 256)


def evidence_problems(evidence: DataFrame, fields: DataFrame) -> DataFrame:
    """``field_id, problem`` for spans ``field_id, start, end, quote`` that their field's text does not hold."""
    e = evidence.join(fields.select("field_id", F.col("text").alias("__text")), "field_id", "left")
    problem = F.when(F.col("__text").isNull(), "unknown_field").when(~span_holds("__text", "start", "end", "quote"), "quote_mismatch")
    return e.select("field_id", "start", "end", problem.alias("problem")).where("problem is not null")


def conflicts(candidates: DataFrame, width: int = 64) -> DataFrame:
    """Pairs of candidates of one field whose spans overlap, unless their populations are disjoint."""
    pairs = overlaps(candidates, ["field_id"], "candidate_id", "start", "end", width)
    who = candidates.select("candidate_id", population("sex").alias("p"))
    known = pairs.join(who.withColumnsRenamed({"candidate_id": "a", "p": "pa"}), "a").join(who.withColumnsRenamed({"candidate_id": "b", "p": "pb"}), "b")
    return known.where(~disjoint(F.col("pa"), F.col("pb"))).select("field_id", "a", "b")


def decision_problems(universe: DataFrame, decisions: DataFrame) -> DataFrame:
    """``field_id, problem``: every field decided exactly once, by a known action, with what the action needs."""
    once = membership_problems(universe, decisions, "field_id")
    n = F.coalesce(F.size("observations"), F.lit(0))
    problem = (
        F.when(~F.col("action").isin(*ACTIONS), "unknown_action").when((F.col("action") == "observations") & (n == 0), "no_observations")
        .when((F.col("action") != "observations") & (n > 0), "observations_without_action").when(F.col("action").isin("excluded", "unresolved") & (F.coalesce(F.btrim("reason"), F.lit("")) == ""), "no_reason")
    )
    return once.unionByName(decisions.select("field_id", problem.alias("problem")).where("problem is not null"))


def expand(decisions: DataFrame) -> DataFrame:
    """``field_id, action, ordinal, observation, state``: one row an observation, one for a decision without any."""
    rows = decisions.select("field_id", "action", F.posexplode_outer(F.when(F.col("action") == "observations", F.col("observations"))).alias("pos", "observation"))
    state = F.when(F.col("action") == "observations", "observed").when(F.col("action") == "parser", "parsed").when(F.col("action") == "excluded", "excluded").otherwise("quarantined")
    return rows.select("field_id", "action", (F.coalesce("pos", F.lit(0)) + 1).alias("ordinal"), "observation", state.alias("state"))


def terminal_problems(terminals: DataFrame, clauses: DataFrame) -> DataFrame:
    """``candidate_id, problem``: a disposition follows from a named clause, and a quarantine has two alternatives."""
    t = terminals.join(clauses.select("clause", F.col("disposition").alias("__d")), "clause", "left")
    few = F.size(F.array_distinct(F.coalesce("alternatives", F.array().cast("array<string>")))) < 2
    problem = F.when(F.col("__d").isNull(), "unknown_clause").when(F.col("__d") != F.col("disposition"), "clause_disposition_mismatch").when((F.col("disposition") == "quarantined") & few, "fewer_than_two_alternatives")
    return t.select("candidate_id", problem.alias("problem")).where("problem is not null")


def review_problems(scope: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``path, problem``: every path in scope is reviewed, or recorded as out of reach with a failure."""
    seen = reviewed.groupBy("path").agg(F.bool_or("ok").alias("ok"), F.bool_or(~F.col("ok") & (F.coalesce("failure", F.lit("")) != "")).alias("failed"))
    j = scope.select("path", "reachable").join(seen, "path", "full_outer")
    problem = (
        F.when(F.col("reachable").isNull(), "outside_scope").when(F.col("ok"), F.lit(None))
        .when(F.coalesce("failed", F.lit(False)) & ~F.col("reachable"), F.lit(None)).when(F.coalesce("failed", F.lit(False)), "reachable_but_failed").otherwise("not_reviewed")
    )
    return j.select("path", problem.alias("problem")).where("problem is not null")


def unaddressed(notices: DataFrame, answers: DataFrame) -> DataFrame:
    """``notice_id, member`` for members a notice names (an array) that have not answered it."""
    return notices.select("notice_id", F.explode("members").alias("member")).join(answers, ["notice_id", "member"], "left_anti")


def receipt_status(receipts: DataFrame, current: DataFrame, now: Column | None = None) -> DataFrame:
    """``receipt_id, status``: INVALID, STALE, REJECTED, BLOCKED or CURRENT_APPROVED, the first that applies.

    A receipt names an artifact's hash, an outcome, its reviewer and producer, an instant and open blockers. It is
    invalid without a zone in its instant, from the future, or if the producer reviewed; stale if the artifact's
    hash is another now.
    """
    now = now if now is not None else F.current_timestamp()
    r = receipts.join(current.select("path", F.col("sha256").alias("__now")), "path", "left")
    invalid = ~strict_utc("reviewed_at") | F.coalesce(F.try_to_timestamp("reviewed_at") > now, F.lit(False)) | (F.lower("reviewer") == F.lower("producer"))
    status = (
        F.when(F.coalesce(invalid, F.lit(True)), "INVALID").when(F.col("__now").isNull() | (F.col("__now") != F.lower("sha256")), "STALE")
        .when(F.col("outcome") != "PASS", "REJECTED").when(F.col("open_blockers") > 0, "BLOCKED").otherwise("CURRENT_APPROVED")
    )
    return r.select("receipt_id", status.alias("status"))
