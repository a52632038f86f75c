"""Closure of an audited dump: scope, bridge, decisions and consumption, each rebuilt and compared by joins.

A stage's claims are tables; what they should be follows from the native rows. Every check returns the rows that break
it, so an empty result is the proof, and ``reconcile.fail_on`` turns a result into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.operators.joins import exact_membership
from attesta.operators.reconcile import membership_problems, ordered_digest

DISPOSITIONS = ("preserve", "scientific_quarantine", "excluded")
#: Texts that stand for no value.
ABSENT = ("", "-")


def absent(c: str | Column) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return v.isNull() | v.cast("string").isin(*ABSENT)


def locator_problems(claimed: DataFrame, native: DataFrame, locator: list[str], digest: str) -> DataFrame:
    """``locator, problem``: places that the native rows lack, that are claimed twice, or whose digest is another there."""
    c = claimed.groupBy(*locator).agg(F.count("*").alias("__n"), F.min(digest).alias("__lo"), F.max(digest).alias("__hi"))
    j = c.join(native.select(*locator, F.col(digest).alias("__d")), locator, "left")
    problem = F.when(F.col("__d").isNull(), "unknown_locator").when(F.col("__n") > 1, "repeated_locator").when((F.col("__lo") != F.col("__d")) | (F.col("__hi") != F.col("__d")), "digest_mismatch")
    return j.select(*locator, problem.alias("problem")).where("problem is not null")


def not_ascending(rows: DataFrame, source: list[str], position: str, locator: list[str]) -> DataFrame:
    """Rows whose locator does not exceed that of the row before, in a ledger's own order."""
    at = F.struct(*locator)
    return rows.where(F.lit(True)).withColumn("__before", F.lag(at).over(Window.partitionBy(*source).orderBy(position))).where(at <= F.col("__before")).drop("__before")


def native_scope(rows: DataFrame, fixes: DataFrame, original: str, current: str, wanted: str) -> DataFrame:
    """``rows`` with ``exact`` (the current term is the wanted one, as it stands) and ``relevant``.

    A row is relevant if either term is the wanted one but for case and blanks, or if ``fixes`` (``term_original,
    term_final``) leads its original term there; exact rows are relevant. Rows out of scope stay, with both flags false.
    """
    same = lambda c: F.coalesce(F.upper(F.trim(c)) == wanted.upper(), F.lit(False))
    mapped = fixes.where(same(F.col("term_final")) & F.col("term_original").isNotNull()).select(F.col("term_original").alias("__term")).distinct().withColumn("__hit", F.lit(True))
    out = rows.join(mapped, F.col(original) == F.col("__term"), "left")
    relevant = same(F.col(current)) | same(F.col(original)) | F.coalesce("__hit", F.lit(False))
    return out.withColumns({"exact": F.coalesce(F.col(current) == wanted, F.lit(False)), "relevant": relevant}).drop("__term", "__hit")


def flag_problems(claimed: DataFrame, rebuilt: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """``keys, problem``: members that are ``missing``, ``unexpected`` or ``repeated``, or whose flags differ."""
    c = claimed.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(F.struct(*flags)).alias("__lo"), F.max(F.struct(*flags)).alias("__hi"))
    j = c.join(rebuilt.select(*keys, F.struct(*flags).alias("__w")), keys, "full_outer")
    differ = (F.col("__lo") != F.col("__w")) | (F.col("__hi") != F.col("__w"))
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__w").isNull(), "unexpected").when(F.col("__n") > 1, "repeated").when(differ, "flags_differ")
    return j.select(*keys, problem.alias("problem")).where("problem is not null")


def scope_counters(rows: DataFrame, roles: dict[str, Column], member: Column, order: list[str]) -> DataFrame:
    """``role, n, digest``: how many rows have each role, and one hash over these members in order; a role may have none."""
    held = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in roles.items()]))
    got = ordered_digest(rows.withColumn("role", F.explode(held)), ["role"], member, order)
    every = rows.sparkSession.createDataFrame([(r,) for r in roles], "role string")
    return every.join(got, "role", "left").select("role", F.coalesce("n", F.lit(0)).alias("n"), "digest")


def bridge_problems(scope: DataFrame, bridge: DataFrame, candidates: DataFrame, key: str, numeric: list[str]) -> DataFrame:
    """``key, problem``: every relevant row has one entry, with exactly one of candidates, a review and a terminal.

    ``scope`` has ``key, exact, relevant`` and the numeric columns, ``bridge`` ``key, review, terminal``, ``candidates``
    ``key, candidate_id``. A row without candidates must show no number, and an exact row needs candidates or a terminal.
    """
    once = membership_problems(scope.where("relevant").select(key), bridge.select(key), key)
    counts = candidates.groupBy(key).agg(F.count("*").alias("__c"))
    j = bridge.join(counts, key, "left").join(scope.select(key, "exact", *[F.col(c).alias(f"__v{i}") for i, c in enumerate(numeric)]), key)
    some = F.coalesce("__c", F.lit(0)) > 0
    branches = some.cast("int") + F.col("review").isNotNull().cast("int") + F.col("terminal").isNotNull().cast("int")
    shown = F.lit(False)
    for i in range(len(numeric)):
        shown = shown | ~absent(f"__v{i}")
    problem = F.when(branches > 1, "branches_overlap").when(branches == 0, "no_branch").when(~some & shown, "hides_a_number").when(~some & F.col("terminal").isNull() & F.col("exact"), "exact_without_candidates")
    return once.unionByName(j.select(key, problem.alias("problem")).where("problem is not null"))


def candidate_decision_problems(candidates: DataFrame, decisions: DataFrame, clauses: DataFrame) -> DataFrame:
    """``candidate_id, problem`` of decisions: each candidate once, by an approved clause, from values the row has.

    ``candidates`` has ``candidate_id`` and ``numeric, units, qualifier`` both as they are and as ``..._original``;
    ``decisions`` has ``candidate_id, disposition, clause`` and the values it took. Number and unit must come from the same side, and
    a preserved row keeps an inequality of the original.
    """
    once = membership_problems(candidates.select("candidate_id"), decisions.select("candidate_id"), "candidate_id")
    own = candidates.select("candidate_id", *[F.col(c).alias(f"__{c}") for c in ("numeric", "units", "qualifier", "numeric_original", "units_original", "qualifier_original")])
    d = decisions.join(own, "candidate_id").join(clauses.select("clause", F.col("disposition").alias("__approved")), "clause", "left")
    one_of = lambda c: F.col(c).eqNullSafe(F.col(f"__{c}")) | F.col(c).eqNullSafe(F.col(f"__{c}_original"))
    side = lambda s: F.col("numeric").eqNullSafe(F.col(f"__numeric{s}")) & F.col("units").eqNullSafe(F.col(f"__units{s}"))
    kept = F.col("disposition") == "preserve"
    inequality = F.coalesce(F.col("__qualifier_original").rlike("[<>]"), F.lit(False))
    problem = (
        F.when(~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False)), "unknown_disposition").when(kept & F.col("clause").isNotNull(), "preserve_with_clause")
        .when(~kept & ~F.coalesce(F.col("__approved") == F.col("disposition"), F.lit(False)), "unapproved_clause").when(~(one_of("numeric") & one_of("units") & one_of("qualifier")), "unsupported_value")
        .when(~(side("") | side("_original")), "mixed_values").when(kept & inequality & ~F.col("qualifier").eqNullSafe(F.col("__qualifier_original")), "inequality_erased")
    )
    return once.unionByName(d.select("candidate_id", problem.alias("problem")).where("problem is not null"))


def fix_problems(candidates: DataFrame, decisions: DataFrame, fixes: DataFrame, fields: list[str]) -> DataFrame:
    """``candidate_id, fix_id, problem``: fixes (``field, term_original, fix_id``) that apply to a candidate's ``<field>_original`` and
    that its decision (``candidate_id, fix_ids``) leaves out, and those it names without cause."""
    long = candidates.select("candidate_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_original").alias("term_original")) for f in fields])))
    wanted = long.join(fixes, ["field", "term_original"]).select("candidate_id", "fix_id").distinct().withColumn("__w", F.lit(True))
    named = decisions.select("candidate_id", F.explode("fix_ids").alias("fix_id")).distinct().withColumn("__n", F.lit(True))
    j = wanted.join(named, ["candidate_id", "fix_id"], "full_outer")
    return j.select("candidate_id", "fix_id", F.when(F.col("__n").isNull(), "omitted").when(F.col("__w").isNull(), "extra").alias("problem")).where("problem is not null")


def consumption_problems(decisions: DataFrame, consumed: DataFrame) -> DataFrame:
    """``candidate_id, problem``: each decision (``candidate_id, decision_id, disposition``) is consumed once, as decided.

    ``consumed`` has ``candidate_id, decision_id, action`` and ``outputs``, an array of ids. What is not preserved gives no
    output, what is gives some, and no output comes twice.
    """
    once = membership_problems(decisions.select("candidate_id"), consumed.select("candidate_id"), "candidate_id")
    d = consumed.join(decisions.select("candidate_id", F.col("decision_id").alias("__id"), F.when(F.col("disposition") == "preserve", "preserved").otherwise(F.col("disposition")).alias("__action")), "candidate_id")
    n = F.coalesce(F.size("outputs"), F.lit(0))
    problem = F.when((F.col("decision_id") != F.col("__id")) | (F.col("action") != F.col("__action")), "decision_differs").when((F.col("action") != "preserved") & (n > 0), "excluded_emits").when((F.col("action") == "preserved") & (n == 0), "preserved_without_output")
    out = consumed.select("candidate_id", F.explode("outputs").alias("output"))
    twice = out.join(out.groupBy("output").agg(F.count("*").alias("__n")).where("__n > 1"), "output").select("candidate_id", F.lit("output_repeated").alias("problem")).distinct()
    return once.unionByName(d.select("candidate_id", problem.alias("problem")).where("problem is not null")).unionByName(twice)


def replay_difference(saved: DataFrame, rebuilt: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, ``side`` and ``times`` in which a saved ledger and its replay differ as bags of rows; empty if they are equal."""
    return exact_membership(saved.select(*columns), rebuilt.select(*columns))


def obligations(gaps: DataFrame) -> DataFrame:
    """``obligation_id, source_id, table_name``: one for each table that a gap (``source_id, unparsed_tables``) leaves unread."""
    each = gaps.select("source_id", F.explode("unparsed_tables").alias("table_name")).distinct()
    return each.select(F.sha2(F.to_json(F.array("source_id", "table_name")), 256).alias("obligation_id"), "source_id", "table_name")


def gap_status(owed: DataFrame, receipts: DataFrame) -> DataFrame:
    """``source_id, owed, met, status``: a source's gap is closed once a receipt (``obligation_id``) meets each obligation."""
    met = receipts.select("obligation_id").distinct().withColumn("__met", F.lit(1))
    got = owed.join(met, "obligation_id", "left").groupBy("source_id").agg(F.count("*").alias("owed"), F.count("__met").alias("met"))
    return got.withColumn("status", F.when(F.col("owed") == F.col("met"), "closed").when(F.col("met") > 0, "partial").otherwise("open"))


def contract_status(sources: DataFrame) -> DataFrame:
    """``source_id, status`` from ``source_id, required, retained, gaps, missing``: ``blocked`` if a required source is missing or
    gives nothing, ``limited`` if anything is missing or left open, else ``produced``."""
    blocked = F.col("required") & (F.col("missing") | (F.col("retained") == 0))
    limited = F.col("missing") | (F.col("gaps") > 0) | (F.col("retained") == 0)
    return sources.select("source_id", F.when(blocked, "blocked").when(limited, "limited").otherwise("produced").alias("status"))


def inferred_units(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """``path, unit, problem``: a unit follows from exactly one receipt that names the file and its hash, from nothing else."""
    got = receipts.groupBy("path", "sha256").agg(F.count("*").alias("__n"), F.min("unit").alias("unit"))
    j = files.select("path", "sha256").join(got, ["path", "sha256"], "left").join(receipts.select("path", F.lit(True).alias("__other")).distinct(), "path", "left")
    problem = F.when(F.col("__n") > 1, "several_receipts").when(F.col("__n").isNull() & F.col("__other"), "receipt_for_another_hash").when(F.col("__n").isNull(), "no_receipt")
    return j.select("path", F.when(F.col("__n") == 1, F.col("unit")).alias("unit"), problem.alias("problem"))


def token_problems(accepted: DataFrame, current: DataFrame) -> DataFrame:
    """``stage, problem``: acceptance tokens (``stage, sha256``) that are not the stages' current state."""
    a = accepted.groupBy("stage").agg(F.count("*").alias("__n"), F.min("sha256").alias("__a"), F.max("sha256").alias("__b"))
    j = a.join(current.select("stage", F.col("sha256").alias("__c")), "stage", "full_outer")
    stale = (F.col("__a") != F.col("__c")) | (F.col("__b") != F.col("__c"))
    problem = F.when(F.col("__n").isNull(), "not_accepted").when(F.col("__c").isNull(), "unknown_stage").when(stale, "stale_token").when(F.col("__n") > 1, "repeated_token")
    return j.select("stage", problem.alias("problem")).where("problem is not null")


def protected_references(facts: DataFrame, protected: DataFrame) -> DataFrame:
    """Facts (``key, path, value``, see ``release.scalar_facts``) whose value is a protected path or hash (``value``)."""
    return facts.join(protected.select("value").distinct(), "value", "left_semi")


def effect_problems(records: DataFrame, effects: DataFrame, key: list[str], projection: dict[str, str]) -> DataFrame:
    """``key, problem`` where an adapter's effects are not the projection (``effect column: record column``) of its records."""
    want = records.select(*key, F.struct(*[F.col(b).cast("string").alias(a) for a, b in projection.items()]).alias("__w"))
    got = effects.groupBy(*key).agg(F.count("*").alias("__n"), F.min(F.struct(*[F.col(a).cast("string").alias(a) for a in projection])).alias("__g"))
    j = want.join(got, key, "full_outer")
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__w").isNull(), "unexpected").when(F.col("__n") > 1, "repeated").when(~F.col("__w").eqNullSafe(F.col("__g")), "projection_differs")
    return j.select(*key, problem.alias("problem")).where("problem is not null")


def ledger_problems(rows: DataFrame, dispositions: DataFrame, retained: DataFrame, key: str) -> DataFrame:
    """``key, problem``: each row has one disposition, exactly the retained ones have output, and others a reason.

    ``dispositions`` has ``key, disposition, reasons``; ``retained`` may have several outputs of a row.
    """
    once = membership_problems(rows.select(key), dispositions.select(key), key)
    out = retained.select(key).distinct().withColumn("__out", F.lit(True))
    j = dispositions.join(out, key, "full_outer")
    kept, emits = F.col("disposition") == "retained", F.coalesce("__out", F.lit(False))
    problem = F.when(F.col("disposition").isNull(), "output_without_disposition").when(kept & ~emits, "retained_without_output").when(~kept & emits, "output_of_a_row_not_retained").when(~kept & (F.coalesce(F.size("reasons"), F.lit(0)) == 0), "no_reason")
    return once.unionByName(j.select(key, problem.alias("problem")).where("problem is not null"))


def emitted_from_blocked(emitted: DataFrame, blocked: DataFrame, keys: list[str]) -> DataFrame:
    """Emitted rows that show a blocked key (``kind, value``) of any kind, with that key."""
    shown = emitted.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])).alias("__k")).select("*", "__k.kind", "__k.value").drop("__k")
    return shown.join(blocked.select("kind", "value").distinct(), ["kind", "value"], "left_semi")


def output_problems(decisions: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """``key, expected, found``: decisions (``key, expected``) that gave another number of outputs, and outputs without a decision."""
    got = outputs.groupBy(key).agg(F.count("*").alias("found"))
    j = decisions.select(key, F.col("expected").cast("long").alias("expected")).join(got, key, "full_outer").na.fill(0, ["expected", "found"])
    return j.where("expected <> found")
