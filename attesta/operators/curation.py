"""Contract-driven curation: every input row ends in exactly one disposition, with its reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.values import looked_up, positive_number, reasons, relation, text, unit_factor, unit_kind, valid_cas
from attesta.plans.contract import FIELDS, CurationContract, Task

#: Reasons that leave a row open for review instead of excluding it.
IDENTITY_OPEN = ("ambiguous_identity", "unresolved_identity", "identity_conflict", "unresolved_support_identity")
KEYS = ("dtxsid", "cas", "npid")


def map_fields(rows: DataFrame, contract: CurationContract, keep: tuple[str, ...] = ()) -> DataFrame:
    """The canonical fields of each row as text, constants filled in, exact aliases applied.

    A constant that a native value contradicts (but for case) fails the job: that is a wrong contract, not a
    bad row. A mapped column that the source lacks is empty.
    """
    out = []
    for f in FIELDS:
        source = contract.mapping.get(f)
        value = text(source) if source in rows.columns else F.lit("")
        if f in contract.constants:
            constant = contract.constants[f]
            clash = (value != "") & (F.lower(value) != constant.lower())
            value = F.when(clash, F.raise_error(F.concat(F.lit(f"{f} contradicts its constant: "), value))).otherwise(F.lit(constant))
        if f in contract.aliases:
            value = looked_up(value, contract.aliases[f])
        out.append(value.alias(f))
    return rows.select(*keep, *out)


def administrative_route(endpoint: Column, route: Column, routes: dict[str, str]) -> tuple[Column, Column]:
    """The route that an endpoint's name implies, and whether a stated route contradicts it."""
    implied = looked_up(endpoint, routes, F.lit(""))
    clash = (implied != "") & (route != "") & (F.lower(route) != F.lower(implied))
    return F.when((route == "") & (implied != ""), implied).otherwise(route), clash


def matching_tasks(rows: DataFrame, tasks: tuple[Task, ...]) -> Column:
    """Ids of the tasks whose species, route and endpoint equal the row's but for case."""
    hits = [F.when((F.lower("species") == t.species.lower()) & (F.lower("route") == t.route.lower()) & (F.lower("endpoint") == t.endpoint.lower()), F.lit(t.id)) for t in tasks]
    return F.array_compact(F.array(*hits))


def explode_tasks(rows: DataFrame, tasks: DataFrame, on: list[str]) -> DataFrame:
    """One row for each task that matches on all of ``on`` without regard to case; ``tasks`` is a contract's few rows."""
    cond = [F.lower(rows[c]) == F.lower(tasks[c]) for c in on]
    return rows.join(tasks, cond).drop(*[tasks[c] for c in on])


def observe(mapped: DataFrame, contract: CurationContract, native: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``tasks, normalized_relation, number, flags, reasons``: all that can be said before identity."""
    route, clash = administrative_route(F.col("endpoint"), F.col("route"), contract.administrative_routes) if contract.administrative_routes else (F.col("route"), F.lit(False))
    rows = mapped.withColumns({"route": route, "__clash": clash})
    rows = rows.withColumns({"tasks": matching_tasks(rows, contract.tasks), "normalized_relation": relation("relation"), "number": positive_number("value")})
    inexact = F.col("normalized_relation") != "="
    if contract.relation_policy == "reported_numeric":
        inexact = inexact & (F.col("relation") != "")
    rules = [(~text(f).isin(list(allowed)), f"native_field_not_allowed:{f}") for f, allowed in contract.native_filters.items()]
    rules += [
        (F.col("__clash"), "endpoint_route_conflict"),
        (F.size("tasks") == 0, "outside_declared_task_or_missing_stratum"),
        (inexact, "nonexact_or_unknown_relation"),
        (F.col("number").isNull(), "invalid_positive_numeric_value"),
        (unit_kind("unit").isNull(), "unsupported_or_unknown_unit"),
    ]
    if contract.test_materials is not None:
        rules.append((~F.col("test_material").isin(list(contract.test_materials)), "test_material_not_allowed"))
    flags = reasons(((F.col("cas") != "") & ~valid_cas("cas"), "invalid_cas"))
    return rows.withColumns({"reasons": reasons(*rules), "flags": flags}).drop("__clash")


def replicates(rows: DataFrame, keys: list[str], measures: list[Column]) -> DataFrame:
    """Groups of more than one row: ``keys, n`` and the measures."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *measures).where("n > 1")


def replicate_flag(rows: DataFrame, keys: list[str], name: str = "replicate_flag", over: int = 1) -> DataFrame:
    """``rows`` with whether their group has more than ``over`` rows: counts are joined back, no window holds a group."""
    return rows.join(rows.groupBy(*keys).agg((F.count("*") > over).alias(name)), keys)


def scope_flags(rows: DataFrame, term: str, exact: str, mapped: DataFrame) -> DataFrame:
    """``rows`` with ``exact``, whether the folded term is the wanted one, and ``mapped``, whether ``mapped`` (``term``) leads there."""
    own = F.lower(F.trim(F.col(term)))
    known = mapped.select(F.lower(F.trim("term")).alias("__term")).distinct().withColumn("__hit", F.lit(True))
    out = rows.withColumn("__term", own).join(known, "__term", "left")
    return out.withColumns({"exact": F.coalesce(F.col("__term") == exact, F.lit(False)), "mapped": F.coalesce("__hit", F.lit(False))}).drop("__term", "__hit")


def effect_blocks(rows: DataFrame, id_column: str, prefix: str = "effects") -> DataFrame:
    """``id, block, field, value``: columns named ``prefix.block.field``, wide to long; cells without a value go.

    Columns of one block belong together; a column's name alone decides, so new blocks need no change.
    """
    named = [(c, *c[len(prefix) + 1 :].split(".", 1)) for c in rows.columns if c.startswith(f"{prefix}.") and c.count(".") >= 2]
    if not named:
        raise ValueError(f"no column is named {prefix}.block.field")
    cells = F.array(*[F.struct(F.lit(block).alias("block"), F.lit(field).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c, block, field in named])
    return rows.select(id_column, F.inline(cells)).where("value is not null")


def support_index(support: DataFrame, keys: tuple[str, ...] = KEYS, structure: str = "structure") -> tuple[DataFrame, DataFrame]:
    """``(kind, value, structures)`` and the blocked ``(kind, value, why)``.

    A key with any row that lacks a structure is blocked, whichever row came first: the rows of a key are
    judged together.
    """
    pairs = support.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), text(k).alias("value")) for k in keys if k in support.columns])).alias("p"), text(structure).alias("s"))
    pairs = pairs.select("p.kind", "p.value", "s").where("value <> ''")
    judged = pairs.groupBy("kind", "value").agg(F.sort_array(F.collect_set(F.when(F.col("s") != "", F.col("s")))).alias("structures"), F.count_if(F.col("s") == "").alias("bad"))
    return judged.where("bad = 0").drop("bad"), judged.where("bad > 0").select("kind", "value", F.lit("missing_structure").alias("why"))


def resolve_identity(rows: DataFrame, index: DataFrame, blocked: DataFrame, id_column: str, keys: tuple[str, ...] = KEYS, direct: str = "smiles") -> DataFrame:
    """``id, structure, status``: one structure for each row, by its own or over all of its keys.

    A structure of its own wins unless a key says otherwise (``identity_conflict``); without one, the keys
    must agree on a single structure. An invalid registry number is no key; a blocked key leaves its row open.
    """
    long = rows.select(id_column, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in keys])).alias("p"))
    long = long.select(id_column, "p.*").where((F.col("value") != "") & ((F.col("kind") != "cas") | valid_cas("value")))
    both = index.select("kind", "value", "structures", F.lit(None).cast("string").alias("why")).unionByName(blocked.select("kind", "value", F.array().cast("array<string>").alias("structures"), "why"))
    found = long.join(both, ["kind", "value"]).groupBy(id_column).agg(F.array_distinct(F.flatten(F.collect_list("structures"))).alias("candidates"), F.count_if(F.col("why").isNotNull()).alias("stopped"))
    n = F.coalesce(F.size("candidates"), F.lit(0))
    own = F.col(direct) != ""
    status = (
        F.when(F.coalesce("stopped", F.lit(0)) > 0, "unresolved_support_identity")
        .when(own & (n > 0) & ~((n == 1) & (F.col("candidates")[0] == F.col(direct))), "identity_conflict")
        .when(own, "direct_source")
        .when(n == 1, "exact_identifier_mapping")
        .when(n > 1, "ambiguous_identity")
        .otherwise("unresolved_identity")
    )
    joined = rows.select(id_column, direct).join(found, id_column, "left").withColumn("status", status)
    structure = F.when(F.col("status") == "direct_source", F.col(direct)).when(F.col("status") == "exact_identifier_mapping", F.try_element_at("candidates", F.lit(1)))
    return joined.select(id_column, structure.alias("structure"), "status")


def disposition(reason_column: str = "reasons") -> Column:
    """``retained`` without a reason, ``quarantined`` if one is about identity, else ``excluded``."""
    c = F.col(reason_column)
    return F.when(F.size(c) == 0, "retained").when(F.arrays_overlap(c, F.array(*map(F.lit, IDENTITY_OPEN))), "quarantined").otherwise("excluded")


@dataclass(frozen=True)
class Curated:
    """The ledgers of one run."""

    dispositions: DataFrame
    retained: DataFrame
    identities: DataFrame


def curate(rows: DataFrame, contract: CurationContract, support: DataFrame, id_column: str = "row_id", native: tuple[str, ...] = ()) -> Curated:
    """Maps, checks, resolves, converts and explodes ``rows``; ``id_column`` must be unique.

    ``support`` has identity keys, ``structure`` and, for molar units, ``weight`` of each structure. Retained
    rows carry ``target_mg_kg``, ``target_mol_kg``, ``target_pLD50`` and a replicate flag of their task and group.
    """
    native = tuple(dict.fromkeys([*native, *contract.native_filters]))
    mapped = observe(map_fields(rows, contract, (id_column, *native)), contract, native)
    index, blocked = support_index(support)
    identities = resolve_identity(mapped, index, blocked, id_column)
    weights = support.select(text("structure").alias("structure"), F.col("weight").cast("double").alias("weight")).where("structure <> '' and weight > 0").groupBy("structure").agg(F.min("weight").alias("weight"))
    known = mapped.join(identities, id_column).join(weights, "structure", "left")
    mg = F.col("number") * unit_factor("unit") * F.when(unit_kind("unit") == "mass", F.lit(1.0)).otherwise(F.col("weight") * 1000)
    known = known.withColumn("target_mg_kg", mg).withColumn("target_mol_kg", F.col("target_mg_kg") / (1000 * F.col("weight")))
    bad_number = (F.size("reasons") == 0) & F.col("structure").isNotNull() & ~F.coalesce((F.col("target_mol_kg") > 0) & (F.col("target_mol_kg") < float("inf")), F.lit(False))
    known = known.withColumn("reasons", F.array_compact(F.concat("reasons", F.array(F.when(F.col("structure").isNull(), F.col("status")), F.when(bad_number, F.lit("numeric_conversion_overflow_or_underflow"))))))
    known = known.withColumn("disposition", disposition())
    retained = known.where("disposition = 'retained'").withColumn("task_id", F.explode("tasks"))
    retained = retained.withColumns({
        "output_row_id": F.concat_ws(":", F.col(id_column), "task_id"),
        "group_id": F.concat(F.lit("structure:"), F.sha2("structure", 256)),
        "target_kind": F.when(F.col("normalized_relation") == "=", "exact").otherwise("reported_numeric_estimate"),
        "target_pLD50": -F.log10("target_mol_kg"),
    })
    retained = replicate_flag(retained.drop("tasks", "reasons", "disposition"), ["task_id", "group_id"])
    return Curated(known.select(id_column, "disposition", "reasons", "flags"), retained, identities)
