"""Narratives of archived documents: what becomes of each field, and of each document without any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.narrative import mentions, narrative

#: The tags of a document's number, of its registry number and of the fields that are always read.
NUMBER, REGISTRY, NARRATED = "DOCNO", "CASRegistryNumber", "ntxv"


def dispositions(fields: DataFrame, document: list[str], tag: str = "tag", text: str = "text", position: str = "position") -> DataFrame:
    """``document, position, tag, ordinal, source, docno, cas, status, why, said`` of fields as ``office.read_xml_records`` gives them.

    A field is read if its tag says so or its text names the endpoint; ``ordinal`` counts a document's fields of its tag,
    ``said`` is what ``narrative`` makes of it and ``why`` an array of reasons. Without exactly one registry number in its document a field is quarantined,
    whatever it says. A document without such a field is one row with null ``position``, excluded. Documents are grouped by their
    few numbers only, so a long one isn't gathered; a document without fields is there by its row with a null tag.
    """
    own = fields.select(*document, F.col(position).alias("position"), F.col(tag).alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(["ordinal"] if "ordinal" in fields.columns else []))
    reads = (F.col("tag") == NARRATED) | (mentions("text") > 0)
    own = own.withColumn("reads", F.coalesce(F.col("tag").isNotNull() & reads, F.lit(False)))
    named = lambda t: F.collect_set(F.when((F.col("tag") == t) & (F.btrim("text") != ""), F.btrim("text")))
    known = own.groupBy(*document).agg(named(REGISTRY).alias("numbers"), F.min(F.when(F.col("tag") == NUMBER, F.btrim("text"))).alias("docno"), F.count_if("reads").alias("read"))
    cas = F.when(F.size("numbers") == 1, F.get("numbers", F.lit(0))).otherwise("")
    known = known.select(*document, "docno", cas.alias("cas"), F.size("numbers").alias("n"), "read")
    names = [f"__d{i}" for i in range(len(document))]
    facts = known.select(*[F.col(d).alias(n) for d, n in zip(document, names, strict=True)], "docno", "cas", "n")
    same = [own[d].eqNullSafe(F.col(n)) for d, n in zip(document, names, strict=True)]
    met = own.where("reads").join(facts, same).withColumn("said", narrative("text"))
    lacks = F.when(F.col("n") == 0, "missing_native_cas").when(F.col("n") > 1, "ambiguous_native_cas")
    status = F.when(lacks.isNotNull(), "quarantined").otherwise(F.col("said.status"))
    ordinal = F.col("ordinal") if "ordinal" in fields.columns else F.lit(None).cast("int")
    read = met.select(*document, "position", "tag", ordinal.cast("int").alias("ordinal"), F.lit("narrative_field").alias("source"), "docno", "cas", status.alias("status"), F.array_compact(F.array(F.col("said.why"), lacks)).alias("why"), "said")
    nothing = lambda name: F.lit(None).cast(read.schema[name].dataType)
    rest = known.where("read = 0").select(*document, nothing("position").alias("position"), F.lit(None).cast("string").alias("tag"), nothing("ordinal").alias("ordinal"), F.lit("document_disposition").alias("source"), "docno", "cas", F.lit("excluded").alias("status"), F.array(F.lit("no_toxicity_candidate_fields")).alias("why"), nothing("said").alias("said"))
    return read.unionByName(rest)
