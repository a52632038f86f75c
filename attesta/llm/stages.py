"""The operators as stages of a corpus pipeline: documents in, documents out.

Column names that begin with two underscores are the stages' own and must not be in the input; all others pass through.
A null key is a key, and rows of one key are told apart by a 64-bit hash of their text. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from attesta.llm import language_id, line_dedup, packing, simhash, substring_dedup
from attesta.plans.staging import bounded_batches


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` in order, with ``n_chars``, if it is one of them, counted anew."""
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def identify_language(docs: DataFrame) -> DataFrame:
    """Documents that have a language: rows without any letter or text go, a null ``lang`` is filled in.

    The network learns from the rows given. All columns pass through in the one pass that labels them; a ``lang`` that
    is set stays, also where the network reads another. Repeated rows, null keys and an empty table need nothing special.
    """
    net = language_id.train(language_id.labelled_sample(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            names = language_id.predictions(net, texts)[0] if net else pa.array(["und" if not t or not language_id.has_letter(t) else None for t in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, names], [*b.schema.names, "__lang_pred"])

    bounded_batches(docs.sparkSession)
    got = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__lang_pred", StringType())]))
    kept = got.where("__lang_pred is null or __lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "__lang_pred"))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Documents without the lines of three-line windows that an earlier place has.

    Null texts stay null, texts of fewer lines stay as they are; rows equal in key and text are one text and lose the same
    lines; a very long text is looked at once a line.
    """
    return _measured(line_dedup.dedup_lines(docs), docs.columns)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies; of rows equal in key and text one.

    Null texts and those without words are one group. Of a group the smallest key stays, null first, then the smallest hash;
    a very long text is one set of shingles.
    """
    groups = simhash.near_groups(docs).where("first").select(F.col("doc_id").alias("__k"), F.col("tag").alias("__tag")).distinct()
    tagged = docs.withColumn("__own", F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col("__k")) & (F.col("__own") == F.col("__tag"))
    return tagged.join(groups, on, "left_semi").dropDuplicates(["doc_id", "__own"]).select(*[f"`{c}`" for c in docs.columns])


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """Documents without the words of 35-word windows that occur more than once.

    Null texts stay null; of rows equal in key and text one stays, and they count as places of their own; a very long text is
    dealt in stretches.
    """
    got = substring_dedup.dedup_substrings(docs).select(F.col("doc_id").alias("__k"), F.col("tag").alias("__tag"), F.col("kept_text").alias("__text")).dropDuplicates(["__k", "__tag"])
    rest = docs.withColumn("__own", F.xxhash64("text")).drop("text")
    on = F.col("doc_id").eqNullSafe(F.col("__k")) & (F.col("__own") == F.col("__tag"))
    return _measured(rest.join(got, on).withColumn("text", F.col("__text")), docs.columns)


def pack(docs: DataFrame) -> DataFrame:
    """All documents packed into sequences, by ``packing.pack_documents``: null texts are their closing 0, repeated rows are packed again."""
    return packing.pack_documents(docs)
