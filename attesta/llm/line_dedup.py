"""Line dedup over overlapping windows of lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.plans.staging import Staging


def duplicate_lines(docs: DataFrame, window: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``tag`` and ``gone``: the line numbers (from 0, ascending) to remove from each text that loses any.

    A window is ``window`` consecutive lines of one text, cut at each line feed, compared unchanged. Of
    each window the occurrence at the smallest (key, tag, line) stays; the lines that any other occurrence
    covers go. Windows of nothing but white space never count. ``tag`` is a hash of the text: rows equal
    in key and text are one text, rows equal in key alone are told apart. Null texts have no lines; an empty table gives
    no rows.
    """
    stage = Staging(docs.sparkSession, "lines")
    lines = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("k"), F.xxhash64(text).alias("tag"), F.split(text, "\n", -1).alias("lines")
    )
    n = F.size("lines")
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))
    windows = lines.select("k", "tag", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("lines", i + 1, window), "\n"))).alias("at", "w"))
    windows = windows.where(F.regexp_like("w", F.lit(r"\S"))).select(
        F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("second"), "w").alias("h2"), F.struct(F.col("k").isNull().alias("none"), "k", "tag", "at").alias("place")
    )
    windows = stage.put(windows, "windows")
    counted = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("place").alias("kept"))
    repeated = stage.put(counted.where("n > 1").drop("n"), "repeated")
    later = windows.join(repeated, ["h1", "h2"]).where("place > kept")
    covered = F.sequence(F.col("place.at"), F.col("place.at") + (window - 1))
    return later.groupBy("place.k", "place.tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(covered)))).alias("gone")).withColumnRenamed("k", key)


def dedup_lines(docs: DataFrame, window: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``, and ``lines_removed`` (long).

    The kept lines are joined by line feeds. Null texts stay null; texts below ``window`` lines stay as
    they are. All other columns pass through, whatever their names (but for two leading underscores); a
    ``lines_removed`` of the input's own is replaced. A text's lines are looked at once each, however many go. An empty
    table gives an empty result.
    """
    gone = duplicate_lines(docs, window, text, key).select(F.col(key).alias("__k"), F.col("tag").alias("__tag"), F.col("gone").alias("__gone"))
    rest = [c for c in docs.columns if c not in (text, "lines_removed")]
    split = docs.select(*[F.col(f"`{c}`") for c in rest], F.split(text, "\n", -1).alias("__lines"), F.col(key).alias("__own"), F.xxhash64(text).alias("__own_tag"))
    on = F.col("__own").eqNullSafe(F.col("__k")) & (F.col("__own_tag") == F.col("__tag"))
    joined = split.join(gone, on, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    kept = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.transform(left, lambda i: F.get("__lines", i)))
    return joined.select(*[F.col(f"`{c}`") for c in rest], F.array_join(kept, "\n").alias(text), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("lines_removed"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    """All documents after three-line dedup: key, what is left and how many lines went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("text").alias("text_kept"), "lines_removed")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(x) AS line, unnest(generate_series(0, len(x) - 1)) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)
), windows AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS w
  FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k
  FROM windows WHERE w IS NOT NULL AND regexp_matches(w, '\S')
), gone AS (
  SELECT DISTINCT doc_id, pos + i AS pos FROM ranked, (VALUES (0), (1), (2)) AS v(i) WHERE k > 1
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text_kept, count(g.pos) AS lines_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(text_kept, '') END AS text_kept,
  coalesce(lines_removed, 0)::BIGINT AS lines_removed
FROM documents d LEFT JOIN kept USING (doc_id)
"""
