"""Phrases whose words stand together more often than apart: n-grams of distinct pieces, counted in duckdb by hash bucket.

Equal pieces of text are one row with a multiplicity. Map tasks make the n-grams and add up what they have; the sums are
dealt to hash buckets, and each bucket's task streams them through duckdb, which groups them within a bounded memory and
spills to its scratch folder beyond. Candidates then send requests for the counts of their parts to where these are kept:
joins, whose answers come back by another shuffle.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.plans.staging import Staging

#: Characters that a map task looks at before it hands on sums, n-grams of a bucket, about, and how many buckets there are at most.
AT_ONCE, BUCKET, MOST_BUCKETS = 4_000_000, 4_000_000, 20_000
MEMORY_MB = 256
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distinct_pieces(docs: DataFrame, text: str = "text", group: str = "lang", no_group: str = "und") -> DataFrame:
    """``lang, piece, times``: the distinct pieces of all texts, their words joined by one space, and how often each stands.

    A-Z become lower case; texts are cut at ``.,;:!?`` and line ends, pieces without words are none. Null texts have no
    pieces; a null group is ``no_group``.
    """
    lowered = docs.select(F.coalesce(F.col(group), F.lit(no_group)).alias("lang"), F.translate(F.col(text), *_LOWER).alias("t"))
    pieces = lowered.select("lang", F.explode(F.split("t", r"[.,;:!?\x0A-\x0D]+")).alias("p"))
    pieces = pieces.select("lang", F.regexp_replace(F.trim(F.translate("p", "\t", " ")), " {2,}", " ").alias("piece"))
    return pieces.where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("times"))


def _connected() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute(f"SET threads=1; SET memory_limit='{MEMORY_MB}MB'; SET preserve_insertion_order=false")
    return con


_SUMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("f", pa.int64())])
_PACKED = pa.schema([("bucket", pa.int32()), ("sums", pa.binary())])
_COUNTS = pa.schema([*_SUMS, ("size", pa.int32())])


def _map_sums(pieces: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``bucket, sums``: what map tasks have of each hash bucket, the n-grams of up to ``longest`` words, as packed Arrow."""
    gram = lambda n: " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    grams = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram(n)})) AS gram, times FROM split" for n in range(1, longest + 1))
    sql = f"""WITH split AS MATERIALIZED (SELECT lang, string_split(piece, ' ') AS w, times FROM chunk), summed AS (SELECT lang, gram, sum(times)::BIGINT AS f FROM ({grams}) GROUP BY lang, gram)
        SELECT (hash(lang, gram) % {buckets})::INTEGER AS bucket, lang, gram, f FROM summed ORDER BY bucket"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, packed = 0, pa.ipc.IpcWriteOptions(compression="zstd")

        def sums() -> Iterator[pa.RecordBatch]:
            with _connected() as con:
                con.register("chunk", pa.Table.from_batches(held))
                got = con.sql(sql).to_arrow_table()
            of = got.column("bucket").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]) if len(of) else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _SUMS, options=packed) as out:
                    out.write_table(got.slice(lo, hi - lo).select(_SUMS.names).cast(_SUMS).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([of[lo]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=_PACKED)

        for b in batches:
            for at in range(0, b.num_rows, 500):
                held.append(b.slice(at, 500))
                size += held[-1].column("piece").nbytes
                if size >= AT_ONCE:
                    yield from sums()
                    held, size = [], 0
        if held:
            yield from sums()

    return pieces.select("lang", "piece", "times").mapInArrow(run, "bucket int, sums binary")


def frequent_grams(pieces: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """``lang, gram, f, size`` of the n-grams of up to ``longest`` words that stand ``least`` times or more, overlaps included.

    A bucket is one task's; it is read as a stream and grouped out of core, so it needn't fit in memory. The scratch folder
    is the task's own and goes with it, as a spill does.
    """
    rough = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(8, -(-rough * longest // (6 * BUCKET))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = (part for b in batches for x in b.column("sums") for part in pa.ipc.open_stream(x.as_buffer()))
        with tempfile.TemporaryDirectory(prefix="grams-") as scratch, _connected() as con:
            con.execute(f"SET temp_directory='{os.path.join(scratch, 'spill')}'")
            con.register("bucket", pa.RecordBatchReader.from_batches(_SUMS, streams))
            got = con.sql(f"SELECT lang, gram, sum(f)::BIGINT AS f, (len(gram) - len(replace(gram, ' ', '')) + 1)::INTEGER AS size FROM bucket GROUP BY lang, gram HAVING sum(f) >= {int(least)}")
            for b in got.to_arrow_reader(20_000):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, _COUNTS, strict=True)], schema=_COUNTS)

    return _map_sums(pieces, longest, buckets).repartitionById(buckets, F.col("bucket")).mapInArrow(run, "lang string, gram string, f bigint, size int")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, keep: int = 2000, held_pct: int = 50, text: str = "text", group: str = "lang", no_group: str = "und") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each group's ``keep`` strongest phrases of 2 to ``longest`` words.

    ``a`` is how often a phrase stands, ``l`` and ``r`` how often the two parts of its weakest cut do, ``n`` the words of
    the group, ``score`` the whole part of 1,000,000 * a * a / (l * r), by exact decimals. Phrases below ``least`` are no
    candidates; those inside a longer candidate that stands at least ``held_pct`` % as often are dropped. Ties go to the
    larger ``a``, then to the smaller phrase by bytes, and of cuts to the earliest.

    Null and empty texts have no words, a null group is ``no_group``, repeated rows count as often as they stand, a very long
    piece is cut into words by one task; columns but ``text`` and ``group`` aren't read, whatever their names; an empty table
    gives an empty result.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words at least and stand once at least")
    stage = Staging(docs.sparkSession, "collocations")
    pieces = stage.put(distinct_pieces(docs, text, group, no_group), "pieces")
    words = F.length("piece") - F.length(F.translate("piece", " ", "")) + 1
    totals = stage.put(pieces.groupBy("lang").agg(F.sum(words * F.col("times")).alias("n")), "totals")
    counts = stage.put(frequent_grams(pieces, longest, least), "counts")
    stage.drop("pieces")
    asking = counts.where("size > 1").select("lang", F.col("gram").alias("phrase"), "size", F.col("f").alias("a"), F.split("gram", " ").alias("w"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(F.struct(part(F.lit(1), k).alias("gram"), k.alias("cut"), F.lit(True).alias("first")), F.struct(part(k + 1, F.col("size") - k).alias("gram"), k.alias("cut"), F.lit(False).alias("first"))))
    asked = asking.select("lang", "phrase", "size", "a", F.explode(F.flatten(cuts)).alias("q")).select("lang", "phrase", "size", "a", "q.*")
    answered = asked.join(counts.select("lang", "gram", "f"), ["lang", "gram"])
    of = F.when(F.col("first"), F.col("f")), F.when(~F.col("first"), F.col("f"))
    cut = answered.groupBy("lang", "phrase", "size", "a", "cut").agg(F.max(of[0]).alias("l"), F.max(of[1]).alias("r"))
    exact = F.expr("(1000000 * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    weakest = cut.withColumn("score", exact).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("weakest"))
    # what lies inside a phrase: its runs of two words or more but the whole, each told the count of what holds it
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: part(at, n))))
    held = asking.where("size > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("holder"))
    scored = stage.put(weakest.join(held, ["lang", "phrase"], "left").where(F.col("holder").isNull() | (100 * F.col("holder") < held_pct * F.col("a"))), "scored")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    flat = scored.select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score", F.pmod(F.xxhash64("phrase"), F.lit(16)).alias("salt"))
    some = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= keep)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= keep)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_query(spark, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two or three words in each language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, unnest(w) AS gram, 1 AS size FROM words
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM words
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM words
), f AS MATERIALIZED (
  SELECT lang, gram, any_value(size) AS size, count(*) AS f FROM grams GROUP BY lang, gram
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), cand AS (
  SELECT lang, gram AS phrase, size, f AS a, string_split(gram, ' ') AS w FROM f WHERE size > 1 AND f >= 10
), cuts AS MATERIALIZED (
  SELECT lang, phrase, a, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y, k FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM cand)
), firsts AS MATERIALIZED (
  SELECT c.*, f.f AS l FROM cuts c JOIN f ON f.lang = c.lang AND f.gram = c.x
), parts AS (
  SELECT p.lang, phrase, a, k, l, f.f AS r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * f.f))::BIGINT AS score FROM firsts p JOIN f ON f.lang = p.lang AND f.gram = p.y
), weakest AS (
  SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM cand WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE size = 3) GROUP BY lang, phrase
), ranked AS (
  SELECT x.lang, x.phrase, x.a, x.l, x.r, x.score, row_number() OVER (PARTITION BY x.lang ORDER BY x.score DESC, x.a DESC, x.phrase) AS rank
  FROM weakest x LEFT JOIN held h ON h.lang = x.lang AND h.phrase = x.phrase WHERE h.a IS NULL OR 100 * h.a < 50 * x.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
