"""Queries over the given tables for text rules, similarity, lifecycle and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import chemistry, text
from attesta.functions.values import mod10
from attesta.operators import documents, similarity
from attesta.session import table
from attesta.streaming import lifecycle


def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(mod10("o_orderkey").cast("long").alias("digit")).groupBy("digit").agg(F.count("*").alias("n"))


def regex_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("(?i)licen[cs]e")).cast("long").alias("n"), F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"))


def citation_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets written from order keys; wrong ranges are reported."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 50).alias("a"), (F.col("o_orderkey") * 7 % 40 + 1).alias("b"))
    written = o.withColumn("t", F.concat(F.lit("x ["), "a", F.lit(", "), "b", F.lit("-"), F.col("b") + F.col("a") % 5 - 1, F.lit("; 7] [C#] y [1,,2]")))
    got = text.citations(written, "o_orderkey", "t")
    return got.groupBy("number", "problem").agg(F.count("*").alias("n"))


def label_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 6 + 1).alias("a"))
    written = F.concat(F.lit("see Figs. S"), "a", F.lit("-"), F.col("a") + 2, F.lit(" and "), "a", F.lit("b; Table 3."))
    return p.select(F.explode(text.label_references(written)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("text", (F.col("doc_id") % 40).alias("s"), (F.col("doc_id") % 40 + F.col("doc_id") % 7).alias("e"))
    d = d.withColumn("quote", F.when(F.col("s") % 3 == 0, F.upper(F.expr("substring(text, cast(s as int) + 1, cast(e - s as int))"))).otherwise(F.expr("substring(text, cast(s as int) + 1, cast(e - s as int))")))
    return d.select(text.span_holds("text", "s", "e", "quote").alias("holds")).groupBy("holds").agg(F.count("*").alias("n"))


def a1_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 700
    letters = F.concat(F.when(n >= 26, F.chr(n / 26 + 64)).otherwise(""), F.chr(n % 26 + 65))
    return table(spark, sf_dir, "part").select("p_partkey", text.column_index(letters).cast("long").alias("idx"))


def range_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits fitted on even keys, applied to all."""
    part = table(spark, sf_dir, "part")
    fit = part.where("p_partkey % 2 = 0").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    scaled, bin_ = text.range_bin("p_retailprice", "lo", "hi", 4)
    return part.join(F.broadcast(fit)).select(bin_.cast("long").alias("bin"), scaled.alias("s")).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"))


def tanimoto(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("m"))
    got = similarity.tanimoto_pairs(b, "item_id", "m", 0.1)
    return got.select("a", "b", F.round("tanimoto", 6).alias("tanimoto"))


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    near = similarity.cosine_top_k(e.where("vec_id % 50 = 0"), e, 3, "vec_id", "embedding")
    return similarity.knn_mean(near, 3).select(F.col("query_id").alias("vec_id"), F.round("score", 5).alias("score"))


def domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain of the vectors whose id is divisible by 50 among all others; the cutoff comes from the references whose id leaves 25, each judged without its label's group."""
    e = table(spark, sf_dir, "embeddings")
    refs, asked = e.where("vec_id % 50 <> 0"), e.where("vec_id % 50 = 0")
    cut = similarity.domain_cutoff(refs, 2, "vec_id", "embedding", "label", 0.05, F.col("vec_id") % 50 == 25)
    scores = similarity.knn_mean(similarity.cosine_top_k(asked, refs, 2, "vec_id", "embedding"), 2)
    return similarity.in_domain(scores, asked, "vec_id", cut).groupBy("in_domain").agg(F.count("*").alias("n"))


def compute_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structure function of each distinct text; here the hook counts words."""
    chemistry.register("graph_facts", lambda t: len(t.split(" ")), "bigint")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chemistry.once_each(d, "text", "graph_facts", "words").select("doc_id", "words")


def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.json_facts(table(spark, sf_dir, "events"), ["event_id"], "props", dotted=True, raw=True).groupBy("path", "value").agg(F.count("*").alias("n"))


def _stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "changed").when(F.col("event_type").isin("click", "view"), "accepted").otherwise("noted")
    return table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5).cast("int").alias("stage"), "event_id", kind.alias("kind"))


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lifecycle.stage_states(_stage_events(spark, sf_dir), "user_id", "stage", "event_id", "kind")
    return got.select("user_id", "stage", "state", "ready")


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])


def latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latched(table(spark, sf_dir, "events"), ["user_id"], "event_type", "purchase").groupBy("exposed").agg(F.count("*").alias("n"))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lifecycle.windowed(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 day")
    return got.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lifecycle.windowed(table(spark, sf_dir, "events"), "ts", [], "12 hours", "6 hours")
    return got.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("total", 4).alias("total"))


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lifecycle.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours")
    return got.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {
    "q_f01_checksum": checksum, "q_f02_regex_count": regex_count, "q_f05_citation_expand": citation_expand, "q_f06_label_references": label_refs, "q_f14_spans": spans,
    "q_f16_a1_index": a1_index, "q_f21_range_bins": range_bins, "q_f22_tanimoto": tanimoto, "q_j17_topk_similarity": top_k, "q_d08_domain": domain, "q_d06_compute_once": compute_once,
    "q_p24_flatten": flatten, "q_z02_cascade": cascade, "q_z04_latch": latch, "q_z06_latest_state": latest, "ext_tumbling": tumbling, "ext_sliding": sliding, "ext_session": session,
}

ORACLE = {
    "q_f01_checksum": """SELECT (list_sum(list_transform(generate_series(1, len(s)), lambda i: i * s[len(s) - i + 1]::INT)) % 10)::BIGINT AS digit, count(*) AS n FROM (SELECT o_orderkey::VARCHAR AS s FROM orders) GROUP BY 1""",
    "q_f02_regex_count": "SELECT doc_id, len(regexp_extract_all(text, '(?i)licen[cs]e')) AS n, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents",
    "q_f05_citation_expand": """WITH o AS (SELECT o_orderkey % 50 AS a, o_orderkey * 7 % 40 + 1 AS b FROM orders), r AS (SELECT *, b + a % 5 - 1 AS e FROM o),
      c AS (SELECT row_number() OVER () AS i, a, b, e FROM r), d AS (SELECT i, unnest(list_distinct(CASE WHEN e < b THEN [a] ELSE list_concat([a, 7::BIGINT], generate_series(b, e)) END)) AS number FROM c)
      SELECT number, NULL::VARCHAR AS problem, count(*) AS n FROM d GROUP BY 1 UNION ALL SELECT NULL, 'descending', count(*) FROM c WHERE e < b UNION ALL SELECT NULL, 'malformed', count(*) FROM c""",
    "q_f06_label_references": """WITH p AS (SELECT p_partkey % 6 + 1 AS a FROM part) SELECT label, count(*) AS n FROM (SELECT unnest(list_distinct(['S' || a, 'S' || (a + 1), 'S' || (a + 2), a::VARCHAR])) AS label FROM p) GROUP BY 1""",
    "q_f14_spans": """WITH d AS (SELECT text, doc_id % 40 AS s, doc_id % 40 + doc_id % 7 AS e FROM documents), q AS (SELECT *, substring(text, s + 1, e - s) AS t FROM d)
      SELECT e > s AND e <= length(text) AND t = (CASE WHEN s % 3 = 0 THEN upper(t) ELSE t END) AS holds, count(*) AS n FROM q GROUP BY 1""",
    "q_f16_a1_index": "SELECT p_partkey, (CASE WHEN p_partkey % 700 >= 26 THEN (p_partkey % 700) // 26 * 26 ELSE 0 END + (p_partkey % 700) % 26 + 1)::BIGINT AS idx FROM part",
    "q_f21_range_bins": """WITH f AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part WHERE p_partkey % 2 = 0), s AS (SELECT least(1, greatest(0, (p_retailprice - lo) / (hi - lo))) AS s FROM part, f)
      SELECT least(floor(s * 4), 3)::BIGINT AS bin, count(*) AS n, round(avg(s), 6) AS mean FROM s GROUP BY 1""",
    "q_f22_tanimoto": """WITH t AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS m FROM benchmark)
      SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.m, y.m)) / (len(x.m) + len(y.m) - len(list_intersect(x.m, y.m))), 6) AS tanimoto FROM t x JOIN t y ON x.item_id < y.item_id WHERE len(list_intersect(x.m, y.m)) >= 0.1::DOUBLE * (len(x.m) + len(y.m) - len(list_intersect(x.m, y.m)))""",
    "q_j17_topk_similarity": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id, r.vec_id AS ref, list_cosine_similarity(q.v, r.v) AS c FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
      k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, ref) AS n FROM s) SELECT vec_id, round(avg(c), 5) AS score FROM k WHERE n <= 3 GROUP BY 1""",
    "q_d08_domain": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT * FROM e WHERE vec_id % 50 <> 0),
      own AS (SELECT q.vec_id, list_cosine_similarity(q.v, r.v) AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, r.v) DESC) AS k FROM r q JOIN r ON q.label <> r.label WHERE q.vec_id % 50 = 25),
      os AS (SELECT avg(c) AS s FROM own WHERE k <= 2 GROUP BY vec_id), cut AS (SELECT list_sort(list(s))[(floor((count(*) - 1) * 0.05::DOUBLE) + 1)::INT] AS c FROM os),
      al AS (SELECT q.vec_id, list_cosine_similarity(q.v, r.v) AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, r.v) DESC) AS k FROM (SELECT * FROM e WHERE vec_id % 50 = 0) q, r),
      sc AS (SELECT vec_id, avg(c) AS s FROM al WHERE k <= 2 GROUP BY 1) SELECT s >= (SELECT c FROM cut) AS in_domain, count(*) AS n FROM sc GROUP BY 1""",
    "q_d06_compute_once": "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS words FROM documents",
    "q_p24_flatten": "SELECT 'k' AS path, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 2",
    "q_z02_cascade": """WITH s AS (SELECT user_id, (event_id % 5)::INT AS stage, max(CASE WHEN event_type IN ('click','view') THEN event_id END) AS a, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS c FROM events GROUP BY 1, 2),
      t AS (SELECT *, max(c) OVER (PARTITION BY user_id ORDER BY stage) AS w FROM s), u AS (SELECT user_id, stage, CASE WHEN a IS NULL THEN 'pending' WHEN w > a THEN 'stale' ELSE 'accepted' END AS state FROM t)
      SELECT user_id, stage, state, coalesce(bool_and(state = 'accepted') OVER (PARTITION BY user_id ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ready FROM u""",
    "q_z04_latch": "SELECT exposed, count(*) AS n FROM (SELECT user_id, bool_or(event_type = 'purchase') AS exposed FROM events GROUP BY 1) GROUP BY 1",
    "q_z06_latest_state": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "ext_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "ext_sliding": """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR AS s, value FROM events, (VALUES (0), (1)) v(i))
      SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1""",
    "ext_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER o + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
      k AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM k GROUP BY user_id, s""",
}
