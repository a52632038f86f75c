"""SpotSigs: chains of content words after common words as a document's fingerprint."""

from __future__ import annotations

import hashlib
import math
from base64 import b64decode, b64encode
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attesta.plans.staging import Staging

#: Common words of English, German, French and Spanish, the anchors.
COMMON = frozenset(
    b"a an and are as at be but by for from had has have he in is it of on or she that the there they this to was were which with you"
    b" auf das dem den der des die ein eine er es ist mit nicht sich sie und von war zu"
    b" au aux ce dans est et il la le les ne par pas pour que qui sur un une"
    b" al con del el en la las los no para por se su una y".split()
)
#: A text with fewer chains than one for so many words is also read by plain chains of words.
SPARSE = 16
_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
CHAIN = 2
#: Kinds of signatures that are counted: what a task is sent to order a set's signatures by.
KINDS = 1 << 20


class _Words(dict):
    """64-bit hash of a word; the lowest bit says that it is common. Long words aren't kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word) & ~1 | (word in COMMON)
        if len(word) <= 24:
            if len(self) >= 300_000:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """Distinct signatures of a text, ascending: for each common word, it and the ``chain`` content words next after it.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Where common words are rare, as in code,
    tables or other languages, the text has a signature of each ``chain + 1`` words in a row besides, so that an edit
    never changes all of its fingerprint. A text too short for either has one signature, of all its words (or, without any,
    of the text itself); an empty text or null has none.
    """
    if not text:
        return np.zeros(0, np.uint32)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_SPACES).split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    common = (h & np.uint64(1)).astype(bool)
    content = np.flatnonzero(~common)
    after = (np.cumsum(~common)[common] if len(words) else np.zeros(0, int)).astype(np.int64)
    full = after + chain <= len(content)
    sig, after = _mixed(h[common][full]), after[full]
    for k in range(chain):
        sig = _mixed(sig + h[content[after + k]])
    if len(words) > chain and len(sig) * SPARSE < len(words):
        plain = h[: len(h) - chain]
        for k in range(1, chain + 1):
            plain = _mixed(plain + h[k : len(h) - chain + k])
        sig = np.concatenate([sig, plain])
    if not len(sig):
        return np.array([xxhash.xxh32_intdigest(b" ".join(words) or raw)], np.uint32)
    return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def as_text(sigs: np.ndarray) -> str:
    """The fingerprint: base 64 of the ascending little-endian 32-bit signatures."""
    return b64encode(sigs.astype("<u4").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two ascending signature sets; 0 without a look at them if their sizes rule out ``least``.

    Two empty sets are alike (1), an empty and another are not (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(both) - same)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _with_followers(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``(bucket, follower, none, k, h, t)``: rows by ranges of (key, hash), each range closed by the first row of the next.

    A sort by ranges of keys and hashes alone gives each range's first row; these, as many as there are
    ranges, are all that the driver sees. The texts are then dealt once, by range; there are four ranges to a
    partition, so that those that meet in one even out.
    """
    spark = docs.sparkSession
    none = "" if docs.schema[key].dataType == StringType() else 0
    ids = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"))
    order = (F.struct(F.col("k").isNotNull().alias("some"), "k", "h")).alias("o")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ids.select(order).repartitionByRange(4 * parts, "o").groupBy(F.spark_partition_id().alias("p")).agg(F.min("o").alias("o"))
    firsts = sorted((r.o.some, r.o.k if r.o.some else none, r.o.h) for r in ranges.collect())
    shared = spark.sparkContext.broadcast(firsts)

    @F.pandas_udf("array<int>")
    def bucket(some: pd.Series, k: pd.Series, h: pd.Series) -> pd.Series:
        out, first = [], shared.value
        for x in zip(some.tolist(), k.tolist(), h.tolist(), strict=True):
            b = bisect_right(first, x) - 1
            out.append([b, (b - 1) % len(first)] if first[b] == x else [b])
        return pd.Series(out)

    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("bs", bucket(F.col("k").isNotNull(), F.coalesce("k", F.lit(none).cast(docs.schema[key].dataType)), "h"))
    rows = rows.select(F.posexplode("bs").alias("follower", "bucket"), "k", "h", "t")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "follower", F.col("k").asc_nulls_first(), "h")


def compare_with_edits(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row of ``docs`` its fingerprint, that of its edited text, and likenesses.

    Columns ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The
    next document is the next by ascending key (null first; rows of one key by a hash of the text), after
    the last the first; a single row follows itself. A null text is an empty one. Only key and text are
    read, whatever the names of others. An empty table gives an empty result; a very long text is one set, made by its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, done = None, None, True
        names = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for b in batches:
            rows: list[tuple] = []
            cols = [b.column(c) for c in ("bucket", "follower", "k", "t")]
            for bucket, follower, k, t in zip(*cols, strict=True):
                bucket, t = bucket.as_py(), t.as_py()
                if bucket != at:
                    held, at, done = None, bucket, False
                if done:
                    continue
                own = signatures(t)
                if held:
                    old_k, old, sigs = held
                    new = edited(old, t)
                    new_sigs = signatures(new)
                    rows.append((old_k, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_text(sigs), as_text(new_sigs), likeness(sigs, new_sigs), likeness(sigs, own)))
                held, done = (k, t, own), bool(follower.as_py())
            got = list(zip(*rows, strict=True)) if rows else [()] * 7
            keys = pa.array([x.as_py() for x in got[0]], b.schema.field("k").type)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, kind) for x, kind in zip(got[1:], kinds, strict=True))], names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_followers(docs, text, key).select("bucket", "follower", "k", "t").mapInArrow(run, schema).withColumnRenamed("k", key)


def signature_sets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``sigs`` (ascending array of longs) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([signatures(t.as_py()).astype(np.int64) for t in b.column("t")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("k"), sets], ["k", "sigs"])

    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, sigs array<bigint>")
    return got.withColumnRenamed("k", key)


def near_pairs(docs: DataFrame, least: float = 0.8, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``key, class_id`` of each row, and ``a, b, likeness`` of classes alike by ``least`` or more.

    A class holds the rows of one signature set. Sets are partitioned by length so that a set's partners lie
    in its own partition or the next; there, sets meet over the signatures that are rarest by a histogram of ``KINDS``
    hashed signatures, of which two sets that are alike enough must share one among the first ``n - ceil(least * n) + 1`` in
    any one order. Posts hold a signature and its set's number; their sizes and places rule pairs out in the join, and the
    likeness of what is left is taken from the sets, once a pair. Rows without
    any signature form one class without partners. Repeated rows are members of one class, null keys are keys, a very long
    text is a long set, other columns aren't read, and an empty table gives two empty results.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    spark, stage = docs.sparkSession, Staging(docs.sparkSession, "spotsigs")
    each = signature_sets(docs, text, key).select(F.col(key).alias("k"), "sigs", F.sha2(F.array_join("sigs", " "), 256).alias("class_id"))
    each = stage.put(each.withColumn("sigs", F.col("sigs").cast("array<bigint>")), "each")
    number = F.conv(F.substring("class_id", 1, 15), 16, 10).cast("bigint")
    sets = stage.put(each.groupBy("class_id").agg(F.first("sigs").alias("sigs")).select("class_id", "sigs", number.alias("c")), "sets")
    often = np.zeros(KINDS, np.int64)
    counted = sets.select(F.explode("sigs").alias("s")).groupBy((F.col("s") % KINDS).cast("int").alias("kind")).agg(F.count("*").alias("n")).toPandas()
    often[counted["kind"].to_numpy(int)] = counted["n"].to_numpy(int)
    shared = spark.sparkContext.broadcast(often)

    def posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c", "n", "at", "s"]
        for b in batches:
            for c, sigs in zip(b.column("c").to_pylist(), b.column("sigs"), strict=True):
                x = sigs.values.to_numpy()
                n = len(x)
                rare = x[np.lexsort((x, shared.value[x % KINDS]))][: n - math.ceil(n * least - 1e-9) + 1] if n else x
                m = len(rare)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, c)), pa.array(np.full(m, n, np.int32)), pa.array(np.arange(m, dtype=np.int32)), pa.array(rare)], names)

    step = math.log(1 / least) if least < 1 else math.log(2)
    rare = sets.select("c", "sigs").mapInArrow(posts, "c bigint, n int, at int, s bigint").withColumn("band", F.floor(F.log("n") / step + 1e-9).cast("int"))
    one = rare.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).alias("one")
    two = rare.alias("two")
    before = (F.col("one.n") < F.col("two.n")) | ((F.col("one.n") == F.col("two.n")) & (F.col("one.c") < F.col("two.c")))
    # both share at most what lies before either place, and what lies from there on in the shorter rest
    left = F.least(F.col("one.n") - F.col("one.at"), F.col("two.n") - F.col("two.at"))
    must = (F.col("one.n") + F.col("two.n")) * (least / (1 + least)) - 1e-6
    on = (F.col("one.band") == F.col("two.band")) & (F.col("one.s") == F.col("two.s")) & before & (F.col("one.n") >= F.col("two.n") * (least - 1e-9)) & (F.least("one.at", "two.at") + left >= must)
    met = stage.put(one.join(two, on).select(F.col("one.c").alias("x"), F.col("two.c").alias("y")).distinct(), "met")
    held = lambda end, c: sets.select(F.col("c").alias(c), F.col("class_id").alias(end), F.col("sigs").alias(f"{end}s"))
    same = F.size(F.array_intersect("as", "bs"))
    like = same / (F.size("as") + F.size("bs") - same)
    pairs = met.join(held("a", "x"), "x").join(held("b", "y"), "y").select("a", "b", like.alias("likeness")).where(F.col("likeness") >= least - 1e-12)
    return each.select(F.col("k").alias(key), "class_id"), pairs


def spotsigs_pairs_query(spark, sf_dir: str) -> DataFrame:
    """Each document with the class of its fingerprint, how many documents have it, and how many classes are near it."""
    members, pairs = near_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_near"))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n_equal"))
    return members.join(sizes, "class_id").join(ends, "class_id", "left").select("doc_id", "class_id", "n_equal", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def op7_query(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
