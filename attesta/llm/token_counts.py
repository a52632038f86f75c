"""Token totals by source, language and tokenizer version, kept up by signed batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import byte_bpe
from attesta.plans.staging import Staging

KEYS = ["source", "lang", "version"]


def count_tokens(docs: DataFrame, path: str | None = None, version: str = "byte_bpe_50k", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, source, lang, version, n_tokens`` of each row; a null or empty text has 0 tokens.

    Rows don't affect each other, so repeats, null keys and an empty table need nothing special; a very long text is
    encoded whole by its task; other columns, a ``version`` or ``n_tokens`` of the input's own among them, aren't read.
    """
    path = path or byte_bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(path)
        for b in batches:
            n = pa.array([len(bpe.ids(t.as_py() or "")) // 4 for t in b.column("t")], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], n], ["k", "source", "lang", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("k"), "source", "lang", F.col(text).alias("t")).mapInArrow(run, f"k {kind}, source string, lang string, n_tokens bigint")
    return got.select(F.col("k").alias(key), "source", "lang", F.lit(version).alias("version"), "n_tokens")


def inserts(counts: DataFrame) -> DataFrame:
    """Counted documents that are new, as signed rows, one each; none of an empty table, null keys kept."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Counted documents that are gone: the same rows, null keys and repeats among them, with the opposite sign."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents counted anew: the old rows go, the new ones come, under whatever keys they now have."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Additive totals in ``path``: a folder for each committed batch, with one row a key.

    A batch's rows are summed and written to a folder of their own, which is then renamed to the batch's name: that is
    the commit, and of two jobs that commit one id at a time only one can do it. To commit an id again changes
    nothing, so a job that failed midway is simply run again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def committed(self, batch: str) -> bool:
        fs, p = self._fs(f"{self.path}/batch={batch}")
        return fs.exists(p)

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Adds the signed rows of ``batch``; False if that id was committed before.

        A batch without rows is committed like any other and adds nothing; null sources, languages and versions are keys;
        repeated rows count as often as they stand; columns but the keys, ``docs`` and ``tokens`` aren't read.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id is letters, digits, - and _")
        if self.committed(batch):
            return False
        sums = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        draft = f"{self.path}/draft-{uuid.uuid4().hex}"
        sums.write.parquet(draft)
        fs, source = self._fs(draft)
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # a rename without the option to replace fails if the batch is there by now
            files.rename(source, jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch}"), options)
        except Py4JJavaError:
            fs.delete(source, True)
            if not self.committed(batch):
                raise
            return False
        return True

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens``: sums over the committed batches; keys that are back at zero go.

        Null keys are a group of their own. Before the first commit there are no rows.
        """
        schema = "source string, lang string, version string, docs bigint, tokens bigint"
        fs, root = self._fs(self.path)
        found = [str(x.getPath()) for x in fs.listStatus(root)] if fs.exists(root) else []
        done = [p for p in found if "/batch=" in p]
        rows = self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def op4_query(spark, sf_dir: str) -> DataFrame:
    """Totals of all documents after a life of batches: four loads, one of them counted by an earlier version and revised,
    one taken out and put in again, and each batch sent twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = Staging(spark, "rollup")
    counts, rollup = stage.put(count_tokens(docs), "counts"), Rollup(spark, f"{stage.root}/totals")
    part = lambda k: counts.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k)
    early = part(1).withColumns({"version": F.lit("draft"), "n_tokens": F.col("n_tokens") + 1})
    batches = {f"load-{k}": inserts(early if k == 1 else part(k)) for k in range(4)}
    batches |= {"revise-1": revisions(early, part(1)), "remove-2": deletes(part(2)), "again-2": inserts(part(2))}
    for batch, signed in batches.items():
        rollup.commit(batch, signed)
        rollup.commit(batch, signed)
    return rollup.totals()
