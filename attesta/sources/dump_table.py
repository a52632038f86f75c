"""One table of a dump as a data source: a plan's filters on its columns reach the reader, before rows are made."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

from attesta.plans.staging import LONG_VALUES, Staging
from attesta.sources import sql_dump
from attesta.sources.delimited import SourceError

FORMAT = "dump_table"


class _Rows(InputPartition):
    def __init__(self, path: str, group: int):
        super().__init__((path, group))
        self.path, self.group = path, group


class DumpReader(DataSourceReader):
    """Reads the VALUES lists that ``sql_dump.statements`` cut, a row group a partition."""

    def __init__(self, options: dict[str, str]):
        self.root, self.columns = options["path"], json.loads(options["columns"])
        self.wanted: dict[str, frozenset[str]] = {}
        self.null: dict[str, bool] = {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Equality, membership and null tests of columns are taken; what is left goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.columns and isinstance(f, EqualTo | In):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            elif name in self.columns and isinstance(f, IsNull | IsNotNull) and self.null.get(name, isinstance(f, IsNull)) == isinstance(f, IsNull):
                self.null[name] = isinstance(f, IsNull)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, folder = FileSystem.from_uri(self.root)
        files = [f.path for f in store.get_file_info(FileSelector(folder)) if f.path.endswith(".parquet")]
        return [_Rows(f, g) for f in sorted(files) for g in range(pq.ParquetFile(f, filesystem=store).num_row_groups)] or [_Rows("", 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = FileSystem.from_uri(self.root)
        held: list[tuple] = []
        schema = pa.schema([("statement", pa.int64()), ("tuple", pa.int64()), *[(c, pa.string()) for c in self.columns]])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
        for group in pq.ParquetFile(partition.path, filesystem=store).iter_batches(64, [partition.group], ["statement", "rest"]):
            for statement, rest in zip(group.column("statement").to_pylist(), group.column("rest").to_pylist(), strict=True):
                for row in self._decoded(statement, rest):
                    held.append(row)
                    if len(held) == 10_000:
                        yield batch()
                        held.clear()
        if held:
            yield batch()

    def _decoded(self, statement: int, rest: str) -> Iterator[tuple]:
        given, values = json.loads(rest)
        names = [n.strip().strip("`") for n in given.split(",")] if given else self.columns
        if len(set(names)) < len(names) or not set(names) <= set(self.columns):
            raise SourceError(f"statement {statement}: unknown or repeated columns {names}")
        place = {c: i for i, c in enumerate(names)}
        if any(c not in place for c in self.wanted):
            return
        tests = [(place[c], v) for c, v in self.wanted.items()]
        for k, row in sql_dump.tuples(values, tests[0] if tests else None):
            if len(row) != len(names):
                raise SourceError(f"statement {statement}: {len(row)} values for {len(names)} columns")
            if all(row[i] in v for i, v in tests[1:]) and all(((c not in place) or row[place[c]] is None) == null for c, null in self.null.items()):
                yield (statement, k, *[row[place[c]] if c in place else None for c in self.columns])


class DumpTable(DataSource):
    """``spark.read.format("dump_table")``: columns as text, with the statement and the tuple that each row stands in."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "statement bigint, tuple bigint, " + ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return DumpReader(dict(self.options))


def dump_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a dump, as text; ``where`` on its columns is handed to the reader, so rows that fail it are never made.

    Statements are cut once, in Spark's splits, and written to the shared folder, which must be of a kind that Arrow's file systems
    open (a mounted folder, HDFS, an object store); the reader's tasks take row groups from there.
    """
    every = sql_dump.statements(spark, path).where(F.col("table_name") == name)
    staged = Staging(spark, "dumptable")
    kept = staged.put(every, "statements", LONG_VALUES)
    made = [json.loads(r.rest)[0] for r in kept.where("kind = 'create'").collect()]
    if len(made) != 1:
        raise SourceError(f"{name} is defined {len(made)} times")
    staged.put(kept.where("kind = 'insert'").select("statement", "rest"), "inserts", LONG_VALUES)
    spark.dataSource.register(DumpTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    columns = sql_dump.definition(name, made[0]).columns
    return spark.read.format(FORMAT).options(columns=json.dumps(columns)).load(f"{staged.root}/inserts")
