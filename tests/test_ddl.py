import random

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest

from attesta.plans import staging
from attesta.queries import files
from attesta.sources import ddl, dump_table, sql_dump
from attesta.sources.delimited import SourceError

FULL = """(`id` int(11) unsigned NOT NULL AUTO_INCREMENT, `p` decimal(12,2) DEFAULT '0.00', n varchar(20) CHARACTER SET utf8 COLLATE utf8_bin DEFAULT 'a, (b)',
 `t` longtext COMMENT 'it''s; (x)', `d` datetime NULL, `x` double DEFAULT -1.5e3, `up` int, PRIMARY KEY (`id`,`P`), UNIQUE KEY `u` (`n`(4),`d`) USING BTREE, FULLTEXT KEY `f` (`t`),
 KEY `plain` (`x`), CONSTRAINT `self` FOREIGN KEY (`up`) REFERENCES `a` (`id`) ON DELETE CASCADE ON UPDATE NO ACTION) ENGINE=InnoDB AUTO_INCREMENT=7 DEFAULT CHARSET=utf8 COLLATE=utf8_bin"""


def test_definition():
    d = ddl.defined("a", FULL)
    assert d.schema() == "`id` bigint, `p` decimal(12,2), `n` string, `t` string, `d` timestamp_ntz, `x` double, `up` int"
    assert [(f.nullable, f.longest) for f in d.fields][:3] == [(False, None), (True, None), (True, 20)]
    assert d.keys == {"PRIMARY": ("id", "p"), "u": ("n", "d")}
    assert d.references == (ddl.Reference("self", ("up",), "a", ("id",)),)


@pytest.mark.parametrize(
    "text",
    [
        "(`a` blob)", "(`a` int, `A` int)", "(PRIMARY KEY (`a`))", "(`a` int, KEY `k` (`b`))", "(`a` int", "(`a` int) AS SELECT 1", "(`a` int DEFAULT now())", "(`a` varchar)", "(`a` int GENERATED)", "()", "(`a` int, CHECK (`a` > 1))", "(`a` int) ENGINE",
    ],
)
def test_unknown_definitions_fail(text):
    with pytest.raises(SourceError):
        ddl.defined("t", text)


def test_problems(spark, tmp_path):
    (tmp_path / "d.sql").write_text(
        "CREATE TABLE p (`id` int NOT NULL, `k` varchar(3), PRIMARY KEY (`id`), UNIQUE KEY `u` (`k`));\n"
        "CREATE TABLE c (`id` int NOT NULL, `p` int, `q` varchar(9), `n` tinyint NOT NULL, PRIMARY KEY (`id`), FOREIGN KEY (`p`, `q`) REFERENCES P (`ID`, `k`), CONSTRAINT `own` FOREIGN KEY (`p`) REFERENCES p (id));\n"
        "INSERT INTO p VALUES (1,'a'),(2,NULL),(3,NULL),(4,'long'),('5','e'),(5,'f'),(6,'a'),('x','g');\n"
        "INSERT INTO c (`id`,`p`,`q`,`n`) VALUES (1,1,'a',0),(2,'01','a',0),(3,9,NULL,0),(4,NULL,'z',300000),(5,1,'b',0);INSERT INTO c (`id`,`p`) VALUES (6,1);\n"
    )
    tables, rows = sql_dump.read_dump(spark, f"{tmp_path}/d.sql")
    got = {(r.table_name, r.key, r.name, r.problem) for r in ddl.dump_problems(rows, tables).collect()}
    assert got == {
        ("p", "4", "k", "too_long"), ("p", "5", "PRIMARY", "repeated_key"), ("p", "6", "u", "repeated_key"), ("p", "x", "id", "not_of_type"),
        ("c", "3", "own", "broken_reference"), ("c", "4", "n", "not_of_type"), ("c", "5", "c_1", "broken_reference"), ("c", "6", "n", "missing"),
    }
    assert ddl.typed_rows(rows, tables["p"]).schema.simpleString() == "struct<statement:bigint,tuple:bigint,id:int,k:string>"
    assert sorted(r.id for r in ddl.typed_rows(rows, tables["p"]).where("id is not null").collect()) == [1, 2, 3, 4, 5, 5, 6]
    with pytest.raises(SourceError):
        ddl.reference_problems(rows, tables["c"], {"c": tables["c"]})


def test_filters_reach_the_reader(spark, tmp_path):
    rows = ",".join(f"({i},{'NULL' if i % 5 == 0 else repr(chr(97 + i % 3))})" for i in range(1000))
    (tmp_path / "d.sql").write_text(f"CREATE TABLE `t` (`id` int, `k` text);\nCREATE TABLE `other` (`x` int);\nINSERT INTO `t` VALUES {rows};\nINSERT INTO `t` (`id`) VALUES (5000);\nINSERT INTO `other` VALUES (1);\n")
    t = dump_table.dump_table(spark, f"{tmp_path}/d.sql", "t")
    assert t.count() == 1001

    def made(df):
        """The rows that the reader made, as the plan's scan counts them."""
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().apply(0)
        return df.count(), leaf.metrics().apply("numOutputRows").value()

    for where, n in (("k = 'a'", 267), ("k in ('a', 'b') and id = '7'", 1), ("k is null", 201), ("k is not null and id in ('1', '5')", 1), ("k = 'a' and k = 'b'", 0)):
        got = t.where(where)
        assert made(got) == (n, n), where
        assert "Filter (" not in got._jdf.queryExecution().executedPlan().toString()
    assert made(t.where("id like '9%' and k = 'a'")) == (31, 267)
    with pytest.raises(SourceError):
        dump_table.dump_table(spark, f"{tmp_path}/d.sql", "none")


def test_reader_alone():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull

    r = dump_table.DumpReader({"path": "/x", "columns": '["a", "b"]'})
    left = list(r.pushFilters([EqualTo(("a",), "1"), GreaterThan(("a",), "0"), In(("a",), ("1", "2")), IsNull(("b",)), EqualTo(("c",), "1")]))
    assert [type(x).__name__ for x in left] == ["GreaterThan", "EqualTo"] and r.wanted == {"a": frozenset("1")} and r.null == {"b": True}
    assert list(r._decoded(3, '[null, "(1,NULL),(1,2),(2,NULL)"]')) == [(3, 1, "1", None)]
    assert list(r._decoded(3, '["`b`", "(NULL)"]')) == []


def test_long_statements_are_held_some_at_a_time(spark, tmp_path):
    r = random.Random(5)
    (tmp_path / "d.sql").write_text("CREATE TABLE `t` (`x` text);\n" + "".join(f"INSERT INTO `t` VALUES ('{r.randbytes(1 << 19).hex()}');\n" for _ in range(24)))
    old = spark.conf.get(staging._BATCH, None)
    spark.conf.unset(staging._BATCH)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        got = sql_dump.statements(spark, f"{tmp_path}/d.sql")
        at_once = got.mapInPandas(lambda frames: (pd.DataFrame({"n": [f["rest"].str.len().sum()]}) for f in frames), "n bigint").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.set(staging._BATCH, old) if old is not None else spark.conf.unset(staging._BATCH)
    assert sum(x.n for x in at_once) > 24 << 20 and max(x.n for x in at_once) <= 2 * staging.BATCH_BYTES
    staged = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in got.inputFiles()]
    sizes = [m.row_group(g).total_byte_size for m in staged for g in range(m.num_row_groups)]
    assert sum(sizes) > 24 << 20 and max(sizes) <= 4 * staging.BATCH_BYTES


def test_a_dump_of_more_rows_has_more_statements(spark, tmp_path):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    c.execute("CREATE TABLE orders AS SELECT (199 * i + 5)::BIGINT AS o_orderkey, (1240 * (i % 70) + 2)::BIGINT AS o_custkey, i + 0.5::DOUBLE AS o_totalprice, TIMESTAMP '2024-01-01' + to_days((i % 300)::INT) AS o_orderdate FROM range(6001) t(i)")
    c.execute("CREATE TABLE customer AS SELECT (1240 * (i // 2) + 2 + i % 2)::BIGINT AS c_custkey, 'SOME' AS c_mktsegment FROM range(6000) t(i)")
    for t in ("orders", "customer"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    rows = {}
    for line in spark.read.text(files._dump(spark, str(tmp_path))).where("value like 'INSERT%'").collect():
        rows.setdefault(line.value[13], []).append([int(x.partition(",")[0]) for x in line.value.partition("(")[2].split("),(")])
    assert {t: sum(map(len, s)) for t, s in rows.items()} == {"o": 6001, "c": 6000}
    assert max(len(s) for t in rows.values() for s in t) <= files.STATEMENT_KEYS
    assert all(s == sorted(s) and {k - k % 2 for k in s} <= set(s) for s in rows["c"])
    for name in ("q_s14_typed_rows", "q_s14_broken_rows"):
        df = files.QUERIES[name](spark, str(tmp_path))
        got = [tuple(r) for r in df.collect()]
        want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({files.ORACLE[name]})").fetchall()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and got
