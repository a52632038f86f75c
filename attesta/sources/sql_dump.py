"""Table dumps in SQL: statements are split by Spark, rows are read with their place and a hash.

A dump is read by lines, in Spark's splits. Whether a semicolon ends a statement depends on the quotes and comments
that are open before it, so a first pass tells for each split what it leaves open, whatever was open at its start; the
splits' answers are put together in order, and a second pass cuts each split from its true beginning on.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.plans.staging import LONG_VALUES, Staging, bounded_batches
from attesta.sources.ddl import Definition, defined
from attesta.sources.delimited import SourceError

#: The escapes that a string of the dump dialect has; of the last two the backslash stays.
ESCAPES = {"0": "\0", "'": "'", '"': '"', "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a", "\\": "\\", "%": "\\%", "_": "\\_"}
#: What may be open between two lines: nothing, one of three quotes, or a block comment.
STATES = ("", "'", '"', "`", "*")
#: Characters of a statement beyond which a dump is refused.
LONGEST = 16 << 20
#: Rows of a statement that a task makes at once.
PIECE = 2000
_MARK = re.compile(r"['\"`;#]|--(?=\s|\Z)|/\*")
_CLOSE = {"'": re.compile(r"[\\']"), '"': re.compile(r'[\\"]'), "`": re.compile("`"), "*": re.compile(r"\*/")}
_CREATE = re.compile(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?`?(\w+)`?\s*(\(.*)\Z", re.S | re.I)
_INSERT = re.compile(r"INSERT\s+INTO\s+`?(\w+)`?\s*(?:\(([^)]*)\))?\s*VALUES\s*(.*)\Z", re.S | re.I)
_HARMLESS = re.compile(r"(?:SET|LOCK\s+TABLES|UNLOCK\s+TABLES|USE|START\s+TRANSACTION|COMMIT|BEGIN|/\*!\d+\s+(?:SET|ALTER\s+TABLE\s+`?\w+`?\s+(?:DISABLE|ENABLE)\s+KEYS))\b", re.I)
_DROP = re.compile(r"DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?`?(\w+)`?\s*\Z", re.I)
SCHEMA = "table_name string, statement bigint, tuple bigint, columns array<string>, body map<string,string>, row_sha256 string"


def scan(line: str, state: str) -> tuple[list[int], str]:
    """Where a line's statements end, given what is open before it, and what is open after it."""
    ends, at = [], 0
    while True:
        if state:
            m = _CLOSE[state].search(line, at)
            if not m:
                return ends, state
            if m.group() == "\\":
                at = m.end() + 1
            else:  # a doubled quote closes and opens again
                state, at = "", m.end()
            continue
        m = _MARK.search(line, at)
        if not m or m.group() in ("#", "--"):
            return ends, ""
        at = m.end()
        if m.group() == ";":
            ends.append(m.start())
        else:
            state = "*" if m.group() == "/*" else m.group()


def uncommented(statement: str) -> str:
    """A statement without leading blanks and comments; versioned ones (``/*!``) are part of it."""
    at = 0
    while True:
        while at < len(statement) and statement[at].isspace():
            at += 1
        if statement.startswith(("#", "--"), at):
            end = statement.find("\n", at)
            at = len(statement) if end < 0 else end + 1
        elif statement.startswith("/*", at) and not statement.startswith("/*!", at):
            end = statement.find("*/", at + 2)
            if end < 0:
                raise SourceError("a comment does not end")
            at = end + 2
        else:
            return statement[at:].rstrip()


def _quoted(text: str, at: int) -> tuple[str, int]:
    """The string that opens at ``at``, unescaped, and where it ends."""
    out, start = [], at + 1
    while m := _CLOSE["'"].search(text, start):
        out.append(text[start : m.start()])
        after = text[m.end() : m.end() + 1]
        if m.group() == "\\" and after:
            out.append(ESCAPES.get(after, after))
        elif m.group() == "'" and after == "'":
            out.append("'")
        elif m.group() == "'":
            return "".join(out), m.end()
        else:
            break
        start = m.end() + 1
    raise SourceError(f"a string does not end: {text[at : at + 60]}")


def is_number(word: str) -> bool:
    """A decimal literal: digits with at most one point, a sign and an exponent if it has them."""
    mantissa, e, power = word.lstrip("+-").replace("E", "e").partition("e")
    whole, _, part = mantissa.partition(".")
    power = power[1:] if power[:1] in ("+", "-") else power
    plain = lambda x: x.isascii() and x.isdigit()
    return len(word) - len(word.lstrip("+-")) <= 1 and plain(whole + part) and (plain(power) if e else True)


def tuples(text: str, wanted: tuple[int, frozenset[str]] | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """``(number, values)`` of the rows of a VALUES list, as text: NULL is null, numbers stay as they are written.

    With ``wanted``, a place and the values it may have, other rows are passed over, but counted. Anything that is no
    literal fails.
    """
    at, number, end = 0, 0, len(text)

    def skip(at: int) -> int:
        while at < end and text[at].isspace():
            at += 1
        return at

    at = skip(at)
    while True:
        if at >= end or text[at] != "(":
            raise SourceError(f"unreadable values near: {text[at : at + 60]!r}")
        at, row, number = skip(at + 1), [], number + 1
        while True:
            if at < end and text[at] == "'":
                value, at = _quoted(text, at)
                at = skip(at)
            else:
                start = at
                while at < end and text[at] not in ",()'":
                    at += 1
                word = text[start:at].strip()
                if at < end and text[at] in "('" or not (word.upper() == "NULL" or is_number(word)):
                    raise SourceError(f"not a literal: {text[start : start + 80]!r}")
                value = None if word.upper() == "NULL" else word
            row.append(value)
            if at >= end or text[at] not in ",)":
                raise SourceError(f"unreadable values near: {text[at : at + 60]!r}")
            at += 1
            if text[at - 1] == ")":
                break
            at = skip(at)
        if wanted is None or len(row) > wanted[0] and row[wanted[0]] in wanted[1]:
            yield number, row
        at = skip(at)
        if at >= end:
            return
        if text[at] != ",":
            raise SourceError(f"unreadable values near: {text[at : at + 60]!r}")
        at = skip(at + 1)


def definition(table: str, text: str) -> Definition:
    """The definition of a table, from what follows its name."""
    return defined(table, text)


def classified(statement: str) -> tuple[str, str, str]:
    """``(kind, table, rest)`` of one statement; whatever could change rows in another way fails."""
    s = uncommented(statement)
    if not s or _HARMLESS.match(s):
        return "none", "", ""
    for kind, pattern in (("create", _CREATE), ("insert", _INSERT), ("drop", _DROP)):
        if m := pattern.match(s):
            return kind, m.group(1), json.dumps(m.groups()[1:])
    raise SourceError(f"statement is not allowed in a dump: {s[:80]}")


def _left_open(lines: DataFrame) -> DataFrame:
    """``f, b, after, ends``: for each split and each of ``STATES`` before it, the state after it and how many statements end.

    Ways that meet go on together, which they mostly do within a line or two.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, ways = None, []
        for pdf in frames:
            out = []
            for f, b, line in zip(pdf["f"], pdf["b"], pdf["value"], strict=True):
                if (f, b) != split:
                    if split:
                        out.append((*split, [w[0] for w in ways], [w[1] for w in ways]))
                    split, ways = (f, b), [[s, 0] for s in STATES]
                known: dict[str, tuple[int, str]] = {}
                for w in ways:
                    if w[0] not in known:
                        ends, after = scan(line, w[0])
                        known[w[0]] = len(ends), after
                    n, w[0] = known[w[0]]
                    w[1] += n
            if out:
                yield pd.DataFrame(out, columns=["f", "b", "after", "ends"])
        if split:
            yield pd.DataFrame([(*split, [w[0] for w in ways], [w[1] for w in ways])], columns=["f", "b", "after", "ends"])

    return lines.mapInPandas(run, "f string, b bigint, after array<string>, ends array<bigint>")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """``statement, kind, table_name, rest``: statements in file order, split wherever a semicolon ends one.

    Quotes, comments, several statements on a line, either line end and statements over several splits are
    followed; a statement of over ``LONGEST`` characters, a string or comment that does not end, and a last statement
    without its semicolon fail. The driver sees one small row a split. A task holds some statements at a time, however
    many its split has: they go to Python by bytes, and are staged in small row groups.
    """
    bounded_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    begins, open_, before, file = [], "", 0, None
    for r in sorted(_left_open(lines).collect(), key=lambda r: (r.f, r.b)):
        if r.f != file:
            if open_:
                raise SourceError(f"{file} ends inside a string or comment")
            open_, before, file = "", 0, r.f
        begins.append((r.f, r.b, open_, before))
        k = STATES.index(open_)
        open_, before = r.after[k], before + r.ends[k]
    if open_:
        raise SourceError(f"{file} ends inside a string or comment")
    if not begins:
        return spark.createDataFrame([], "statement bigint, kind string, table_name string, rest string")
    known = spark.sparkContext.broadcast({(f, b): (state, n) for f, b, state, n in begins})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, state, number, held, size, whole = None, "", 0, [], 0, False
        for pdf in frames:
            out = []
            for f, b, line in zip(pdf["f"], pdf["b"], pdf["value"], strict=True):
                if (f, b) != split:
                    if split and "".join(held).strip():
                        out.append((*split, number, "\n".join(held), whole, False))
                    split, held, size, whole = (f, b), [], 0, known.value[f, b] == ("", 0)
                    state, number = known.value[split]
                ends, state = scan(line, state)
                start = 0
                for end in ends:
                    out.append((f, b, number, "\n".join([*held, line[start:end]]), whole, True))
                    number, held, size, whole, start = number + 1, [], 0, True, end + 1
                held.append(line[start:])
                size += len(held[-1])
                if size > LONGEST:
                    raise SourceError(f"statement {number + 1} of {f} is longer than {LONGEST} characters")
            if out:
                yield pd.DataFrame(out, columns=["f", "b", "n", "part", "begins", "ends"])
        if split and "".join(held).strip():
            yield pd.DataFrame([(*split, number, "\n".join(held), whole, False)], columns=["f", "b", "n", "part", "begins", "ends"])

    stage = Staging(spark, "dump")
    parts = stage.put(lines.mapInPandas(cut, "f string, b bigint, n bigint, part string, begins boolean, ends boolean"), "parts", LONG_VALUES)
    whole = parts.where("begins and ends").select("f", "n", F.col("part").alias("s"))
    torn = parts.where("not (begins and ends)").groupBy("f", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "part"))), lambda x: x["part"]), "\n").alias("s"), F.bool_or("ends").alias("done"))
    torn = torn.select("f", "n", F.when(F.col("done"), F.col("s")).otherwise(F.concat("s", F.lit("\0"))).alias("s"))

    def classify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = []
            for f, n, s in zip(pdf["f"], pdf["n"], pdf["s"], strict=True):
                unended = s.endswith("\0")
                kind, table, rest = classified(s.removesuffix("\0"))
                if unended and kind != "none":
                    raise SourceError(f"the last statement of {f} does not end")
                if kind != "none":
                    got.append((f, n, kind, table, rest))
            yield pd.DataFrame(got, columns=["f", "n", "kind", "table_name", "rest"])

    kept = stage.put(whole.unionByName(torn).mapInPandas(classify, "f string, n bigint, kind string, table_name string, rest string"), "statements", LONG_VALUES)
    stage.drop("parts")
    order = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = kept.groupBy("f").agg(F.max("n").alias("m")).select("f", F.coalesce(F.sum(F.col("m") + 1).over(order), F.lit(0)).alias("o"))
    return kept.join(F.broadcast(files), "f").select((F.col("o") + F.col("n") + 1).alias("statement"), "kind", "table_name", "rest")


def framed(table: str, statement: int, names: list[str], found: Iterator[tuple[int, list[str | None]]]) -> Iterator[pd.DataFrame]:
    """The rows of one statement as frames of at most ``PIECE`` rows, each made when it is asked for, however many the statement has."""
    for piece in batched(found, PIECE):
        out = []
        for k, row in piece:
            if len(row) != len(names):
                raise SourceError(f"{table}: {len(row)} values for {len(names)} columns")
            body = dict(zip(names, row, strict=True))
            canon = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            out.append((table, statement, k, names, body, hashlib.sha256(canon.encode()).hexdigest()))
        yield pd.DataFrame(out, columns=["table_name", "statement", "tuple", "columns", "body", "row_sha256"])


def read_dump(spark: SparkSession, path: str, only: list[str] | None = None, where: dict[str, tuple[str, list[str]]] | None = None) -> tuple[dict[str, Definition], DataFrame]:
    """``(definitions by table, rows)``: every row of the dump, or of some tables, as text with its place and hash.

    Definitions come to the driver, rows don't. An insert must name known, distinct columns and give each a
    value; a column it leaves out is absent from ``body``. Dropping a table after it was defined fails. ``where`` names for
    a table a column and the values it may have; other rows are passed over before anything is made of them, and
    keep their numbers.
    """
    every = statements(spark, path)
    if only is not None:
        every = every.where(F.col("table_name").isin(only))
    tables: dict[str, Definition] = {}
    for r in every.where("kind <> 'insert'").orderBy("statement").collect():
        if r.kind == "create":
            if r.table_name in tables:
                raise SourceError(f"{r.table_name} is defined twice")
            tables[r.table_name] = definition(r.table_name, json.loads(r.rest)[0])
        elif r.table_name in tables:
            raise SourceError(f"{r.table_name} is dropped after it is defined")
    filters = {t: (c, frozenset(v)) for t, (c, v) in (where or {}).items()}
    for t, (c, _) in filters.items():
        if t not in tables or c not in tables[t].columns:
            raise SourceError(f"{t} has no column {c}")
    known = spark.sparkContext.broadcast(({t: d.columns for t, d in tables.items()}, filters))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, filters = known.value
        for pdf in frames:
            for table, statement, rest in zip(pdf["table_name"], pdf["statement"], pdf["rest"], strict=True):
                names, values = json.loads(rest)
                all_names = columns.get(table)
                if all_names is None:
                    raise SourceError(f"rows for {table}, which is not defined")
                names = [n.strip().strip("`") for n in names.split(",")] if names else all_names
                if len(set(names)) < len(names) or not set(names) <= set(all_names):
                    raise SourceError(f"{table}: unknown or repeated columns {names}")
                wanted = None
                if table in filters:
                    if filters[table][0] not in names:
                        continue
                    wanted = names.index(filters[table][0]), filters[table][1]
                yield from framed(table, statement, names, tuples(values, wanted))

    return tables, every.where("kind = 'insert'").mapInPandas(run, SCHEMA)


def table_digests(rows: DataFrame) -> DataFrame:
    """``table_name, n, digest``: an ordered hash of each table's row hashes."""
    from attesta.operators.reconcile import ordered_digest

    return ordered_digest(rows, ["table_name"], F.col("row_sha256"), ["statement", "tuple"])
