"""Table definitions of a dump: columns, types, keys and references, and what rows break of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.sources.delimited import SourceError

#: The column types of a dump and Spark's; of integers the signed and the unsigned one.
INTEGERS = {"tinyint": ("smallint", "smallint"), "smallint": ("smallint", "int"), "mediumint": ("int", "int"), "int": ("int", "bigint"), "integer": ("int", "bigint"), "bigint": ("bigint", "decimal(20,0)")}
REALS = {"float": "float", "double": "double"}
EXACT = ("decimal", "numeric")
BOUNDED = ("varchar", "char")
TEXTS = ("tinytext", "text", "mediumtext", "longtext")
TIMES = {"date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz"}
_TOKEN = re.compile(r"\s*(?:(`[^`]+`)|('(?:[^'\\]|\\.|'')*')|([+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(\w+)|(.))", re.S)
_KINDS = ("name", "text", "number", "word", "sign")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = True
    longest: int | None = None
    default: str | None = None


@dataclass(frozen=True)
class Reference:
    name: str
    columns: tuple[str, ...]
    table: str
    parents: tuple[str, ...]


@dataclass(frozen=True)
class Definition:
    """A table: its columns in order, its primary and unique keys by name, and its references to other tables."""

    table: str
    fields: tuple[Field, ...]
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    references: tuple[Reference, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def schema(self) -> str:
        """The columns and their Spark types."""
        return ", ".join(f"`{f.name}` {f.type}" for f in self.fields)


class _Words:
    """The tokens of a definition, taken one after another."""

    def __init__(self, text: str):
        self.tokens, self.at = [], 0
        for m in _TOKEN.finditer(text.rstrip()):
            self.tokens.append((_KINDS[m.lastindex - 1], m.group(m.lastindex)))

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        kind, value = self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")
        return kind, value.upper() if kind == "word" else value

    def take(self, *want: str) -> bool:
        """Whether the next tokens are these words or signs; they are taken if so."""
        if [self.peek(i)[1] if self.peek(i)[0] in ("word", "sign") else None for i in range(len(want))] == list(want):
            self.at += len(want)
            return True
        return False

    def need(self, *want: str) -> None:
        if not self.take(*want):
            raise SourceError(f"definition: {' '.join(want)} expected near {' '.join(v for _, v in self.tokens[self.at : self.at + 6])!r}")

    def value(self, *kinds: str) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind not in kinds:
            raise SourceError(f"definition: {' or '.join(kinds)} expected, not {value!r}")
        self.at += 1
        return value.strip("`") if kind == "name" else value

    def names(self) -> tuple[str, ...]:
        """A list of columns in brackets; a length after one, for prefixes, is passed over."""
        out = []
        self.need("(")
        while True:
            out.append(self.value("name", "word"))
            if self.take("("):
                self.value("number")
                self.need(")")
            if not self.take(","):
                self.need(")")
                return tuple(out)


def _field(words: _Words) -> Field:
    name, kind = words.value("name", "word"), words.value("word").lower()
    sizes = []
    if words.take("("):
        sizes.append(int(words.value("number")))
        if words.take(","):
            sizes.append(int(words.value("number")))
        words.need(")")
    nullable, unsigned, default = True, False, None
    while True:
        if words.take("NOT", "NULL"):
            nullable = False
        elif words.take("UNSIGNED"):
            unsigned = True
        elif words.take("NULL") or words.take("AUTO_INCREMENT") or words.take("ZEROFILL"):
            pass
        elif words.take("COLLATE") or words.take("CHARACTER", "SET"):
            words.value("word")
        elif words.take("COMMENT"):
            words.value("text")
        elif words.take("DEFAULT"):
            given = words.value("text", "number", "word")
            if words.tokens[words.at - 1][0] == "word" and given.upper() not in ("NULL", "CURRENT_TIMESTAMP"):
                raise SourceError(f"definition: the default of {name} is no literal")
            default = None if given.upper() == "NULL" else given
        else:
            break
    if kind in INTEGERS and len(sizes) < 2:
        return Field(name, INTEGERS[kind][unsigned], nullable, None, default)
    if kind in REALS:
        return Field(name, REALS[kind], nullable, None, default)
    if kind in EXACT:
        return Field(name, f"decimal({','.join(map(str, [*sizes, 0][:2] if sizes else [10, 0]))})", nullable, None, default)
    if kind in BOUNDED and len(sizes) == 1:
        return Field(name, "string", nullable, sizes[0], default)
    if kind in TEXTS and not sizes:
        return Field(name, "string", nullable, None, default)
    if kind in TIMES:
        return Field(name, TIMES[kind], nullable, None, default)
    raise SourceError(f"definition: {name} has an unknown type {kind}")


def defined(table: str, text: str) -> Definition:
    """The definition in what follows ``CREATE TABLE name``: ``(columns and keys) options``.

    Anything that is no column of a known type, no key, no reference and no known option fails, as do a missing or repeated column
    and a key over columns that aren't there. Names are compared without regard to case.
    """
    words, fields, keys, plain, references = _Words(text), [], {}, [], []
    words.need("(")
    while True:
        if words.take("PRIMARY", "KEY"):
            keys["PRIMARY"] = words.names()
        elif words.take("CONSTRAINT") or (words.peek() == ("word", "FOREIGN")):
            name = words.value("name", "word") if words.peek() != ("word", "FOREIGN") else f"{table}_{len(references) + 1}"
            words.need("FOREIGN", "KEY")
            columns = words.names()
            words.need("REFERENCES")
            references.append(Reference(name, columns, words.value("name", "word"), words.names()))
            while words.take("ON"):
                words.value("word")
                if not (words.take("SET", "NULL") or words.take("NO", "ACTION")):
                    words.value("word")
        elif words.peek()[0] == "word" and words.peek()[1] in ("UNIQUE", "KEY", "INDEX", "FULLTEXT", "SPATIAL"):
            unique = words.take("UNIQUE")
            _ = words.take("FULLTEXT") or words.take("SPATIAL")
            _ = words.take("KEY") or words.take("INDEX")
            name = words.value("name", "word") if words.peek() != ("sign", "(") else f"key_{len(keys)}"
            columns = words.names()
            if unique:
                keys[name] = columns
            plain.append(columns)
            if words.take("USING"):
                words.value("word")
        else:
            fields.append(_field(words))
        if not words.take(","):
            words.need(")")
            break
    while words.peek()[0] != "end":
        _ = words.take("DEFAULT")
        if not (words.take("CHARACTER", "SET") or any(words.take(w) for w in ("ENGINE", "AUTO_INCREMENT", "CHARSET", "COLLATE", "ROW_FORMAT", "COMMENT"))):
            raise SourceError(f"definition of {table}: unknown option {words.peek()[1]!r}")
        words.take("=")
        words.value("word", "number", "text")
    names = {f.name.casefold(): f.name for f in fields}
    if not fields or len(names) < len(fields):
        raise SourceError(f"definition of {table}: no or repeated columns")
    for columns in [*keys.values(), *plain, *(r.columns for r in references)]:
        if unknown := [c for c in columns if c.casefold() not in names]:
            raise SourceError(f"definition of {table}: a key over unknown columns {unknown}")
    own = lambda columns: tuple(names[c.casefold()] for c in columns)
    return Definition(table, tuple(fields), {k: own(v) for k, v in keys.items()}, tuple(Reference(r.name, own(r.columns), r.table, r.parents) for r in references))


def value_of(f: Field) -> Column:
    """A column's value in ``body``, by its type; null if it is missing or not of the type."""
    raw = F.col("body")[f.name]
    return raw if f.type == "string" else F.btrim(raw).try_cast(f.type)


def typed_rows(rows: DataFrame, definition: Definition) -> DataFrame:
    """``statement, tuple`` and a table's columns by their types, of rows that ``sql_dump.read_dump`` gives."""
    own = rows.where(F.col("table_name") == definition.table)
    return own.select("statement", "tuple", *[value_of(f).alias(f.name) for f in definition.fields])


def _place(own: DataFrame, definition: Definition, *more: Column) -> DataFrame:
    key = F.concat_ws(",", *[F.col("body")[c] for c in definition.keys.get("PRIMARY", ())])
    return own.select(F.col("table_name"), "statement", "tuple", key.alias("key"), *more)


def value_problems(rows: DataFrame, definition: Definition) -> DataFrame:
    """``table_name, statement, tuple, key, name, problem`` of values that are ``missing``, ``not_of_type`` or ``too_long``."""
    own = rows.where(F.col("table_name") == definition.table)

    def problem(f: Field) -> Column:
        raw = F.col("body")[f.name]
        absent = F.when(raw.isNull() & F.lit(not f.nullable and f.default is None), "missing")
        long = absent.when(F.char_length(raw) > f.longest, "too_long") if f.longest is not None else absent
        return long.when(raw.isNotNull() & value_of(f).isNull(), "not_of_type")

    found = F.filter(F.array(*[F.struct(F.lit(f.name).alias("name"), problem(f).alias("problem")) for f in definition.fields]), lambda x: x["problem"].isNotNull())
    return _place(own, definition, F.inline(found))


def key_problems(rows: DataFrame, definition: Definition) -> DataFrame:
    """The same columns for rows whose key another row has, all but the first of them by place; keys with a null never meet."""
    by = {f.name: value_of(f) for f in definition.fields}
    own = rows.where(F.col("table_name") == definition.table)
    parts = []
    for name, columns in definition.keys.items():
        whole = reduce(lambda a, b: a & b, [by[c].isNotNull() for c in columns])
        keyed = _place(own.where(whole), definition, F.to_json(F.struct(*[by[c].alias(c) for c in columns])).alias("value"))
        first = keyed.groupBy("value").agg(F.min(F.struct("statement", "tuple")).alias("first"), F.count("*").alias("n")).where("n > 1")
        later = keyed.join(first, "value").where(F.struct("statement", "tuple") > F.col("first"))
        parts.append(later.select("table_name", "statement", "tuple", "key", F.lit(name).alias("name"), F.lit("repeated_key").alias("problem")))
    return reduce(DataFrame.unionByName, parts) if parts else value_problems(rows.limit(0), definition)


def reference_problems(rows: DataFrame, definition: Definition, others: dict[str, Definition]) -> DataFrame:
    """The same columns for rows that refer to a row that isn't there: one anti-join for each reference.

    A reference with a null refers to nothing. Values are compared by the type of the column referred to. References to
    tables or columns that the dump doesn't define fail.
    """
    parts = []
    for r in definition.references:
        parent = {k.casefold(): d for k, d in others.items()}.get(r.table.casefold())
        fields = {f.name.casefold(): f for f in parent.fields} if parent else {}
        if not parent or len(r.parents) != len(r.columns) or any(c.casefold() not in fields for c in r.parents):
            raise SourceError(f"{r.name} refers to {r.table}{r.parents}, which is not defined")
        of = [fields[c.casefold()] for c in r.parents]
        mine = [F.col("body")[c] if f.type == "string" else F.btrim(F.col("body")[c]).try_cast(f.type) for c, f in zip(r.columns, of, strict=True)]
        given = reduce(lambda a, b: a & b, [F.col("body")[c].isNotNull() for c in r.columns])
        names = [f"r{i}" for i in range(len(of))]
        child = _place(rows.where((F.col("table_name") == definition.table) & given), definition, *[m.alias(n) for m, n in zip(mine, names, strict=True)])
        known = rows.where(F.col("table_name") == parent.table).select(*[value_of(f).alias(n) for f, n in zip(of, names, strict=True)])
        parts.append(child.join(known, names, "left_anti").select("table_name", "statement", "tuple", "key", F.lit(r.name).alias("name"), F.lit("broken_reference").alias("problem")))
    return reduce(DataFrame.unionByName, parts) if parts else value_problems(rows.limit(0), definition)


def dump_problems(rows: DataFrame, tables: dict[str, Definition]) -> DataFrame:
    """All problems of all tables of a dump."""
    every = [f for d in tables.values() for f in (value_problems(rows, d), key_problems(rows, d), reference_problems(rows, d, tables))]
    return reduce(DataFrame.unionByName, every)
