"""Column builders for numbers, sentinels, relations, units and small text rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"
#: A decimal number: a sign, digits with at most one point among or beside them, and an exponent.
NUMBER = r"^[-+]?(?=\.?[0-9])[0-9]*\.?[0-9]*(?:[eE][-+]?[0-9]+)?$"
#: The relations that are understood, and what they mean.
RELATIONS = {"=": "=", "==": "=", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "≤": "<=", "≥": ">="}
#: Units, what they measure, and the factor to mg/kg or mol/kg.
UNITS = {
    "mg/kg": ("mass", 1.0), "ug/kg": ("mass", 0.001), "µg/kg": ("mass", 0.001), "μg/kg": ("mass", 0.001), "ng/kg": ("mass", 0.000001), "g/kg": ("mass", 1000.0),
    "mol/kg": ("molar", 1.0), "mmol/kg": ("molar", 0.001), "umol/kg": ("molar", 0.000001), "µmol/kg": ("molar", 0.000001), "μmol/kg": ("molar", 0.000001), "nmol/kg": ("molar", 1e-9),
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column) -> Column:
    """Stripped of white space at both ends; null becomes the empty string."""
    return F.coalesce(F.btrim(col(c), F.lit(BLANKS)), F.lit(""))


def source_text(c: str | Column) -> Column:
    """As ``text``, with a lone ``-`` taken as missing."""
    return F.when(text(c) == "-", "").otherwise(text(c))


def positive_number(c: str | Column) -> Column:
    """The finite positive value of a number written in full; null for anything else."""
    value = F.when(text(c).rlike(NUMBER), text(c).try_cast("double"))
    return F.when((value > 0) & (value < float("inf")), value)


def looked_up(c: str | Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A literal table's value; without an entry the default, or else the value itself."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[col(c)]
    return F.coalesce(found, default if default is not None else col(c))


def relation(c: str | Column) -> Column:
    return looked_up(c, RELATIONS, F.lit("unknown"))


def unit_kind(c: str | Column) -> Column:
    """``mass``, ``molar`` or null."""
    return looked_up(c, {u: k for u, (k, _) in UNITS.items()}, F.lit(None).cast("string"))


def unit_factor(c: str | Column) -> Column:
    return F.create_map(*[F.lit(x) for u, (_, f) in UNITS.items() for x in (u, f)])[col(c)]


def reasons(*rules: tuple[Column, str | Column]) -> Column:
    """The names of the rules that hold, in order; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name) if isinstance(name, str) else name) for cond, name in rules]))


def is_close(a: Column, b: Column, relative: float = 2e-5, absolute: float = 2e-6) -> Column:
    """Equal within the larger of a relative and an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def folded(c: str | Column) -> Column:
    """White space runs as one space, ends stripped, lower case."""
    return F.lower(F.btrim(F.regexp_replace(col(c), r"\s+", " ")))


def valid_cas(c: str | Column) -> Column:
    """A registry number whose last digit is the position-weighted sum of the others, mod 10."""
    digits = F.regexp_replace(col(c), "-", "")
    n = F.length(digits)
    weighted = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda s, i: s + i * F.substring(digits, n - i, F.lit(1)).cast("int"))
    shape = col(c).rlike(r"^\d{2,7}-\d{2}-\d$")
    return F.when(shape, weighted % 10 == F.substring(digits, n, F.lit(1)).cast("int")).otherwise(False)


def mod10(c: str | Column) -> Column:
    """Position-weighted digit sum mod 10, from the right, weights from 1."""
    digits = col(c).cast("string")
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + i * F.substring(digits, n - i + 1, F.lit(1)).cast("int")) % 10


def effect_point(lower: Column, upper: Column, lower_q: Column, upper_q: Column) -> tuple[Column, Column, Column]:
    """Point value, its relation, and why there is none: an interval or an upper bound is no point."""
    lo, up, lq, uq = (text(c) for c in (lower, upper, lower_q, upper_q))
    why = F.when((lo != "") & (up != ""), "interval_not_point").when(up != "", "upper_bound_not_point").when(lo == "", "missing_effect_value").when(uq != "", "upper_qualifier_without_upper_value")
    return F.when(why.isNull(), lo).otherwise(""), F.when(why.isNull(), lq).otherwise(""), why


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda p, q: p | q, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda p, q: p & q, conditions)


def fraction(c: str | Column) -> Column:
    """A percentage or a fraction as a fraction: what ends with a percent sign is divided by 100; null if it isn't within 0 to 1."""
    t = text(c)
    number = F.when(t.endswith("%"), F.btrim(F.rtrim(F.regexp_replace(t, "%$", ""))).try_cast("double") / 100).otherwise(t.try_cast("double"))
    return F.when((number >= 0) & (number <= 1), number)


def same_target(a: Column, b: Column) -> Column:
    """Whether two targets are one but for rounding: within 1e-12 of the larger, and of one sign."""
    return F.coalesce(F.abs(a - b) <= F.lit(1e-12) * F.greatest(F.abs(a), F.abs(b)), F.lit(False))


def side_value(record: str | Column, key: str, original: bool) -> Column:
    """A map's value of ``key``; of the original side ``key_original`` if the record has that key, even where it is null."""
    m, side = col(record), F.lit(f"{key}_original")
    return F.when(F.lit(original) & F.map_contains_key(m, side), F.try_element_at(m, side)).otherwise(F.try_element_at(m, F.lit(key)))


def json_like(c: str | Column, path: str, part: str) -> Column:
    """Whether a JSON field, at a path, holds a part; a missing field does not."""
    return F.coalesce(F.contains(F.get_json_object(col(c), path), F.lit(part)), F.lit(False))


def says_unavailable(c: str | Column, markers: tuple[str, ...] = ("not available", "unavailable", "not reported", "n/a")) -> Column:
    """Whether a text says that a value can't be had, by any of the markers, case and runs of white space aside."""
    return reduce(lambda p, q: p | q, [F.coalesce(F.contains(folded(c), F.lit(m)), F.lit(False)) for m in markers])
