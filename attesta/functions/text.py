"""Column builders for references, labels, spans, A1 addresses and flattened JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.values import col

RANGE_CAP = 10_000
#: Characters of a bracket beyond which it is no citation.
LONGEST_CITATION = 200
#: Words that lead to a label, and what joins labels.
LEADS = {"figure": ("figure", "fig"), "table": ("table",)}
JOINS, RANGES = (",", ";", "&", "and"), ("to", "-", "–", "—")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blankless(c: Column) -> Column:
    """A text in lower case without outer white space of any kind, inner runs as one space."""
    return F.lower(F.btrim(F.regexp_replace(c, r"(?U)\s+", " ")))


def folded_dashes(c: str | Column) -> Column:
    """Six kinds of dashes as the plain one."""
    return F.translate(col(c), "‐‑‒–—−", "------")


def citation_brackets(c: str | Column) -> Column:
    """The insides of brackets that hold nothing but numbers, separators and dashes."""
    opened = F.slice(F.split(col(c), r"\[", -1), F.lit(2), F.length(col(c)) + 1)
    inner = F.transform(F.filter(opened, lambda x: F.contains(x, F.lit("]"))), lambda x: F.substring_index(x, "]", 1))
    rest = lambda x: F.regexp_replace(F.translate(x, ",;-–—", ""), r"(?U)\s", "")
    return F.filter(inner, lambda x: (F.length(x) <= LONGEST_CITATION) & (rest(x) != "") & (F.translate(rest(x), "0123456789", "") == ""))


def expand_citation(inner: Column) -> tuple[Column, Column]:
    """The cited numbers of one bracket, and why it is wrong: ``malformed``, ``descending`` or ``too_large``.

    A range that is wrong ends the bracket: what stands before it counts, what follows does not.
    """
    parts = F.transform(F.split(F.translate(inner, ";–—", ",--"), ",", -1), lambda x: F.transform(F.split(x, "-", -1), lambda y: F.btrim(F.regexp_replace(y, r"(?U)\s+", " "))))
    good = F.forall(parts, lambda p: (F.size(p) <= 2) & F.forall(p, lambda y: (y != "") & (F.translate(y, "0123456789", "") == "")))
    ends = F.transform(parts, lambda x: F.struct(F.get(x, F.lit(0)).try_cast("long").alias("a"), F.try_element_at(x, F.lit(-1)).try_cast("long").alias("b")))
    wrong = lambda e: F.when(e["b"] < e["a"], "descending").when(e["b"] - e["a"] > RANGE_CAP, "too_large")
    first_wrong = F.array_min(F.transform(ends, lambda e, i: F.when(wrong(e).isNotNull(), i)))
    upto = F.filter(ends, lambda e, i: first_wrong.isNull() | (i < first_wrong))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(upto, lambda e: F.sequence(e["a"], e["b"])))))
    why = F.when(~good, "malformed").when(first_wrong.isNotNull(), wrong(F.element_at(ends, (first_wrong + 1).cast("int"))))
    return F.when(good, numbers).otherwise(F.array().cast("array<bigint>")), why


def citations(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, number, problem``: one row for each cited number and each wrong bracket.

    Each distinct bracket is expanded once; texts without a bracket that begins like one are passed over first.
    """
    some = rows.select(key, F.col(text).alias("__t")).where(F.contains("__t", F.lit("[")))
    inner = some.select(key, F.explode(citation_brackets("__t")).alias("inner"))
    numbers, why = expand_citation(F.col("inner"))
    known = inner.select("inner").distinct().select("inner", numbers.alias("numbers"), why.alias("why"))
    none = F.array(F.struct(F.lit(None).cast("long").alias("number"), F.col("why").alias("problem")))
    found = F.transform("numbers", lambda n: F.struct(n.alias("number"), F.lit(None).cast("string").alias("problem")))
    lines = known.select("inner", F.inline(F.when(F.col("why").isNull(), found).otherwise(F.concat(found, none))))
    return inner.join(lines, "inner").select(key, "number", "problem")


def canonical_label(c: str | Column) -> Column:
    """A label without white space, in capitals."""
    return F.upper(F.regexp_replace(col(c), r"\s+", ""))


def _words(c: Column) -> Column:
    """All of a text as runs of letters, of digits and of blanks, and single signs, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?Us)\p{L}+|[0-9]+|\s+|."), 0)


_is_digits = lambda x: F.ascii(x).between(48, 57)
_is_blank = lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s", "")) == ""


def leading_label(c: str | Column, kind: str, caption: bool = False) -> Column:
    """The label that a text opens with after ``Figure`` or ``Table``; null if it opens otherwise.

    Of a name, the label is a word of its own; of a ``caption``, a stop, colon, bar, dash or the end follows it, and
    blanks may stand inside it. The tokens are read in steps: 0 start, 1 ``supplementary``, 2 the lead, 3 an S that touches
    the lead, 4 an S, 5 the number, 6 done, 9 no label.
    """
    leads = LEADS[kind]
    blank = lambda x: _is_blank(x)

    def step(state: Column, x: Column) -> Column:
        at = state["at"]
        lead, touching = x.isin(*leads), x.isin(*[f"{w}s" for w in leads])
        opened = F.when(blank(x), at).when(lead, 2).when(touching, 3).otherwise(9)
        ended = F.when(x.isin(".", ":", "|", "–", "—", "-"), 6).when(blank(x), 5).otherwise(9) if caption else F.when(x.rlike(r"(?U)^\w"), 9).otherwise(6)
        after_s = F.when(_is_digits(x), 5).when(blank(x) & F.lit(caption), at).otherwise(9)
        after_lead = F.when(_is_digits(x), 5).when(blank(x) | x.isin("_", ".", "-"), 2).when(x == "s", 4).otherwise(9)
        to = (
            F.when(at == 0, F.when(x == "supplementary", 1).otherwise(opened)).when(at == 1, opened).when(at == 2, after_lead)
            .when(at.isin(3, 4), after_s).when(at == 5, ended).otherwise(at)
        )
        label = F.when((to == 5) & at.isin(2, 3, 4), F.concat(F.when(at == 2, "").otherwise("S"), x)).otherwise(state["label"])
        return F.struct(to.cast("int").alias("at"), label.alias("label"))

    short = F.when(F.lower(F.ltrim(F.regexp_replace(F.substring(col(c), 1, 400), r"(?U)\s+", " "))).rlike("^(?:supplementary |fig|table)"), col(c))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("label"))
    return F.aggregate(_words(short), start, step, lambda s: F.when(s["at"].isin(5, 6), s["label"]))


def label_references(c: str | Column, kind: str = "figure") -> Column:
    """Distinct labels that a text refers to (``Figures 2, S3-S5 and 7a``), ranges filled in, sorted.

    A bare number that ends a range begun in the S series is of that series; a range over two series, a
    descending one and one of over ``RANGE_CAP`` count by their ends only. The tokens are read in steps: 0 outside, 1 a
    lead, 2 a lead and its full stop, 3 blanks after it, 4 an S, 5 a number, 6 its letter, 7 blanks after those, 8 what joins labels.
    """
    leads = [w + s for w in LEADS[kind] for s in ("", "s")]

    def step(state: Column, x: Column) -> Column:
        at, blank = state["at"], _is_blank(x)
        fresh = F.when(x.isin(*leads) & ~state["touched"], 1).otherwise(0)
        joined = F.when(x.isin(*JOINS, *RANGES), 8).otherwise(fresh)
        awaited = F.when(_is_digits(x), 5).when(x == "s", 4).otherwise(fresh)
        to = (
            F.when(at == 0, fresh).when(at.isin(1, 2), F.when(blank, 3).when((at == 1) & (x == ".") & F.lit(kind == "figure"), 2).otherwise(fresh))
            .when(at == 3, awaited).when(at == 4, F.when(blank, 4).when(_is_digits(x), 5).otherwise(fresh)).when(at == 8, F.when(blank, 8).otherwise(awaited))
            .otherwise(F.when(blank, 7).when((at == 5) & (F.length(x) == 1) & x.rlike("^[a-z]$"), 6).otherwise(joined))
        )
        join = F.when(to == 8, F.when(at == 8, state["join"]).when(x.isin(*RANGES), "to").otherwise("and")).when(to.isin(4, 5), state["join"]).otherwise("")
        found = (to == 5) & at.isin(3, 4, 8)
        own = F.concat(F.when(at == 4, "S").otherwise(""), x)
        label = F.when((at != 4) & (state["join"] == "to") & state["last"].startswith("S"), F.concat(F.lit("S"), own)).otherwise(own)
        pair = F.struct(F.when(state["join"] == "to", state["last"]).alias("a"), label.alias("b"))
        return F.struct(
            to.cast("int").alias("at"), x.rlike(r"(?U)^\w").alias("touched"), join.alias("join"), F.when(found, label).when(to == 0, "").otherwise(state["last"]).alias("last"),
            F.when(found, F.concat(state["out"], F.array(pair))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("touched"), F.lit("").alias("join"), F.lit("").alias("last"), F.array().cast("array<struct<a: string, b: string>>").alias("out"))
    worth = F.when(F.contains(F.lower(col(c)), F.lit(LEADS[kind][-1])), col(c)).otherwise("")
    pairs = F.aggregate(_words(worth), start, step, lambda s: s["out"])

    def filled(p: Column) -> Column:
        number = lambda x: F.replace(x, F.lit("S")).try_cast("long")
        same = p["a"].isNotNull() & (p["a"].startswith("S") == p["b"].startswith("S")) & (number(p["b"]) >= number(p["a"])) & (number(p["b"]) - number(p["a"]) <= RANGE_CAP)
        series = F.when(p["b"].startswith("S"), "S").otherwise("")
        between = F.transform(F.sequence(number(p["a"]), number(p["b"])), lambda i: F.concat(series, i.cast("string")))
        return F.concat(F.array(p["b"]), F.when(same, between).otherwise(F.array().cast("array<string>")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, filled))))


def span_holds(text: str | Column, start: str | Column, end: str | Column, quote: str | Column) -> Column:
    """Whether code points ``start`` to ``end`` of a text are the quote."""
    s, e = col(start), col(end)
    return F.coalesce((s >= 0) & (e > s) & (e <= F.char_length(col(text))) & (F.substring(col(text), (s + 1).cast("int"), (e - s).cast("int")) == col(quote)), F.lit(False))


def column_index(letters: str | Column) -> Column:
    """Spreadsheet column letters to a number from 1."""
    codes = F.transform(F.split(F.upper(col(letters)), ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(0), lambda s, x: s * 26 + x)


def tanimoto(a: str | Column, b: str | Column) -> Column:
    """Shared over all members of two sets; 1 for two empty ones."""
    n = F.size(F.array_intersect(col(a), col(b)))
    return F.coalesce(F.try_divide(n.cast("double"), F.size(col(a)) + F.size(col(b)) - n), F.lit(1.0))


def html_escaped(c: str | Column) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def parameters(c: str | Column) -> tuple[Column, Column]:
    """``a=1; b=2`` as a map of the well-formed parts, and the sorted issues ``malformed`` and ``duplicate``."""
    parts = F.filter(F.transform(F.split(col(c), ";"), lambda x: F.btrim(x)), lambda x: x != "")
    good = F.filter(parts, lambda x: x.rlike(r"^[^=\s][^=]*=\s*\S.*$"))
    pairs = F.transform(good, lambda x: F.struct(F.btrim(F.substring_index(x, "=", 1)).alias("k"), F.btrim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    issues = F.array_compact(F.array(F.when(F.size(F.array_distinct(names)) < F.size(names), "duplicate"), F.when(F.size(good) < F.size(parts), "malformed")))
    return F.map_from_entries(first), issues


def timestamp_with_zone(c: str | Column) -> Column:
    """An ISO 8601 instant; null without a zone or for anything else."""
    return F.when(col(c).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(col(c)))


def strict_utc(c: str | Column) -> Column:
    """Whether a text is exactly ``YYYY-mm-ddTHH:MM:SSZ`` of a real instant."""
    at = timestamp_with_zone(c)
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'") == col(c), F.lit(False))


def range_bin(value: str | Column, low: str | Column, high: str | Column, bins: int) -> tuple[Column, Column]:
    """A value clipped and scaled to 0..1 by fitted limits, and its bin of equal width (the last one closed)."""
    span = col(high) - col(low)
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(col(value) - col(low), span), F.lit(0.0))))
    return scaled, F.least(F.floor(scaled * bins), F.lit(bins - 1)).cast("int")
