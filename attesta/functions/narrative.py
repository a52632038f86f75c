"""Narrative fields: statements read by kinds of token, scalar points, bracketed references, panel letters and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import blankless, folded_dashes, leading_label, let
from attesta.functions.values import RELATIONS, col, looked_up

#: What a narrative may say in each place, and the markers and the link that may close it.
SPECIES = ("rat", "rats")
ROUTES = ("oral", "intragastric", "gavage", "ingestion", "po")
COMPARED = (">=", "<=", ">", "<", "=", "≤", "≥")
MEASURES = ("mg", "g", "ug", "µg", "μg", "mol", "mmol")
WEIGHTS = ("bw", "body weight")
NOTES = ("male", "female")
MARKERS = ("peer reviewed", "qc reviewed")
LINK_STARTS = ('<a href="http://www.ncbi.nlm.nih.gov/pubmed/', '<a href="https://www.ncbi.nlm.nih.gov/pubmed/')
LINK_END = '?dopt=abstract" target=new>pubmed abstract</a>'

#: A text is cut into these: what brackets hold, links, markers, comparisons, numbers, units, words, single signs.
_TOKENS = (
    r"(?iUs)\[[^\[\]]*\]", r"\([^)]+\)", r"<a\s[^>]*>[^<]*</a>", r"\*\*[^*]*\*\*", "[<>]=",
    r"[0-9][0-9,]*(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?", r"\p{L}+/\p{L}+", "body weight", r"[\p{L}_][\p{L}\p{N}_]*", r"\S",
)
#: The places of a statement in order; those in capitals must be there.
PLACES = ("ENDPOINT", "SPECIES", "ROUTE", "note", "relation", "VALUE", "UNIT", "weight", "stop", "REFERENCE", "marker", "link")


def is_scalar(c: str | Column) -> Column:
    """Whether a text is a plain number: digits, or groups of three after the first, a fraction, a power."""
    digits = lambda x: (x != "") & (F.translate(x, "0123456789", "") == "")

    def checked(parts: Column) -> Column:
        power = F.coalesce(F.get(parts, F.lit(1)), F.lit("0"))
        decimal = F.split(F.get(parts, F.lit(0)), r"\.", -1)
        groups = F.split(F.get(decimal, F.lit(0)), ",", -1)
        first = F.get(groups, F.lit(0))
        grouped = (F.size(groups) == 1) | ((F.length(first) <= 3) & ~first.startswith("0") & F.forall(F.slice(groups, 2, 9999), lambda g: F.length(g) == 3))
        signless = F.when(power.startswith("+") | power.startswith("-"), F.substring(power, F.lit(2), F.length(power))).otherwise(power)
        return (F.size(parts) <= 2) & digits(signless) & (F.size(decimal) <= 2) & digits(F.coalesce(F.get(decimal, F.lit(1)), F.lit("0"))) & F.forall(groups, digits) & grouped

    return F.coalesce(let(F.split(F.lower(col(c)), "e", -1), checked), F.lit(False))


def number_text(c: str | Column) -> Column:
    """A written number without its thousands separators."""
    return F.replace(col(c), F.lit(","), F.lit(""))


def mentions(c: str | Column) -> Column:
    """How often a text names the endpoint, as one word, as two or with its number in brackets."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(?U)[\p{L}\p{N}_]+|\S"), 0)
    one = lambda *w: "".join(f"\x01{x}\x02" for x in w)
    marked = F.array_join(F.transform(words, lambda w: F.concat(F.lit("\x01"), w, F.lit("\x02"))), "")
    return sum(((F.length(marked) - F.length(F.replace(marked, F.lit(w)))) / len(w)).cast("int") for w in (one("ld50"), one("ld", "50"), one("ld", "(", "50", ")")))


def _place(token: Column) -> Column:
    """The place in a statement that a token can have, by number; 0 if it has none."""
    x, at = F.lower(token), {name: i + 1 for i, name in enumerate(PLACES)}
    fixed = {"ENDPOINT": ("ld50",), "SPECIES": SPECIES, "ROUTE": ROUTES, "relation": COMPARED, "weight": WEIGHTS, "stop": (".",), "UNIT": [f"{m}/kg" for m in MEASURES], "marker": [f"**{m}**" for m in MARKERS]}
    known = F.create_map(*[F.lit(v) for name, words in fixed.items() for w in words for v in (w, at[name])])
    link = F.replace(F.replace(F.replace(x, F.lit(LINK_STARTS[0])), F.lit(LINK_STARTS[1])), F.lit(LINK_END))
    is_link = (x.startswith(LINK_STARTS[0]) | x.startswith(LINK_STARTS[1])) & x.endswith(LINK_END) & (link != "") & (F.translate(link, "0123456789", "") == "")
    by_sign = (
        F.when(F.ascii(x).between(48, 57), F.when(is_scalar(x), at["VALUE"]).otherwise(0)).when(x.startswith("("), F.when(F.length(x) > 1, at["note"]).otherwise(0))
        .when(x.startswith("["), F.when(F.length(x) > 1, at["REFERENCE"]).otherwise(0)).when(x.startswith("<a"), F.when(is_link, at["link"]).otherwise(0)).otherwise(0)
    )
    return F.coalesce(known[x], by_sign)


def narrative(c: str | Column) -> Column:
    """A struct of what a narrative says: ``species, route, note, relation, value, unit, reference, status, why``.

    Each token has a place; the whole text is one statement, ``candidate``, if the places rise and none that must be
    there is missing. ``excluded`` without the endpoint's name; else ``quarantined`` with the reason. A note is a sex, or
    ``gavage`` for an oral route; a dose in the reference's bracket makes it ambiguous.
    """
    t = F.coalesce(col(c), F.lit(""))

    def read(tokens: Column, places: Column) -> Column:
        said = lambda name: F.coalesce(F.get(tokens, (F.array_position(places, PLACES.index(name) + 1) - 1).cast("int")), F.lit(""))
        must = F.array(*[F.lit(i + 1) for i, name in enumerate(PLACES) if name.isupper()])
        apart = (said("weight") == "") | (F.instr(t, F.concat(said("UNIT"), F.lit(" "), said("weight"))) > 0)
        whole = (places == F.array_sort(F.array_distinct(places))) & ~F.array_contains(places, 0) & (F.size(F.array_except(must, places)) == 0) & apart
        note = F.substring(said("note"), F.lit(2), F.length(said("note")) - 2)
        by_tube = (F.lower(said("ROUTE")) == "oral") & (F.lower(note) == "gavage")
        words = F.regexp_extract_all(F.lower(said("REFERENCE")), F.lit(r"(?U)[\p{L}\p{N}_]+|\S"), 0)
        named = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        dosed = reduce(lambda p, q: p | q, [F.contains(named, F.lit(f" {m} / kg ")) for m in MEASURES])
        why = let(
            mentions(t),
            lambda n: (
                F.when(n == 0, "no_ld50_mention").when(n > 1, "multiple_or_ambiguous_ld50_observations").when(~whole, "narrative_not_verified_single_rat_oral_scalar")
                .when((note != "") & ~F.lower(note).isin(*NOTES) & ~by_tube, "unverified_parenthetical_context").when(dosed, "ambiguous_bracketed_dose_context")
            ),
        )

        def told(reason: Column) -> Column:
            own = lambda x: F.when(reason.isNull(), x).otherwise("")
            unit = F.concat(said("UNIT"), F.when(said("weight") != "", F.concat(F.lit(" "), said("weight"))).otherwise(""))
            status = F.when(reason == "no_ld50_mention", "excluded").when(reason.isNull(), "candidate").otherwise("quarantined")
            return F.struct(
                own(said("SPECIES")).alias("species"), own(said("ROUTE")).alias("route"), own(F.when(by_tube, "").otherwise(note)).alias("note"), own(looked_up(said("relation"), RELATIONS, F.lit("unknown"))).alias("relation"),
                own(number_text(said("VALUE"))).alias("value"), own(unit).alias("unit"), own(said("REFERENCE")).alias("reference"), status.alias("status"), reason.alias("why"),
            )

        return let(why, told)

    found = F.regexp_extract_all(t, F.lit("|".join(_TOKENS)), 0)
    return let(found, lambda tokens: let(F.transform(tokens, _place), lambda places: read(tokens, places)))


_TIMES = ("x", "×", "·", "*")


def point_problem(text: str | Column, start: str | Column, end: str | Column) -> Column:
    """Why code points ``start`` to ``end`` of a text are no positive scalar of their own; null if they are.

    ``composite``: a part of a negative number, a range or a power of ten; ``embedded``: a part of a longer token;
    ``not_scalar``: no number; ``not_positive``. What stands before and after the point decides: tokens next to it, the
    nearest first, and the signs that touch it.
    """
    t, s, e = folded_dashes(text), col(start), col(end)
    point = F.substring(t, s + 1, e - s)
    before, after = F.substring(t, F.lit(1), s), F.substring(t, e + 1, F.length(t))
    tokens = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"(?U)[0-9]+|[\p{L}_]+|\S"), 0)
    digits = lambda x: F.coalesce((x != "") & (F.translate(x, "0123456789", "") == ""), F.lit(False))

    def judged(near: Column) -> Column:
        b, a = (lambda i: F.get(near["b"], F.lit(i))), (lambda i: F.get(near["a"], F.lit(i)))
        bare = F.rtrim(F.substring(F.rtrim(before), F.lit(1), F.length(F.rtrim(before)) - 1))
        untouched = F.regexp_replace(F.substring(F.rtrim(before), -2, 1), r"(?U)[\w.]", "") != ""
        dashed = F.coalesce(b(0) == "-", F.lit(False))
        negative = dashed & ((bare == "") | untouched | (F.length(F.rtrim(before)) == 1))
        between = (dashed & digits(b(1))) | ((a(0) == "-") & (digits(a(1)) | ((a(1) == ".") & digits(a(2)))))
        signed = lambda at, i: F.when(at(i).isin("+", "-"), at(i + 1)).otherwise(at(i))
        raised = lambda i: ((a(i) == "^") & digits(signed(a, i + 1))) | ((a(i) == "*") & (a(i + 1) == "*") & digits(signed(a, i + 2)))
        below = lambda i: ((b(i) == "^") & b(i + 1).endswith("10")) | ((b(i) == "*") & (b(i + 1) == "*") & b(i + 2).endswith("10"))
        power = (a(0).isin(*_TIMES) & (a(1) == "10") & raised(2)) | (point.endswith("10") & raised(0)) | below(0) | (b(0).isin("+", "-") & below(1))
        x = lambda i: F.substring(before, -i, 1) if i == 1 else F.when(F.length(before) >= i, F.substring(before, -i, 1)).otherwise("")
        y = lambda i: F.substring(after, i, 1)
        wordy = x(1).rlike(r"(?U)^[\w.]$")
        left = wordy | ((x(1) == ",") & digits(x(2))) | (x(1).isin("+", "-") & (F.lower(x(2)) == "e") & digits(x(3)))
        right = digits(y(1)) | (y(1).isin(".", ",") & digits(y(2))) | ((F.lower(y(1)) == "e") & (digits(y(2)) | (y(2).isin("+", "-") & digits(y(3)))))
        value = number_text(point).try_cast("double")
        sure = lambda c: F.coalesce(c, F.lit(False))
        return (
            F.when(sure(negative) | sure(between) | sure(power), "composite").when(sure(left) | sure(right), "embedded")
            .when(~is_scalar(point), "not_scalar").when(~sure((value > 0) & (value < float("inf"))), "not_positive")
        )

    return let(F.struct(F.reverse(tokens(before)).alias("b"), tokens(after).alias("a")), judged)


def whole_bracket(quote: str | Column) -> Column:
    """Whether a text is one outer pair of brackets: it opens first, closes last and never before."""
    q = col(quote)
    step = lambda s, x: F.struct((s["depth"] + F.when(x == "[", 1).when(x == "]", -1).otherwise(0)).alias("depth"), (s["n"] + 1).alias("n"), (s["shut"] + ((s["depth"] == 1) & (x == "]")).cast("int")).alias("shut"))
    seen = F.aggregate(F.split(q, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("shut")), step)
    return F.coalesce(q.startswith("[") & q.endswith("]") & (seen["depth"] == 0) & (seen["shut"] == 1), F.lit(False))


def terminal_reference(text: str | Column, start: str | Column, end: str | Column) -> Column:
    """Whether code points ``start`` to ``end`` are a whole bracket, the first of the text, with at most a marker after it."""
    t, s, e = col(text), col(start), col(end)
    after = F.substring(t, e + 1, F.length(t))
    return whole_bracket(F.substring(t, s + 1, e - s)) & (F.instr(F.substring(t, F.lit(1), s), "[") == 0) & blankless(after).isin("", *[f"**{m}**" for m in MARKERS])


def contains_span(outer: tuple[Column, Column], inner: tuple[Column, Column]) -> Column:
    """Whether one half-open span lies in another; an empty or reversed one lies nowhere."""
    return F.coalesce((inner[0] < inner[1]) & (outer[0] <= inner[0]) & (inner[1] <= outer[1]), F.lit(False))


def panel_letters(caption: str | Column) -> Column:
    """Whether a caption's bracketed capitals, if it has any, run A, B, C."""
    letters = F.regexp_extract_all(col(caption), F.lit(r"\(([A-Z])\)"), 1)
    return F.array_join(letters, "") == F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(1), F.size(letters))


def identifier(c: str | Column, kind: str) -> Column:
    """The label at the start of a sheet's or table's name (``Supplementary Table S3``); null for another kind of name."""
    return leading_label(c, kind)


def is_sha256(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_inchikey(c: str | Column) -> Column:
    """Fourteen, ten and one capitals, joined by hyphens."""
    return F.coalesce(col(c).rlike("^[A-Z]{14}-[A-Z]{10}-[A-Z]$"), F.lit(False))


def past_deadline(at: str | Column, deadline: str | Column) -> Column:
    """Whether an instant lies after a deadline; a missing instant does, a missing deadline never passes."""
    return F.when(col(deadline).isNull(), F.lit(False)).otherwise(F.coalesce(col(at) > col(deadline), F.lit(True)))
