"""Statements, points, captions and labels by tokens, against what they should say."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import narrative, text

NBSP = " "
LINK = '<a href="https://www.ncbi.nlm.nih.gov/pubmed/123?dopt=Abstract" target=new>PubMed Abstract</a>'


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("t", "status", "why"),
    [
        ("LD50 Rat oral 12 mg/kg [Smith]", "candidate", None),
        (f"LD50{NBSP}Rat oral{NBSP}12 mg/kg [Smith]", "candidate", None),
        ("  ld50 RATS gavage (male) >= 1,234.5e2 MG/KG bw. [S; 3] **PEER REVIEWED** ", "candidate", None),
        (f"LD50 Rat oral 12 µg/kg body weight [Smith] {LINK}", "candidate", None),
        ("LD50 Rat oral (gavage) 12 mg/kg [Smith]", "candidate", None),
        ("LD50 Rat oral(female)<12mg/kg.[Smith]**QC REVIEWED**", "candidate", None),
        ("LD 50 Rat oral 12 mg/kg [Smith]", "quarantined", "narrative_not_verified_single_rat_oral_scalar"),
        ("LD(50) Rat oral 12 mg/kg [Smith]", "quarantined", "narrative_not_verified_single_rat_oral_scalar"),
        ("LD50 Rat oral 5 mg/kg [S; LD (50) 3]", "quarantined", "multiple_or_ambiguous_ld50_observations"),
        ("LD50 Rat oral 5 mg/kg [S] LD 50", "quarantined", "multiple_or_ambiguous_ld50_observations"),
        ("LD50s Rat oral 5 mg/kg [S]", "excluded", "no_ld50_mention"),
        ("Rat oral 12 mg/kg [Smith]", "excluded", "no_ld50_mention"),
        (None, "excluded", "no_ld50_mention"),
        ("", "excluded", "no_ld50_mention"),
        ("LD50 Rat oral 12,34 mg/kg [Smith]", "quarantined", "narrative_not_verified_single_rat_oral_scalar"),
        ("LD50 Rat oral 012,345 mg/kg [Smith]", "quarantined", "narrative_not_verified_single_rat_oral_scalar"),
        ("LD50 Rat oral 12-14 mg/kg [Smith]", "quarantined", "narrative_not_verified_single_rat_oral_scalar"),
        ("LD50 Rat oral 12 mg/kg", "quarantined", "narrative_not_verified_single_rat_oral_scalar"),
        ("LD50 Rat oral 12 mg/kg [a] [b]", "quarantined", "narrative_not_verified_single_rat_oral_scalar"),
        ("LD50 Rat 12 mg/kg [Smith]", "quarantined", "narrative_not_verified_single_rat_oral_scalar"),
        ("LD50 Rat oral 12 mg/kg  bw [Smith] x", "quarantined", "narrative_not_verified_single_rat_oral_scalar"),
        ("LD50 Rat oral 12 mg/kg  bw [Smith]", "quarantined", "narrative_not_verified_single_rat_oral_scalar"),
        ("LD50 Rat oral 12 mg/kg [Smith] <a href=x>PubMed Abstract</a>", "quarantined", "narrative_not_verified_single_rat_oral_scalar"),
        ("LD50 Rat oral (old) 12 mg/kg [Smith]", "quarantined", "unverified_parenthetical_context"),
        ("LD50 Rat po (gavage) 12 mg/kg [Smith]", "quarantined", "unverified_parenthetical_context"),
        ("LD50 Rat oral 12 mg/kg [3 ug / kg]", "quarantined", "ambiguous_bracketed_dose_context"),
        ("LD50 Rat oral 12 mg/kg [3 mg/kgs]", "candidate", None),
    ],
)
def test_narrative(spark, t, status, why):
    got = one(spark, narrative.narrative(F.lit(t).cast("string")))
    assert (got.status, got.why) == (status, why)


def test_what_a_narrative_says(spark):
    got = one(spark, narrative.narrative(F.lit("LD50 Rats ORAL (Female) ≥ 1,234.5e2 mg/kg body weight. [S; 3]")))
    assert got.asDict() == {"species": "Rats", "route": "ORAL", "note": "Female", "relation": ">=", "value": "1234.5e2", "unit": "mg/kg body weight", "reference": "[S; 3]", "status": "candidate", "why": None}
    got = one(spark, narrative.narrative(F.lit("LD50 Rats oral (gavage) 5 mg/kg [S]")))
    assert (got.note, got.relation) == ("", "unknown")


@pytest.mark.parametrize(
    ("t", "problem"),
    [
        ("12.5", None), ("a 12.5 b", None), ("-12.5", "composite"), ("x -12.5", "composite"), ("x-12.5", None), ("3-12.5", "composite"), ("3 − 12.5", "composite"), ("12.5-20", "composite"),
        ("12.5 - .5", "composite"), ("12.5 - x", None), ("12.5 x 10^3", "composite"), ("12.5×10**-3", "composite"), ("12.5 x 10 3", None), ("10^12.5", "composite"), ("10 ** - 12.5", "composite"), ("x12.5", "embedded"), ("12.57", "embedded"),
        ("1,12.5", "embedded"), ("12.5e3", "embedded"), ("12.5e", None), ("3e-12.5", "embedded"), ("12.5,3", "embedded"), ("12.5, 3", None), ("=12.5 mg", None), ("2 – 12.5", "composite"), ("é12.5", "embedded"),
    ],
)
def test_points(spark, t, problem):
    s = t.index("12.5")
    assert one(spark, narrative.point_problem(F.lit(t), F.lit(s), F.lit(s + 4))) == problem


@pytest.mark.parametrize(("t", "problem"), [("0", "not_positive"), ("1e999", "not_positive"), ("1,23", "not_scalar"), ("5 to 6", "not_scalar"), ("1,234.5e-3", None), (".5", "not_scalar"), ("1.", "not_scalar")])
def test_what_is_a_scalar(spark, t, problem):
    assert one(spark, narrative.point_problem(F.lit(t), F.lit(0), F.lit(len(t)))) == problem


def test_base_of_a_power(spark):
    assert one(spark, narrative.point_problem(F.lit("a 10^3"), F.lit(2), F.lit(4))) == "composite"
    assert one(spark, narrative.point_problem(F.lit("a 10 3"), F.lit(2), F.lit(4))) is None


@pytest.mark.parametrize(
    ("t", "kind", "caption", "label"),
    [
        ("Supplementary Figure S1. A caption", "figure", True, "S1"), ("Figure 2 – caption", "figure", True, "2"), ("Fig_3", "figure", True, "3"), ("FIG. 4: x", "figure", True, "4"), ("Fig.5|x", "figure", True, "5"),
        ("Figure S 6.", "figure", True, "S6"), ("Figure 7 shows", "figure", True, None), ("Figure 8a.", "figure", True, None), ("see Figure 1.", "figure", True, None), ("Table 1.", "figure", True, None), (f"{NBSP}Table{NBSP}2 -", "table", True, "2"),
        ("Supplementary Table S3", "table", False, "S3"), ("FigS12", "figure", False, "S12"), ("Fig. 3 data", "figure", False, "3"), ("Fig_3_old", "figure", False, None), ("Table 4b", "table", False, None), ("Figures 2", "figure", False, None), ("SupplementaryTable 1", "table", False, None),
        ("Tables", "table", False, None), ("", "table", True, None), (None, "table", True, None),
    ],
)
def test_leading_labels(spark, t, kind, caption, label):
    assert one(spark, text.leading_label(F.lit(t).cast("string"), kind, caption)) == label


@pytest.mark.parametrize(
    ("t", "kind", "labels"),
    [
        ("Fig. S3-5; Figures 7a, 8B and 9", "figure", ["7", "8", "9", "S3", "S4", "S5"]), ("figs 2and3", "figure", ["2", "3"]), ("Fig. 1 to S2", "figure", ["1", "S2"]), ("Fig. 5-3", "figure", ["3", "5"]), ("Figure 2 a", "figure", ["2"]),
        ("Tables 1 & S 2, 4 – 6", "table", ["1", "4", "5", "6", "S2"]), ("tables1", "table", []), ("Figure. 1", "figure", ["1"]), ("Figure 1, and nothing; table 2", "figure", ["1"]), ("2figure 3", "figure", []), ("Fig 1-20000", "figure", ["1", "20000"]),
    ],
)
def test_label_references(spark, t, kind, labels):
    assert one(spark, text.label_references(F.lit(t), kind)) == labels


def test_brackets(spark):
    got = one(spark, text.citation_brackets(F.lit(f"a [1, 2–4] [x1] [] [{NBSP}7 ] [8 [9] [#6] 10] [{'1,' * 120}1]")))
    assert got == ["1, 2–4", f"{NBSP}7 ", "9"]
    assert not one(spark, narrative.terminal_reference(F.lit("x [a] more"), F.lit(2), F.lit(5)))
    assert one(spark, narrative.terminal_reference(F.lit("x [a] **Peer Reviewed** "), F.lit(2), F.lit(5)))
