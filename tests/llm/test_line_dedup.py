from attesta.llm.line_dedup import dedup_lines


def slow(rows, window=3):
    first, gone = {}, {}
    for k, t in sorted((k, t) for k, t in rows if t is not None):
        x = t.split("\n")
        for i in range(len(x) - window + 1):
            w = tuple(x[i : i + window])
            if "".join(w).strip():
                if w in first:
                    gone.setdefault(k, set()).update(range(i, i + window))
                first.setdefault(w, (k, i))
    return {(k, None if t is None else "\n".join(y for i, y in enumerate(t.split("\n")) if i not in gone.get(k, ())), len(gone.get(k, ()))) for k, t in rows}


def test_against_brute_force(spark):
    import random

    r = random.Random(1)
    rows = [(i, "\n".join(r.choice(["a", "b", "c d", "", " "]) for _ in range(r.randint(0, 9)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "x" * 300_000), (203, "\n\n\n\n"), (204, "\n\n\n\n"), (205, "q\nq\nq\nq\nq")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(x) for x in dedup_lines(df).select("doc_id", "text", "lines_removed").collect()} == slow(rows)


def test_nulls_ties_empty_and_clashing_columns(spark):
    rows = [(None, "a\nb\nc", "1"), (1, "a\nb\nc", "2"), (1, "a\nb\nc\nd", "3"), (1, None, "4")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    got = {r.kept: (r.doc_id, r.text, r.lines_removed) for r in dedup_lines(df).collect()}
    kept = [k for k in "123" if got[k][2] == 0]
    assert len(kept) == 1 and got["4"] == (1, None, 0)
    assert dedup_lines(df).columns[:2] == ["doc_id", "kept"]
    assert dedup_lines(df.limit(0)).count() == 0


def test_a_text_of_very_many_lines(spark):
    """Two texts of 200,000 lines with a shared half: minutes if a line were looked up among all that go."""
    own = lambda x: "\n".join(f"{x} {i}" for i in range(100_000))
    rows = [(1, own("a") + "\n" + own("b")), (2, own("c") + "\n" + own("b"))]
    got = {r.doc_id: (r.text, r.lines_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == (own("c"), 100_000)


def test_rows_equal_in_key_and_text(spark):
    rows = [(1, "a\nb\nc\nd")] * 2 + [(2, "x\na\nb\nc"), (None, "q\nr\ns"), (None, "q\nr\ns")]
    got = sorted((repr(r.doc_id), r.text, r.lines_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [("1", "a\nb\nc\nd", 0), ("1", "a\nb\nc\nd", 0), ("2", "x", 3), ("None", "q\nr\ns", 0), ("None", "q\nr\ns", 0)]
