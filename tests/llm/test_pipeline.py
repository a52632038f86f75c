import corpus_pipeline
import pyarrow as pa
from attesta.llm import packing
from attesta.llm.language_id import labelled_sample, predict, train
from test_line_dedup import slow as slow_lines
from test_substring_dedup import slow as slow_substrings


def kept_by_all_pairs(rows, least=0.8):
    """The smallest key of each group of texts that pairs of a likeness of ``least`` or more join, every pair compared."""
    sets = {}
    for k, t in rows:
        words = (t or "").encode().lower().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    group = {k: k for k in sets}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y) - 1e-9:
                low, high = sorted((root(a), root(b)))
                group[high] = low
    return {k for k in keys if root(k) == k}


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 -- 45", "en", "s", 9), (9003, "12 the of", None, "s", 9)], docs.schema)
    docs = docs.unionByName(extra)
    frames, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, "").write.parquet(f"{tmp_path}/{name}")
        frames[name] = at = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "best_fit_packing" or (at.columns, at.dtypes) == (docs.columns, docs.dtypes)
    rows = {name: {r.doc_id: r for r in f.collect()} for name, f in frames.items() if name != "best_fit_packing"}
    first = {r.doc_id: r for r in docs.collect()}
    labels = predict(train(labelled_sample(docs)), [r.text for r in first.values()])[0]
    assert set(rows["language_id"]) == {k for k, x in zip(first, labels) if x != "und"} and 9003 in rows["language_id"] and {9001, 9002}.isdisjoint(rows["language_id"])
    assert all(r.text == first[k].text and r.lang for k, r in rows["language_id"].items())
    want = slow_lines([(k, r.text) for k, r in rows["language_id"].items()])
    assert {(k, r.text) for k, r in rows["line_dedup"].items()} == {x[:2] for x in want}
    assert all(r.n_chars == len(r.text) for r in rows["line_dedup"].values())
    kept = kept_by_all_pairs([(k, r.text) for k, r in rows["line_dedup"].items()])
    assert set(rows["simhash_near_dedup"]) == kept and len({r.text for r in rows["simhash_near_dedup"].values()}) == len(kept)
    before = rows["simhash_near_dedup"]
    want = {x[0]: x[1:] for x in slow_substrings([(k, r.text) for k, r in before.items()], 35)}
    assert set(rows["substring_dedup"]) == set(before)
    for k, r in rows["substring_dedup"].items():
        assert len(r.text.split()) == want[k][0] - want[k][1] and (want[k][1] or r.text == before[k].text)
    packed = frames["best_fit_packing"].collect()
    assert {r.doc_id for r in packed} == set(before)
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_repeated_rows_nulls_and_extra_columns(spark):
    rows = [(1, "the one text", "en", 1), (1, "the one text", "en", 2), (None, "der andere Text", None, 3), (2, "der andere Text", "de", 4), (3, None, "de", 5), (4, "", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, `first` int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert sorted(r.text for r in docs.collect()) == ["der andere Text", "the one text"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 2
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def test_very_long_texts(spark):
    """A text of 30,000 lines and one of a single line of 300,000 words, with a repeated passage, go through all stages."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = [(1, "\n".join(" ".join(word() for _ in range(4)) for _ in range(30_000)), "en"), (2, " ".join(word() for _ in range(300_000)) + " " + passage, "en"), (3, passage + " " + word(), "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    got = {x.doc_id: len(x.text.split()) for x in docs.collect()}
    assert got == {1: 120_000, 2: 300_000, 3: 1}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {x.doc_id for x in packed} == {1, 2, 3} and max(x.length for x in packed) <= 2048


def test_texts_go_to_python_by_their_bytes(spark):
    """However many rows fit a batch, its bytes are bounded; the small tables of the stages start no Python workers."""
    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.sql("select 1L doc_id, 'the one text' text, 'en' lang, 's' source, 12L n_chars")
    long_rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 10000) t")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    for _, stage in corpus_pipeline.STAGES:
        if stage is corpus_pipeline.STAGES[1][1]:
            continue  # lines are dealt with outside Python
        spark.conf.unset(key)
        stage(spark, docs, "")
        assert max(r.n for r in long_rows.mapInArrow(sizes, "n bigint").collect()) < 6 << 20
    spark.conf.set(key, "1000000")
    assert "ExistingRDD" not in packing.pack(packing.pieces(docs))._jdf.queryExecution().toString()
    assert spark.conf.get(key) == "1000000"
    spark.conf.unset(key)
