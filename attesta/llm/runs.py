"""Periodic runs of words, by Lyndon arrays that reuse extensions matched before.

A text's Lyndon array, for the words' order and for its reverse, gives each place the longest Lyndon word that starts
there; every run has, in one of the two, such a word as its root (Bannai et al.). The array is made from left to right
with a stack of smaller suffixes. A comparison of two suffixes isn't made anew inside a stretch that is known to equal
an earlier one: its outcome is looked up there, so that no word right of the start of the longest match is read twice (Ellert
and Fischer). Words are only compared, as the numbers of an ordered alphabet; there are no suffix arrays and no hashes of
stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def lyndon_edges(s: list[int]) -> tuple[list[int], list[int]]:
    """For each place, where the next smaller suffix starts (``len(s)`` if none does) and how far the two agree.

    The end is smaller than any word. ``before`` and ``common`` are the previous smaller suffix and how far it agrees.
    ``s[at - shift : reach - shift] == s[at : reach]`` is the match that reaches furthest.
    """
    n = len(s)
    after, agree, before, common = [n] * n, [0] * n, [-1] * n, [0] * n
    reach = at = shift = 0

    def seen(c: int, j: int) -> int:
        """How far the suffixes at ``c`` and ``j`` agree by what was found one shift before; -1 if they never met."""
        c, j = c - shift, j - shift
        return agree[c] if after[c] == j else common[j] if before[j] == c else -1

    for j in range(1, n):
        c, m, exact = j - 1, 0, False  # the suffixes at c and j agree in m words, or in at least so many
        while c >= 0:
            if not exact:
                if c >= at and j + m < reach and (found := seen(c, j)) >= 0:
                    m = min(found, reach - j)
                    exact = j + m < reach
                if not exact:
                    while j + m < n and s[c + m] == s[j + m]:
                        m += 1
                    if j + m > reach:
                        reach, at, shift = j + m, j, j - c
            if j + m < n and s[c + m] < s[j + m]:
                before[j], common[j] = c, m
                break
            after[c], agree[c] = j, m
            if common[c] < m:
                before[j], common[j] = before[c], common[c]
                break
            c, exact = before[c], common[c] > m
    return after, agree


def find_runs(s: list[int], least_length: int = 6, least_times: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)``, sorted by start and period, of the runs of at least ``least_length`` and ``least_times`` periods.

    A run is a stretch with a smallest period that neither neighbour continues. Its first whole root starts within
    its first period, so looking left from there takes less than a period.
    """
    found = set()
    for t in (s, [-x for x in s]):
        after, agree = lyndon_edges(t)
        for i, (j, right) in enumerate(zip(after, agree, strict=True)):
            p = j - i
            if right + p <= (least_times - 1) * p or (i >= p and after[i - p] == i and agree[i - p] == right + p):
                continue  # too short with all that could be left of it, or not the run's first root
            left = 0
            while left < min(p, i) and t[i - left - 1] == t[j - left - 1]:
                left += 1
            if left < p and left + p + right >= max(least_length, least_times * p):
                found.add((i - left, left + p + right, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of_words(words: list[bytes], least_length: int = 6, least_times: int = 4) -> list[tuple[int, int, int]]:
    """The runs of a text. A word that stands there less than ``least_times`` times is in none: texts are cut at those."""
    if len(words) < least_length:
        return []
    kinds: dict[bytes, int] = {}
    s = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int64, len(words))
    often = np.bincount(s)[s] >= least_times
    edges = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]])))
    parts = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least_length]
    return [(a + i, n, p) for a, b in parts for i, n, p in find_runs(s[a:b].tolist(), least_length, least_times)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by spaces, without what follows the first period of each run."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        start, length, period = np.array(runs).T
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, least_length: int = 6, least_times: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, runs, kept_text`` for each row of ``docs``, in one pass without a shuffle.

    Words are cut at ASCII white space and compared unchanged. ``runs`` is an array of ``start, length, period`` in
    words, by start and period; ``kept_text`` has each run's first period only, words joined by one space. Runs of
    less than two periods are no runs. Null and empty texts have no words and no runs and an empty ``kept_text``; repeated
    rows give their rows again, null keys are keys; a very long text is read whole by its task, in time linear in its
    words; other columns aren't read, whatever their names; an empty table gives an empty result.
    """
    if least_times < 2:
        raise ValueError("a run has at least two periods")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for b in batches:
            counts, found, kept = [], [], []
            for t in b.column("t"):
                words = (t.as_py() or b"").split()
                runs = runs_of_words(words, least_length, least_times)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                kept.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())], ["k", "n_words", "runs", "kept"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))
    got = rows.mapInArrow(work, f"k {rows.schema['k'].dataType.simpleString()}, n_words bigint, runs array<{RUN}>, kept binary")
    return got.select(F.col("k").alias(key), "n_words", "runs", F.col("kept").cast("string").alias("kept_text"))


def strongest(runs):
    """The run of the greatest length in periods, the first of those; null without runs."""
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | more(r, best), r).otherwise(best))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where the texts that the digest picks by ``doc_id`` repeat some of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    picked = docs.select("doc_id", "text", (h % 10 == 0).alias("on"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = picked.withColumn("words", F.when(F.col("on"), words)).withColumn("n", F.size("words"))
    first = split.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    sized = first.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    new = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n")), " ")
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def op11_query(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, the strongest one, and digests of all runs and of what is left without repetitions."""
    got = periodic_runs(with_repeated_tails(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))
    exact = F.expr("1000 * best.length div best.period")
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exact.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
