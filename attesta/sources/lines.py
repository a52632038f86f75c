"""Text files in Spark's splits: physical line numbers, and records that quotes carry over lines and splits.

What a split is depends on what is open at its start, and what its lines are called on how many came before. A first pass
tells both for each split, for either beginning; windows over one small row a split put these together, file by file, and a
second pass cuts each split from its true beginning on. Nothing but Spark's reader touches the files, so any store will do.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.plans.staging import Staging


def split_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``f, b, value``: the lines of text files in order, with their file and where their split starts in it."""
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    return spark.read.option("lineSep", "\n").text(paths).select(path.alias("f"), F.col("_metadata.file_block_start").alias("b"), "value")


def open_after(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted field is open after a line; quotes count at the start of a field and, doubled or not, inside one."""
    if not inside and '"' not in line:
        return False
    at, fresh = 0, not inside
    while True:
        if fresh:
            inside = line.startswith('"', at)
            at += inside
        if inside:
            close = line.find('"', at)
            while close >= 0 and line.startswith('""', close):
                close = line.find('"', close + 2)
            if close < 0:
                return True
            inside, at = False, close + 1
        at, fresh = line.find(delimiter, at) + 1, True
        if not at:
            return False


def _by_split(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """The parts of batches that are of one split each."""
    for pdf in frames:
        if len(pdf):
            new = (pdf["f"] != pdf["f"].shift()) | (pdf["b"] != pdf["b"].shift())
            for _, part in pdf.groupby(new.cumsum(), sort=False):
                yield (part["f"].iat[0], int(part["b"].iat[0])), part


def _ways(lines: DataFrame) -> DataFrame:
    """``f, b, lines, open0, open1, ends0, ends1``: a split's lines, whether quotes are open after it and the records it ends, by what was open before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, n, state, ends = None, 0, [False, True], [0, 0]
        done = lambda: pd.DataFrame([(*split, n, *state, *ends)], columns=["f", "b", "lines", "open0", "open1", "ends0", "ends1"])
        for key, part in _by_split(frames):
            if key != split:
                if split:
                    yield done()
                split, n, state, ends = key, 0, [False, True], [0, 0]
            n += len(part)
            for value, delimiter in zip(part["value"], part["delimiter"], strict=True):
                for k in (0, 1):
                    state[k] = open_after(value, delimiter, state[k])
                    ends[k] += not state[k]
        if split:
            yield done()

    return lines.mapInPandas(run, "f string, b bigint, lines bigint, open0 boolean, open1 boolean, ends0 bigint, ends1 bigint")


def _starts(ways: DataFrame) -> DataFrame:
    """``f, b, open, before, records``: what is open at each split's start, and the lines and records before it.

    A split leaves quotes as they were, turns them over, or sets them whatever they were; so they are as the last split that
    set them left them, turned over as often as happened since.
    """
    order = Window.partitionBy("f").orderBy("b")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    turned = ways.select("*", F.sum((F.col("open0") & ~F.col("open1")).cast("int")).over(order).alias("turns"), (F.col("open0") == F.col("open1")).alias("sets"))
    last = lambda c: F.last(F.when(F.col("sets"), c), ignorenulls=True).over(past)
    since = F.coalesce(F.last("turns").over(past), F.lit(0)) - F.coalesce(last(F.col("turns")), F.lit(0))
    known = turned.select("f", "b", "lines", "ends0", "ends1", ((F.coalesce(last(F.col("open0").cast("int")), F.lit(0)) + since) % 2 == 1).alias("open"))
    ends = F.when(F.col("open"), F.col("ends1")).otherwise(F.col("ends0"))
    total = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0))
    return known.select("f", "b", "open", total(F.col("lines")).alias("before"), total(ends).alias("records"))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, row, value``: the lines of text files with their physical numbers from 1, read in splits."""
    lines = split_lines(spark, paths)
    counts = lines.groupBy("f", "b").agg(F.count("*").alias("lines"))
    past = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("f", "b", F.coalesce(F.sum("lines").over(past), F.lit(0)).alias("before"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, n = None, 0
        for key, part in _by_split(frames):
            n = n if key == split else 0
            split = key
            yield pd.DataFrame({"path": part["f"], "row": part["before"] + range(n + 1, n + 1 + len(part)), "value": part["value"]})
            n += len(part)

    return lines.join(F.broadcast(starts), ["f", "b"]).mapInPandas(run, "path string, row bigint, value string")  # one small row a split


def parsed(text: str, delimiter: str) -> list[str]:
    """The cells of one record; a blank line has none."""
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), [])


def delimited_records(spark: SparkSession, paths: str | list[str], delimiter: Column) -> DataFrame:
    """``path, n, row, cells``: each record of delimited files, its number from 0 and the line it ends on.

    ``delimiter`` is a column of ``f``, the path. Fields may hold line ends in quotes, over as many lines and splits as they like;
    a file that ends inside quotes ends its last record, without its last line end. A byte-order mark is no part of the first cell.
    """
    lines = split_lines(spark, paths).withColumn("delimiter", delimiter)
    stage = Staging(spark, "delimited")
    starts = stage.put(_starts(_ways(lines)), "starts")
    schema = "f string, b bigint, n bigint, row bigint, delimiter string, cells array<string>, text string"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, held, torn, inside, n, row, delimiter = None, [], False, False, 0, 0, ""
        columns = ["f", "b", "n", "row", "delimiter", "cells", "text"]
        left = lambda: [(*split, n, row, delimiter, None, "\n".join(held))] if split and held else []
        for key, part in _by_split(frames):
            out = []
            if key != split:
                out = left()
                first = part.iloc[0]
                split, held, inside, n, row, delimiter = key, [], bool(first["open"]), int(first["records"]), int(first["before"]), first["delimiter"]
                torn = inside
            for value in part["value"]:
                row += 1
                if row == 1:
                    value = value.removeprefix("﻿")
                held.append(value)
                inside = open_after(value, delimiter, inside)
                if not inside:
                    text = "\n".join(held)
                    out.append((*split, n, row, delimiter, None, text) if torn else (*split, n, row, delimiter, parsed(text, delimiter), None))
                    held, torn, n = [], False, n + 1
            if out:
                yield pd.DataFrame(out, columns=columns)
        if left():
            yield pd.DataFrame(left(), columns=columns)

    parts = stage.put(lines.join(F.broadcast(starts), ["f", "b"]).mapInPandas(cut, schema), "parts")  # one small row a split
    whole = parts.where("text is null").select(F.col("f").alias("path"), "n", "row", "cells")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("b", "text"))), lambda x: x["text"])
    joined = parts.where("text is not null").groupBy("f", "n").agg(F.max("row").alias("row"), F.first("delimiter").alias("delimiter"), F.array_join(pieces, "\n").alias("text"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["f"], "n": pdf["n"], "row": pdf["row"], "cells": [parsed(t, d) for t, d in zip(pdf["text"], pdf["delimiter"], strict=True)]})

    return whole.unionByName(joined.mapInPandas(parse, "path string, n bigint, row bigint, cells array<string>"))
