"""Event-sourced stages: replay in batch by windows, and the same fold over a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Scheduler states and what they mean for a job.
JOB_STATES = {"PENDING": "queued", "CONFIGURING": "queued", "RUNNING": "running", "COMPLETING": "running", "COMPLETED": "succeeded", "FAILED": "failed", "TIMEOUT": "failed", "CANCELLED": "cancelled", "OUT_OF_MEMORY": "failed", "NODE_FAIL": "failed"}


def latest(events: DataFrame, key: list[str], at: list[str], value: list[str]) -> DataFrame:
    """The last state of each key: a partial maximum, no sort."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*value), F.struct(*at)).alias("s")).select(*key, "s.*")


def stage_states(events: DataFrame, run: str, stage: str, sequence: str, kind: str) -> DataFrame:
    """``run, stage, state, ready``: each stage after all ``accepted`` and ``changed`` events of its run.

    A change of a stage makes it and all later ones stale until they are accepted again; a stage is ready if
    all earlier ones are accepted.
    """
    last = events.groupBy(run, stage).agg(F.max(F.when(F.col(kind) == "accepted", F.col(sequence))).alias("acc"), F.max(F.when(F.col(kind) == "changed", F.col(sequence))).alias("chg"))
    before = Window.partitionBy(run).orderBy(stage).rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("stale_at", F.max("chg").over(before))
    state = F.when(F.col("acc").isNull(), "pending").when(F.col("stale_at") > F.col("acc"), "stale").otherwise("accepted")
    earlier = Window.partitionBy(run).orderBy(stage).rowsBetween(Window.unboundedPreceding, -1)
    out = last.withColumn("state", state)
    return out.select(run, stage, "state", F.coalesce(F.min((F.col("state") == "accepted").cast("int")).over(earlier) == 1, F.lit(True)).alias("ready"))


def latched(events: DataFrame, key: list[str], kind: str, once: str) -> DataFrame:
    """Whether a one-time exposure has happened; it can't be undone."""
    return events.groupBy(*key).agg(F.coalesce(F.bool_or(F.col(kind) == once), F.lit(False)).alias("exposed"))


def job_states(observed: DataFrame, receipts: DataFrame, job: str, at: str, state: str) -> DataFrame:
    """``job, status``: a receipt's word stands above the scheduler's latest."""
    mapped = F.coalesce(F.create_map(*[F.lit(x) for kv in JOB_STATES.items() for x in kv])[F.upper(F.split(state, r"[ +]")[0])], F.lit("unknown"))
    last = observed.groupBy(job).agg(F.max_by(mapped, at).alias("seen"))
    said = receipts.groupBy(job).agg(F.max_by("outcome", at).alias("outcome"))
    return last.join(said, job, "full_outer").select(job, F.coalesce("outcome", "seen").alias("status"))


def resumable(expected: DataFrame, ledger: DataFrame, keys: list[str], digest: str) -> tuple[DataFrame, DataFrame]:
    """``(reuse, redo)`` of expected cells: a cell is reused if a trial of the same digest ended, else done again."""
    ended = ledger.where(F.col("status").isin("complete", "failed")).select(*keys, digest).distinct()
    return expected.join(ended, [*keys, digest], "left_semi"), expected.join(ended, [*keys, digest], "left_anti")


def stream_stage_states(events: DataFrame, run: str, stage: str, sequence: str, kind: str) -> DataFrame:
    """The fold of ``stage_states`` over a stream: ``run, stage, state, ready`` for each stage that a batch changes in either.

    The state of a run is, for each stage, the last accepted and the last changed sequence number: as large as the
    run has stages, whatever the number of events. Both are maxima, so late events, repeated ones and batches cut in any way
    end in the same states, which are those of the table.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {s: (a, c) for s, a, c in zip(*state.get, strict=True)} if state.exists else {}
        old = stage_verdicts(held)
        for pdf in batches:
            for s, n, k in zip(pdf["stage"].tolist(), pdf["sequence"].tolist(), pdf["kind"].tolist(), strict=True):
                a, c = held.get(s, (-1, -1))
                held[s] = (max(a, n), c) if k == "accepted" else (a, max(c, n)) if k == "changed" else (a, c)
        state.update(([*held], [a for a, _ in held.values()], [c for _, c in held.values()]))
        new = [(s, *x) for s, x in stage_verdicts(held).items() if old.get(s) != x]
        yield pd.DataFrame({"run": [key[0]] * len(new), "stage": [s for s, _, _ in new], "state": [x for _, x, _ in new], "ready": [r for _, _, r in new]})

    rows = events.select(F.col(run).cast("string").alias("run"), F.col(stage).cast("int").alias("stage"), F.col(sequence).cast("long").alias("sequence"), F.col(kind).alias("kind"))
    return rows.groupBy("run").applyInPandasWithState(fold, "run string, stage int, state string, ready boolean", "stages array<int>, accepted array<bigint>, changed array<bigint>", "append", GroupStateTimeout.NoTimeout)


def _states(held: dict[int, tuple[int, int]]) -> dict[int, str]:
    stale, out = -1, {}
    for s in sorted(held):
        accepted, changed = held[s]
        stale = max(stale, changed)
        out[s] = "pending" if accepted < 0 else "stale" if stale > accepted else "accepted"
    return out


def stage_verdicts(held: dict[int, tuple[int, int]]) -> dict[int, tuple[str, bool]]:
    """``(state, ready)`` of each stage, from when it was last accepted and last changed: ``stage_states`` of one run."""
    out, ready = {}, True
    for s, state in _states(held).items():
        out[s] = state, ready
        ready = ready and state == "accepted"
    return out


def windowed(events: DataFrame, at: str, keys: list[str], length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums in tumbling or sliding windows, over a table or a stream (with a watermark, if given)."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.window(at, length, slide or length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, at: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Sessions that end after a gap."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """Repeats of a key within the watermark go."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
