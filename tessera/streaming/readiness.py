"""Readiness of transcripts: pending, ready, missing or failed, as keyed state of a stream and as one batch plan with the same rows.

events: artifact_id, at, kind (request, transcript or failed), paths (of a request: how many files it has), segments (of a transcript), warning. The
newest event decides, whatever order events come in; of events of one time a transcript decides before a failure, and that before a
request. A request without files is missing. One that nothing has answered when the watermark (the newest time less late) is more than
the timeout past it is failed. Warnings are distinct, by the time that they were first given.

A stream drops events that are older than its watermark when they come; in a table all events count.

Defined results: rows with a null artifact_id, time or kind, or with another kind, count for nothing; a null count is 0; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Ranks of kinds of one time, and warnings of what is missing or late.
KINDS = {"request": 0, "failed": 1, "transcript": 2}
NO_PATHS, TOO_LATE = "no_material_paths", "transcription_timeout"
TIMEOUT, LATE = timedelta(hours=6), timedelta(hours=1)
OUT = "artifact_id string, status string, segments long, warnings array<string>"
_STATE = "at long, rank int, status string, segments long, times array<long>, warnings array<string>"


def _events(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("artifact_id").cast("string").alias("artifact_id"), F.col("at").cast("timestamp").alias("at"), "kind", F.coalesce(F.col("paths").cast("long"), F.lit(0)).alias("paths"), F.coalesce(F.col("segments").cast("long"), F.lit(0)).alias("segments"), "warning")
    return rows.filter(F.col("kind").isin(*KINDS) & F.col("artifact_id").isNotNull() & F.col("at").isNotNull())


def _judged(rows: DataFrame) -> DataFrame:
    """events with micros, rank, the status that each alone gives, and its warning."""
    rank = F.lit(0)
    for kind, r in KINDS.items():
        rank = F.when(F.col("kind") == kind, r).otherwise(rank)
    bare = (F.col("kind") == "request") & (F.col("paths") == 0)
    status = F.when(bare, "missing").when(F.col("kind") == "request", "pending").when(F.col("kind") == "failed", "failed").otherwise("ready")
    warning = F.when(bare, NO_PATHS).when((F.col("kind") == "failed") & (F.coalesce("warning", F.lit("")) != ""), F.col("warning"))
    return rows.withColumns({"micros": F.unix_micros("at"), "rank": rank, "status": status, "told": warning, "segments": F.when(F.col("kind") == "transcript", F.col("segments")).otherwise(0)})


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def readiness(events: DataFrame, timeout: timedelta = TIMEOUT, late: timedelta = LATE) -> DataFrame:
    """artifact_id, status, segments, warnings of each artifact of a finished table of events."""
    rows = _judged(_events(events))
    newest = F.struct("micros", "rank", "segments", "paths")
    last = rows.groupBy("artifact_id").agg(F.max_by(F.struct("micros", "status", "segments"), newest).alias("s")).select("artifact_id", "s.*")
    # One row.
    last = last.join(F.broadcast(rows.agg((F.max("micros") - _micros(late)).alias("mark"))), F.lit(True))
    gone = (F.col("status") == "pending") & (F.col("micros") + _micros(timeout) < F.col("mark"))
    firsts = rows.filter("told is not null").groupBy("artifact_id", "told").agg(F.min("micros").alias("first"))
    told = firsts.groupBy("artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "told"))), lambda x: x["told"]).alias("warnings"))
    warnings = F.coalesce("warnings", F.array().cast("array<string>"))
    out = last.join(told, "artifact_id", "left").withColumn("gone", gone)
    return out.select("artifact_id", F.when(F.col("gone"), "failed").otherwise(F.col("status")).alias("status"), "segments", F.when(F.col("gone"), F.array_append(F.array_remove(warnings, TOO_LATE), F.lit(TOO_LATE))).otherwise(warnings).alias("warnings"))


def _folded(timeout: timedelta):
    limit = _micros(timeout)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, rank, status, segments, times, warnings = state.get if state.exists else (-(1 << 62), -1, "", 0, [], [])
        told = dict(zip(warnings, times))
        if state.hasTimedOut:
            told[TOO_LATE] = at + limit
            status = "failed"
            state.update((at, rank, status, segments, list(told.values()), list(told)))
        else:
            best = (at, rank, segments, 0)
            for batch in batches:
                for micros, r, s, n, p, w in zip(batch["micros"], batch["rank"], batch["status"], batch["segments"], batch["paths"], batch["told"]):
                    if (micros, r, n, p) > best:
                        best, status = (micros, r, n, p), s
                    if w:
                        told[w] = min(told.get(w, micros), micros)
            if (best[0], best[1]) != (at, rank):
                # What came after a timeout takes it back.
                told.pop(TOO_LATE, None)
            at, rank, segments = best[0], best[1], best[2]
            state.update((at, rank, status, segments, list(told.values()), list(told)))
            if status == "pending":
                state.setTimeoutTimestamp(max((at + limit) // 1000, state.getCurrentWatermarkMs() + 1))
        ordered = sorted(told, key=lambda w: (told[w], w))
        yield pd.DataFrame({"artifact_id": [key[0]], "status": [status], "segments": [segments], "warnings": [ordered]})

    return run


def readiness_stream(events: DataFrame, timeout: timedelta = TIMEOUT, late: timedelta = LATE) -> DataFrame:
    """The same of a stream of events, in update mode: a row for each artifact that changes. State is one row an artifact."""
    rows = _judged(_events(events).withWatermark("at", f"{_micros(late)} microseconds"))
    return rows.groupBy("artifact_id").applyInPandasWithState(_folded(timeout), OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def text_units(units: DataFrame, artifacts: DataFrame, ready: DataFrame) -> DataFrame:
    """Units after their transcripts: season_id, episode_id, pos, unit_id, unit_kind, artifact_id, segments, status.

    units: season_id, episode_id, pos, unit_id, unit_kind, artifact_id. artifacts: artifact_id, season_id, episode_id. ready: as of readiness. A ready
    transcript takes the place of its old unit or the next place of its episode; one that is missing or failed loses its unit; a pending
    one keeps it. pos runs from 1 in each episode.
    """
    keys = ["season_id", "episode_id", "artifact_id"]
    known = artifacts.join(ready.select("artifact_id", "status", "segments"), "artifact_id")
    is_text = F.col("unit_kind") == "transcript_text"
    old = units.filter(is_text).groupBy(*keys).agg(F.min("pos").alias("old"))
    others = units.filter(~F.coalesce(is_text, F.lit(False))).select(*keys, "unit_id", "unit_kind", F.col("pos").cast("long").alias("at"), F.lit(None).cast("long").alias("segments"), F.lit(None).cast("string").alias("status"))
    now = known.join(old, keys, "left").filter("status = 'ready' or status = 'pending' and old is not null")
    unit_id = F.concat(F.lit("unit_"), F.substring(F.sha1(F.concat(F.lit("transcript:"), "artifact_id")), 1, 12))
    # New ones follow all that is there, by their ids.
    texts = now.select(*keys, unit_id.alias("unit_id"), F.lit("transcript_text").alias("unit_kind"), F.coalesce(F.col("old").cast("long"), F.lit(1 << 40)).alias("at"), "segments", "status")
    unknown = units.filter(is_text).join(known.select("artifact_id"), "artifact_id", "left_anti").select(*keys, "unit_id", "unit_kind", F.col("pos").cast("long").alias("at"), F.lit(None).cast("long").alias("segments"), F.lit(None).cast("string").alias("status"))
    rows = others.unionByName(texts).unionByName(unknown)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("season_id", "episode_id").orderBy("at", "unit_id"))).select("season_id", "episode_id", "pos", "unit_id", "unit_kind", "artifact_id", "segments", "status")
