import random
from datetime import datetime, timedelta

from tessera.streaming import readiness as R

SCHEMA = "artifact_id string, at timestamp, kind string, paths int, segments int, warning string"
START = datetime(2024, 1, 1)


def event(key, minute, kind, paths=None, segments=None, warning=None):
    return key, START + timedelta(minutes=minute), kind, paths, segments, warning


def rows_of(df):
    return {r.artifact_id: (r.status, r.segments, r.warnings) for r in df.collect()}


CASES = [event("a", 0, "request", 2), event("a", 5, "transcript", None, 7), event("b", 0, "request", 0), event("c", 0, "request", 1), event("d", 0, "request", 1), event("d", 3, "failed", None, None, "x"), event("d", 9, "failed", None, None, "x"), event("d", 7, "failed", None, None, "y"),
         event("e", 1, "failed", None, None, "z"), event("e", 1, "transcript", None, 3), event("f", 700, "request", 1), event("g", 4, "other"), event(None, 4, "request", 1), event("h", 800, "failed", None, None, ""), event("h", 800, "failed")]


def test_what_the_newest_event_says(spark):
    got = rows_of(R.readiness(spark.createDataFrame(CASES, SCHEMA)))
    assert got == {"a": ("ready", 7, []), "b": ("missing", 0, [R.NO_PATHS]), "c": ("failed", 0, [R.TOO_LATE]), "d": ("failed", 0, ["x", "y"]), "e": ("ready", 3, ["z"]), "f": ("pending", 0, []), "h": ("failed", 0, [])}
    assert R.readiness(spark.createDataFrame([], SCHEMA)).count() == 0


def streamed(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in{i}")
    found = {}

    def keep(df, n):
        found.update(rows_of(df))

    # One folder after the other: each is a batch of its own.
    for i in range(len(batches)):
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in[0-{i}]")
        R.readiness_stream(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination(240)
    return found


def test_a_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [event(r.choice("abcdefgh"), r.randrange(600), k, r.randrange(3), r.randrange(9), r.choice(["u", "v", ""])) for k in ["request", "transcript", "failed"] * 14] + [event("i", 1, "request", 1), event("j", 2, "request", 1), event("k", 560, "request", 2)]
    r.shuffle(rows)
    last, half = [event("z", 900, "request", 1)], START + timedelta(minutes=300)
    got = streamed(spark, str(tmp_path), [[x for x in rows if x[1] < half], [x for x in rows if x[1] >= half], last])
    assert got == rows_of(R.readiness(spark.createDataFrame(rows + last, SCHEMA)))
    assert got["i"] == ("failed", 0, [R.TOO_LATE])


def test_units_follow_their_transcripts(spark):
    units = spark.createDataFrame([("s", "e", 1, "v1", "video", None), ("s", "e", 2, "old1", "transcript_text", "t1"), ("s", "e", 3, "old2", "transcript_text", "t2"), ("s", "e", 4, "old3", "transcript_text", "t3"), ("s", "e", 5, "old9", "transcript_text", "t9")], "season_id string, episode_id string, pos int, unit_id string, unit_kind string, artifact_id string")
    artifacts = spark.createDataFrame([(f"t{i}", "s", "e") for i in range(1, 6)], "artifact_id string, season_id string, episode_id string")
    ready = spark.createDataFrame([("t1", "ready", 4, []), ("t2", "failed", 0, []), ("t3", "pending", 0, []), ("t4", "ready", 2, []), ("t5", "pending", 0, [])], R.OUT)
    got = [(r.pos, r.unit_kind, r.artifact_id, r.segments, r.status) for r in R.text_units(units, artifacts, ready).orderBy("pos").collect()]
    assert got == [(1, "video", None, None, None), (2, "transcript_text", "t1", 4, "ready"), (3, "transcript_text", "t3", 0, "pending"), (4, "transcript_text", "t9", None, None), (5, "transcript_text", "t4", 2, "ready")]
