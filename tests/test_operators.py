import io
import zipfile

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import context, joins, rollup
from tessera.sources import files
from tessera.streaming import events


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, lambda c: T.clip(c, 8), "  a  b\tcdefgh ij") == "a b c..."
    assert one(spark, lambda c: T.clip(c, 8), "") == "" and one(spark, lambda c: T.clip(c, 8), None) is None
    assert one(spark, T.token_estimate, "") == 0
    assert one(spark, T.token_estimate, "漢字 abcde") == 5  # 2 + 2, with the margin 4.8
    assert one(spark, T.redact, "http://me:pw@h/x sk-abcdefgh1 Bearer q.r") == "http://***:***@h/x sk-*** Bearer ***"
    assert one(spark, lambda c: T.refuses(c, ["cannot help"]), "I  CANNOT\nhelp") is True
    assert one(spark, lambda c: T.refuses(c, ["cannot help"]), "cannot help" + "x" * 4000) is False
    assert one(spark, lambda c: T.has_term(c, ["x"]), "xyz") is False
    names = spark.createDataFrame([(n,) for n in ("p10", "P2", "a", "2", None)], "n string").orderBy(T.natural_key(F.col("n"))).collect()
    assert [r.n for r in names] == [None, "2", "a", "P2", "p10"]


def test_fixed_chunks_cover_the_text(spark):
    got = one(spark, lambda c: T.fixed_chunks(c, 4, 1), "abcdefghij")
    assert [(p.idx, p.start, p.part) for p in got] == [(0, 0, "abcd"), (1, 3, "defg"), (2, 6, "ghij")]
    assert one(spark, lambda c: T.fixed_chunks(c, 4, 1), "") == []


def test_zip_entries(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/ok.txt", "hello")
        z.writestr("../up.txt", "no")
        z.writestr("bomb.txt", "0" * 10**6)
    rows = files.zip_entries(spark.createDataFrame([("z", held.getvalue()), ("bad", b"x"), ("none", None)], "path string, content binary")).collect()
    assert {(r.path, r.entry): r.rejected for r in rows} == {("z", "a/ok.txt"): None, ("z", "../up.txt"): "unsafe_path", ("z", "bomb.txt"): "ratio", ("bad", None): "not_a_container", ("none", None): "not_a_container"}


def test_greedy_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("s", 1, 50, 20, 10), ("s", 2, 80, 60, 55), ("s", 3, 90, 45, 5)], "s string, candidate long, full long, long long, brief long")
    got = context.greedy(rows, "s", (F.col("candidate"),), ("full", "long", "brief"), 100).orderBy("candidate").collect()
    assert [(r.candidate, r.view, r.used) for r in got] == [(1, 0, 50), (3, 1, 95)]


def test_exactly_one(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "k long, stem string, folder string")
    right = spark.createDataFrame([(7, "a", "z"), (8, "q", "y"), (9, "q", "y")], "v long, stem string, folder string")
    got = joins.exactly_one(left, right, "k", ["stem", "folder"], "v").orderBy("k").collect()
    assert [(r.k, r.v, r.status, r.rule) for r in got] == [(1, 7, "matched", "stem"), (2, None, "ambiguous", None), (3, None, "unmatched", None)]


def test_rollup_of_odd_rows(spark):
    rows = spark.createDataFrame([(0, 1, 0, "A. B. A!"), (0, 1, 1, None), (0, 2, 0, " \n"), (0, 1, 2, "B. C.")], "season long, episode long, chunk long, text string")
    got = rollup.episode_rollup(rows).orderBy("episode").collect()
    assert [(r.episode, r.n_chunks, r.n_items, r.n_distinct, r["items"]) for r in got] == [(1, 3, 5, 3, "A | B | C"), (2, 1, 0, 0, "")]
    assert not rollup.episode_rollup(rows.limit(0)).collect()


def test_latest_event_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "a"), (1, 12, "b"), (2, 5, "c"), (1, 11, "d")], "k long, t long, v string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = events.latest(stream, "k", ("t",)).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.k, r.v) for r in spark.table("latest").collect()) == [(1, "b"), (2, "c")]


def test_season_background_holds_all_items(spark):
    rows = spark.createDataFrame([(0, 1, 0, "A. B. C. A"), (0, 1, 1, "D"), (0, 2, 0, "E")], "season long, episode long, chunk long, text string")
    assert [r.background for r in rollup.season_background(rows).collect()] == ["1: A; B; C; D | 2: E"]


def test_spans_without_end_overlap(spark):
    ranges = spark.createDataFrame([("k", 1, 0.0, 5.0), ("k", 2, 100.0, 200.0), ("k", 3, 9000.0, 9001.0), ("q", 4, 100.0, 200.0)], "key string, range_id long, lo double, hi double")
    spans = spark.createDataFrame([("k", 7, 150.0, 0.0), ("k", 8, 3.0, 4.0)], "key string, span_id long, start double, end double")
    got = joins.overlapping(ranges, spans, "key", 10).collect()
    assert sorted((r.key, r.range_id, r.span_id) for r in got) == [("k", 1, 8), ("k", 2, 7), ("k", 3, 7)]
