from pyspark.sql import functions as F

from tessera.operators import cards as C
from tessera.operators import context as X
from tessera.operators import joins, runs
from tessera.sources import scans, stores, texts


def test_progress_is_the_same_for_any_buckets(spark):
    from tessera.streaming import events

    rows = spark.createDataFrame([("k", t, v, end) for t, (v, end) in enumerate([(10, None), (5, None), (150, None), (20, None), (99, "success"), (100, None)])] + [(None, 1, 3, None)], "k string, t int, v int, end string")
    for width in (1, 2, 10):
        got = events.progress(rows, "k", ("t",), "v", "end", F.floor(F.col("t") / width)).orderBy("k", "t").collect()
        assert [(r.k, r.t, r.shown) for r in got] == [(None, 1, 3), ("k", 0, 10), ("k", 2, 99), ("k", 4, 100)]
        last = joins.last_where(rows, "k", ("t",), F.col("v") > 9, "v", "seen", F.floor(F.col("t") / width)).orderBy("k", "t").collect()
        assert [r.seen for r in last] == [None, None, 10, 10, 150, 20, 99]


def test_selection_takes_briefer_views(spark):
    rows = spark.createDataFrame([("s", "e1", 0, 0.7, False, [60, 30, 10]), ("s", "e2", 1, 0.4, False, [60, 30, 10]), ("s", "e3", 2, 0.1, True, [80, 50, 40]), ("s", "e4", 3, 0.9, False, [0, 5, 5]), ("s", "e5", 4, 0.2, False, [9, 9, 9])], "k string, episode_id string, place int, relevance double, is_previous boolean, costs array<bigint>")
    got = X.selected(rows, "k", 100).orderBy("used").collect()
    assert [(r.episode_id, r.view, r.used, r.reason) for r in got] == [("e3", "full_context_view", 80, "previous_episode_priority"), ("e1", "context_brief", 90, "strong_relevance"), ("e2", "context_brief", 100, "medium_relevance")]
    assert not X.selected(rows.limit(0), "k").collect()


def test_overlap_of_lists(spark):
    rows = spark.createDataFrame([(["A b", "c"], ["ab", "D", "e"]), ([], ["x"]), (["x", "X "], ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(X.overlap(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0, 1.0]


def test_copy_policies_and_packages(spark):
    refs = spark.createDataFrame([("s", 1, "materials/a/../b.txt", "copy_allowed", True, 5), ("s", 2, "raw/big", "index_only_large", True, 99), ("s", 3, "gone", "missing", False, None), ("s", 4, "out", "outside_project", True, 1), ("s", 5, "lost", "copy_allowed", False, None)], "sample string, pos int, label string, policy string, exists boolean, size long")
    r = runs.packaged(refs, True, 50).first()
    assert (r.copied, r.indexed, r.missing) == (["materials/a/b.txt"], ["raw/big", "out"], ["gone", "lost"]) and len(r.warnings) == 2
    assert runs.packaged(refs, False, 50).first().indexed == ["materials/a/../b.txt", "raw/big", "out", "lost"]


def test_aligned_subtitles(spark):
    videos = spark.createDataFrame([("e1", "a/One.mp4", "a/One.mp4"), ("e2", "a/two.mp4", "a/two.mp4"), ("e3", "b/x.mkv", "b")], "episode_id string, path string, episode_path string")
    files = spark.createDataFrame([("a/one.SRT",), ("b/any.ass",), ("c/none.vtt",), ("b/note.txt",)], "path string")
    got = {r.path: (r.episode_id, r.status, r.rule) for r in scans.aligned(files, videos).collect()}
    assert got == {"a/one.SRT": ("e1", "matched", "same_stem"), "b/any.ass": ("e3", "matched", "same_episode_directory"), "c/none.vtt": (None, "unmatched", None)}
    units, alone = scans.attached(files, scans.aligned(files, videos))
    assert sorted((r.episode_id, r.path, r.unit_kind) for r in units.collect()) == [("e1", "a/one.SRT", "subtitle_text"), ("e3", "b/any.ass", "subtitle_text")] and sorted(r.path for r in alone.collect()) == ["b/note.txt", "c/none.vtt"]


def test_container_entries(spark):
    schema = "path string, pos int, entry string, size long, packed long, encrypted boolean, special boolean, directory boolean"
    rows = [("z", i, e, 10, 10, False, False, e.endswith("/")) for i, e in enumerate(["a/b.txt", "A\\B.txt", "con.log", "x/./y", "ok/", "a:b", "trail.", "good"])] + [("y", 0, "n", 5, 5, False, False, False)] * 3
    got = {(r.path, r.pos): r.rejected for r in texts.checked_entries(spark.createDataFrame(rows, schema), most_entries=8).collect()}
    assert got == {("z", 0): None, ("z", 1): "entry_path_collision", ("z", 2): "entry_path_unsafe", ("z", 3): "entry_path_unsafe", ("z", 4): None, ("z", 5): "entry_path_unsafe", ("z", 6): "entry_path_unsafe", ("z", 7): None, ("y", 0): None}


def test_versions_and_warnings(spark):
    tags = ["1.2.3", "v1.2.3-rc.2", "1.2.3-BETA", "1.10.0", "x", "1.2"]
    rows = spark.createDataFrame([(t,) for t in tags], "tag string").withColumn("key", C.version_key(F.col("tag")))
    assert [r.tag for r in rows.filter("key is not null").orderBy("key").collect()] == ["1.2.3-BETA", "v1.2.3-rc.2", "1.2.3", "1.10.0"]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "path string, text string")
    good, bad = stores.configs(none)
    assert good.count() == bad.count() == scans.formal_scan(none).count() == stores.imported(none, "p", "t", spark.createDataFrame([], "card_id string")).count() == 0
    assert runs.traces(spark.createDataFrame([("k", 1, "unit", None, None, None)], "k string, pos int, kind string, id string, path string, media_type string"), "k").count() == 0
