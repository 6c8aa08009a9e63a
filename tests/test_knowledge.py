import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import knowledge as K

SCHEMA = "kind string, project_id string, season_id string, episode_id string, item_id string, text string"


def rows(spark, *more):
    out = [("source_manifest", "p", None, None, None, "{}"), ("run_plan", "p", None, None, "r1", '{"n": 1}'), ("run_plan", "p", None, None, "r2", '{"n": 2}'), ("card", "p", None, None, "ann", '{"a": 1}'), ("card", "q", None, None, "bob", "{}")]
    out += [("episode_content", "p", f"s{s}", f"e{e}", None, json.dumps({"at": [s, e]})) for s in (1, 2) for e in (1, 2, 3)]
    out += [(k, "p", "s1", "e1", f"c{c}", json.dumps({"c": c})) for c in (1, 2) for k in ("chunk", "preview_chunk")]
    return spark.createDataFrame([*out, *more], SCHEMA)


def test_what_is_written_is_read(spark, tmp_path):
    root, log = str(tmp_path / "kb"), str(tmp_path / "log")
    K.save(rows(spark), root, log=log)
    got = sorted(repr(tuple(r)) for r in K.store(spark, root).select(*K.KEYS, "text").collect())
    assert got == sorted(repr(tuple(r)) for r in rows(spark).collect())
    assert {r.status for r in spark.read.json(log).collect()} == {"written"} and spark.read.json(log).count() == len(got)
    assert not [f for _, _, names in os.walk(root) for f in names if f.startswith(".") and not f.endswith(".crc")]


def test_filters_keep_files_unread(spark, tmp_path):
    root = str(tmp_path / "kb")
    K.save(rows(spark), root)
    reader = K.PushedReader({"path": root, "season_id": "s1"})
    assert [(p.project, p.folder) for p in reader.partitions()] == [("p", "seasons/s1")]
    rest = list(reader.pushFilters([K.EqualTo(("episode_id",), "e1"), K.In(("kind",), ("chunk", "episode_content")), K.EqualTo(("text",), "x")]))
    assert rest == [K.EqualTo(("text",), "x")]
    os.chmod(f"{root}/p/seasons/s1/episodes/e2", 0)
    found = [b.to_pylist()[0]["path"] for p in reader.partitions() for b in reader.read(p)]
    assert found == [f"p/seasons/s1/episodes/e1/{n}.json" for n in ("chunks/c1", "chunks/c2", "episode_content")]
    os.chmod(f"{root}/p/seasons/s1/episodes/e2", 0o755)
    assert K.store(spark, root, kind="run_plan", item_id="r2").select("item_id", K.field("$.n", "int").alias("n")).collect() == [("r2", 2)]
    assert K.store(spark, root, project_id="none").count() == 0 and K.store(spark, root, season_id="s2", kind="card").count() == 0
    assert K.store(spark, root, episode_id="e3").count() == 2 and K.store(spark, root, kind="source_manifest").count() == 1


def test_pushed_filters_give_the_same_rows(spark, tmp_path):
    root = str(tmp_path / "kb")
    K.save(rows(spark), root)
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    try:
        for on in ("true", "false"):
            spark.conf.set(key, on)
            df = K.store(spark, root).filter(F.col("season_id").isin("s1", "s2") & (F.col("episode_id") == "e2"))
            assert sorted(r.path for r in df.collect()) == [f"p/seasons/s{i}/episodes/e2/episode_content.json" for i in (1, 2)]
    finally:
        spark.conf.set(key, before)


def test_failing_tasks_leave_nothing(spark, tmp_path):
    root = str(tmp_path / "kb")
    bad = rows(spark, ("chunk", "p", "s1", "../e", "c", "{}")).repartition(4)
    with pytest.raises(Exception, match="no safe place"):
        K.save(bad, root)
    assert not [f for _, _, names in os.walk(root) for f in names]


def test_targets_are_kept_or_backed_up(spark, tmp_path):
    root, log = str(tmp_path / "kb"), str(tmp_path / "log")
    one = lambda text: spark.createDataFrame([("card", "p", None, None, "ann", text)], SCHEMA)
    K.save(one('{"v": 1}'), root)
    K.save(one('{"v": 2}'), root, log=log)
    assert [r.status for r in spark.read.json(log).collect()] == ["target_exists"]
    time.sleep(0.01)
    K.save(one("no json"), root, overwrite=True)
    files = K.store(spark, root)
    good, issues = K.current(files)
    assert [(r.path, r.text) for r in good.collect()] == [("p/character_cards/ann/card.json", '{"v": 1}')]
    assert [tuple(r) for r in issues.collect()] == [("p/character_cards/ann/card.json", True)]
    K.save(one('{"v": 3}'), root, overwrite=True)
    good, issues = K.current(K.store(spark, root))
    assert [r.text for r in good.collect()] == ['{"v": 3}'] and issues.count() == 0


def test_states_of_both_forms(spark):
    texts = ['{"season_id": "x1", "characters": {"Ann": {"stage_states": [1], "final_state": {"a": 1}}, "Bob": {}}}', '{"character": "Cid", "stage_states": [2]}', '{"character": ""}', "[]", None]
    files = spark.createDataFrame([("stage_states", f"s{i}", t) for i, t in enumerate(texts)], "kind string, season_id string, text string")
    got = sorted(tuple(r) for r in K.stage_characters(files).collect())
    assert got == [("s1", "Cid", "[2]", "{}"), ("x1", "Ann", "[1]", '{"a":1}'), ("x1", "Bob", "[]", "{}")]


def test_card_summaries(spark):
    texts = ['{"card_kind": "official", "identity": {"character_name": "Ann"}, "updated_at": "2024-01-02T00:00:00", "quality": {"warnings": ["q"]}, "evidence": {"warnings": ["e"]}, "assets": {"cover_path": "c.png"}}', '{"card_kind": "preview"}', '{"updated_at": "2025-01-02T00:00:00", "user_metadata": {"tags": ["t"]}}']
    files = spark.createDataFrame([("card", f"k{i}", f"p/character_cards/k{i}/card.json", t) for i, t in enumerate(texts)], "kind string, item_id string, path string, text string")
    got = [(r.card_id, r.display_name, r.tags, r.cover_path, r.warnings) for r in K.card_summaries(files).collect()]
    assert got == [("k2", "k2", ["t"], "", []), ("k0", "Ann", [], "p/character_cards/k0/c.png", ["q", "e"])]


def test_manifests_that_still_hold(spark):
    a, b, f1, f2 = "a" * 64, "b" * 64, "sha256:" + "1" * 64, "sha256:" + "2" * 64
    make = lambda raw, h, *files: json.dumps({"source_raw_path": raw, "source_hash": h, "derived_materials": [{"material_relative_path": p, "size_bytes": n, "fingerprint": f} for p, n, f in files]})
    texts = [("m1", 1, make("raw/x.zip", a, ("t/1.txt", 5, f1))), ("m2", 2, make("raw/x.zip", a, ("t/1.txt", 5, f1), ("t/2.txt", 6, f2))), ("m3", 3, make("raw/x.zip", b, ("t/1.txt", 5, f1))), ("m4", 1, make("raw/y.zip", a, ("t/1.txt", 4, f1))), ("m5", 1, make("raw/z.zip", "short", ("t/1.txt", 5, f1))), ("m6", 1, "[]"), ("m7", 1, make("raw/w.zip", a, ("../1.txt", 5, f1))), ("m8", 1, make("./raw\\v.zip", b, ("t/2.txt", 6, f2)))]
    manifests = spark.createDataFrame(texts, "path string, m int, text string").select("path", F.timestamp_seconds("m").alias("modified"), "text")
    sources = spark.createDataFrame([(f"raw/{c}.zip", b if c == "v" else a) for c in "xyzwvu"], "raw_path string, hash string")
    derived = spark.createDataFrame([("t/1.txt", 5, f1), ("t/2.txt", 6, f2), ("../1.txt", 5, f1)], "path string, size long, fingerprint string")
    got = {r.raw_path[4]: (r.manifest, r.reason) for r in K.reusable(manifests, sources, derived).collect()}
    assert got == {"x": ("m2", "reused"), "y": (None, "derived_files_changed"), "z": (None, "manifest_invalid"), "w": (None, "derived_files_changed"), "v": ("m8", "reused"), "u": (None, "manifest_missing")}


def test_a_saved_knowledge_base_is_read_once(spark):
    from tessera.plans import store_queries

    rows = spark.createDataFrame([("episode_content", "p", "s", f"e{i}", None, "{}") for i in range(30)], "kind string, project_id string, season_id string, episode_id string, item_id string, text string")
    files = store_queries._saved(rows)
    assert files.count() == 30 and "knowledge_base" not in files._jdf.queryExecution().executedPlan().toString()
