import json

from pyspark.sql import functions as F

from tessera.functions import payloads as P

UNITS = "season_id string, episode_id string, chunk_id string, extraction_stage string, extraction_run_id string, unit_id string, unit_kind string, medium string, relative_path string, start_offset long, end_offset long, segments array<struct<source_line:int,start:double,end:double>>, page int, region struct<x:int,y:int,width:int,height:int,unit:string>, payload string"


def unit(chunk, payload, medium="text", kind="text", segments=None, page=None, region=None):
    return "s", "e", chunk, "full", "r", "u", kind, medium, "a/b.txt", 5, 90, segments, page, region, payload


def test_answers_become_typed_rows(spark):
    full = json.dumps({"facts": [" a ", "", 5, None, "b", ["x"]], "relationships": ["r"], "conflicts": "none", "insight_summary": " sum　", "evidence_refs": ["a/b.txt#text=5-90", "q"]})
    cases = [
        unit("1", full), unit("2", json.dumps({"relationship_interactions": None, "relationships": ["r"], "insight_summary": 7}), segments=[(3, 1.0, 2.5), (None, 2.0, 9.25), (8, 3.0, 4.0)], kind="transcript_text"), unit("3", "{bad"), unit("4", "[1]"), unit("5", None),
        unit("6", "{}", "image", "image", page=3, region=(1, 2, 3, 4, "px")), unit("7", "{}", "image"), unit("8", "{}", segments=[(None, 0.0, 1.0)]),
    ]
    rows = {r.chunk_id: r for r in P.chunk_rows(spark.createDataFrame(cases, UNITS)).collect()}
    one = rows["1"]
    assert (one.facts, one.relationship_interactions, one.conflicts, one.insight_summary, one.evidence_refs, one.malformed) == (["a", "b"], ["r"], [], "sum", ["a/b.txt#text=5-90", "q"], False)
    assert rows["2"].relationship_interactions == [] and rows["2"].insight_summary == "7" and rows["2"].evidence_refs == ["a/b.txt#time=1.000-9.250&lines=3-8"]
    assert rows["2"].source_counts == {"materials": 1, "units": 1, "text_ranges": 1, "timed_text_segments": 3, "transcript_segments": 3}
    assert [(rows[c].malformed, rows[c].facts, rows[c].evidence_refs) for c in "345"] == [(True, [], ["a/b.txt#text=5-90"])] * 3
    assert rows["6"].evidence_refs == ["a/b.txt#page=3&region=1,2,3,4,px"] and rows["6"].source_counts == {"materials": 1, "units": 1, "images": 1, "pages": 1, "regions": 1}
    assert rows["7"].evidence_refs == ["a/b.txt#image"] and rows["8"].evidence_refs == ["a/b.txt#time=0.000-1.000"]


def test_media_by_precedence(spark):
    trace = lambda **x: {"source_trace": x}
    cases = {
        "header": ({"media_types": ["x", "text", " text ", "video"], **trace(media_types=["audio"])}, ["text", "video"]),
        "trace": ({"media_types": ["gif"], **trace(media_types=["audio", 5])}, ["audio"]),
        "counted": (trace(source_breakdown={"media_types": {"video": 2, "text": 0, "image": "3", "audio": True, "other": 4, "text ": 1.5}}), ["video", "audio"]),
        "kind": ({"source_kind": " image ", **trace(source_breakdown={"media_types": [1]})}, ["image"]),
        "none": ({"source_kind": "mixed", "media_types": "text", "source_trace": "x"}, []),
    }
    rows = spark.createDataFrame([(k, json.dumps(p)) for k, (p, _) in cases.items()] + [("bad", "{"), ("null", None)], "k string, payload string")
    got = {r.k: r.media_types for r in P.source_metadata(rows).collect()}
    assert got == {k: want for k, (_, want) in cases.items()} | {"bad": [], "null": []}


def test_the_rest_of_the_source(spark):
    refs = lambda *forms: {"material_refs": [{"content_form": f} for f in forms]}
    payload = {"content_forms": ["a", ""], "source_trace": {**refs("b", " a ", ""), "unit_refs": ["u", "u", 3], "derived_artifact_refs": "x"}, "chunk_results": [{"source_trace": refs("c", None)}, 5, {"source_trace": []}], "source_counts": {"n": 2, "gone": None, "l": [1, "x"]}, "evidence_refs": [*map(str, range(30)), "1"], "extraction_run_id": " run "}
    row = P.source_metadata(spark.createDataFrame([(json.dumps(payload), 1)], "payload string, media_types int").drop("media_types").withColumn("media", F.lit(1))).first()
    assert row.content_forms == ["a", "b", "c"] and row.unit_refs == ["u", "3"] and row.derived_refs == [] and row.source_counts == {"n": "2", "l": '[1,"x"]'}
    assert row.evidence_refs == [str(i) for i in range(20)] and row.extraction_run_id == "run" and row.source_kind == ""


def test_short_texts_are_stripped_without_expressions(spark):
    from tessera.functions import text

    ends = [chr(c) for c in range(1, 0x3100)]
    rows = spark.createDataFrame([(a + "x" + a + "y" + a,) for a in ends] + [(None,), ("",), (" \n",), ("x \n",)], "t string")
    assert rows.filter(~P.strip(F.col("t")).eqNullSafe(text.strip(F.col("t")))).count() == 0
    out = P.source_metadata(spark.createDataFrame([('{"source_trace": {"material_refs": [{"content_form": " a\\u00a0"}, 3]}, "chunk_results": [1, {"source_trace": 2}, {"source_trace": {"material_refs": [{"content_form": 7}]}}]}',)], "payload string"))
    assert out.first().content_forms == ["a", "7"]
    plan = out.select("content_forms", "media_types")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
