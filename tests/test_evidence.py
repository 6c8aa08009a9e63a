from tessera.operators import evidence as E

SCHEMA = "season_id string, episode_id string, file_name string, readable boolean, valid boolean, extraction_stage string, extraction_run_id string, insight_summary string, " + ", ".join(f"{f} array<string>" for f in E.FIELDS)


def chunk(season, episode, name, stage="full", run="r1", readable=True, valid=True, insight="", **lists):
    return (season, episode, name, readable, valid, stage, run, insight, *[lists.get(f, []) for f in E.FIELDS])


def contents(spark, rows, run="r1", **options):
    return E.episode_contents(spark.createDataFrame(rows, SCHEMA), run, **options)


def test_run_filter_and_warnings(spark):
    rows = [chunk("s", "e", "b.json", facts=["x", "y"], insight=" later "), chunk("s", "e", "A.json", " FULL ", facts=["y", "y ", "z"], insight="first"), chunk("s", "e", "old.json", run="r0"), chunk("s", "e", "pre.json", "preview"), chunk("s", "e", "leg.json", None), chunk("s", "e", "bad.json", valid=False), chunk("s", "e", "no.json", readable=False), chunk("s", "f", "p.json", "preview", facts=["p"])]
    got = {r.episode_id: r for r in contents(spark, rows).collect()}
    e = got["e"]
    assert e.facts == ["y", "y ", "z", "x"] and e.insight_summary == "first | later" and (e.total_chunk_files, e.full_chunks, e.skipped_chunks) == (7, 2, 5)
    assert e.aggregation_warnings == ["chunk_validation_failed:bad.json", "chunk_read_failed:no.json", "chunk_run_mismatch:old.json"]
    assert got["f"].facts == [] and got["f"].aggregation_warnings == ["no_full_chunks:s/f"]
    assert {r.episode_id: r.facts for r in contents(spark, rows, " ", wanted="preview").collect()}["f"] == ["p"]
    assert contents(spark, rows, "").filter("episode_id = 'e'").first().full_chunks == 3
    assert E.episode_contents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_states_follow_episodes(spark):
    rows = [chunk("s1", "E2", "a", facts=["Ann left"]), chunk("s1", "e1", "a", behavior_traits=["ann sings; loudly"], facts=["Ann sat"], conflicts=["Ann or Bob"]), chunk("s2", "e1", "a", facts=["nobody"]), chunk("s2", "e2", "a", conflicts=["Ann or Bob", "Anna?"])]
    got = E.states(contents(spark, rows), E.match_terms(" Ann", ["ann", "A"]))
    assert [tuple(r) for r in got.orderBy("season_id", "evidence_count").collect()] == [("s1", "e1", "ann sings; loudly", 3, ["Ann or Bob"]), ("s1", "E2", "ann sings; loudly; Ann left", 4, ["Ann or Bob"]), ("s2", "e2", "ann sings; loudly; Ann left", 6, ["Ann or Bob", "Anna?"])]
    assert tuple(E.final_state(got).first()) == ("ann sings; loudly; Ann left", 6, ["Ann or Bob", "Anna?"])
    assert {r.season_id: (r.n_states, r.evidence_count) for r in E.stage_states(got).collect()} == {"s1": (2, 4), "s2": (1, 6)}
    assert not E.states(contents(spark, rows), ["A"]).collect() and not E.final_state(got.limit(0)).collect()


def test_layers(spark):
    rows = [chunk("s", "1", "a", facts=["Nick ran"], targets=["Nick"]), chunk("s", "2", "a", targets=["Nick (hero)"]), chunk("s", "3", "a", conflicts=["Nick knows the MOTIVE"]), chunk("s", "4", "a", facts=["no one"], targets=["Other"]), chunk("s", "5", "a", relationship_interactions=["with Nick"])]
    got = {r.episode_id: r for r in E.layers(contents(spark, rows), ["Nick"]).collect()}
    assert {k: r.layer for k, r in got.items()} == {"1": "direct", "2": "mention", "3": "causal", "5": "mention"}
    assert got["1"].source_fields == ["facts"] and got["1"].match_terms == ["Nick"] and got["2"].source_fields == ["targets"] and got["3"].evidence_summary == "Nick knows the MOTIVE"
    assert {r.episode_id for r in E.layers(contents(spark, rows), ["x"]).collect()} >= {"1", "4"}  # without a usable term all items count
    groups = E.conflict_groups(contents(spark, rows), ["Nick"]).collect()
    assert [(r.description, r.source_episode, r.severity, r.candidate_explanations) for r in groups] == [("Nick knows the MOTIVE", "s/3", "info", ["needs_human_review"])]


def test_seasons(spark):
    rows = [chunk("s", "e1", "a", facts=["one"], conflicts=["c"]), chunk("s", "e2", "a", facts=["two", "one"])]
    found = contents(spark, rows)
    kept = found.selectExpr("*", "'full' AS extraction_stage", "'r1' AS extraction_run_id", "true AS readable")
    manifest = spark.createDataFrame([("s", "e1"), ("s", "e2"), ("s", "e3"), ("t", "e1")], "season_id string, episode_id string")
    got = {r.season_id: r for r in E.season_contents(manifest, kept, "r1").collect()}
    assert got["s"].facts == ["one", "two"] and got["s"].aggregation_warnings == ["episode_content_missing:e3"] and (got["s"].total_episodes, got["s"].full_episodes) == (3, 2)
    assert got["t"].aggregation_warnings == ["episode_content_missing:e1", "no_full_episode_contents:t"]
    told = {r.season_id: (r.background, r.unresolved_threads) for r in E.season_summaries(kept, E.season_contents(manifest, kept, "r1")).collect()}
    assert told == {"s": ("e1: one | e2: two; one", ["c"]), "t": ("", [])}
