from pyspark.sql import functions as F

from tessera.sources import scans

LISTING = ["s1/a.mp4", "s1/b.mp4", "s1/A.srt", "s1/c.ass", "s2/ep/segment_1.mp4", "s2/ep/segment_2.mp4", "s2/ep/x.srt", "top.mkv", "book10.txt", "book2.txt", "art/p10.png", "art/p2.PNG", "art/b.gif", "one/x.webp", "voice.mp3", "derived_inputs/k/t.txt", "derived_inputs/k/gone.txt", "readme.exe", "set/setting.md"]


def scanned(spark):
    files = spark.createDataFrame([(p,) for p in LISTING], "path string")
    indexed = spark.createDataFrame([("derived_inputs/k/t.txt", "script", 7, "f1", {"display_title": "lost", "origin": "zip"}), ("art/b.gif", None, 9, "f2", {"page_number": "9"})], "path string, hint string, page_number int, fingerprint string, metadata map<string,string>")
    return scans.material_scan(files, indexed), files


def test_one_plan_of_all_media(spark):
    rows = scanned(spark)[0].orderBy("episode_no", "unit_no").collect()
    got = [(r.episode_no, r.unit_no, r.path, r.unit_kind, r.content_form, r.page) for r in rows]
    videos, episode = [g for g in got if g[3] == "video_chunk"], {}
    assert [v[2] for v in videos] == ["top.mkv", "s1/a.mp4", "s1/b.mp4", "s2/ep/segment_1.mp4", "s2/ep/segment_2.mp4"]
    for g in got:
        episode.setdefault(g[0], []).append(g[2:])
    assert list(episode) == list(range(1, len(episode) + 1))
    assert episode[2] == [("s1/a.mp4", "video_chunk", "unknown", None), ("s1/A.srt", "subtitle_text", "script", None)]
    assert [x[0] for x in episode[4]] == ["s2/ep/segment_1.mp4", "s2/ep/segment_2.mp4", "s2/ep/x.srt"]
    rest = [[(x[0], x[2], x[3]) for x in episode[n]] for n in range(5, len(episode) + 1)]
    assert rest == [
        [("voice.mp3", "audio_drama", None)], [("art/b.gif", "manga", 1), ("art/p2.PNG", "manga", 2), ("art/p10.png", "manga", 3)], [("one/x.webp", "image_set", 1)], [("book2.txt", "novel", None)], [("book10.txt", "novel", None)],
        [("derived_inputs/k/t.txt", "script", 7)], [("s1/c.ass", "script", None)], [("set/setting.md", "setting_book", None)],
    ]
    by = {r.path: r for r in rows}
    assert by["s1/c.ass"].warnings == ["timed_text_episode_alignment_unmatched"] and by["s1/c.ass"].metadata["reason"] == "timed_text_episode_alignment_unmatched" and by["s1/A.srt"].metadata["matched_by"] == "same_stem"
    assert by["derived_inputs/k/t.txt"].metadata["display_title"] == "t.txt" and by["derived_inputs/k/t.txt"].metadata["origin"] == "zip" and by["derived_inputs/k/t.txt"].fingerprint == "f1"
    assert by["art/b.gif"].metadata["page_number"] == "1" and by["voice.mp3"].handler_options["transcript_candidate"] == "true" and by["s1/A.srt"].handler_options["timed_text_format"] == "srt"


def test_a_second_scan_gives_the_same_rows(spark):
    one, two = (sorted(repr(r) for r in scanned(spark)[0].collect()) for _ in range(2))
    assert one == two and len({r.split("unit_id=")[1].split(",")[0] for r in one}) == len(one)


def test_paths_of_episodes(spark):
    plan, files = scanned(spark)
    episodes = scans.formal_scan(files).select("season_id", "episode_id", "episode_path").distinct().unionByName(spark.createDataFrame([("x", "e", "art/p2.PNG"), ("x", "f", "none")], "season_id string, episode_id string, episode_path string"))
    some = files.filter(F.col("path") != "s2/ep/segment_1.mp4")
    got = {(r.season_id, r.episode_id): r.paths for r in scans.episode_paths(plan, episodes, some).collect()}
    assert got[("x", "e")] == ["art/p2.PNG"] and got[("x", "f")] == [] and ["s2/ep/segment_2.mp4"] in got.values() and ["s1/b.mp4"] in got.values()


def test_roots_cover_what_lies_below(spark):
    files = spark.createDataFrame([(p,) for p in ("a/b/c.txt", "a/bc.txt", "a/b", "x\\y\\z.txt", "d.txt")], "path string")
    roots = spark.createDataFrame([("a/b/",), ("x/y",), ("q",)], "path string")
    assert sorted(r.path for r in scans.uncovered(files, roots).collect()) == ["a/bc.txt", "d.txt"]
