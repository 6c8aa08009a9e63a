import hashlib
import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import cards, evidence, joins, order, runs
from tessera.sources import scans, stores, subtitles, texts
from tessera.streaming import events

LISTS = "facts array<string>, behavior_traits array<string>, dialogue_style array<string>, relationship_interactions array<string>, character_state_changes array<string>, conflicts array<string>"


def contents(spark, rows):
    """rows: (season, episode, facts, traits, conflicts)."""
    return spark.createDataFrame([(s, e, f, t, [], [], [], c) for s, e, f, t, c in rows], "season_id string, episode_id string, " + LISTS)


def test_places_and_sums_are_those_of_one_list(spark):
    r = random.Random(5)
    values = [(r.randrange(50), r.randrange(9), i) for i in range(2000)]
    df = spark.createDataFrame(values, "k int, v int, bucket_ int").repartition(7)
    got = {(x.k, x.bucket_): (x.place, x.total) for x in order.placed(df, [F.col("k"), F.col("bucket_")], {"total": F.col("v")}).collect()}
    total = 0
    for place, (k, v, i) in enumerate(sorted(values, key=lambda x: (x[0], x[2])), 1):
        total += v
        assert got[(k, i)] == (place, total)
    ranks = {x.k: x.rank for x in order.dense_rank(df, "k").collect()}
    assert ranks == {k: i for i, k in enumerate(sorted({v[0] for v in values}), 1)}
    assert order.placed(df.limit(0), [F.col("k")]).count() == 0


def no_single_partition(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Window" not in plan or "SinglePartition" not in plan


def fold(rows, term):
    """The states after each episode, one after the other."""
    lines, count, conflicts, out = [], 0, [], []
    has = lambda items: [x.strip() for x in items if term in x.lower()]
    for s, e, facts, traits, cs in sorted(rows, key=lambda x: (x[0].lower(), x[1].lower(), x[0], x[1])):
        f, t, c = has(facts), has(traits), has(cs)
        if f or t or c:
            lines += ["; ".join(t or f)] * bool(t or f)
            count += len(f) + len(t) + len(c)
            conflicts += [x for x in dict.fromkeys(c) if x not in conflicts]
            out.append((s, e, "; ".join(lines), count, tuple(conflicts)))
    return out


def test_states_equal_a_fold(spark):
    r = random.Random(7)
    some = lambda: [r.choice(["ann met bob", " ann left ", "bob", "ann again", "ann; twice"]) for _ in range(r.randrange(3))]
    rows = [(f"s{i // 9}", f"e{i:03d}", some(), some(), some()) for i in range(120)]
    r.shuffle(rows)
    timeline = evidence.timeline(contents(spark, rows), ["ann"])
    want = fold(rows, "ann")
    got = evidence.assembled(timeline, timeline).collect()
    assert sorted((x.season_id, x.episode_id, x.summary, x.evidence_count, tuple(x.conflicts)) for x in got) == sorted(want)
    assert no_single_partition(timeline)
    last = evidence.last_state(timeline).first()
    assert last.evidence_count == want[-1][3] and last.conflicts == list(want[-1][4]) and last.summary == "; ".join(dict.fromkeys(x.strip() for x in want[-1][2].split(";")))
    per = {x.season_id: (x.n_states, x.episode_id, x.summary) for x in evidence.season_states(timeline).collect()}
    assert per == {s: (sum(w[0] == s for w in want), *max(w for w in want if w[0] == s)[1:3]) for s in {w[0] for w in want}}


def test_one_character_in_many_episodes(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("S").alias("season_id"), F.format_string("e%06d", "id").alias("episode_id"), F.array(F.format_string("ann %d", "id")).alias("facts"), *[F.array().cast("array<string>").alias(c) for c in ("behavior_traits", "dialogue_style", "relationship_interactions", "character_state_changes")], F.array(F.format_string("ann fights %d", F.col("id") % 1000)).alias("conflicts"))
    timeline = evidence.timeline(rows, ["ann"])
    got = timeline.agg(F.count("*"), F.max("place"), F.max("evidence_count"), F.max("n_conflicts"), F.max(F.size("parts"))).first()
    assert tuple(got) == (n, n, 2 * n, 1000, 1)
    asked = evidence.assembled(timeline, timeline.filter(F.col("place").isin(1, 1500, n))).collect()
    assert sorted((len(x.summary.split("; ")), len(x.conflicts)) for x in asked) == [(1, 1), (1500, 1000), (n, 1000)]


def test_digests_are_those_of_whole_states(spark):
    r = random.Random(3)
    some = lambda: [r.choice(["ann met bob", " ann left ", "bob", "ann ä", "ann; twice"]) for _ in range(r.randrange(3))]
    rows = [(f"s{i // 7}", f"e{i:03d}", some(), some(), some()) for i in range(60)]
    timeline = evidence.timeline(contents(spark, rows), ["ann"])
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {(s, e): (digest(text), n, len(cs), digest(" | ".join(cs))) for s, e, text, n, cs in fold(rows, "ann")}
    assert {(x.season_id, x.episode_id): (x.summary, x.evidence_count, x.n_conflicts, x.conflicts) for x in evidence.digests(timeline).collect()} == want
    assert {(x.season_id, x.episode_id): (x.summary, x.evidence_count, x.conflicts) for x in evidence.season_digests(timeline).collect()} == {k: (v[0], v[1], v[3]) for k, v in want.items() if k == max(x for x in want if x[0] == k[0])}
    # Whole states of so many episodes would be 30 GB.
    n = 30_000
    many = spark.range(n).select(F.lit("S").alias("season_id"), F.format_string("e%06d", "id").alias("episode_id"), F.array(F.concat(F.lit("ann "), F.col("id").cast("string"), F.repeat(F.lit("x"), F.lit(60)))).alias("facts"), *[F.array().cast("array<string>").alias(c) for c in ("behavior_traits", "dialogue_style", "relationship_interactions", "character_state_changes", "conflicts")])
    got = evidence.digests(evidence.timeline(many, ["ann"])).filter(F.col("place") == n).first()
    assert got.summary == digest("; ".join(f"ann {i}" + "x" * 60 for i in range(n))) and got.conflicts == digest("")


def preview_fold(rows):
    now, count, out = "", 0, []
    for s, e, facts, traits, _ in sorted(rows):
        shown = [x.strip() for x in traits or facts]
        if shown:
            now = "; ".join(dict.fromkeys(x for x in [now, *shown] if x))
        count += len(facts)
        out.append((s, e, now, count))
    return out


def test_previews_equal_a_fold(spark):
    r = random.Random(11)
    for words in (["a", "b"], ["a"], ["a", "a; b", "b", "a; b; a"], ["ann met bob", "x"]):
        some = lambda: [r.choice(words) for _ in range(r.randrange(3))]  # noqa: B023, E731
        rows = [("s", f"e{i:03d}", some(), some(), []) for i in range(40)]
        got = sorted((x.season_id, x.episode_id, x.summary, x.evidence_count) for x in cards.preview_states(contents(spark, rows), "").collect())
        assert got == preview_fold(rows)


def test_applied_state_lists_chunks_and_runs(spark):
    rows = spark.createDataFrame([("S2", "e1", [" b", "a"], ["r1"]), ("S1", "e2", ["a", ""], ["r2", "r1"])], "season_id string, episode_id string, behavior_traits array<string>, evidence_refs array<string>")
    chunks = spark.createDataFrame([("S2", "e1", "c2.json", "run2"), ("S1", "e2", "c1.json", "run1"), ("S2", "e1", "c1.json", "run1")], "season_id string, episode_id string, file_name string, extraction_run_id string")
    got = cards.applied_state(rows, chunks).first().asDict()
    assert got == {"included_seasons": ["S1", "S2"], "included_episodes": ["S1/e2", "S2/e1"], "personality_traits": ["a", "b"], "refs": ["r2", "r1"], "included_chunks": ["S1/e2/c1", "S2/e1/c1", "S2/e1/c2"], "included_runs": ["run1", "run2"]}


def test_versions_of_any_length(spark):
    tags = ["v1.0.0", "v10.0.0", "v2.0.0-rc.2", "v2.0.0-rc.10", "2.0.0", "v99999999999.0.0", "v" + "9" * 60 + ".0.0", "x", None]
    got = {r.tag: r.rank for r in cards.ranked_versions(spark.createDataFrame([(t,) for t in tags], "tag string"), "tag").collect()}
    assert got == {"v1.0.0": 1, "v2.0.0-rc.2": 2, "v2.0.0-rc.10": 3, "2.0.0": 4, "v10.0.0": 5, "v99999999999.0.0": 6}


def test_stem_before_directory(spark):
    files = spark.createDataFrame([(p,) for p in ("s1/a.mp4", "s1/b.mp4", "s1/a.srt", "s1/c.srt", "s2/ep1/x.srt")], "path string")
    videos = spark.createDataFrame([("e1", "s1/a.mp4", "s1/a.mp4"), ("e2", "s1/b.mp4", "s1/b.mp4"), ("e3", "s2/ep1/chunk_1.mp4", "s2/ep1")], "episode_id string, path string, episode_path string")
    got = {r.path: (r.episode_id, r.status, r.rule) for r in scans.aligned(files, videos).collect()}
    assert got == {"s1/a.srt": ("e1", "matched", "same_stem"), "s1/c.srt": (None, "unmatched", None), "s2/ep1/x.srt": ("e3", "matched", "same_episode_directory")}
    left = spark.createDataFrame([(1, "a", "x"), (2, "n", "x"), (3, "n", None)], "id int, stem string, folder string")
    right = spark.createDataFrame([(7, "a", "x"), (8, "b", "x")], "t int, stem string, folder string")
    assert sorted(tuple(r) for r in joins.exactly_one(left, right, "id", ["stem", "folder"], "t").collect()) == [(1, 7, "matched", "stem"), (2, None, "ambiguous", None), (3, None, "unmatched", None)]


def test_imported_cards_get_free_ids(spark):
    card = lambda n: '{"format": "f", "identity": {"character_name": "%s"}}' % n
    names = ["Ann Lee", "Ann Lee", "Ann Lee 3", "Ann Lee", "Ann Lee 3", "Bob", "Ann Lee 3 2", "x-1"]
    rows = spark.createDataFrame([(f"{i:02d}", card(n)) for i, n in enumerate(names)], "path string, text string")
    taken = spark.createDataFrame([("ann-lee-2",), ("bob",), ("bob-2",), ("bob-04",)], "card_id string")
    got = [r.card_id for r in stores.imported(rows, "p", "f", taken).orderBy("path").collect()]
    assert got == ["ann-lee", "ann-lee-4", "ann-lee-3", "ann-lee-5", "ann-lee-3-3", "bob-3", "ann-lee-3-2", "x-1"]
    assert not set(got) & {"ann-lee-2", "bob", "bob-2"} and len(set(got)) == len(got)


def test_white_space_of_any_kind(spark):
    df = spark.createDataFrame([([" a\n", "\t", "\u3000b\u00a0", None, "c d"], "\u3000x\u00a0 \ty\u2003")], "items array<string>, text string").withColumn("m", F.expr("map(' a', '1', 'a', '2', ' ', '3', 'b', null)"))
    row = df.select(T.trimmed(F.col("items")).alias("t"), T.clip(F.col("text"), 9).alias("c"), T.safe_metadata(F.col("m")).alias("m")).first()
    assert row.t == ["a", "b", "c d"] and row.c == "x y" and row.m == {"a": "2", "b": None}


def test_numbers_of_any_length_sort_by_value(spark):
    names = ["a2", "a10", "a" + "9" * 45, "a1" + "0" * 45, "a002", "10", "9x"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n"))).collect()]
    assert got == ["9x", "10", "a002", "a2", "a10", "a" + "9" * 45, "a1" + "0" * 45]


def test_columns_of_inner_names(spark):
    states = spark.createDataFrame([("ann", 1, "x", "y")], "name string, place int, s string, season string")
    assert runs.state_for(states, "season", "place", "name", ["ann"]).first().asDict() == {"season": "y", "name": "ann", "place": 1, "s": "x"}
    log = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "last string, at int, v string")
    assert events.latest(log, "last", ("at",)).first().asDict() == {"last": "k", "at": 2, "v": "new"}


def test_many_alias_proposals(spark, monkeypatch):
    monkeypatch.setattr(cards, "PROPOSALS", 3)
    aliases = spark.createDataFrame([(i, f"alias{i:02d}") for i in range(20)], "pos int, alias string")
    targets = spark.createDataFrame([("n", "ALIAS17 and alias02"), ("alias19", "")], "candidate_name string, target string")
    assert [tuple(r) for r in cards.confirmed_aliases(aliases, targets, 2).collect()] == [(2, "alias02"), (17, "alias17")]
    assert [r.pos for r in cards.confirmed_aliases(aliases, targets).collect()] == [2, 17, 19]


def test_dialogues_of_ass(spark):
    text = "\n".join([
        "[Script Info]", "Dialogue: not here", "[Events]", "Dialogue: 0,early", "Format: Layer, Start, End, Name, Text", "Comment: 0,x", "Dialogue: 0,0:00:01.50,0:00:03.2,Ann,Hi, {\\i1}you\\Nthere",
        "Dialogue: 0,0:00:01.50", "Dialogue: 0,nope,0:00:03.2,,Text", "Dialogue: 0,0:00:09.00,0:00:03.00,,back", "Dialogue: 0,0:00:01.5x,0:00:03,,bad", "Dialogue: 0,0:00:01,0:00:02,,{only}", "[Fonts]", "Dialogue: 0,0:00:01.50,0:00:03.2,Ann,no", "[EVENTS]", "dialogue : 0,1:00:01.5009,1:00:03,, again\\hso ",
    ])
    rows = subtitles.cues(spark.createDataFrame([("a/b.ASS", text), ("c.ass", None), ("d.vtt", "x")], "path string, text string")).collect()
    good = sorted((r.cue, r.source_line, r.start, r.end, r.text, r.raw, r.speaker) for r in rows if r.cue)
    assert good == [(1, 7, 1.5, 3.02, "Hi, you\nthere", "Hi, {\\i1}you\\Nthere", "Ann"), (2, 10, 9.0, 9.0, "back", "back", ""), (3, 16, 3606.0, 3606.0, "again so", "again\\hso", "")]
    assert sorted(r.warning for r in rows if r.warning) == sorted(["ass_dialogue_skipped_without_format:line=4", "ass_dialogue_field_mismatch:line=8", "ass_dialogue_time_invalid:line=9", "ass_dialogue_time_invalid:line=11", "ass_empty_dialogue_skipped:line=12", "ass_no_usable_segments", "timed_text_format_not_supported"])


def test_page_goes_on_after_a_bad_declaration():
    assert texts.xhtml("<head><title>T</title></head><p>one</p><![x y><p>two <ruby>k<rt>no</rt></ruby></p><script>x</script></style><img alt='pic'/>") == ("one\n\ntwo k\n\n[Image: pic]", "T")


def test_books_are_not_joined_with_themselves(spark):
    items = spark.createDataFrame([("a", 1, "i1", "x"), ("a", 2, "i2", "y"), ("a", 3, "i3", "z"), ("b", 2, "i1", "x"), ("b", 1, "i2", "y"), (None, 1, "i1", "x")], "book string, pos int, item_id string, entry string")
    spine = spark.createDataFrame([("a", 2, "i1", None), ("a", 1, "i2", "yes"), ("a", 3, "i3", "NO"), ("b", 1, "i1", "no")], "book string, pos int, item_id string, linear string")
    got = scans.book_order(items, spine, spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "book string, entry string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", 1, "x", None), ("a", None, "y", "epub_entry_missing"), ("b", 1, "y", None), ("b", 2, "x", None)]))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_white_space_and_secrets_of_any_form(spark):
    values = ["  a\t\tb  c \u00a0d\u3000e ", "\n", "x sk-abcdefgh1 Bearer  t.k http://u:p@h/", "sk- Bearer ://", None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(T.clean(F.col("v"), 99)).collect()]
    assert got == ["a b c d e", "", "x sk-*** Bearer *** http://***:***@h/", "sk- Bearer ://", None]
