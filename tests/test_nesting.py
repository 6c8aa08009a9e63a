import random

from tessera.operators import nesting as N

LEVELS = [(["season_id", "season_title"], "episodes"), (["episode_id"], "units")]


def frame(spark, n=300):
    r = random.Random(1)
    rows = [(i, r.choice(["s1", "s2", None]), "t", f"e{r.randrange(5)}", f"p{i}", r.choice(["video", "text"]), {"k": "v"}) for i in range(n)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "at int, season_id string, season_title string, episode_id string, path string, media string, metadata map<string,string>").repartition(5)


def test_flatten_gives_what_nest_took(spark):
    rows, df = frame(spark)
    nested = N.nest(df, LEVELS, "at")
    back = N.flatten(nested, LEVELS).select(*df.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    first = {}
    for at, s, _, e, *_ in sorted(rows):
        first.setdefault(s, {}).setdefault(e, []).append(at)
    got = {r.season_id: [(e.episode_id, [u["at"] for u in e.units]) for e in r.episodes] for r in nested.collect()}
    assert got == {s: list(e.items()) for s, e in first.items()}
    assert [r.season_id for r in nested.orderBy("at").collect()] == list(first)
    assert N.nest(df.limit(0), LEVELS, "at").count() == 0


def test_part_of_a_handler(spark):
    rows, df = frame(spark, 40)
    part = N.pruned(N.nest(df, LEVELS, "at"), LEVELS, lambda u: (u["media"] == "video") & (u["at"] < 12))
    got = sorted(r.at for r in N.flatten(part, LEVELS).collect())
    assert got == sorted(r[0] for r in rows if r[5] == "video" and r[0] < 12)
    assert all(e.units for r in part.collect() for e in r.episodes)


def test_manifest_counts(spark):
    rows, df = frame(spark, 60)
    got = {r.season_id: (r.episode_count, r.unit_count, sum(len(e.paths) for e in r.episodes)) for r in N.manifest(N.nest(df, LEVELS, "at")).collect()}
    want = {s: (len({x[3] for x in rows if x[1] == s}), sum(x[1] == s for x in rows), sum(x[1] == s for x in rows)) for s in {x[1] for x in rows}}
    assert got == want
