import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import minhash
from tessera.llm.minhash import near_duplicates

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width):
    """{row index: (n_shingles, component_id)} by all pairs, through an index of shingles."""
    sets = [shingles(t, width) for _, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        counts = {}
        if rows[i][0] is None:
            continue
        for x in s:
            for j in where.setdefault(x, []):
                counts[j] = counts.get(j, 0) + 1
            where[x].append(i)
        for j, both in counts.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[b] = a
    return sorted(((d, len(s), d if d is None or not s else root(d)) for (d, _), s in zip(rows, sets)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs, width=2)) == brute(rows, 2)


def test_edge_rows(spark):
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(2, 58, 3)]
    rows = [(10 + i, t) for i, t in enumerate(near)] + [(5, " ".join(base)), (5, " ".join(base)), (None, " ".join(base)), (1, None), (2, ""), (3, " \t\n"), (4, "One"), (6, "oNE"), (7, "one\x0btwo"), (8, "One Two"), (9, "zwei drei"), (99, "y " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("a", F.lit(1)).withColumn("key", F.lit(1))
    assert result(near_duplicates(docs, width=2)) == brute(rows, 2)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_compared_finds_all_shared_shingles():
    rng = random.Random(3)
    for n in (20, 100, 500, 3000):
        text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text])], names=["doc_id", "text"])
        sets = pa.Table.from_batches(minhash._sets(2)(iter([batch])))
        got = minhash._compared(100)(sets.slice(0, 1), sets.slice(1).rename_columns(["y", "y_shingles"]))
        assert got.to_pylist() == [{"a": 1, "b": 2}]


def test_links_through_members_that_are_no_hubs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUBS", 1)
    rng = random.Random(11)
    rows = []
    for f in range(25):
        base = [f"f{f}w{i}" for i in range(120)]
        edit = lambda words, n: [f"x{rng.randrange(10**9)}" if i in chosen else w for chosen in [set(rng.sample(range(len(words)), n))] for i, w in enumerate(words)]
        members = [edit(base, 5) for _ in range(12)]
        rows += [(0, " ".join(w)) for w in [base, *members, *[edit(m, 6) for m in members]]]
    ids = rng.sample(range(10**6), len(rows))
    rows = [(i, t) for i, (_, t) in zip(ids, rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs, width=2)) == brute(rows, 2)


def thue_morse(n):
    """A word and its complement, which polynomial hashes modulo a power of two confuse."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_texts_that_polynomial_hashes_confuse(spark):
    rows = list(enumerate(thue_morse(1024), 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs, width=2)) == brute(rows, 2) == [(1, 1, 1), (2, 1, 2)]


def test_small_blocks_and_hot_keys(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(common, "HOT", 4)
    test_links_through_members_that_are_no_hubs(spark, monkeypatch)


def test_members_and_balls_meet_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUBS", 1)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    edit = lambda words, n: [f"x{rng.randrange(10**9)}" if i in chosen else w for chosen in [set(rng.sample(range(len(words)), n))] for i, w in enumerate(words)]
    rows = list(enumerate(" ".join(edit(base, 4 + i % 10)) for i in range(60)))
    made, meetings = [], minhash._meetings
    monkeypatch.setattr(minhash, "_meetings", lambda *a: made.append(minhash.settle(meetings(*a), "made")) or made[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs, width=2)) == brute(rows, 2)
    assert 100 < made[0].count() <= 1.1 * made[0].distinct().count()
