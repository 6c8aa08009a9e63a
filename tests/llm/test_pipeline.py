import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline
from test_minhash import brute as near_groups
from test_packing import check as packed
from test_suffix import brute as repeats

from tessera.llm import minhash, mixing, quality, suffix

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = corpus_pipeline.good(spark, docs, SF).cache()
    passed = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    assert sorted(rows_of(good)) == sorted(r for r in rows_of(docs) if r[0] in passed) and len(passed) < docs.count()

    one = corpus_pipeline.near_dedup(spark, good, SF).cache()
    smallest = {d for d, _, c in near_groups([r[:2] for r in rows_of(good)], 5) if d == c}
    assert sorted(rows_of(one)) == sorted(r for r in rows_of(good) if r[0] in smallest)

    cut = corpus_pipeline.suffix_dedup(spark, one, SF).cache()
    before, after = sorted(rows_of(one)), sorted(rows_of(cut))
    want = repeats([r[1].encode() for r in before], 200, "first")
    assert [r[0] for r in before] == [r[0] for r in after]
    for a, b, (n, gone, _, _) in zip(before, after, want):
        assert 0 <= n - gone - len(b[1].encode()) <= 6 * (gone > 0) and b[4] == len(b[1]) and (gone or a == b)

    mixed = corpus_pipeline.mix(spark, cut, SF)
    assert mixed.columns == docs.columns
    words = lambda t: len((t or "").split())
    spans = {r.doc_id: sum(s.length * s.times for s in r.spans) for r in mixing.mix(cut).collect()}
    got = {}
    for r in rows_of(mixed):
        got[r[0]] = got.get(r[0], 0) + words(r[1])
    assert got == {d: n for d, n in spans.items() if n}

    rows = [r[:2] for r in rows_of(mixed)]
    assert packed(rows, corpus_pipeline.pack(spark, mixed, SF).collect()) < 1024
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == corpus_pipeline.pack(spark, mixed, SF).agg(F.sum("length")).first()[0]


def test_stages_take_odd_rows(spark):
    rows = [(1, "the cat of the house went to the sea " * 30, "en", "a", 1), (1, "the cat of the house went to the sea " * 30, "en", "a", 1), (None, "le chat", None, None, None), (2, None, "fr", "b", 0), (3, "", "fr", None, 0), (None, None, None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in (docs, docs.limit(0)):
        kept = extra
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, extra, SF)
            out.collect()
            assert stage is corpus_pipeline.pack or out.columns == kept.columns


def test_passages_of_50_words_stay_in_one_document(spark):
    import random

    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(n))
    passages = [text(52) for _ in range(3)]
    rows = [(i, f"{text(80)} {passages[i % 3]} {text(80)}") for i in range(30)] + [(100 + i, text(200)) for i in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    after = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, SF).collect()}
    inner = [" ".join(p.split()[1:-1]) for p in passages]
    assert [sum(p in t for t in after.values()) for p in inner] == [1, 1, 1] and all(p in after[i] for i, p in enumerate(inner))
    assert all(after[i] == t for i, t in rows if i >= 100)


def test_clashing_columns_and_long_texts_keep_their_values(spark):
    rows = [(1, "one two three " * 40, "a"), (1, "two three one " * 40, "a"), (2, "x" * 300_000 + " y", "b"), (None, "no id " * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for i, name in enumerate(["size", "spans", "spans_", "tid", "k", "row", "carried", "time", "h", "shard", "n_chars", "found", "target"]):
        docs = docs.withColumn(name, F.lit(i))
    plain = docs.drop("n_chars")
    want = sorted(map(str, plain.collect()))
    assert sorted(map(str, suffix.remove_repeats(plain, length=10**6).collect())) == want
    assert sorted(map(str, minhash.drop_near_duplicates(plain.filter("doc_id = 2")).collect())) == [w for w in want if "doc_id=2" in w]
    first, again = (sorted(map(str, mixing.take(docs, block=8).collect())) for _ in range(2))
    assert first == again and mixing.take(docs).columns == docs.columns
    assert all(r.size == 0 and r.spans == 1 and r.n_chars == len(r.text) for r in mixing.take(docs).collect())
