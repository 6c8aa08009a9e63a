import hashlib
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tessera.llm import suffix

sys.path.insert(0, str(Path(__file__).parent))
SF = "/root/testdata/sf0.01"


def brute(texts, length, keep):
    """{index: kept bytes, spans} by a table of every string; texts in order of place."""
    seen = {}
    for i, data in enumerate(texts):
        for s in range(len(data) - length + 1):
            seen.setdefault(data[s : s + length], []).append((i, s))
    out = []
    for i, data in enumerate(texts):
        covered = bytearray(len(data))
        for s in range(len(data) - length + 1):
            places = seen[data[s : s + length]]
            if len(places) > 1 and (keep == "none" or places[0] != (i, s)):
                covered[s : s + length] = b"\x01" * length
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(c and not (j and covered[j - 1]) for j, c in enumerate(covered))
        out.append((len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, docs, **options):
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_spans(docs, **options).collect()))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = brute([(t or "").encode() for _, t in ordered], options.get("length", 400), options["keep"])
    assert got == sorted((d is not None, d or 0, *w) for (d, _), w in zip(ordered, want))


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(spark, rows, docs, keep="none")


def test_first_copies_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(spark, rows, docs, keep="first")


def edge_rows():
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, other = word(70), word(45)
    rows = [(i, word(rng.randint(0, 60)) + passage[rng.randint(0, 12) : rng.randint(50, 70)] + word(rng.randint(0, 60))) for i in range(40)]
    rows += [(100 + i, word(9) + other + word(20) + other) for i in range(3)]
    rows += [(200, "a" * 300), (201, "ab" * 90), (202, "a" * 20 + word(30)), (203, None), (204, ""), (None, passage), (205, word(39)), (206, word(5000))]
    rows += [(207, rows[3][1]), (208, rows[3][1])]
    return rows


def test_edge_rows(spark, monkeypatch):
    rows = edge_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("clash")).withColumn("anchor", F.lit(1))
    for keep in ("none", "first"):
        check(spark, rows, docs, keep=keep, length=40, anchor=8)
    monkeypatch.setattr(suffix, "MOST_SEGMENTS", 1)
    for keep in ("none", "first"):
        check(spark, rows, docs, keep=keep, length=40, anchor=8)
    assert suffix.repeated_spans(docs.limit(0)).count() == 0


def test_repeated_rows_are_removed_by_the_query(spark):
    docs = spark.createDataFrame([(1, "x" * 50 + "y" * 450), (1, "x" * 50 + "y" * 450)], "doc_id long, text string")
    assert [(r.n_bytes, r.n_removed) for r in suffix.repeated_spans(docs, keep="none").collect()] == [(500, 500)] * 2


def test_rows_without_id_keep_their_own_spans(spark):
    word = lambda n: hashlib.sha512(str(n).encode()).hexdigest()
    passage = "".join(word(i) for i in range(5))
    clean = "".join(word(i) for i in range(100, 107))
    late, early = word(50) + word(51) + passage, passage + word(52) + word(53)
    assert len(clean) == len(late) == len(early)
    for doc_id in (None, 7):
        rows = [(doc_id, passage), (doc_id, clean), (doc_id, late), (doc_id, early)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tid", F.lit("clash"))
        got = [r.text for r in suffix.remove_repeats(docs).collect()]
        assert clean in got and "".join(got).count(passage) == 1
        assert all(any(g in (t, t.replace(passage, "")) for g in got) for _, t in rows) and sum(map(len, got)) == 640 + 896 + 256 + 256


def test_texts_that_polynomial_hashes_confuse(spark, monkeypatch):
    from test_minhash import thue_morse

    one, other = thue_morse(2048)
    rows = [(1, one[:1024] + "xyz"), (2, other[:1024] + "uvw"), (3, "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (2000, 0):
        monkeypatch.setattr(suffix, "MOST_SEGMENTS", most)
        for keep in ("none", "first"):
            check(spark, rows, docs, keep=keep, length=500, anchor=8)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT", 3)
    test_edge_rows(spark, monkeypatch)


def test_large_groups_deal_out_edges_only(spark, monkeypatch):
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = word(180)
    rows = [(i, word(90) + passage + word(90)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, settle = {}, suffix.settle
    monkeypatch.setattr(suffix, "settle", lambda df, name: made.setdefault(name, settle(df, name)))
    monkeypatch.setattr(suffix, "MOST_SEGMENTS", 10)
    for keep in ("none", "first"):
        made.clear()
        check(spark, rows, docs, keep=keep, length=100, anchor=8)
        strings = made["cut"].filter("many").agg(F.sum("n")).first()[0]
        assert strings > 1000 and made["dealt"].count() < strings / 2


def test_planted_passages_of_over_50_words(spark):
    import random

    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    words = lambda n: " ".join(word(rng.randint(3, 9)) for _ in range(n))
    planted = {n: " ".join([*[word(6) for _ in range(54)], word(n - 54 * 7)]) for n in (399, 400)}
    assert all(len(p) == n and len(p.split()) > 50 for n, p in planted.items())
    rows, want = [], {}
    for n, passage in planted.items():
        for gap in " \n\t":
            before, after = words(40) + gap, gap + words(60)
            rows.append((len(rows), before + passage + after))
            kept = before + after if n == 400 else rows[-1][1]
            want[rows[-1][0]] = (len(rows[-1][1]), n if n == 400 else 0, int(n == 400), hashlib.sha256(kept.encode()).hexdigest())
    for size in [len(t) for _, t in rows]:  # clean rows as long as the planted ones
        rows.append((len(rows), words(200)[:size]))
        want[rows[-1][0]] = (size, 0, 0, hashlib.sha256(rows[-1][1].encode()).hexdigest())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_spans(docs, keep="none").collect()}
    assert got == want
