import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing

SF = "/root/testdata/sf0.001"


def expected(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(text or "", add_special_tokens=False).ids + [0] for _, text in rows]


def check(rows, pieces):
    """Every id lies in one piece with the right checksum; sequences have no gaps and little padding."""
    want = {}
    for (doc_id, _), ids in zip(rows, expected(rows)):
        want.setdefault((doc_id, len(ids)), []).append(ids)
    got = {}
    for p in pieces:
        got.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    assert got.keys() == want.keys()
    for key, parts in got.items():
        copies = want[key]
        assert sum(p.length for p in parts) == key[1] * len(copies)
        if len(copies) == 1:
            at = 0
            for p in sorted(parts, key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(copies[0][at : at + p.length], "<u4").tobytes())
                at += p.length
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 1024
    return sum(1024 - sum(p.length for p in s) for s in sequences.values())


def test_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    padding = check(rows, packing.op3_packing(spark, SF).collect())
    assert padding < 1024


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "<|endoftext|>"), (None, "no id"), (5, "again"), (5, "again"), (6, "é" * 3000), (7, "x" * 2047)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("tail", F.lit(1))
    assert check(rows, packing.pack(docs).collect()) < 1024
    assert packing.pack(docs.limit(0)).count() == 0


def test_neighbours_are_lexical():
    topics = [np.arange(10) + 100 * t + 1 for t in range(4)]
    rng = np.random.default_rng(1)
    tails = [rng.choice(topics[i % 4], 40).astype("<u2") for i in range(24)]
    table = pa.table({"tail": [t.tobytes() for t in tails], "terms": [b""] * 24, "counts": [b""] * 24})
    of, term, count = packing.postings(table)
    df = np.bincount(term, minlength=packing.VOCABULARY)
    weight = packing.Scale(df, 24, 24 * 40).weights(term, count, np.full(len(of), 40))
    for pieces in packing.fill(np.array([40] * 24), packing.Index(24, of, term, weight), 240):
        assert len({d % 4 for d, _, _ in pieces}) == 1


def test_special_tokens_are_as_the_library_gives_them():
    rows = [(1, "<|endoftext|> x"), (2, "end <|endoftext|> start"), (3, "<|endoftext|>" * 3), (4, "<|endof text|>")]
    path = public_tokenizers.path(packing.RANKS)
    want = expected(rows)
    assert want[0][:2] == [50256, 2124]
    for (_, text), ids in zip(rows, want):
        assert [*packing.encoded(path, text).tolist(), 0] == ids


def test_shards_hold_what_belongs_together(spark):
    """Documents of a topic share shards, hot groups are spread evenly, and long texts count as a whole."""
    rng = np.random.default_rng(2)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(240)]
    text = lambda topic, n: " ".join(words[topic * 30 + j] for j in rng.integers(0, 30, n))
    rows = [(i, text(i % 8, 40)) for i in range(400)]
    rows += [(1000 + i, "copy of one text that is there many times over") for i in range(200)] + [(2000, None), (2001, "")]
    rows += [(3000 + i, text(i, 700)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit("clash")).withColumn("n", F.lit(1))
    ordered, _ = packing.in_order(docs, public_tokenizers.path(packing.RANKS), 1024)
    parts = ordered.select(F.spark_partition_id().alias("p"), "doc_id").toArrow()
    shard, at = {}, 0
    for p in sorted(set(parts["p"].to_pylist())):
        for held in packing.shards(iter(parts.filter(pc.equal(parts["p"], p)).to_batches()), 64):
            shard |= dict.fromkeys(held["doc_id"].to_pylist(), at)
            at += 1
    assert shard.keys() == {d for d, _ in rows}
    sizes = np.bincount(list(shard.values()))
    assert sizes.max() == 64
    near = [np.mean([shard[a] == shard[b] for a in shard if a < 400 and a % 8 == t for b in shard if b < 400 and b % 8 == t]) for t in range(8)]
    assert np.mean(near) > 1.5 * ((sizes / len(rows)) ** 2).sum()
    assert check(rows, packing.pack(docs, shard_docs=64).collect()) < 1024 * len(sizes)


def test_long_runs_of_white_space():
    rows = [(1, "\n" * 1_000_000 + "a"), (2, " " * 1_500_000), (3, "plain text"), (4, " " * 99_999 + "a"), (5, "\n\t" * 50_000), (6, "a" * 100_000), (7, "é " * 60_000)]
    path = public_tokenizers.path(packing.RANKS)
    for (_, text), ids in zip(rows, expected(rows)):
        assert [*packing.encoded(path, text).tolist(), 0] == ids
