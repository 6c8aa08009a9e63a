import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import same_as_sql

from tessera.llm import embeddings, rules

SF = "/root/testdata/sf0.01"


def test_embeddings_match_sql(spark):
    same_as_sql(embeddings.op5_embeddings, embeddings.OP5_SQL, spark, SF)


def brute(rows, bound=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and not any(c is None for c in v) and np.isfinite(np.array(v, float)).all() and any(v)]
    x = np.zeros((len(good), max(len(v) for _, v in good)))
    for k, (_, v) in enumerate(good):
        x[k, : len(v)] = v
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= bound
    np.fill_diagonal(link, False)
    label = {i: i for i, _ in good}
    for _ in good:
        for a, b in zip(*np.nonzero(link)):
            low = min(label[good[a][0]], label[good[b][0]])
            label[good[a][0]] = label[good[b][0]] = low
    n = {k: int(link[k].sum()) for k in range(len(good))}
    out, k = [], 0
    for i, v in rows:
        if k < len(good) and good[k][0] == i and v and not any(c is None for c in v) and len(good[k][1]) == len(v) and (good[k][1] == v).all():
            out.append((i, n[k], label[i]))
            k += 1
        else:
            out.append((i, 0, label.get(i, i)))
    return sorted(out, key=str)


def test_embeddings_edge_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 20))
    rows = [(i, (base[i % 40] + rng.normal(size=20) * 0.22 * (i > 40)).tolist()) for i in range(400)]
    rows += [(1000, rows[7][1]), (1001, [2 * c for c in rows[7][1]]), (None, rows[7][1]), (1002, None), (1003, []), (1004, [0.0] * 20), (1005, [float("nan")] * 20), (1006, [float("inf")] + [1.0] * 19), (1007, [1.0, None]), (1008, [1.0, 2.0]), (1009, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("raw", F.lit(1))
    for per, chunk in ((1024, 4096), (16, 30)):
        monkeypatch.setattr(embeddings, "PER_PIVOT", per)
        monkeypatch.setattr(embeddings, "CHUNK", chunk)
        got = embeddings.near_duplicates(vectors).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert embeddings.near_duplicates(vectors.limit(0)).count() == 0


def test_rules_match_sql(spark):
    same_as_sql(rules.op10_rules, rules.OP10_SQL, spark, SF)


def test_rules_keep_labelled_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = rules.op10_rules(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("not base_failed").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.99 and out[out.quality == 0].kept.mean() < 0.2


def repeats(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)})


def test_rules_edge_rows(spark):
    import random

    rng = random.Random(2)
    long = [rng.choice("a b c d e f".split()) for _ in range(3000)]
    texts = [None, "", " \n\x0b", "one", "a b c", "a a a a", "a b c a b c", " ".join(long), "x\n\ny\nx\n x\nx", "é# *ü|<>%$&", "w " * 70_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("n_words", F.lit(-1))
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert rules.judge(docs).count() == len(rows) and rules.judge(docs.limit(0)).count() == 0
    for i, t in enumerate(texts):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), repeats(words), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
