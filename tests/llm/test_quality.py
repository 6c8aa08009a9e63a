import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality

SF = "/root/testdata/sf0.1"


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_accuracy(spark):
    rows = quality.op6_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    out = rows.join(labels, "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.97
    assert (held.predicted == held.quality).mean() > 0.97
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_edge_rows(spark):
    good = ["the cat of the house went to the sea and saw a fish in it " + str(i) for i in range(40)]
    bad = ["win *** now *** " * 20 + str(i) for i in range(10)]
    rows = [(i, t) for i, t in enumerate([*good, *bad])] + [(None, None), (100, ""), (101, None), (102, "x " * 60_000), (5, good[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("quality", F.lit(1)).withColumn("kind", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (3, None), (3, 0)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len({r.score for r in quality.classify(docs, labels.limit(0)).collect()}) == 1
    assert quality.classify(docs.limit(0), labels).count() == 0
