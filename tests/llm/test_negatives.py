import math
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import same_as_sql  # noqa: E402

from tessera.llm import negatives as n

SCHEMA = "vec_id long, embedding array<double>, label int, row int, anchor string, whole int"


def brute(rows, positives=5, k=10):
    """rows: (vec_id, embedding, label); anchors are those whose id divides by 10."""
    good = [(i, [math.floor(256 * x) for x in e], lab) for i, e, lab in rows if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (i, e, lab) in enumerate(good):
        if i is None or i % 10:
            continue
        scored = [(sum(x * y for x, y in zip(e, f)), j, other) for b, (j, f, other) in enumerate(good) if b != a]
        for ps, pid, _ in sorted((s for s in scored if s[2] == lab), key=order)[:positives]:
            fit = sorted((s for s in scored if s[2] != lab and 30 * ps <= 100 * s[0] <= 90 * ps), key=order)[:k]
            out += [(i, pid, r, nid, ps, ns) for r, (ns, nid, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    found = n.hard_negatives(frame, F.col("vec_id") % 10 == 0, F.col("label"))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def cloud(seed, size, ids):
    r = random.Random(seed)
    return [(r.choice(ids), [r.choice([-0.5, 0.1, 0.3, 0.31, 0.7]) for _ in range(4)], r.randrange(3)) for _ in range(size)]


def test_equal_to_sql(spark):
    same_as_sql(n.op11_negatives, n.OP11_SQL, spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("block,anchors,scores", [(n.BLOCK, n.ROUND, n.SCORES), (7, 3, 20)])
def test_equal_to_brute_force(spark, monkeypatch, block, anchors, scores):
    monkeypatch.setattr(n, "ROUND", anchors)
    rows = cloud(1, 150, list(range(90))) + [(10, None, 1), (20, [0.1, None, 0.2, 0.3], 1), (30, [0.1, float("nan"), 0.2, 0.3], 1), (40, [float("inf"), 0.0, 0.0, 0.0], 1), (50, [0.1, 0.1, 0.1, 0.1], None), (None, [0.7, 0.7, 0.7, 0.7], 0), (None, [0.3, 0.31, 0.7, 0.3], 1), (60, [], 1), (70, [0.5], 2)]
    assert mined(spark, rows) == brute(rows)


def test_small_blocks_give_the_same(monkeypatch):
    """Blocks, and anchors in several turns, inside a task."""
    import numpy as np
    import pyarrow as pa

    rows = cloud(3, 90, list(range(60)))
    whole = [np.floor(256 * np.array(e)).astype("<i8").tobytes() for _, e, _ in rows]
    table = pa.table({"row": list(range(90)), "vec_id": [r[0] for r in rows], "label": [r[2] for r in rows], "whole": pa.array(whole, pa.binary())})
    mine = n.Anchors(table.slice(0, 12), 4, 5)
    results = []
    for block, scores in ((1 << 15, 1 << 20), (7, 20)):
        monkeypatch.setattr(n, "BLOCK", block)
        monkeypatch.setattr(n, "SCORES", scores)
        first = next(n._positives(mine, 5)(iter(table.to_batches(max_chunksize=4))))
        place = np.searchsorted(mine.row, first.column("anchor").to_numpy())
        last = next(n._negatives(mine, place, first.column("score").to_numpy(), np.arange(len(place)), 10, 30, 90)(iter(table.to_batches(max_chunksize=4))))
        results.append((first.to_pydict(), last.to_pydict()))
    assert results[0] == results[1] and results[0][1]["id"]


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**18 + i / 256, 2.0**19 - i / 256], i % 2) for i in range(1, 31)] + [(i, [2.0**18 - i, 2.0**17], i % 3) for i in range(31, 60)]
    assert mined(spark, rows) == brute(rows) != []


def test_components_beyond_a_long_and_no_rows(spark):
    assert mined(spark, [(10, [1e300, -1e308], 1), (11, [1e300, 0.0], 1), (12, [1e299, 1.0], 2)]) == []
    frame = spark.createDataFrame([], SCHEMA)
    assert n.hard_negatives(frame, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    assert mined(spark, [(10, [1.0], 1), (11, [1.0], 2)]) == []
