"""Hard negatives for anchors by a full sort of each anchor's scores.

Components become integers, so a score (an inner product) is exact and its order total: higher scores first, then smaller
vec_id. Rows stay where they lie: anchors, at most ROUND at a time, are sent to all tasks, and a task takes its rows in blocks of
BLOCK. For each anchor it scores the block, sorts all the scores by (score, id), and reads from that order: in a first pass the first
rows of the anchor's label, its positives; in a second one, for each positive, where its upper limit lies (by binary search) and the first
rows of another label from there that reach its lower limit. A task keeps only the best of its blocks, so it gives a fixed
number of rows for each anchor, and their merge is exact: the best of all rows are among the best of each block.

Defined results: rows with a null label or vector, or with a component that is null or not finite, take no part; shorter vectors count as
padded with zeros; an empty vector scores 0; components whose scores could pass a long are held at that bound; a null vec_id is no anchor,
comes last among ties, and is given as null; rows that repeat a vec_id are rows of their own, as anchors too;
an anchor without positives, and a positive without fitting rows, give no rows; an empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

POSITIVES, NEGATIVES, LOWER, UPPER = 5, 10, 30, 90
#: Anchors that are sent to all tasks at once, rows of a block, and scores that are sorted at once.
ROUND, BLOCK, SCORES = 1 << 13, 1 << 15, 1 << 20
NO_ID = np.iinfo(np.int64).max


def _whole(dims: int, scale: int):
    """row, vec_id, label and the vector's integers as bytes; rows that take no part go."""
    bound = int((2**62 / max(dims, 1)) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kept = [], []
            for i, v in enumerate(batch.column("embedding")):
                x = v.as_py()
                if x is None or any(c is None for c in x):
                    continue
                x = np.array(x, np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        whole = np.clip(np.floor(x * scale), -bound, bound).astype(np.int64)
                    out.append(np.concatenate([whole, np.zeros(dims - len(x), np.int64)]).astype("<i8").tobytes())
                    kept.append(i)
            rest = batch.select(["row", "vec_id", "label"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.binary())], names=["row", "vec_id", "label", "whole"])

    return run


class Anchors:
    """Some anchors' integers, labels and rows, and, once they are known, their positives."""

    def __init__(self, table: pa.Table, dims: int, places: int):
        self.dims, self.n = dims, table.num_rows
        self.row, self.label = (table.column(c).to_numpy() for c in ("row", "label"))
        self.whole = np.frombuffer(b"".join(table.column("whole").to_pylist()), "<i8").reshape(self.n, dims)
        self.largest = int(np.abs(self.whole).max(initial=0))
        self.places = places

    def scored(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The scores of all rows for some anchors at a time, from the first of these. Floats hold them exactly below 2**53."""
        exact = self.dims * self.largest * int(np.abs(rows).max(initial=0)) < 2**53
        kind = np.float64 if exact else np.int64
        turned, step = rows.T.astype(kind), max(1, SCORES // max(1, len(rows)))
        for i in range(0, self.n, step):
            yield i, (self.whole[i : i + step].astype(kind) @ turned).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _ordered(block: pa.Table, dims: int) -> tuple[np.ndarray, ...]:
    """Row, id, label and integers of a block's rows, by id: a stable sort by score then leaves ties in order."""
    ids = block.column("vec_id").combine_chunks().fill_null(NO_ID).to_numpy()
    order = np.argsort(ids, kind="stable")
    row, label = (block.column(c).to_numpy()[order] for c in ("row", "label"))
    whole = np.frombuffer(b"".join(block.column("whole").to_pylist()), "<i8").reshape(len(ids), dims)[order]
    return row, ids[order], label, whole


class Best:
    """The best rows for each place (an anchor, or one of its positives): at most k scores and ids, higher scores and then smaller ids first."""

    def __init__(self, places: int, k: int):
        self.score, self.id = np.full((places, k), np.iinfo(np.int64).min), np.full((places, k), NO_ID)
        self.n = np.zeros(places, np.int64)

    def add(self, place: int, score: np.ndarray, ids: np.ndarray) -> None:
        n, k = self.n[place], self.score.shape[1]
        score, ids = np.concatenate([self.score[place, :n], score]), np.concatenate([self.id[place, :n], ids])
        order = np.lexsort((ids, -score))[:k]
        self.n[place] = len(order)
        self.score[place, : len(order)], self.id[place, : len(order)] = score[order], ids[order]

    def rows(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Place, id and score of all."""
        place = np.repeat(np.arange(len(self.n)), self.n)
        at = np.arange(self.score.shape[1])[None, :] < self.n[:, None]
        ids = self.id[at]
        return place, pa.array(ids, mask=ids == NO_ID), self.score[at]


def _positives(anchors: Anchors, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(anchors.n, k)
        for block in _blocks(batches, BLOCK):
            row, ids, label, whole = _ordered(block, anchors.dims)
            for first, scores in anchors.scored(whole):
                order = np.argsort(-scores, axis=1, kind="stable")
                for a in range(len(scores)):
                    i = order[a]
                    mine = i[(label[i] == anchors.label[first + a]) & (row[i] != anchors.row[first + a])][:k]
                    best.add(first + a, scores[a, mine], ids[mine])
        place, found, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(anchors.row[place]), found, pa.array(score)], names=["anchor", "id", "score"])

    return run


def _negatives(anchors: Anchors, place: np.ndarray, score: np.ndarray, number: np.ndarray, k: int, lower: int, upper: int):
    """place: the anchor of each positive, ascending; score, number: the positive's."""
    begin = np.searchsorted(place, np.arange(anchors.n + 1))
    low, high = -(-lower * score // 100), upper * score // 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(place), k)
        for block in _blocks(batches, BLOCK):
            row, ids, label, whole = _ordered(block, anchors.dims)
            for first, scores in anchors.scored(whole):
                order = np.argsort(-scores, axis=1, kind="stable")
                for a in range(len(scores)):
                    i = order[a]
                    falling = -scores[a, i]
                    other = np.flatnonzero(label[i] != anchors.label[first + a])
                    for p in range(begin[first + a], begin[first + a + 1]):
                        at = np.searchsorted(other, np.searchsorted(falling, -high[p], side="left"))
                        mine = i[other[at : at + k]]
                        mine = mine[scores[a, mine] >= low[p]]
                        if len(mine):
                            best.add(p, scores[a, mine], ids[mine])
        at, found, value = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(anchors.row[place[at]]), pa.array(number[at]), found, pa.array(value)], names=["anchor", "number", "id", "score"])

    return run


def _first(df: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The first k rows of each key by score and id, numbered from 1. A key has k rows of each task at most."""
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn(name, F.row_number().over(by)).filter(F.col(name) <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of vectors (vec_id, embedding) that anchor says.

    label: the label as a column of vectors; lower, upper: percent of the positive's score that a negative's may have.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = settle(rows.filter("label is not null and embedding is not null"), "rows")
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    whole = settle(rows.mapInArrow(_whole(dims, scale), "row long, vec_id long, label long, whole binary"), "whole")
    anchors = whole.join(rows.filter("anchor and vec_id is not null").select("row"), "row", "left_semi")
    n = anchors.count()
    rounds = -(-n // ROUND)
    anchors = settle(anchors.withColumn("round", F.pmod(F.xxhash64("row"), F.lit(rounds or 1))), "anchors")
    found = None
    for k in range(rounds):
        # An even share of the anchors: about ROUND rows, whatever the table's size.
        table = anchors.filter(F.col("round") == k).orderBy("row").toArrow()
        mine = Anchors(table, dims, positives)
        first = whole.mapInArrow(_positives(mine, positives), "anchor long, id long, score long")
        first = settle(_first(first, ["anchor"], positives, "number"), "positives")
        taken = first.orderBy("anchor", "number").toArrow()
        place = np.searchsorted(mine.row, taken.column("anchor").to_numpy())
        score, number = taken.column("score").to_numpy(), taken.column("number").to_numpy().astype(np.int64)
        last = whole.mapInArrow(_negatives(mine, place, score, number, negatives, lower, upper), "anchor long, number long, id long, score long")
        last = _first(last, ["anchor", "number"], negatives, "rank")
        named = first.select("anchor", "number", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        last = settle(last.join(named, ["anchor", "number"]), "negatives")
        found = last if found is None else found.unionByName(last)
    if found is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(named, "anchor").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOWER} * positive_score <= 100 * score AND 100 * score <= {UPPER} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
