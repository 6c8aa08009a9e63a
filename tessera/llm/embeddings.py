"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of BLOCK dimensions. Two vectors of cosine c lie at a squared
distance of 2 - 2 c, so in at least one block they lie within that block's share of it, in proportion to its
dimensions. Each block is range-joined on its own: pivots drawn from the data cut the block into cells, a vector goes
to its nearest pivot's cell and to lower cells whose border is within the block's radius. A pair meets in one
cell of a block; it is counted in the first block whose budget it meets, and only if the cosine of the whole
vectors, in double precision, reaches the bound. So the union over blocks is exact and no pair is seen twice.

Equal vectors are one class before the join. A cell's pairs are compared and counted inside its task, which
returns a count and a component label for each member, never the pairs; large cells are cut into chunks, and
tasks compare chunk with chunk.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; shorter
vectors count as padded with zeros; null vec_id: linked with nothing, component_id null, kept; rows that repeat a
vec_id: each row is a vector and counts as a link, one component; an empty table: no rows. Vectors of floats travel as
floats; all distances and cosines are in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settle

COSINE, BLOCK, SEED = 0.95, 16, 20
#: Vectors for one pivot, the most pivots (they are collected and sent to all tasks), and members of a chunk.
PER_PIVOT, MOST_PIVOTS, CHUNK = 1024, 1024, 4096
TILE, SLICE = 1024, 20_000


class Space:
    """The rotation, the blocks and their pivots."""

    def __init__(self, pivots: pa.Array, dims: int, kind: str, cosine: float):
        self.dims, self.kind, self.cosine = dims, kind, cosine
        self.rotation = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))[0]
        self.blocks = [slice(i, min(i + BLOCK, dims)) for i in range(0, dims, BLOCK)]
        self.budgets = [(2 - 2 * cosine + 1e-9) * (b.stop - b.start) / dims for b in self.blocks]
        self.pivots = self.turned(self.rows(pivots))

    def rows(self, column: pa.Array) -> np.ndarray:
        """The vectors in double precision, from the numbers of their own kind that they travel as."""
        raw = np.zeros((len(column), self.dims))
        for i, v in enumerate(column):
            x = np.frombuffer(v.as_py(), self.kind)
            raw[i, : len(x)] = x
        return raw

    def turned(self, raw: np.ndarray) -> np.ndarray:
        return raw / np.linalg.norm(raw, axis=1, keepdims=True) @ self.rotation

    def cells(self, turned: np.ndarray, k: int) -> np.ndarray:
        """rows x pivots: 2 in the home cell, 1 in lower cells within reach, else 0."""
        x, p = turned[:, self.blocks[k]], self.pivots[:, self.blocks[k]]
        d = (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)
        home = d.argmin(1)
        between = np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(2), 0))[home]
        reach = d - d[np.arange(len(d)), home][:, None] <= 2 * between * np.sqrt(self.budgets[k]) + 1e-9
        reach &= np.arange(len(p))[None, :] < home[:, None]
        out = reach.astype(np.int8)
        out[np.arange(len(d)), home] = 2
        return out


def _checked(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, the vector's numbers (null if it links with nothing) and its size."""
        for batch in batches:
            out, sizes = [], []
            for v in batch.column("embedding"):
                x = v.as_py()
                x = None if not x or any(c is None for c in x) else np.array(x, kind)
                good = x is not None and np.isfinite(x).all() and x.any()
                out.append((x + x.dtype.type(0)).tobytes() if good else None)
                sizes.append(len(x) if good else 0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], names=["vec_id", "raw", "dims"])

    return run


def _counted(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, len(space.blocks), len(space.pivots)), np.int64)
        for batch in batches:
            turned = space.turned(space.rows(batch.column("raw")))
            for k in range(len(space.blocks)):
                found = space.cells(turned, k)
                n[0, k] += (found == 2).sum(0)
                n[1, k] += (found == 1).sum(0)
        block, cell = np.nonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(cell), pa.array(n[0, block, cell]), pa.array(n[1, block, cell])], names=["block", "cell", "own", "others"])

    return run


def _placed(space: Space, chunks: dict[tuple[int, int], tuple[int, int]]):
    """Each vector in its cells, once for each task (i, j) that compares its chunk: own chunks i with all chunks j.

    A cell's own vectors lie in the first chunks, those that only reach it in later ones; these never meet each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = space.turned(space.rows(batch.column("raw")))
            rep = batch.column("rep").to_numpy()
            part = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for k in range(len(space.blocks)):
                found = space.cells(turned, k)
                row, cell = np.nonzero(found)
                home = found[row, cell] == 2
                own, others = np.array([chunks.get((k, c), (1, 1)) for c in cell.tolist()], np.int64).reshape(-1, 2).T
                of = np.where(home, own, others)
                mine = (part[row] % of.astype(np.uint64)).astype(np.int64) + np.where(home, 0, own)
                times = np.where(home, own + others, own)
                copy = np.repeat(np.arange(len(row)), times)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(times) - times, times)
                lo, hi = np.minimum(mine[copy], other), np.maximum(mine[copy], other)
                at = row[copy]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(copy), k)), pa.array(cell[copy]), pa.array(lo), pa.array(hi), pa.array(mine[copy] == hi), pa.array(rep[at]), batch.column("m").take(pa.array(at)), batch.column("raw").take(pa.array(at))],
                    names=["block", "cell", "i", "j", "second", "rep", "m", "raw"],
                )

    return run


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give a's and b's trees one label each, the smallest."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _joined(space: Space):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        k, one = table.column("block")[0].as_py(), table.column("i")[0].as_py() == table.column("j")[0].as_py()
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        rep, m = (table.column(c).to_numpy()[order] for c in ("rep", "m"))
        raw = space.rows(table.column("raw").take(pa.array(order)).combine_chunks())
        norm = np.linalg.norm(raw, axis=1)
        turned = space.turned(raw)
        second = table.column("second").to_numpy(zero_copy_only=False)[order]
        left, right = (np.arange(len(rep)),) * 2 if one else (np.flatnonzero(~second), np.flatnonzero(second))
        links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        x = turned[:, space.blocks[k]]
        square, ones = (x**2).sum(1), np.ones(len(x))
        # Single precision and slack find candidates; the difference in double precision decides.
        x, y = np.c_[-2 * x, square, ones].astype(np.float32), np.c_[x, ones, square].astype(np.float32)
        for p in range(0, len(left), TILE):
            a = left[p : p + TILE]
            for q in range(p if one else 0, len(right), TILE):
                b = right[q : q + TILE]
                near = x[a] @ y[b].T <= np.float32(space.budgets[k] + 1e-5)
                if one and p == q:
                    near = np.triu(near, 1)
                found = np.nonzero(near)
                for s in range(0, len(found[0]), SLICE):
                    i, j = a[found[0][s : s + SLICE]], b[found[1][s : s + SLICE]]
                    for e in range(k, -1, -1):
                        within = ((turned[i, space.blocks[e]] - turned[j, space.blocks[e]]) ** 2).sum(1) <= space.budgets[e] + 1e-12
                        i, j = (i[within], j[within]) if e == k else (i[~within], j[~within])
                    cosine = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j])
                    i, j = i[cosine >= space.cosine], j[cosine >= space.cosine]
                    if len(i):
                        np.add.at(links, i, m[j])
                        np.add.at(links, j, m[i])
                        _merge(label, i, j)
        has = np.flatnonzero(links)
        return pa.table({"rep": pa.array(rep[has], pa.int64()), "links": pa.array(links[has], pa.int64()), "with": pa.array(rep[label[has]], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding; other columns are ignored)."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    rows = settle(rows.mapInArrow(_checked(kind), "vec_id long, raw binary, dims long"), "vectors")
    good = rows.filter("raw is not null and vec_id is not null")
    classes = settle(good.groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "classes")
    n, dims = classes.count(), good.agg(F.max("dims")).first()[0] or 0
    if n:
        few = min(MOST_PIVOTS, max(1, -(-n // PER_PIVOT)))
        drawn = classes.select("rep", "raw").orderBy(F.xxhash64("raw"), "rep").limit(few).toArrow()
        space = Space(drawn.column("raw").combine_chunks(), dims, kind, cosine)
        # At most pivots x blocks rows.
        sizes = classes.select("raw").mapInArrow(_counted(space), "block long, cell long, own long, others long").groupBy("block", "cell").agg(F.sum("own").alias("own"), F.sum("others").alias("others")).filter(F.greatest("own", "others") > CHUNK).collect()
        chunks = {(r.block, r.cell): (max(1, -(-r.own // CHUNK)), max(1, -(-r.others // CHUNK))) for r in sizes}
        placed = classes.mapInArrow(_placed(space, chunks), "block long, cell long, i long, j long, second boolean, rep long, m long, raw binary")
        joined = settle(placed.groupBy("block", "cell", "i", "j").applyInArrow(_joined(space), "rep long, links long, with long"), "joined")
    else:
        joined = rows.sparkSession.createDataFrame([], "rep long, links long, with long")
    links = joined.groupBy("rep").agg(F.sum("links").alias("links"))
    # A repeated vec_id with different vectors is one node of the components.
    edges = joined.filter(F.col("rep") != F.col("with")).select(F.col("with").alias("a"), F.col("rep").alias("b")).distinct()
    twice = good.join(classes, "raw").filter("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    repeated = twice.join(classes.select(F.col("rep").alias("b")).distinct(), "b", "left_semi").select("a", "b").distinct()
    labels = components(edges.union(repeated), "vectors")
    named = classes.join(links, "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("raw", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "rep").alias("comp"))
    named = settle(named, "named")
    out = rows.join(named, (rows["raw"] == named["raw"]) & rows["vec_id"].isNotNull(), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp
"""
