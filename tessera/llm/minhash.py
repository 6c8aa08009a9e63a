"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Every coordinate of a sketch is a bin; in round i each shingle is hashed into one bin and the bin keeps the
smallest (round, hash). Rounds go on until all bins are full; rounds after the t-th place every shingle in
one given bin, so no bin stays empty. Equal bins estimate the Jaccard similarity with the concentration of
independent minima at the cost of a few hashes per shingle.

Texts with one set of shingles are one class before any comparison, so a group of copies costs one row. The
classes' bands meet in buckets; each bucket offers three of its members as hubs, and a text meets the four hubs that
it shares most buckets with. Links are confirmed on full sets. In buckets whose members still lie in different
components, members meet the centres of balls of linked texts instead of each other (see _across), so no group emits
its pairs.

Defined results: null text or no words: empty set, linked with nothing; null doc_id: linked with nothing,
component_id null, kept; rows that repeat a doc_id: each gets a row, one component; an empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, hot_join, settle, text_chunks
from .words import U, mix, shingle_sets

BANDS, ROWS = 32, 5
#: Bits of each coordinate that a pair's filter sees, and longs that hold those of all coordinates.
NIBBLE, LONGS = 4, BANDS * ROWS // 16
#: Hubs that a text meets first, those of most shared buckets; _across finds what links they leave.
HUBS = 4
#: Members of a block that one task compares with another block.
BLOCK = 512
#: Buckets of a member, and of a ball, that decide where two of them meet once.
KEYS = 64


def most_apart(percent: int) -> int:
    """Differing coordinates beyond which no pair of that similarity lies: the mean and six deviations."""
    n, apart = BANDS * ROWS, (1 - percent / 100) * (1 - 0.5**NIBBLE)
    return int(n * apart + 6 * (n * apart * (1 - apart)) ** 0.5)


def sketch(row: np.ndarray, value: np.ndarray, n: int, t: int) -> np.ndarray:
    """n x t coordinates for rows of shingle hashes sorted by row; rows without shingles stay at the maximum."""
    top = U(2**64 - 1)
    out = np.full(n * t, top, U)
    r, v = row, value
    for i in range(2 * t):
        if not len(r):
            break
        h = mix(v, i + 101)
        key = (U(i) << U(32)) | (h & U(0xFFFFFFFF))
        at = r * t + ((h >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else r * t + (i - t)
        if i < t:
            np.minimum.at(out, at, key)
        else:
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            out[at[first]] = np.minimum(out[at[first]], np.minimum.reduceat(key, first))
        open_rows = (out.reshape(n, t) == top).any(1)
        keep = open_rows[r]
        if not keep.all():
            r, v = r[keep], v[keep]
    return out.reshape(n, t)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = BANDS * ROWS
        for batch, data, offsets in text_chunks(batches, "text"):
            n = batch.num_rows
            row, value, at = shingle_sets(data, offsets, width)
            size = np.diff(at)
            digests = [np.zeros(n, U) for _ in range(2)]
            for k, d in enumerate(digests):
                total = np.zeros(len(value) + 1, U)
                np.cumsum(mix(mix(value, 11 + k), 21 + k), out=total[1:])
                d += total[at[1:]] - total[at[:-1]]
            s = sketch(row, value, n, t)
            bands = np.zeros((n, BANDS), U)
            for j in range(ROWS):
                bands = mix(bands + s[:, j::ROWS], j + 1)
            bands = mix(bands + np.arange(BANDS, dtype=U)[None, :], 9)
            low = (mix(s, 5) & U(2**NIBBLE - 1)).astype(np.uint8)
            bits = np.ascontiguousarray(low[:, 0::2] | low[:, 1::2] << NIBBLE).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(size.astype(np.int64)),
                    *[pa.array(d.view(np.int64)) for d in digests],
                    pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64())),
                    pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), LONGS).cast(pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "bits"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, "text"):
            _, value, at = shingle_sets(data, offsets, width)
            # With the top bit flipped, the order of unsigned numbers is that of signed ones: sets stay sorted.
            value = value ^ U(2**63)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))], names=["doc_id", "shingles"])

    return run


#: Ids (of 8 bytes) that are sent to every executor at most.
MOST_SENT = 2_000_000


def apart(x: str, y: str) -> F.Column:
    """Differing coordinates of two sketches, by the bits kept of each."""
    differs = lambda z: f"bit_count(({z} | shiftrightunsigned({z}, 1) | shiftrightunsigned({z}, 2) | shiftrightunsigned({z}, 3)) & 1229782938247303441)"
    return F.expr(" + ".join(differs(f"({x}[{i}] ^ {y}[{i}])") for i in range(LONGS)))


def _sets_of(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of the texts with those ids; a short list of ids goes to the texts, a long one meets them."""
    ids = settle(ids, "ids")
    if ids.count() <= MOST_SENT:
        ids = F.broadcast(ids)
    return settle(texts.join(ids, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, shingles array<long>"), "sets")


def _measured(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """pairs (a, b, ...) with both and sizes: the sizes of the intersection of their full shingle sets, and of the two."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = settle(pairs, f"{name}-pairs")
    return settle(pairs.join(left, "a").join(right, "b").select(*pairs.columns, both.alias("both"), (F.size("sa") + F.size("sb")).alias("sizes")), f"{name}-measured")


def _links(measured: DataFrame, percent: int) -> DataFrame:
    return measured.filter(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = settle(texts.mapInArrow(_signatures(width), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, bits array<long>"), "sigs")
    known = sigs.filter("n_shingles > 0 and doc_id is not null")
    classes = settle(known.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "bands", "bits")).alias("m")).select("d1", "d2", "n_shingles", F.col("m.doc_id").alias("rep"), "m.bands", "m.bits"), "classes")
    # A repeated doc_id with different texts can stand for two classes: it is one node, its texts all count.
    members = classes.select("rep", F.explode("bands").alias("key"))
    # Three members of each bucket, by id and by two orders that are the same in all buckets of a group.
    drawn = lambda seed: F.min(F.struct(F.xxhash64("rep", F.lit(seed)).alias("h"), "rep"))["rep"]
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.array(F.min("rep"), drawn(1), drawn(2)).alias("hubs")).filter("n > 1")
    buckets = settle(buckets, "buckets")
    shared = settle(hot_join(members, buckets, ["key"], "n").select("rep", "key", "hubs"), "shared")
    bits = settle(classes.select("rep", "bits").dropDuplicates(["rep"]), "bits")
    sets = _sets_of(texts, shared.select(F.col("rep").alias("doc_id")).distinct(), width)
    tried = shared.repartition("rep").select("rep", F.explode("hubs").alias("hub")).filter("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("n"))
    tried = tried.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("n"), "hub"))).filter(F.col("at") <= HUBS)
    spokes = tried.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    spokes = spokes.join(bits.select(F.col("rep").alias("a"), F.col("bits").alias("xs")), "a").join(bits.select(F.col("rep").alias("b"), F.col("bits").alias("ys")), "b")
    first = _measured(spokes.filter(apart("xs", "ys") <= most_apart(percent)).select("a", "b"), sets, "first")
    links = settle(_links(first, percent), "links")
    same = known.join(classes.select("d1", "d2", "n_shingles", "rep"), ["d1", "d2", "n_shingles"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    repeated = same.join(classes.select(F.col("rep").alias("b")).distinct(), "b", "left_semi").select("a", "b").distinct()
    labels = components(links.union(repeated), "first")
    more = _across(shared.select("key", "rep"), bits, labels, links, sets, percent)
    merged = more.join(labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
    bridges = merged.select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    over = components(bridges, "bridges").select(F.col("id").alias("comp"), F.col("comp").alias("over"))
    alone = over.join(labels.select(F.col("id").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("rep"), F.col("over").alias("comp"))
    final = settle(labels.join(over, "comp", "left").select(F.col("id").alias("rep"), F.coalesce("over", "comp").alias("comp")).union(alone), "final")
    named = classes.select("d1", "d2", "n_shingles", "rep").join(final, "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("comp", "rep").alias("comp"))
    named = settle(named, "named")
    out = sigs.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    linked = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("comp"))
    return out.select("doc_id", "n_shingles", F.coalesce(linked, "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those that are not kept; of rows equal in doc_id one stays."""
    found = settle(near_duplicates(docs, width, percent), "found")
    gone = settle(found.filter("not kept").select("doc_id").distinct(), "gone")
    again = settle(found.filter("doc_id is not null and kept").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    short = lambda ids: F.broadcast(ids) if ids.count() <= MOST_SENT else ids
    left = docs.join(short(gone), "doc_id", "left_anti").select(docs.columns)
    if not again.limit(1).count():
        return left
    once = left.join(short(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return left.join(short(again), "doc_id", "left_anti").select(docs.columns).union(once)


def _dealt(of: str, blocks: str) -> F.Column:
    """The block, of so many, that an id belongs to."""
    return F.expr(f"cast(pmod(xxhash64({of}), {blocks}) as int)")


def _first_keys(rows: DataFrame, of: str, name: str) -> DataFrame:
    """The smallest buckets that each value of a column has rows in, at most KEYS."""
    found = rows.select(of, "key").distinct().withColumn("at", F.row_number().over(Window.partitionBy(of).orderBy("key"))).filter(F.col("at") <= KEYS)
    return found.groupBy(of).agg(F.collect_list("key").alias(name))


def _meetings(open_rows: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Members a and centres b of other components' larger balls (size) that a bucket has and that sketches don't hold apart.

    What shares many buckets meets in the smallest of those that both sides keep, and in the few smaller ones.
    """
    twice = max(0, 2 * percent - 100)
    open_rows = settle(open_rows.join(_first_keys(open_rows, "rep", "xk"), "rep"), "members")
    # A bucket's members are dealt to blocks; its balls, of which there are fewer, meet every block.
    left = open_rows.select("key", _dealt("rep", "blocks").alias("block"), F.col("rep").alias("x"), F.col("comp").alias("cx"), F.col("bits").alias("xs"), "xk", F.struct("size", "centre").alias("rank_x"))
    balls = open_rows.select("key", "blocks", "centre", "comp", "size").distinct().join(bits.select(F.col("rep").alias("centre"), "bits"), "centre").join(_first_keys(open_rows, "centre", "yk"), "centre")
    balls = balls.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = balls.select("key", "block", F.col("centre").alias("y"), F.col("comp").alias("cy"), F.col("bits").alias("ys"), "yk", "size", F.struct("size", "centre").alias("rank_y"))
    meets = (left["key"] == right["key"]) & (left["block"] == right["block"]) & (F.col("cx") != F.col("cy")) & (F.col("rank_x") < F.col("rank_y")) & (apart("xs", "ys") <= F.when(F.col("size") > 1, most_apart(twice)).otherwise(most_apart(percent)))
    met = F.coalesce(F.array_min(F.array_intersect("xk", "yk")) < left["key"], F.lit(False))
    return left.join(right, meets & ~met).select(F.col("x").alias("a"), F.col("y").alias("b"), "size")


def _across(shared: DataFrame, bits: DataFrame, labels: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket that lie in different components; enough to join those components.

    Jaccard distance is a metric. Every member has a centre: itself or the linked neighbour with most links, at a
    distance of 1 - percent at most. If x and y are linked, x is within twice that of y's centre. So x is compared
    with centres of larger balls only, not with their members, and with members where its distance to
    the centre lies between one and two times the bound. Those comparisons run block by block inside tasks, which
    return one link for each x at most.
    """
    twice = max(0, 2 * percent - 100)
    ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = settle(ends.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree")), "degree")
    near = ends.join(degree.select(F.col("id").alias("b"), "degree"), "b").select(F.col("a").alias("id"), "degree", F.col("b").alias("centre"))
    own = degree.select("id", "degree", F.col("id").alias("centre"))
    centres = settle(near.union(own).groupBy("id").agg(F.max(F.struct("degree", (-F.col("centre")).alias("minus")))["minus"].alias("minus")).select(F.col("id").alias("rep"), (-F.col("minus")).alias("centre")), "centres")
    size = centres.groupBy("centre").agg(F.count("*").alias("size"))
    info = bits.join(centres, "rep", "left").withColumn("centre", F.coalesce("centre", "rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    info = settle(info.join(size, "centre", "left").withColumn("size", F.coalesce("size", F.lit(1))), "info")
    placed = settle(shared.join(info, "rep"), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    open_rows = settle(hot_join(placed, settle(mixed, "mixed"), ["key"], "n"), "open")
    pairs = _meetings(open_rows, bits, percent).distinct()
    measured = _measured(pairs, sets, "across")
    found = _links(measured, percent)
    ring = measured.filter((F.col("size") > 1) & (F.col("both") * 100 < (F.col("sizes") - F.col("both")) * percent) & (F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * twice)).select(F.col("a").alias("x"), F.col("b").alias("centre"))
    ring = settle(ring, "ring")
    ball = settle(centres.join(ring.select("centre").distinct(), "centre", "left_semi").select("centre", F.col("rep").alias("y")), "ball")
    counts = ring.groupBy("centre").agg(F.count("*").alias("n_x")).join(ball.groupBy("centre").agg(F.count("*").alias("n_y")), "centre")
    counts = settle(counts.select("*", F.ceil(F.col("n_x") / BLOCK).cast("int").alias("ni"), F.ceil(F.col("n_y") / BLOCK).cast("int").alias("nj")), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    xs = hot_join(ring, counts, ["centre"], "n_x").select("centre", F.col("x").alias("doc_id"), _dealt("x", "ni").alias("i"), every("nj").alias("j"))
    ys = hot_join(ball, counts, ["centre"], "n_y").select("centre", F.col("y").alias("doc_id"), _dealt("y", "nj").alias("j"), every("ni").alias("i"))
    key = ["centre", "i", "j"]
    xs = xs.join(sets, "doc_id").select(*key, "doc_id", "shingles")
    other = sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("y_shingles"))
    ys = ys.withColumnRenamed("doc_id", "y").join(other, "y").select(*[F.col(k).alias(f"y_{k}") for k in key], "y", "y_shingles")
    inside = xs.groupBy(*key).cogroup(ys.groupBy(*[f"y_{k}" for k in key])).applyInArrow(_compared(percent), "a long, b long")
    return settle(found.union(inside), "across")


def _compared(percent: int):
    def run(xs: pa.Table, ys: pa.Table) -> pa.Table:
        """For each x the first y that it is linked with."""
        out = []
        if xs.num_rows and ys.num_rows:
            lists = ys.column("y_shingles").combine_chunks()
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            sizes = np.diff(at)
            names = ys.column("y").to_numpy()
            for x, mine in zip(xs.column("doc_id").to_pylist(), xs.column("shingles").combine_chunks()):
                mine = mine.values.to_numpy()
                spot = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
                hits = np.r_[0, np.cumsum(mine[spot] == values)]
                both = hits[at[1:]] - hits[at[:-1]]
                linked = np.flatnonzero(100 * both >= percent * (sizes + len(mine) - both))
                if len(linked):
                    out.append((x, names[linked[0]]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
