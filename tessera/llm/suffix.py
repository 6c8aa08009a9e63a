"""Removal of long repeated byte strings through suffix arrays and longest-previous-factor arrays, by shards.

A string of LENGTH bytes is found by its anchor: the smallest hash of its substrings of ANCHOR bytes, which equal
strings share. Runs of neighbouring strings with one anchor form a segment. Anchors seen once, in a segment that
cannot repeat itself, drop out; segments equal byte for byte are counted, not compared. Only what is left, the
edges of repeated passages, is read again: the segments of an anchor meet in one shard, whose suffixes are
sorted by prefix doubling up to LENGTH bytes and, among equals, by place. There a suffix's previous smaller
position is its neighbour and its longest-previous-factor reaches LENGTH exactly if that neighbour agrees with
it. An anchor with very many different segments cuts them into pieces of a few strings, counts equal pieces, and deals
out by hash only the strings of pieces that others resemble.

keep="first" removes later copies and keeps the first, by doc_id and place; keep="none" removes them all.

Defined results: null or empty text: 0 bytes, nothing removed; null doc_id: a document like any other, before all
others in order; rows equal in doc_id and text get one result, and stand for each other's first copy; an empty
table: no rows. A worker holds a few numbers for each byte of the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, settle, text_chunks
from .words import U, prefix, spans

LENGTH, ANCHOR = 400, 50
#: Bytes of segments in a shard, and different segments of an anchor beyond which its suffixes are dealt out.
SHARD_BYTES, MOST_SEGMENTS = 1 << 20, 2000
NO_ID = -(2**63)
#: Documents and spans that are sent to every executor at most.
MOST_SENT = 500_000


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w neighbours, by doubling."""
    span, n = 1, len(x)
    while span * 2 <= w:
        x = f(x[:-span], x[span:])
        span *= 2
    rest = w - span
    return f(x[: n - w + 1], x[rest : rest + n - w + 1]) if rest else x[: n - w + 1]


def segments(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """Segments of the rows' bytes: row, start, strings, anchor hash, hash of all bytes, may repeat itself."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U, bool))
    if len(data) < length:
        return none
    w = length - anchor + 1
    sums, inverse = prefix(data)
    at = np.arange(len(data) - anchor + 1)
    h = spans(sums, inverse, at, at + anchor)
    low = _sliding(h, w, np.minimum)
    valid = np.zeros(len(low), bool)
    first = np.zeros(len(low) + 1, bool)
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        if hi - lo >= length:
            valid[lo : hi - length + 1] = True
            first[lo] = True
    start = valid & first[:-1]
    start[1:] |= valid[1:] & (low[1:] != low[:-1])
    begin = np.flatnonzero(start)
    if not len(begin):
        return none
    row = np.searchsorted(offsets, begin, side="right") - 1
    end = np.minimum(np.r_[begin[1:], len(low)], offsets[row + 1] - length + 1)
    value = low[begin]
    # Where an anchor's hash stands: positions that are smallest in some string.
    reach = _sliding(np.concatenate([np.zeros(w - 1, U), np.where(valid, low, U(0)), np.zeros(w - 1, U)]), w, np.maximum)
    spots = np.flatnonzero((h == reach[: len(h)]) & (reach[: len(h)] > 0))
    lo, hi = np.searchsorted(spots, begin), np.searchsorted(spots, end - 1 + w)
    seen = np.zeros(len(begin), np.int64)
    for j in range(int(min(16, (hi - lo).max()))):
        there = lo + j < hi
        seen[there] += h[spots[lo[there] + j]] == value[there]
    again = (seen > 1) | (hi - lo > 16)
    whole = np.array([xxhash.xxh3_64_intdigest(data[a:b].data) for a, b in zip(begin.tolist(), (end + length - 1).tolist())], U)
    return row, begin, end - begin, value, whole, again


def _digest(data: memoryview) -> bytes:
    return hashlib.sha256(data).digest()


_SIGNED = lambda x: pa.array(x.view(np.int64))


def _found(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, "text"):
            row, begin, n, value, whole, again = segments(data, offsets, length, anchor)
            at = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            digests = [_digest(data[a:b].data) for a, b in zip(offsets[:-1], offsets[1:])]
            lists = [pa.array(begin - offsets[row]), pa.array(n), _SIGNED(value), _SIGNED(whole), pa.array(again)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(np.diff(offsets)), pa.array([d.hex() for d in digests]), pa.array([d[:16] for d in digests], pa.binary()), *[pa.ListArray.from_arrays(at, x) for x in lists]],
                names=["k", "n_bytes", "sha", "tid", "starts", "ns", "anchors", "wholes", "agains"],
            )

    return run


def _cut(length: int):
    """(anchor, seg, order of the segment, bytes) of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(9)]
            for k, tid, text, wanted in zip(*[batch.column(c) for c in ("k", "tid", "text", "wanted")]):
                data = (text.as_py() or "").encode()
                for x in wanted.as_py():
                    for column, v in zip(out, (k.as_py(), tid.as_py(), x["start"], x["n"], x["anchor"], x["seg"], x["known"], x["many"], data[x["start"] : x["start"] + x["n"] + length - 1])):
                        column.append(v)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["k", "tid", "start", "n", "anchor", "seg", "known", "many", "bytes"])

    return run


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes of data by their first length bytes, by prefix doubling; the last ones are padded."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), U)
    for i in range(8):
        word = word << U(8) | padded[i : i + len(data)]
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    span = 8
    while span < length:
        step = min(span, length - span)
        ahead = np.zeros(len(rank), np.int64)
        ahead[: len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        span += step
    return rank


def long_factors(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of the suffixes at places (in order) agrees on length bytes with an earlier one, with a later one.

    In the suffix array of places, equal prefixes in order of place, the previous and the next smaller position
    of a suffix that agree with it on length bytes, if any, are its neighbours.
    """
    rank = ranks(data, length)[places]
    array = np.argsort(rank, kind="stable")
    same = np.r_[False, rank[array][1:] == rank[array][:-1]]
    earlier, later = np.zeros(len(places), bool), np.zeros(len(places), bool)
    earlier[array] = same
    later[array] = np.r_[same[1:], False]
    return earlier, later


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _sorted_shard(length: int, keep: str):
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["k", "tid", "start", "n", "anchor", "seg", "known", "bytes"]).to_pylist()
        rows = list({(r["anchor"], r["seg"]): r for r in rows}.values())
        rows.sort(key=lambda r: (r["k"], r["tid"], r["start"]))
        data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        n = np.array([r["n"] for r in rows])
        first = np.cumsum(n + length - 1) - (n + length - 1)
        places = np.concatenate([np.arange(f, f + m) for f, m in zip(first, n)])
        earlier, later = long_factors(data, places, length)
        at = np.cumsum(n) - n
        out = [[] for _ in range(4)]
        for r, a, m in zip(rows, at, n):
            if keep == "none" and r["known"]:
                continue
            flags = earlier[a : a + m] if keep == "first" else earlier[a : a + m] | later[a : a + m]
            for lo, hi in _runs(flags):
                for column, v in zip(out, (r["k"], r["tid"], r["start"] + lo, hi - lo)):
                    column.append(v)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["k", "tid", "start", "n"])

    return run


#: Strings of a segment, neighbours, that are compared together first.
PIECE = 16
#: Rows after which a task hands on what it has.
HANDED_ON = 50_000


def _columns(out: list[list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """The columns as a batch; the lists are empty again."""
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds.values())], names=list(kinds))
    for c in out:
        c.clear()
    return batch


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _pieces(length: int, anchor: int):
    """Every segment as pieces: neighbouring strings whose first anchor stands at one place, at distances of one multiple of PIECE.

    Both are read off a string's own bytes, so equal strings lie in pieces of one kind. core hashes the bytes that all
    strings of the kind share, of the piece or not; w1 and w2 are the hash of all bytes of the piece.
    """
    kinds = {"k": pa.int64(), "tid": pa.binary(), "segment": pa.int64(), "start": pa.int64(), "n": pa.int64(), "known": pa.bool_(), "core": pa.int64(), "w1": pa.int64(), "w2": pa.int64()}
    step = min(PIECE, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [[] for _ in kinds]
        for batch in batches:
            for k, tid, segment, n, known, value, data in zip(*[batch.column(c) for c in ("k", "tid", "start", "n", "known", "anchor", "bytes")]):
                k, tid, segment, n, known, raw = k.as_py(), tid.as_py(), segment.as_py(), n.as_py(), known.as_py(), memoryview(data.as_py())
                sums, inverse = prefix(np.frombuffer(raw, np.uint8))
                at = np.arange(len(raw) - anchor + 1)
                spots = np.flatnonzero(spans(sums, inverse, at, at + anchor).view(np.int64) == value.as_py())
                spot = spots[np.searchsorted(spots, np.arange(n))]
                part = (spot - np.arange(n)) // step
                first = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (part[1:] != part[:-1])])
                for lo, hi, there, i in zip(first.tolist(), [*first[1:].tolist(), n], spot[first].tolist(), part[first].tolist()):
                    near, far = i * step, min(i * step + step - 1, length - anchor)
                    whole = xxhash.xxh3_128_intdigest(raw[lo : hi - 1 + length])
                    core = _signed(xxhash.xxh3_64_intdigest(raw[there - near : there - far + length], i))
                    for column, v in zip(out, (k, tid, segment, segment + lo, hi - lo, known, core, _signed(whole >> 64), _signed(whole & 2**64 - 1))):
                        column.append(v)
                if len(out[0]) >= HANDED_ON:
                    yield _columns(out, kinds)
        yield _columns(out, kinds)

    return run


def _dealt(length: int):
    """Every string of the wanted pieces by the 128-bit hash of its bytes."""
    kinds = {"k": pa.int64(), "tid": pa.binary(), "start": pa.int64(), "known": pa.bool_(), "w1": pa.int64(), "w2": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [[] for _ in kinds]
        for batch in batches:
            for k, tid, segment, data, pieces in zip(*[batch.column(c) for c in ("k", "tid", "segment", "bytes", "pieces")]):
                k, tid, segment, raw = k.as_py(), tid.as_py(), segment.as_py(), memoryview(data.as_py())
                for x in pieces.as_py():
                    for at in range(x["start"], x["start"] + x["n"]):
                        h = xxhash.xxh3_128_intdigest(raw[at - segment : at - segment + length])
                        for column, v in zip(out, (k, tid, at, x["known"], _signed(h >> 64), _signed(h & 2**64 - 1))):
                            column.append(v)
                    if len(out[0]) >= HANDED_ON:
                        yield _columns(out, kinds)
        yield _columns(out, kinds)

    return run


def _in_many(cut: DataFrame, length: int, keep: str, anchor: int) -> DataFrame:
    """k, tid, start, n of the strings to be removed from segments of anchors that have very many.

    Equal pieces are counted, as equal segments are. Pieces whose core no other piece has drop out; the strings of
    the others, the pieces at the edges of repeated passages, are dealt out by their hash.
    """
    cut = settle(cut.dropDuplicates(["anchor", "seg"]), "many")
    pieces = settle(cut.mapInArrow(_pieces(length, anchor), "k long, tid binary, segment long, start long, n long, known boolean, core long, w1 long, w2 long"), "pieces")
    place = F.struct("k", "tid", "start")
    alike = pieces.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min(F.struct("k", "tid", "start", "segment", "n", "known")).alias("rep"), F.first("core").alias("core"))
    alike = settle(alike, "alike")
    copies = hot_join(pieces, alike.filter("c > 1").select("w1", "w2", "c", "rep"), ["w1", "w2"], "c")
    copies = copies.filter("not known" if keep == "none" else place != F.struct("rep.k", "rep.tid", "rep.start")).select("k", "tid", "start", "n")
    cores = settle(alike.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "cores")
    edges = hot_join(alike, cores, ["core"], "kinds").select("rep.k", "rep.tid", "rep.segment", F.struct("rep.start", "rep.n", (F.col("rep.known") | (F.col("c") > 1)).alias("known")).alias("piece"))
    edges = edges.groupBy("k", "tid", "segment").agg(F.collect_list("piece").alias("pieces"))
    read = cut.select("k", "tid", F.col("start").alias("segment"), "bytes").join(edges, ["k", "tid", "segment"])
    dealt = settle(read.mapInArrow(_dealt(length), "k long, tid binary, start long, known boolean, w1 long, w2 long"), "dealt")
    equal = settle(dealt.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min(place).alias("low")).filter("c > 1"), "equal")
    hits = hot_join(dealt, equal, ["w1", "w2"], "c").filter("not known" if keep == "none" else place != F.col("low"))
    return copies.union(hits.select("k", "tid", "start", F.lit(1).cast("long").alias("n")))


def _removed(length: int):
    """Each text without the bytes that its strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            for k, tid, text, cover in zip(*[batch.column(c) for c in ("k", "tid", "text", "cover")]):
                data = (text.as_py() or "").encode()
                spans_, last = [], -1
                for x in sorted(cover.as_py(), key=lambda x: x["start"]):
                    lo, hi = x["start"], x["start"] + x["n"] + length - 1
                    if spans_ and lo <= last:
                        spans_[-1][1] = last = max(last, hi)
                    else:
                        spans_.append([lo, hi])
                        last = hi
                kept, at = [], 0
                for lo, hi in spans_:
                    kept.append(data[at:lo])
                    at = hi
                kept = b"".join([*kept, data[at:]])
                for column, v in zip(out, (k.as_py(), tid.as_py(), len(data) - len(kept), len(spans_), hashlib.sha256(kept).hexdigest(), [{"start": a, "length": b - a} for a, b in spans_])):
                    column.append(v)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["k", "tid", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: str = "first", anchor: int = ANCHOR) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, length in bytes)."""
    return _repeated(docs, length, keep, anchor).drop("tid")


def _tid(text: str) -> F.Column:
    """The identity of a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _repeated(docs: DataFrame, length: int, keep: str, anchor: int) -> DataFrame:
    """The rows of repeated_spans with tid, the identity of each row's text."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    found = settle(texts.mapInArrow(_found(length, anchor), "k long, n_bytes long, sha string, tid binary, starts array<long>, ns array<long>, anchors array<long>, wholes array<long>, agains array<boolean>"), "found")
    rows = found.select("k", "tid", F.explode(F.arrays_zip("starts", "ns", "anchors", "wholes", "agains")).alias("s")).select("k", "tid", F.col("s.starts").alias("start"), F.col("s.ns").alias("n"), F.col("s.anchors").alias("anchor"), F.col("s.wholes").alias("seg"), F.col("s.agains").alias("again"))
    anchors = rows.groupBy("anchor").agg(F.count("*").alias("in_all"), (F.min("seg") < F.max("seg")).alias("varied"), F.max("again").alias("again")).filter("in_all > 1 or again")
    anchors = settle(anchors.select("anchor", "in_all", (F.col("varied") | F.col("again")).alias("open")), "anchors")
    shared = settle(hot_join(rows.drop("again"), anchors, ["anchor"], "in_all").drop("in_all"), "shared")
    kinds = shared.groupBy("anchor", "seg").agg(F.count("*").alias("c"), F.min(F.struct("k", "tid", "start", "n")).alias("rep"), F.first("open").alias("open"))
    kinds = settle(kinds, "kinds")
    twice = kinds.filter("c > 1").select("anchor", "seg", "rep", "c")
    whole = hot_join(shared, twice, ["anchor", "seg"], "c")
    if keep == "first":
        whole = whole.filter(F.struct("k", "tid", "start") != F.struct("rep.k", "rep.tid", "rep.start"))
    whole = whole.select("k", "tid", "start", "n")
    # What the counts leave open, by anchor.
    by_anchor = kinds.filter("open").groupBy("anchor").agg(F.count("*").alias("segments"), F.min("c").alias("least"))
    by_anchor = settle(by_anchor.filter("least = 1" if keep == "none" else "true"), "open")
    todo = hot_join(kinds.filter("open"), by_anchor, ["anchor"], "segments").select("anchor", "seg", "rep.*", (F.col("c") > 1).alias("known"), (F.col("segments") > MOST_SEGMENTS).alias("many"))
    todo = settle(todo, "todo")
    wanted = todo.groupBy("k", "tid").agg(F.collect_list(F.struct("start", "n", "anchor", "seg", "known", "many")).alias("wanted"))
    keyed = texts.withColumn("tid", _tid("text"))
    cut = settle(keyed.join(wanted, ["k", "tid"]).select("k", "tid", "text", "wanted").mapInArrow(_cut(length), "k long, tid binary, start long, n long, anchor long, seg long, known boolean, many boolean, bytes binary"), "cut")
    few = cut.filter("not many")
    total = few.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    edges = few.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(_sorted_shard(length, keep), "k long, tid binary, start long, n long")
    cover = settle(whole.union(edges).union(_in_many(cut.filter("many"), length, keep, anchor)), "cover").groupBy("k", "tid").agg(F.collect_list(F.struct("start", "n")).alias("cover"))
    result = keyed.join(cover, ["k", "tid"]).select("k", "tid", "text", "cover").mapInArrow(_removed(length), "k long, tid binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>")
    result = settle(result, "result").dropDuplicates(["k", "tid"])
    out = found.select("k", "tid", "n_bytes", "sha").join(result, ["k", "tid"], "left")
    return out.select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
        "tid",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,length:bigint>>")).alias("spans"),
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, cover in zip(batch.column("text"), batch.column(batch.num_columns - 1)):
            text, cover = text.as_py(), cover.as_py()
            if cover:
                data, kept, at = text.encode(), [], 0
                for x in cover:
                    kept.append(data[at : x["start"]])
                    at = x["start"] + x["length"]
                text = b"".join([*kept, data[at:]]).decode(errors="ignore")
            texts.append(text)
        names = batch.schema.names[:-1]
        sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        columns = [pa.array(texts, pa.string()) if c == "text" else sizes.cast(batch.schema.field(c).type) if c == "n_chars" else batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs, all columns, with later copies of long strings cut from text (and n_chars set anew).

    Characters that a cut leaves incomplete go as well. A text cut to nothing stays as an empty text.
    """
    found = settle(_repeated(docs, length, "first", ANCHOR).filter("n_removed > 0").select("doc_id", "tid", "spans"), "spans")
    found = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "tid", "spans").dropDuplicates(["k", "tid"])
    few = found.agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("m")).first()
    if few.n + (few.m or 0) <= MOST_SENT:
        found = F.broadcast(found)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), _tid("text").alias("tid"))
    spare = "_" * (1 + max(map(len, docs.columns)))
    return rows.join(found, ["k", "tid"], "left").select("row.*", F.col("spans").alias(spare)).mapInArrow(_without, docs.schema)


def op7_suffix(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="none").drop("spans")
