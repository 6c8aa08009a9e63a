"""Benchmark decontamination with broadcast sets of hashed windows.

Words are runs of letters, digits and all that isn't ASCII, with A-Z in lower case. A benchmark item's windows are its runs of
WIDTH words, or all its words if they are fewer. The windows' 64-bit hashes are sent to all tasks as one sorted array, at
most MOST_WINDOWS at a time with their words (a larger benchmark goes in as many rounds, each over all documents). A task hashes all
windows of these widths in the words of whole texts, looks them up, and compares the words of each hit byte by byte,
so a hash never decides. Documents are not shuffled; after several rounds the few that were hit are put together by row.

Hit words are merged into spans; spans are cut out of texts, or hit documents dropped.

Defined results: a null or empty text has no words; items without words have no windows; items that share an item_id
are one item; a null item_id hits words and counts as an item, but isn't listed; null doc_id and repeated rows:
each document row is judged by itself; an empty benchmark hits nothing; an empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import settle, text_chunks

WIDTH = 10
#: Windows that are sent to all tasks at once, each with its words and the items that hold it.
MOST_WINDOWS = 1 << 20
#: Windows of documents whose words are compared at once.
BLOCK = 1 << 14
#: A-Z as a-z, and a blank for each byte that belongs to no word.
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x30:0x3A], _PLAIN[0x61:0x7B], _PLAIN[0x80:] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
SPAN = "struct<first: long, last: long, start: long, end: long>"


class Words:
    """The words of texts, their hashes, and the hashes of windows of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _PLAIN[data]
        self.row, self.start, self.end = words.words(self.data, offsets)
        value = words.hashed(self.data, self.start, self.end, lower=False)
        power, self.inverse = words.powers(1 << max(19, len(value).bit_length()))
        self.sums = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * power[: len(value)], out=self.sums[1:])
        #: The words with one blank behind each, and where each begins there.
        size = self.end - self.start
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        self.joined = np.full(int(self.at[-1]), 0x20, np.uint8)
        into = np.repeat(self.at[:-1] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        self.joined[into] = self.data[np.repeat(self.start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of width words that lie in one row."""
        n = len(self.row) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        return first, words.mix((self.sums[first + width] - self.sums[first]) * self.inverse[first], width)


class Windows:
    """Some items' distinct windows: sorted hashes, the words of each, and the items that hold each."""

    def __init__(self, width: int, items: pa.Table):
        texts = pc.fill_null(items.column("text").cast(pa.large_string()), "")
        raw = [x.as_py().encode() for x in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        found = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        count = np.bincount(found.row, minlength=len(raw))
        ids, known, parts = items.column("item_id").to_pylist(), {}, []
        for w in range(1, width + 1):
            for f, h in zip(*(x.tolist() for x in found.windows(w))):
                row = found.row[f]
                if w == width or count[row] == w:
                    k = known.setdefault(found.joined[found.at[f] : found.at[f + w] - 1].tobytes(), len(parts))
                    if k == len(parts):
                        parts.append((h, w, found.at[f], found.at[f + w] - 1, {}))
                    parts[k][4][ids[row]] = True
        parts.sort(key=lambda x: x[0])
        self.value, (self.size, self.begin, self.stop) = np.array([x[0] for x in parts], np.uint64), (np.array([x[k] for x in parts], np.int64) for k in (1, 2, 3))
        self.items, self.joined, self.widths = [list(x[4]) for x in parts], found.joined, np.unique(self.size).tolist()
        #: Whether any hash has these upper bits: most look-ups end here.
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.value >> np.uint64(42)] = True


def _same(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether x[x_at : x_at + size] equals y[y_at : y_at + size]; no size is 0."""
    if not len(size):
        return np.zeros(0, bool)
    ends = np.cumsum(size)
    inside = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
    return np.logical_and.reduceat(x[np.repeat(x_at, size) + inside] == y[np.repeat(y_at, size) + inside], ends - size)


def hits(found: Words, known: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, width and number of each known window that occurs."""
    out = []
    for width in known.widths:
        first, value = found.windows(width)
        maybe = known.bits[value >> np.uint64(42)]
        first, value = first[maybe], value[maybe]
        # Nearly always one window has a hash; if several do, the words decide.
        low, many = np.searchsorted(known.value, value), np.searchsorted(known.value, value, side="right")
        many -= low
        at, to = np.repeat(first, many), np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        size = found.at[at + width] - 1 - found.at[at]
        good = (known.size[to] == width) & (known.stop[to] - known.begin[to] == size)
        at, to, size = at[good], to[good], size[good]
        for i in range(0, len(at), BLOCK):
            a, t = at[i : i + BLOCK], to[i : i + BLOCK]
            same = _same(found.joined, found.at[a], known.joined, known.begin[t], size[i : i + BLOCK])
            out.append((a[same], np.full(int(same.sum()), width), t[same]))
    return tuple(map(np.concatenate, zip(*out))) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def _scanned(known: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))
        for part, data, offsets in text_chunks(batches, "text"):
            found = Words(data, offsets)
            first, width, window = hits(found, known)
            n_words = np.bincount(found.row, minlength=part.num_rows)
            # One up where a window begins, one down behind it; windows end in the row that they begin in.
            cover = np.zeros(len(found.row) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + width, -1)
            hit = np.cumsum(cover[:-1]) > 0
            edge = np.ones(len(hit), bool)
            edge[1:] = (hit[1:] != hit[:-1]) | (found.row[1:] != found.row[:-1])
            begin = np.flatnonzero(edge)
            stop = np.append(begin[1:], len(hit))[hit[begin]] if len(begin) else begin
            begin = begin[hit[begin]]
            word0 = np.cumsum(n_words) - n_words
            spans, items = [[] for _ in range(part.num_rows)], [{} for _ in range(part.num_rows)]
            for b, e in zip(begin.tolist(), stop.tolist()):
                r = int(found.row[b])
                spans[r].append({"first": b - int(word0[r]), "last": e - int(word0[r]), "start": int(found.start[b] - offsets[r]), "end": int(found.end[e - 1] - offsets[r])})
            for r, w in np.unique(np.stack([found.row[first], window]), axis=1).T.tolist():
                items[r] |= dict.fromkeys(known.items[w])
            rest = [c for c in part.schema.names if c != "text"]
            arrays = [*(part.column(c) for c in rest), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array([list(x) for x in items], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "n_words", "spans", "items"])

    return run


def _rounds(benchmark: DataFrame, most: int) -> int:
    """No item has more windows than bytes, so a round holds at most `most` windows, or what chance and one larger item add."""
    return -(-(benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // most) or 1


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MOST_WINDOWS) -> DataFrame:
    """n_words, spans (of hit words: first and last word, start and end byte; ends not included) and items of every row of docs (row, text, others).

    The text goes, the other columns stay. Where the benchmark needs more than one round, row must be the same in each.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rounds = _rounds(items, most)
    if rounds > 1:
        items = settle(items.withColumn("round", F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds))), "items")
    rest = docs.drop("text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema) + f", n_words long, spans array<{SPAN}>, items array<long>"
    found = []
    for k in range(rounds):
        mine = (items.filter(F.col("round") == k) if rounds > 1 else items).select("item_id", "text").toArrow()
        found.append(docs.select(*rest.columns, "text").mapInArrow(_scanned(Windows(width, mine)), schema))
    if rounds == 1:
        return found[0]
    # Rows that any round hit; a row has one entry a round.
    hit = found[0].filter("size(items) > 0").select("row", "spans", "items")
    for one in found[1:]:
        hit = hit.unionByName(one.filter("size(items) > 0").select("row", "spans", "items"))
    hit = hit.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("more"))

    def joined(done, x):
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= x["first"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    none = F.array().cast(f"array<{SPAN}>")
    merged = hit.select("row", F.aggregate("all", none, joined).alias("merged"), "more")
    return found[0].drop("spans", "items").join(merged, "row", "left").select(*rest.columns, "n_words", F.coalesce("merged", none).alias("spans"), F.coalesce("more", F.array().cast("array<long>")).alias("items"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the bytes of their spans."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            raw, at, kept = (text.as_py() or "").encode(), 0, []
            for s in spans.as_py() or []:
                kept.append(raw[at : s["start"]])
                at = s["end"]
            out.append(None if not text.is_valid else b"".join([*kept, raw[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])


def _tagged(docs: DataFrame) -> DataFrame:
    """docs in one struct column beside row and text, so no column of theirs can clash."""
    return settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"), F.struct("*").alias("doc")), "docs")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, drop: bool = False) -> DataFrame:
    """docs without the hit words' spans in their texts, or, with drop, without the documents that were hit. Columns stay as they are."""
    tagged = _tagged(docs)
    found = scan(tagged, benchmark, width).filter("size(items) > 0").select("row", "spans")
    if drop:
        return tagged.join(found.select("row"), "row", "left_anti").select("doc.*")
    cut = tagged.select("row", "text").join(found, "row").mapInArrow(_cut, "row long, text string").withColumnRenamed("text", "cut")
    whole = tagged.join(cut, "row", "left").withColumn("text", F.when(F.col("cut").isNotNull(), F.col("cut")).otherwise(F.col("text")))
    return whole.select(*(F.col("text") if c.lower() == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MOST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs (doc_id, text)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if _rounds(benchmark, most) > 1:
        rows = settle(rows, "docs")
    found = scan(rows, benchmark, width, most)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op12_contamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_WORDS = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"""

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), {WIDTH}) AS k, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
place AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT doc_id, i, k, item_id FROM place JOIN win USING (k, s)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
