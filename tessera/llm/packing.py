"""Lexical retrieval packing into fixed windows.

Each document is its token ids and a closing id 0. Full windows of a long document are sequences of their own; what
remains of it is placed among the other remainders. Remainders are dealt to shards by content: a document's key are its
two terms (token ids) that occur most often for how common they are in general, ids of the vocabulary being in order of how
common they are; documents are range-partitioned and sorted by key and a hash, and every SHARD_DOCS of them in a row are
a shard. So documents of one key lie together, and a key with more documents than a shard holds, or than a partition
should, is simply cut.

A shard holds a BM25 inverted index of its documents, whole texts included (document frequencies and the mean length come
from all documents; terms in more than half of them weigh nothing). The longest unused remainder seeds a window and queries
the index with all its document's terms. Its unused neighbours, best score first, fill the window greedily: whole ones that
fit, then the next one is cut and its rest stays available. So only the last sequence of a shard has padding.

The ids come from the tiktoken build of the vocabulary, which gives the ids that the tokenizers library gives, three
times as fast; texts that its pattern engine gives up on (runs of a million blanks), and texts with the special token,
go to the tokenizers library itself.

Defined results: null or empty text: the single id 0; null doc_id and repeated rows: each row is a document;
texts of any length; a special token in a text is its id, as in that library; an empty table: no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

WINDOW = 1024
SHARD_DOCS = 2048
#: Terms in one document of a shard in so many, or more, have a full row of weights there.
FREQUENT = 8
K1, B = 1.2, 0.75
VOCABULARY = 50257
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: Characters up to which no text fills the pattern engine's stack.
PLAIN_CHARS = 100_000


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def library(path: str):
    """The tokenizers library's own build of the vocabulary, beside that at path."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")


def encoded(path: str, text: str) -> np.ndarray:
    try:
        if SPECIAL not in text:
            # The plain call is the faster one, but ends the worker where the pattern engine's stack is full.
            return np.array(encoder(path).encode_ordinary(text), np.uint32) if len(text) <= PLAIN_CHARS else encoder(path).encode_to_numpy(text)
    except ValueError:  # the pattern engine's stack is full
        pass
    return np.array(library(path).encode(text, add_special_tokens=False).ids, np.uint32)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _counted(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and how often each is there."""
    edge = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    first = np.concatenate([[0], edge]) if len(ordered) else edge
    return ordered[first], np.diff(first, append=len(ordered))


def _tokenized(path: str, window: int):
    """Checksums of a document's full windows, the ids of its remainder, its distinct ids with counts if it has full windows, and its key."""

    rare = np.log1p(np.arange(VOCABULARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(7)]
            for text in batch.column("text"):
                ids = encoded(path, text.as_py() or "")
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                whole = len(ids) // window * window
                term, count = _counted(np.sort(ids))
                often = count * rare[term]
                first = int(often.argmax())
                k1, often[first] = int(term[first]), -1.0
                k2 = int(term[often.argmax()])
                fulls = [zlib.crc32(ids[i : i + window].tobytes()) for i in range(0, whole, window)]
                found = (term.astype("<u2").tobytes(), count.astype("<u4").tobytes()) if whole else (b"", b"")
                for column, v in zip(out, (len(ids), fulls, ids[whole:].astype("<u2").tobytes(), *found, k1, k2)):
                    column.append(v)
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out, kinds)], names=["doc_id", "doc_tokens", "full_crcs", "tail", "terms", "counts", "k1", "k2"])

    return run


def postings(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of the rows' distinct ids, by row and term."""
    tails, terms, counts = (batch.column(c).to_pylist() for c in ("tail", "terms", "counts"))
    short = [i for i, t in enumerate(terms) if not t]
    ids = np.frombuffer(b"".join(tails[i] for i in short), "<u2").astype(np.int64)
    pair, count = _counted(np.sort(np.repeat(short, [len(tails[i]) // 2 for i in short]).astype(np.int64) << 16 | ids))
    full = [i for i, t in enumerate(terms) if t]
    if full:
        own = np.repeat(full, [len(terms[i]) // 2 for i in full]) << 16 | np.frombuffer(b"".join(terms[i] for i in full), "<u2").astype(np.int64)
        pair, count = np.concatenate([pair, own]), np.concatenate([count, np.frombuffer(b"".join(counts[i] for i in full), "<u4").astype(np.int64)])
        order = np.argsort(pair, kind="stable")
        pair, count = pair[order], count[order]
    return pair >> 16, pair & 0xFFFF, count


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document frequencies by token id; id -1 has the documents, id -2 their tokens."""
    df, n, tokens = np.zeros(VOCABULARY, np.int64), 0, 0
    for batch in batches:
        _, term, _ = postings(batch)
        df += np.bincount(term, minlength=VOCABULARY)
        n, tokens = n + batch.num_rows, tokens + int(batch.column("doc_tokens").to_numpy().sum())
    ids = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[ids, -1, -2]), pa.array(np.r_[df[ids], n, tokens])], names=["id", "df"])


class Scale:
    """BM25 weights from the frequencies of all documents."""

    def __init__(self, df: np.ndarray, n: int, tokens: int):
        # A term in more than half of the documents weighs nothing; of one document alone it leads nowhere.
        self.idf = np.where(df > 1, np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0), 0)
        self.mean = max(tokens / n, 1.0) if n else 1.0

    def weights(self, term: np.ndarray, count: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return self.idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * tokens / self.mean))


class Index:
    """The inverted index of a shard: postings by term, and a full row of weights for each frequent term."""

    def __init__(self, n: int, of: np.ndarray, term: np.ndarray, weight: np.ndarray):
        by_term = np.argsort(term, kind="stable")
        self.n, self.doc, self.weight = n, of[by_term], weight[by_term]
        self.terms, begin, sizes = np.unique(term[by_term], return_index=True, return_counts=True)
        self.begin, self.sizes = begin, sizes
        frequent = sizes * FREQUENT >= n
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.full = np.zeros((int(frequent.sum()), n), np.float32)
        mine = np.repeat(self.row, sizes)
        self.full[mine[mine >= 0], self.doc[mine >= 0]] = self.weight[mine >= 0]
        self.of_doc = np.searchsorted(of, np.arange(n + 1))
        self.asked = np.searchsorted(self.terms, term)

    def scores(self, d: int) -> np.ndarray:
        """BM25 of every document for the terms of document d."""
        asked = self.asked[self.of_doc[d] : self.of_doc[d + 1]]
        rows = self.row[asked]
        rare = asked[rows < 0]
        begin, sizes = self.begin[rare], self.sizes[rare]
        found = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.doc[found], self.weight[found], self.n) + self.full[rows[rows >= 0]].sum(0)


def fill(lengths: np.ndarray, index: Index, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """The windows of one shard: lists of (document, begin, end), from its remainders' lengths and the index of its documents."""
    n = len(lengths)
    begin, left = np.zeros(n, np.int64), lengths.astype(np.int64).copy()
    order = np.argsort(-lengths, kind="stable")
    after = 0
    for seed in order:
        while left[seed]:
            pieces = []
            room = window

            def place(d: int) -> int:
                size = min(room, int(left[d]))  # noqa: B023
                pieces.append((int(d), int(begin[d]), int(begin[d]) + size))  # noqa: B023
                begin[d], left[d] = begin[d] + size, left[d] - size
                return room - size  # noqa: B023

            room = place(seed)
            if room:
                score = np.where(left > 0, index.scores(seed), 0)
                # The next best by passes over the scores: a window takes few documents.
                while room:
                    d = int(np.argmax(np.where(left <= room, score, 0)))
                    if score[d] <= 0 or left[d] > room:
                        break
                    room, score[d] = place(d), 0
                while room:
                    d = int(np.argmax(score))
                    if score[d] <= 0:
                        break
                    room, score[d] = place(d), 0
                while room and after < n:
                    if left[order[after]]:
                        room = place(order[after])
                    else:
                        after += 1
            yield pieces


_PIECES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _pieces(table: pa.Table, scale: Scale, window: int, first: int) -> pa.RecordBatch:
    """The pieces of one shard's documents; its sequences are numbered from first."""
    tails = [np.frombuffer(t, "<u2") for t in table.column("tail").to_pylist()]
    lengths = np.array([len(t) for t in tails], np.int64)
    doc_ids, tokens = table.column("doc_id").to_pylist(), table.column("doc_tokens").to_pylist()
    of, term, count = postings(table)
    weight = scale.weights(term, count, np.array(tokens)[of])
    index = Index(len(tails), *(x[weight > 0] for x in (of, term, weight)))
    out = [[] for _ in _PIECES]

    def put(d, start, length, check, offset):
        for column, v in zip(out, (doc_ids[d], start, length, check, tokens[d], first, offset)):
            column.append(v)

    for d, fulls in enumerate(table.column("full_crcs").to_pylist()):
        for i, check in enumerate(fulls):
            put(d, i * window, window, check, 0)
            first += 1
    for pieces in fill(lengths, index, window):
        offset = 0
        for d, lo, hi in pieces:
            put(d, tokens[d] - int(lengths[d]) + lo, hi - lo, crc(tails[d][lo:hi]), offset)
            offset += hi - lo
        first += 1
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=list(_PIECES))


def shards(batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[pa.Table]:
    """Rows in order, so many at a time."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, docs - n)
            held.append(part)
            batch, n = batch.slice(part.num_rows), n + part.num_rows
            if n == docs:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _packed(scale: Scale, window: int, docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sequences of a partition are numbered from its own place on; a retried task gets the same rows and numbers.
        first = TaskContext.get().partitionId() << 40
        for table in shards(batches, docs):
            out = _pieces(table, scale, window, first)
            first = max(out.column("sequence_id").to_pylist()) + 1
            yield out

    return run


def in_order(docs: DataFrame, path: str, window: int) -> tuple[DataFrame, Scale]:
    """The documents' tokens, those of one key beside each other, and the scale of their weights."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = texts.mapInArrow(_tokenized(path, window), "doc_id long, doc_tokens long, full_crcs array<long>, tail binary, terms binary, counts binary, k1 int, k2 int")
    tokens = settle(tokens, "tokens")
    # At most one row for each id of the vocabulary, and two totals.
    df = {r.id: r.df for r in tokens.select("doc_tokens", "tail", "terms", "counts").mapInArrow(_frequencies, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect()}
    counts = np.zeros(VOCABULARY)
    for i, c in df.items():
        if i >= 0:
            counts[i] = c
    order = ["k1", "k2", F.xxhash64("doc_id", "doc_tokens", "tail"), "doc_id"]
    return tokens.repartitionByRange(*order).sortWithinPartitions(*order), Scale(counts, df.get(-1, 0), df.get(-2, 0))


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece of a row of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows, scale = in_order(docs, path or public_tokenizers.path(RANKS), window)
    return rows.drop("k1", "k2").mapInArrow(_packed(scale, window, shard_docs), ", ".join(f"{c} long" for c in _PIECES))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
