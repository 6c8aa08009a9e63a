"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes. The transducer reads both token sequences; its state is the side that leads and the
bytes of that side's last token which the other side hasn't matched yet. It always reads the next token of the side
that lags (of A where nothing dangles), and the transition from (state, token) to the next state is worked out once and
memoised. Where nothing dangles, a group of A and B ids is closed. Each token that is read while bytes dangle overlaps
exactly the leading token, so it makes one link; tokens whose bytes contradict each other end the text.

Neither tokenizer joins a character with a space behind it (A by its pattern of words, B where no piece of its vocabulary has
a space behind another character; else whole texts are read), so a text is read from space to space, what such a part
gives is kept by its string, and a part that comes again costs one look-up. What is kept never decides a result, and is
dropped when it passes KEPT_BYTES.

The corpus-wide count of a pair of ids adds up by partial sums of tasks. Pairs are as many as the corpus has, so
only the commonest, at most MOST_PAIRS, are sent to all tasks; a document's links of other pairs are joined by a shuffle.

Defined results: texts that are null or empty, or whose tokens don't spell a space and the text, have no tokens: zeros and
'' as groups; null doc_id and repeated rows: each row is a document; other columns are ignored; an empty table: no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .packing import PLAIN_CHARS, encoder

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that are sent to all tasks (16 bytes each), pairs that a task holds while it counts, and bytes of kept parts in a worker.
MOST_PAIRS, HELD_PAIRS, KEPT_BYTES = 1 << 22, 1 << 22, 128 << 20
#: Characters of a text that are read at once, as far as a space allows it.
STRETCH = 1 << 18
#: What a kept part takes besides its ids.
PART_BYTES = 300
#: New words that are read as one text.
WORDS = 4096
GAP = re.compile(r"(?<=\S) (?=\S)")
#: Bits of a B id in a pair, and of a token in a transition.
SHIFT, TOKEN_BITS = 32, 20


class ByteLevel:
    """A byte-level vocabulary in a file of the tokenizers library; special tokens in a text are plain text.

    Short texts go to the same vocabulary's ranks, where they lie beside it: the same ids in a third of the time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)
        self._own.encode_special_tokens = True
        ranks = path.removesuffix(".json") + ".tiktoken"
        self._quick = encoder(ranks).encode_ordinary if os.path.exists(ranks) else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [i for i in range(256) if i not in plain]
        letters = {chr(i): i for i in plain} | {chr(256 + k): i for k, i in enumerate(rest)}
        self.bytes = [b""] * (1 + max(self._own.get_vocab().values()))
        for entry, i in self._own.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in entry)

    def encode(self, text: str) -> list[int]:
        return self._quick(" " + text) if self._quick and len(text) < PLAIN_CHARS else self._own.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """A vocabulary of pieces in a file of sentencepiece, which adds the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._own = SentencePieceProcessor(model_file=path)
        pieces = [self._own.id_to_piece(i) for i in range(self._own.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self._own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.parts = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, text: str) -> list[int]:
        return self._own.encode(text)


class Transducer:
    """Groups and links of two token sequences over the same bytes."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.spelt = (a, b)
        self.clear()

    def clear(self) -> None:
        #: The bytes that dangle in a state; its number's last bit is the side that leads. 0: nothing dangles.
        self.rest, self.number, self.steps = {0: b""}, {}, {}

    def _step(self, state: int, token: int) -> int:
        """The state after the lagging side's token; -1: the bytes contradict each other."""
        lead, rest = state & 1, self.rest[state]
        side = 1 - lead if state else 0
        read = self.spelt[side][token]
        if not read or not (rest.startswith(read) or read.startswith(rest)):
            return -1
        after = (lead, rest[len(read) :]) if len(read) < len(rest) else (side, read[len(rest) :])
        if not after[1]:
            return 0
        if after not in self.number:
            self.number[after] = n = 2 * len(self.rest) + after[0]
            self.rest[n] = after[1]
        return self.number[after]

    def run(self, a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]] | None:
        """The groups' ends in a, their ends in b, and the links (A id << SHIFT | B id) in order; None: they don't spell the same."""
        i = j = state = lead = 0
        # Flat lists of numbers: nothing here for the collector of cycles.
        a_ends, b_ends, links, get, n, m = [], [], [], self.steps.get, len(a), len(b)
        while True:
            if state & 1:
                if i == n:
                    return None
                token = a[i]
                i += 1
                links.append(token << SHIFT | lead)
            elif state:
                if j == m:
                    return None
                token = b[j]
                j += 1
                links.append(lead << SHIFT | token)
            elif i < n:
                token = a[i]
                i += 1
            else:
                return (a_ends, b_ends, links) if j == m else None
            after = get(state << TOKEN_BITS | token)
            if after is None:
                after = self.steps[state << TOKEN_BITS | token] = self._step(state, token)
            if after > 0:
                if not state or (after ^ state) & 1:
                    lead = token
            elif after:
                return None
            else:
                a_ends.append(i)
                b_ends.append(j)
            state = after


class Aligner:
    """What the parts of texts give, kept by their strings."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.names = [str(i) for i in range(max(len(self.a.bytes), len(self.b.bytes)))]
        self.opening = {i for i, x in enumerate(self.a.bytes) if x.startswith(b" ")}
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        #: Of each part: counts of A ids (-1: no tokens), B ids, groups and links, and the end of its links in pairs.
        self.counts, self.pairs, self.kept = array("q"), array("q"), 0
        self.transducer.clear()

    def read(self, text: str) -> tuple:
        """Both tokenizers' ids and what the transducer finds; None unless they spell a space and the text."""
        a, b = self.a.encode(text), self.b.encode(text)
        spelt = b"".join(map(self.a.bytes.__getitem__, a)) == b" " + text.encode()
        return a, b, self.transducer.run(a, b) if spelt else None

    def add(self, keys: list[str], parts: list[str]) -> None:
        """Align parts that are new, each by itself."""
        for key, part in zip(keys, parts):
            a, b, found = self.read(part)
            if found:
                self.keep([key], a, b, found, [len(found[0])])
            else:
                self.counts.extend((-1, 0, 0, 0, len(self.pairs)))
                self.known[key] = len(self.groups)
                self.groups.append("")
                self.kept += PART_BYTES + len(key)

    def add_words(self, words: list[str]) -> None:
        """Align parts that are new and hold no space, all as one text: a group that begins with a space begins a part."""
        a, b, found = self.read(" ".join(words))
        opening = self.opening
        begins = [k for k, x in enumerate(found[0][:-1], 1) if a[x] in opening] if found else []
        if found and len(begins) == len(words) - 1:
            self.keep(words, a, b, found, [*begins, len(found[0])])
        else:
            self.add(words, words)

    def keep(self, keys: list[str], a: list[int], b: list[int], found: tuple, ends: list[int]) -> None:
        """Keep what the parts of these keys gave; ends: the number of groups up to the end of each part."""
        (a_ends, b_ends, links), names, base = found, self.names, len(self.pairs)
        text, x, y = [], 0, 0
        for to_x, to_y in zip(a_ends, b_ends):
            left = names[a[x]] if to_x == x + 1 else ",".join([names[k] for k in a[x:to_x]])
            text.append(left + "|" + (names[b[y]] if to_y == y + 1 else ",".join([names[k] for k in b[y:to_y]])))
            x, y = to_x, to_y
        self.pairs.extend(links)
        begin = x = y = 0
        for key, end in zip(keys, ends):
            to_x, to_y = (a_ends[end - 1], b_ends[end - 1]) if end else (0, 0)
            # A group of p and q tokens has p + q - 1 links.
            self.counts.extend((to_x - x, to_y - y, end - begin, to_x - x + to_y - y - end + begin, base + to_x + to_y - end))
            self.known[key] = len(self.groups)
            self.groups.append(";".join(text[begin:end]))
            self.kept += PART_BYTES + len(key) + 12 * (to_x - x + to_y - y)
            begin, x, y = end, to_x, to_y

    def numbers(self, text: str) -> list[int]:
        """The numbers of a text's parts. Parts that a plain split leaves are right unless they are empty or have white space at an end."""
        if self.b.parts:
            parts = text.split(" ")
            found = list(map(self.known.get, parts))
            if None not in found:
                return found
            new = list(dict.fromkeys([p for p, n in zip(parts, found) if n is None]))
            if not any(not p or p[0].isspace() or p[-1].isspace() for p in new):
                for i in range(0, len(new), WORDS):
                    self.add_words(new[i : i + WORDS])
                return list(map(self.known.__getitem__, parts))
        # A key with a space in front is no part of a plain split.
        parts = GAP.split(text) if self.b.parts else [text]
        keys = [" " + p for p in parts]
        new = [k for k in dict.fromkeys(keys) if k not in self.known]
        self.add(new, [k[1:] for k in new])
        return list(map(self.known.__getitem__, keys))

    def document(self, text: str, groups: bool) -> tuple:
        """n_a, n_b, n_groups, n_links, SHA-256 of the groups, the distinct pairs and how often each is linked, the groups if asked for."""
        total, digest, pairs, told, at = np.zeros(4, np.int64), hashlib.sha256(), [], [], 0
        while at <= len(text) and text:
            gap = GAP.search(text, at + STRETCH) if self.b.parts and len(text) > at + STRETCH else None
            if self.kept > KEPT_BYTES:
                self.clear()
            numbers = self.numbers(text[at : gap.start() if gap else len(text)])
            counts = np.frombuffer(self.counts, np.int64).reshape(-1, 5)[np.array(numbers, np.int64)]
            if (counts[:, 0] < 0).any():
                total[:] = 0
                break
            total += counts[:, :4].sum(0)
            said = ";".join(map(self.groups.__getitem__, numbers))
            digest.update((b";" if at else b"") + said.encode())
            if groups:
                told.append(said)
            size = counts[:, 3]
            begins = np.repeat(counts[:, 4] - np.cumsum(size), size)
            pairs.append(np.frombuffer(self.pairs, np.int64)[begins + np.arange(len(begins))])
            at = gap.end() if gap else len(text) + 1
        if not total[0]:
            return 0, 0, 0, 0, "", b"", b"", "" if groups else None
        pair, times = np.unique(np.concatenate(pairs), return_counts=True)
        return *total.tolist(), digest.hexdigest(), pair.astype("<i8").tobytes(), times.astype("<u4").tobytes(), ";".join(told) if groups else None


@lru_cache(1)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(public_tokenizers.path(a), public_tokenizers.path(b))


def _aligned(a: str, b: str, groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.string()]
        for batch in batches:
            rows = [aligner(a, b).document(x.as_py() or "", groups) for x in batch.column("text")]
            found = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *found], names=["row", "doc_id", *COUNTED, "groups_sha256", "pairs", "times", "groups"])

    return run


COUNTED = ["n_a", "n_b", "n_groups", "n_links"]


def _summed(held: int):
    """Partial sums of the pairs' counts."""

    def merged(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        pair, to = np.unique(np.concatenate(pairs), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, to, np.concatenate(times))
        return pair, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, size = [], [], 0
        for batch in batches:
            for p, t in zip(batch.column("pairs"), batch.column("times")):
                pairs.append(np.frombuffer(p.as_py(), "<i8"))
                times.append(np.frombuffer(t.as_py(), "<u4"))
                size += len(pairs[-1])
            if size > held:
                pair, n = merged(pairs, times)
                pairs, times, size = [pair], [n], len(pair)
                if 2 * size > held:
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                    pairs, times, size = [], [], 0
        if size:
            pair, n = merged(pairs, times)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    return run


def _looked_up(pair: np.ndarray, n: np.ndarray, best: np.ndarray):
    """A document's sums over the pairs that were sent, and its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, bests, rest, often = [], [], [], []
            for p, t in zip(batch.column("pairs"), batch.column("times")):
                p, t = np.frombuffer(p.as_py(), "<i8"), np.frombuffer(t.as_py(), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(pair, p), len(pair) - 1)
                has = pair[at] == p if len(pair) else np.zeros(len(p), bool)
                sums.append(int((n[at[has]] * t[has]).sum()))
                bests.append(int(t[has][best[at[has]]].sum()))
                rest.append(p[~has])
                often.append(t[~has])
            kind = pa.list_(pa.int64())
            arrays = [*(batch.column(c) for c in ("row", "doc_id", *COUNTED, "groups_sha256", "groups")), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, kind), pa.array(often, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", *COUNTED, "groups_sha256", "groups", "n_best", "count_sum", "rest", "often"])

    return run


def align(docs: DataFrame, a: str = A, b: str = B, groups: bool = False, most: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text); groups: also the groups as text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    aligned = settle(rows.mapInArrow(_aligned(a, b, groups), f"{counted}, pairs binary, times binary, groups string"), "aligned")
    counts = aligned.select("pairs", "times").mapInArrow(_summed(HELD_PAIRS), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    counts = settle(counts, "pairs")
    # One row for each B id at most.
    highest = counts.groupBy("b").agg(F.max("n").alias("top"))
    ranked = counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    # Sizes of the counts' magnitudes, 64 rows at most: the sent ones are whole magnitudes from above.
    level = F.log2("n").cast("int")
    sent, low = 0, 64
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("size")).orderBy(F.desc("level")).collect():
        if sent + r["size"] > most:
            break
        sent, low = sent + r["size"], r["level"]
    hot = ranked.filter(level >= low).toArrow()
    order = np.argsort(hot.column("pair").to_numpy())
    pair, n, best = (hot.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best"))
    found = aligned.mapInArrow(_looked_up(pair, n, best), f"{counted}, groups string, n_best long, count_sum long, rest array<long>, often array<long>")
    names = ["doc_id", *COUNTED, "n_best", "count_sum", "groups_sha256", *["groups"] * groups]
    if sent == counts.count():
        return found.select(*names)
    found = settle(found, "found")
    links = found.select("row", F.explode(F.arrays_zip("rest", "often")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.often").alias("times"))
    # What a document still lacks; no pair of these is common.
    more = links.join(ranked.filter(level < low), "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    total = found.join(more, "row", "left")
    return total.withColumns({"count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))}).select(*names)


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
