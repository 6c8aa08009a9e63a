"""Helpers shared by the corpus operators: tables in the shared folder, text batches, connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 19
#: Rows of a chunk, and rows of an Arrow batch while a table is written: bounds a Python worker's memory.
CHUNK_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of this machine only where Spark runs on it alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, CHUNK_ROWS)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that count as hot hold more than one part in HOT of all rows, so there are fewer than HOT of them.
HOT = 1000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """left joined with a settled table right of one row a key, whose column rows counts the rows of left for that key.

    The few hot keys are sent to left's rows where they are; all others are shuffled, and none of them is large.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = right.filter(F.col(rows) > total / HOT)
    cold = right.filter(F.col(rows) <= total / HOT)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys, how))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most limit bytes of text (or one row), with the text's bytes and row offsets. Null: empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = min(lo + CHUNK_ROWS, max(lo + 1, int(np.searchsorted(ends, base + limit, side="right"))))
            part = texts.slice(lo, hi - lo)
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + hi - lo + 1]
            raw = part.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            yield batch.slice(lo, hi - lo), data, offsets - offsets[0]
            lo = hi


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, comp) for every id in edges (a, b): the smallest id reachable.

    Smallest label of the neighbours, then a jump to the label's own label, until nothing changes; each
    round is a table, so no lineage grows. A hub's rows are partial minima before the shuffle.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settle(both, f"{name}-edges")
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp"), F.lit(True).alias("moved")), f"{name}-labels")
    while labels.filter("moved").limit(1).count():
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.select("id", F.col("comp").alias("old")).join(near, "id").select("id", "old", F.least("old", "near").alias("comp"))
        step = settle(step, f"{name}-step")
        over = step.select(F.col("id").alias("comp"), F.col("comp").alias("over"))
        labels = step.join(over, "comp").select("id", F.col("over").alias("comp"), (F.col("over") < F.col("old")).alias("moved"))
        labels = settle(labels, f"{name}-labels")
    return labels.select("id", "comp")
