"""Global order without a global window: places, running sums and lists by range partitions and their offsets.

Rows are range-partitioned by their order and written, each partition a bucket. What a bucket holds in total is one row, so the offsets
of all buckets are a short list; a row's place and sums are its bucket's offset and a window inside the bucket. Lists are built
by bucket first, and buckets are put together only in the rows that ask for them.
"""

from __future__ import annotations

import re
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of this machine only where Spark runs on it alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what is read from it is the same each time, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, name: str = "placed") -> DataFrame:
    """df with bucket, place (from 1 in this order; rows equal in it in any order) and running sums by their names.

    df must have no columns of these names. Rows that are equal in the whole order lie in one bucket: give it a tie-breaker.
    """
    sums = {"place": F.lit(1)} | (sums or {})
    keys = [f"_order{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(keys, order)) | {f"_part_{s}": c.cast("long") for s, c in sums.items()})
    rows = written(rows.repartitionByRange(*keys).withColumns({"bucket": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name)
    return _summed(rows, [*keys, "_row"], list(sums)).drop(*keys, "_row")


def running(rows: DataFrame, order: str, sums: dict[str, Column]) -> DataFrame:
    """Running sums over a written table that has buckets in the order of a column."""
    return _summed(rows.withColumns({f"_part_{s}": c.cast("long") for s, c in sums.items()}), [order], list(sums))


def _summed(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    # One row a partition.
    totals = rows.groupBy("bucket").agg(*[F.sum(f"_part_{s}").alias(s) for s in sums]).orderBy("bucket").collect()
    before = [[r.bucket, *x] for r, x in zip(totals, zip(*[[0, *accumulate(r[s] or 0 for r in totals)] for s in sums]))]
    offsets = rows.sparkSession.createDataFrame(before, ", ".join(["bucket int", *[f"_before_{s} long" for s in sums]]))
    so_far = Window.partitionBy("bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(offsets), "bucket")
    out = out.withColumns({s: F.col(f"_before_{s}") + F.coalesce(F.sum(f"_part_{s}").over(so_far), F.lit(0)) for s in sums})
    return out.drop(*[f"_part_{s}" for s in sums], *[f"_before_{s}" for s in sums])


def dense_rank(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """df with the dense rank of the column key over all rows: distinct keys are placed, so a common one is one row there."""
    values = placed(df.select(F.col(key).alias("_key")).distinct(), [F.col("_key")], name=name)
    return df.join(values.select("_key", F.col("place").alias(name)), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def prefixes(items: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """Per place asked for (bucket, place): the values of all items (bucket, place, pos, value) up to it, in order.

    Its own bucket gives single items, earlier ones their lists; a place before all items gets no row.
    """
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["value"])
    lists = items.groupBy("bucket").agg(in_order(F.struct("place", "pos", "value")).alias("values"))
    want = asked.select("bucket", F.col("place").alias("until")).distinct()
    own = want.join(items, "bucket").filter("place <= until").groupBy("bucket", "until").agg(in_order(F.struct("place", "pos", "value")).alias("values"))
    earlier = want.filter("bucket > 0").select("until", F.explode(F.sequence(F.lit(0), F.col("bucket") - 1)).alias("bucket")).join(lists, "bucket")
    both = own.select("until", "bucket", "values").unionByName(earlier.select("until", "bucket", "values"))
    return both.groupBy(F.col("until").alias("place")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "values"))), lambda x: x["values"])).alias(name))


def listed(rows: DataFrame, value: str, order: list[Column], name: str) -> DataFrame:
    """One row: the distinct values of a text column, trimmed, without empty ones, by their first place."""
    keys = [f"_at{i}" for i in range(len(order))]
    firsts = rows.select(F.trim(value).alias("value"), F.struct(*[c.alias(k) for c, k in zip(order, keys)]).alias("at")).filter("value <> ''").groupBy("value").agg(F.min("at").alias("at"))
    by_bucket = placed(firsts, [F.col("at"), F.col("value")], name=name).groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))
    return by_bucket.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "values"))), lambda x: x["values"])).alias(name))
