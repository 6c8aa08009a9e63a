"""Joins with a rule of their own: exactly one partner, intervals by time bucket, missing rows, predecessors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exactly_one(left: DataFrame, right: DataFrame, key: str, rules: list[str], target: str) -> DataFrame:
    """Each key of left with its one partner of right by the first rule (a shared column) that pairs it with any.

    status: matched, unmatched (no rule has a partner) or ambiguous (that rule has two or more; the partner is null). Later rules don't
    count for a key that an earlier one pairs. Each rule is its own equi-join; partners of a hot value are counted before the join.
    """
    out = left.select(key, *rules)
    for i, rule in enumerate(rules):
        side = right.filter(F.col(rule).isNotNull()).groupBy(rule).agg(F.min(target).alias("lo"), F.max(target).alias("hi"))
        out = out.join(side.select(rule, F.struct("lo", "hi", F.lit(rule).alias("rule")).alias(f"_pair{i}")), rule, "left")
    pair = F.coalesce(*[F.col(f"_pair{i}") for i in range(len(rules))])
    one = pair["lo"] == pair["hi"]
    status = F.when(pair.isNull(), "unmatched").when(one, "matched").otherwise("ambiguous")
    return out.select(key, F.when(one, pair["lo"]).alias(target), status.alias("status"), F.when(one, pair["rule"]).alias("rule"))


def overlapping(ranges: DataFrame, spans: DataFrame, by: str, bucket: float) -> DataFrame:
    """ranges (by, range_id, lo, hi) with each span (by, span_id, start, end) of the same key that meets it, ends included.

    Both sides are dealt to time buckets; a pair counts in the bucket of the later start only. A span that ends at 0
    has no end: it has no buckets and meets all ranges of its key that end at its start or later.
    """
    last = F.greatest("start", "end")
    at = lambda c: F.floor(c / bucket)
    left = ranges.select(by, "range_id", "lo", "hi", F.explode(F.sequence(at(F.col("lo")), at(F.greatest("lo", "hi")))).alias("bucket"))
    right = spans.filter(F.col("end") != 0).select(by, "span_id", "start", last.alias("end"), F.explode(F.sequence(at(F.col("start")), at(last))).alias("bucket"))
    meets = left.join(right, [by, "bucket"]).filter((F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")) & (F.col("bucket") == at(F.greatest("start", "lo"))))
    ends = ranges.withColumn("hi", F.greatest("lo", "hi"))
    endless = ends.join(spans.filter(F.col("end") == 0), by).filter(F.col("start") <= F.col("hi"))
    names = [by, "range_id", "span_id", "start", "end"]
    return meets.select(*names).union(endless.select(*names))


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows of expected without a row of found."""
    return expected.join(found.select(key).distinct(), key, "left_anti")


def predecessor(rows: DataFrame, by: str, index: str, value: str) -> DataFrame:
    """Each row with the value at exactly index - 1 of its key, or null."""
    before = rows.select(by, (F.col(index) + 1).alias(index), F.col(value).alias(f"previous_{value}"))
    return rows.join(before, [by, index], "left")


def greatest_before(rows: DataFrame, by: str, order: tuple[str, ...], bucket: Column, values: dict[str, Column]) -> DataFrame:
    """rows with, for each name, the greatest of a value over the rows before it in order with the same key; nulls don't count.

    bucket never falls along the order (a day, say). Rows are ordered within a key's bucket only; what earlier buckets give comes
    from one row for each, so a hot key is as many tasks as it has buckets.
    """
    inside = Window.partitionBy(by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_bucket", bucket).withColumns({f"_{n}": v for n, v in values.items()})
    sums = rows.groupBy(F.col(by).alias("_by"), F.col("_bucket").alias("_at")).agg(*[F.max(f"_{n}").alias(f"_top_{n}") for n in values])
    sums = sums.select("_by", "_at", *[F.max(f"_top_{n}").over(over).alias(f"_old_{n}") for n in values])
    both = rows.withColumns({n: F.max(f"_{n}").over(inside) for n in values}).join(sums, F.col(by).eqNullSafe(F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_at")))
    return both.withColumns({n: F.greatest(n, f"_old_{n}") for n in values}).drop("_bucket", "_by", "_at", *[f"_{n}" for n in values], *[f"_old_{n}" for n in values])


def last_where(rows: DataFrame, by: str, order: tuple[str, ...], condition: Column, value: str, name: str, bucket: Column) -> DataFrame:
    """Each row with the latest earlier value where the condition held, or null; bucket as for greatest_before."""
    found = greatest_before(rows, by, order, bucket, {name: F.when(condition & F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("found")))})
    return found.withColumn(name, F.col(name)["found"])


def earlier(rows: DataFrame, by: str, order: str, n: str) -> DataFrame:
    """Each row with the number of rows before it and the sum of n over them."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("n_before", F.count("*").over(before)).withColumn("sum_before", F.coalesce(F.sum(n).over(before), F.lit(0)))
