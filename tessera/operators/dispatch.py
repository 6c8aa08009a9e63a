"""Routing of units to handlers, previews, failure classes and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def routes(units: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """A row for each unit and each handler whose condition holds; unsupported where none does."""
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules]), lambda x: x.isNotNull())
    return units.withColumn("handler", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unsupported")))))


def first_case(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds; a null condition doesn't."""
    out = F.lit(otherwise)
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def top_with_attempts(candidates: DataFrame, order: list[Column], attempts: int, produced: str, enough: int) -> DataFrame:
    """The first attempts rows in order, cut after those that have produced enough (a top-k report, so it is small)."""
    tried = candidates.orderBy(*order).limit(attempts).withColumn("attempt", F.row_number().over(Window.orderBy(*order)))
    before = F.coalesce(F.sum(produced).over(Window.orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tried.withColumn("before", before).filter(F.col("before") < enough).drop("before")


def stale(cards: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """cards (key, status, compiled_at) with status STALE and a reason where a later change exists."""
    latest = changes.groupBy(key).agg(F.max("changed_at").alias("changed_at"))
    turned = (F.col("status") == "COMPILED") & (F.col("changed_at") > F.col("compiled_at"))
    out = cards.join(latest, key, "left")
    return out.select(*[c for c in cards.columns if c != "status"], F.when(turned, "STALE").otherwise(F.col("status")).alias("status"), F.when(turned, "newer evidence").alias("reason"))
