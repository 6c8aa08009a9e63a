"""Plans as nested rows: levels of keys with lists of what lies below, in order of first appearance, and back again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A level: its key columns, and the name of the list below.
Level = tuple[list[str], str]


def nest(rows: DataFrame, levels: list[Level], order: str) -> DataFrame:
    """rows as one row for each key of the first level, with a list for each level below; the last list holds all other columns.

    order: a column that orders rows; keys come in order of their first row at every level, and the result keeps the first row's order
    as that column. A key of the first level is put together in one task, so it should be what one reader takes at once (a season, not a run).
    Null keys are keys; a table without rows gives none.
    """
    keys = [k for level, _ in levels for k in level]
    rest = [c for c in rows.columns if c not in keys]
    out = rows.select(*keys, F.col(order).alias("_at"), F.struct(*rest).alias("_below"))
    for depth in range(len(levels) - 1, -1, -1):
        outer = [k for level, _ in levels[: depth + 1] for k in level]
        # Equal orders go by what lies below, where that can be ordered.
        lists = F.array_sort(F.collect_list(F.struct("_at", "_below")), lambda a, b: F.when(a["_at"] < b["_at"], -1).when(a["_at"] > b["_at"], 1).otherwise(0))
        below = F.transform(lists, lambda x: x["_below"]).alias("_list")
        out = out.groupBy(*outer).agg(F.min("_at").alias("_at"), below)
        inner = levels[depth][0] if depth else []
        out = out.select(*[k for k in outer if k not in inner], "_at", F.struct(*inner, F.col("_list").alias(levels[depth][1])).alias("_below")) if depth else out.select(*outer, F.col("_at").alias(order), F.col("_list").alias(levels[0][1]))
    return out


def flatten(nested: DataFrame, levels: list[Level]) -> DataFrame:
    """The rows that nest was given: their own order column comes from the last list."""
    out, keys = nested.select(*levels[0][0], F.explode(levels[0][1]).alias("_one")), list(levels[0][0])
    for level, name in levels[1:]:
        out = out.select(*keys, *[F.col("_one").getField(k).alias(k) for k in level], F.explode(F.col("_one").getField(name)).alias("_one"))
        keys += level
    return out.select(*keys, "_one.*")


def pruned(nested: DataFrame, levels: list[Level], keep: Callable[[Column], Column]) -> DataFrame:
    """nested rows with the last level's entries that keep says, without keys that are left with none: a handler's part of a plan."""

    def cut(entries: Column, depth: int) -> Column:
        if depth == len(levels) - 1:
            return F.filter(entries, keep)
        name = levels[depth + 1][1]
        return F.filter(F.transform(entries, lambda e: e.withField(name, cut(e[name], depth + 1))), lambda e: F.size(e[name]) > 0)

    return nested.withColumn(levels[0][1], cut(F.col(levels[0][1]), 0)).filter(F.size(levels[0][1]) > 0)


def manifest(nested: DataFrame, seasons: str = "episodes", units: str = "units") -> DataFrame:
    """A run plan's rows (season_id, a list of episodes with a list of units) as a manifest: season_id, episode_count, unit_count and the episodes with counts and paths in place of units."""
    rest = [c for c in nested.columns if c != seasons]
    told = F.transform(seasons, lambda e: F.struct(e["episode_id"].alias("episode_id"), F.size(e[units]).alias("unit_count"), F.array_distinct(F.transform(e[units], lambda u: u["path"])).alias("paths")))
    return nested.select(*rest, F.size(seasons).alias("episode_count"), F.aggregate(seasons, F.lit(0), lambda n, e: n + F.size(e[units])).alias("unit_count"), told.alias(seasons))
