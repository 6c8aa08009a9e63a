"""Relevance of earlier episodes for an episode, and the choice of views within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Weights in hundredths of recency, characters, threads, relations, places and importance; the bonus of the episode before.
WEIGHTS = {"recency": 25, "characters": 30, "threads": 20, "relations": 10, "places": 5, "importance": 10}
BONUS = 15


def relevance(scores: dict[str, Column], previous: Column) -> Column:
    """Weighted sum of scores from 0 to 1 and the bonus, within 0 and 1."""
    total = sum((F.coalesce(scores[k], F.lit(0.0)) * (w / 100) for k, w in WEIGHTS.items() if k in scores), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total + F.when(previous, BONUS / 100).otherwise(0.0)))


def importance(facts: Column, conflicts: Column, relations: Column, open_conflicts: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (facts + 2 * conflicts + 2 * relations + 2 * open_conflicts) / 20.0))


def greedy(candidates: DataFrame, by: str, order: tuple[Column, ...], costs: tuple[str, ...], budget: int) -> DataFrame:
    """Candidates (by, candidate, costs of views from full to brief) that fit the budget, best first, with view and used.

    A candidate takes its fullest view that still fits, and is passed over where none does. The fold runs over one
    sorted array per key: candidates are the episodes of a season, so arrays stay short.
    """
    entry = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("candidate"), F.array(*[F.col(c).cast("long") for c in costs]).alias("costs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<candidate:bigint,view:int,used:bigint>>").alias("chosen"))

    def step(acc: Column, x: Column) -> Column:
        fits = F.filter(F.transform(x["costs"], lambda c, i: F.struct(i.alias("view"), c.alias("cost"))), lambda v: acc["used"] + v["cost"] <= budget)
        best = F.get(fits, 0)
        used = acc["used"] + best["cost"]
        row = F.struct(x["candidate"].cast("long").alias("candidate"), best["view"].alias("view"), used.alias("used"))
        return F.when(best.isNull(), acc).otherwise(F.struct(used.alias("used"), F.concat(acc["chosen"], F.array(row)).alias("chosen")))

    folded = candidates.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("all")).select(by, F.aggregate("all", start, step)["chosen"].alias("chosen"))
    return folded.select(by, F.explode("chosen").alias("c")).select(by, "c.candidate", "c.view", "c.used")


#: Bounds of relevance for full and long views, sections of the long view, and the order of views.
STRONG, MEDIUM = 0.65, 0.35
SECTIONS = (("概览", "insight_summary"), ("主要人物", "behavior_traits"), ("关键事件", "facts"), ("关系变化", "relationship_interactions"), ("未解决冲突", "conflicts"), ("状态变化", "character_state_changes"))
VIEWS = ("full_context_view", "context_long", "context_brief")
_FULL = ("behavior_traits", "character_state_changes", "conflicts", "dialogue_style", "episode_id", "episode_outline", "evidence_refs", "facts", "relationship_interactions", "season_id", "targets", "uncertainties")


def views(contents: DataFrame) -> DataFrame:
    """contents of episodes with their three views, the tokens of each (costs), and the importance of the episode.

    The full view is JSON with keys in order; the long one has a line for each section that has something; the brief one is the insight,
    three facts and two conflicts. A section of main characters falls back to the targets.
    """
    lists = {f: T.trimmed(F.col(f)) if f in contents.columns else F.array().cast("array<string>") for f in _FULL if f not in ("episode_id", "season_id", "episode_outline")}
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", "$1")
    texts = {"episode_id": F.col("episode_id"), "season_id": F.col("season_id"), "episode_outline": T.strip("insight_summary")}
    value = lambda k: quoted(texts[k]) if k in texts else F.concat(F.lit("["), F.array_join(F.transform(lists[k], quoted), ", "), F.lit("]"))
    full = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), value(k)) for k in _FULL]), F.lit("}"))
    body = lambda f: T.strip("insight_summary") if f == "insight_summary" else F.array_join(F.when(F.size(lists[f]) > 0, lists[f]).otherwise(lists["targets"]) if f == "behavior_traits" else lists[f], "；")
    long = F.concat_ws("\n", *[F.when(body(f) != "", F.concat(F.lit(f"{title}："), body(f))) for title, f in SECTIONS])
    some = lambda x: F.when(x != "", x)
    brief = F.concat_ws(" | ", some(T.strip("insight_summary")), some(F.array_join(F.slice(lists["facts"], 1, 3), "；")), some(F.array_join(F.slice(lists["conflicts"], 1, 2), "；")))
    out = contents.withColumns({"full_context_view": full, "context_long": long, "context_brief": brief})
    costs = F.array(*[T.token_estimate(F.col(v)) for v in VIEWS])
    counts = [F.size(f) for f in ("facts", "conflicts", "relationship_interactions", "conflicts")]
    return out.withColumn("costs", costs).withColumn("importance", importance(*counts))


def overlap(left: Column, right: Column) -> Column:
    """Shared keys of two lists over those of the larger one; keys are texts without blanks and case."""
    keys = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.replace(F.replace(F.lower(T.strip(x)), F.lit("＿"), F.lit("_")), F.lit(" "), F.lit(""))), lambda x: x != ""))
    a, b = keys(left), keys(right)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def scored(candidates: DataFrame, signals: DataFrame, by: str) -> DataFrame:
    """candidates with relevance, by the lists of the target they are for.

    candidates: by, place (from 0 in order), n (of the target's candidates), important_characters, open_threads, relationship_edges, locations, organizations,
    importance, is_previous. signals: one row for each by, with s_characters, s_open_threads, s_relationship_edges, s_locations, s_organizations.
    """
    rows = candidates.join(signals, by)
    recency = 1.0 / (1.0 + F.greatest(F.col("n") - F.col("place"), F.lit(0)))
    pair = lambda a, b: overlap(F.col(a), F.col(f"s_{b}"))
    scores = {
        "recency": recency, "characters": pair("important_characters", "characters"), "threads": pair("open_threads", "open_threads"), "relations": pair("relationship_edges", "relationship_edges"),
        "places": F.greatest(pair("locations", "locations"), pair("organizations", "organizations")), "importance": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("importance", F.lit(0.0)))),
    }
    return rows.select(*candidates.columns, relevance(scores, F.coalesce("is_previous", F.lit(False))).alias("relevance"))


def selected(rows: DataFrame, by: str, budget: int = 128_000) -> DataFrame:
    """scored() rows, with costs, that fit the budget: by, episode_id, view, cost, relevance, reason, used.

    The episode before comes first, then by relevance and relevance per token of the brief view, then by place. A candidate begins with the
    view of its relevance and takes the next briefer one while it doesn't fit; it is passed over where none fits or the first costs nothing.
    The fold is over one target's candidates.
    """
    brief = F.greatest(F.col("costs")[2], F.lit(1))
    first = F.when(F.col("is_previous") | (F.col("relevance") >= STRONG), 0).when(F.col("relevance") >= MEDIUM, 1).otherwise(2)
    reason = F.when(F.col("is_previous"), "previous_episode_priority").when(F.col("relevance") >= STRONG, "strong_relevance").when(F.col("relevance") >= MEDIUM, "medium_relevance").otherwise("low_cost_background")
    entry = F.struct((~F.col("is_previous")).alias("o1"), (-(F.col("relevance") / brief + F.col("relevance"))).alias("o2"), "place", "episode_id", "costs", first.alias("first"), "relevance", reason.alias("reason"))
    row = "struct<episode_id:string,view:int,cost:bigint,relevance:double,reason:string,used:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{row}>").alias("chosen"))

    def step(acc: Column, x: Column) -> Column:
        fits = F.filter(F.transform(x["costs"], lambda c, i: F.struct(i.alias("view"), c.alias("cost"))), lambda v: (v["view"] >= x["first"]) & (acc["used"] + v["cost"] <= budget))
        best = F.get(fits, 0)
        used = acc["used"] + best["cost"]
        one = F.struct(x["episode_id"].alias("episode_id"), best["view"].alias("view"), best["cost"].alias("cost"), x["relevance"].alias("relevance"), x["reason"].alias("reason"), used.alias("used")).cast(row)
        return F.when(best.isNull() | (F.get(x["costs"], x["first"]) <= 0), acc).otherwise(F.struct(used.alias("used"), F.concat(acc["chosen"], F.array(one)).alias("chosen")))

    folded = rows.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("all")).select(by, F.explode(F.aggregate("all", start, step)["chosen"]).alias("c"))
    return folded.select(by, "c.*").withColumn("view", F.element_at(F.array(*map(F.lit, VIEWS)), F.col("view") + 1))


def payloads(chosen: DataFrame, viewed: DataFrame, by: str) -> DataFrame:
    """selected() rows with the text of the view that each has; viewed: episode_id and the three views."""
    rows = chosen.join(viewed.select("episode_id", *VIEWS), "episode_id")
    text = F.lit(None).cast("string")
    for v in VIEWS:
        text = F.when(F.col("view") == v, F.col(v)).otherwise(text)
    return rows.select(by, "episode_id", "view", "relevance", text.alias("context"))


#: Sections of a chunk's text.
CHUNK_SECTIONS = (("FACTS", "facts"), ("BEHAVIOR_TRAITS", "behavior_traits"), ("DIALOGUE_STYLE", "dialogue_style"), ("RELATIONSHIPS", "relationship_interactions"), ("CONFLICTS", "conflicts"), ("STATE_CHANGES", "character_state_changes"), ("EVIDENCE_REFS", "evidence_refs"))


def chunk_text(chunk_id: Column) -> Column:
    """A chunk with its insight and lists as text; empty where it has neither."""
    part = lambda label, f: F.when(F.size(T.trimmed(F.col(f))) > 0, F.concat(F.lit(f"[{label}]\n- "), F.array_join(T.trimmed(F.col(f)), "\n- ")))
    insight = F.when(T.strip("insight_summary") != "", F.concat(F.lit("[INSIGHT_SUMMARY]\n"), T.strip("insight_summary")))
    body = F.concat_ws("\n\n", insight, *[part(label, f) for label, f in CHUNK_SECTIONS])
    return F.when(body == "", "").otherwise(F.concat(F.lit("[CHUNK_ID] "), chunk_id, F.lit("\n\n"), body))
