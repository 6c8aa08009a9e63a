"""Evidence of chunks rolled up to episodes and seasons, the state of a character over them, layers and conflicts.

Chunks and episodes have the list columns FIELDS. Lists are taken apart into items (field, item), distinct items are first
partial minima of their place, and only what is distinct is put together again: a hot episode costs one row for each distinct
item in a task. Lists of one episode or season are its own result, so they are collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.order import placed, prefixes, running, written

#: The list columns of a chunk, those that show a character directly or by mention, and those that count for a state.
FIELDS = ("targets", "facts", "behavior_traits", "dialogue_style", "relationship_interactions", "conflicts", "character_state_changes", "evidence_refs")
DIRECT = ("facts", "behavior_traits", "dialogue_style", "character_state_changes")
MENTION = ("relationship_interactions", "relationships", "conflicts", "uncertainties")
STATE = ("facts", "behavior_traits", "dialogue_style", "relationship_interactions", "character_state_changes", "conflicts")
SUMMARY = ("behavior_traits", "dialogue_style", "relationship_interactions", "character_state_changes")
#: Words of causes, of what is unresolved, and of explanations of conflicts.
CAUSAL = ("动机", "原因", "背景", "误解", "约束", "任务", "冲突", "影响", "cause", "motive", "reason", "background", "misunderstanding", "constraint", "conflict")
UNRESOLVED = ("冲突", "矛盾", "不一致", "误解", "未确认", "复核", "uncertain", "conflict")
EXPLANATIONS = {
    "misunderstanding": ("误解", "misunderstanding"),
    "relationship_shift": ("关系", "转折", "relationship"),
    "growth_or_change": ("成长", "变化", "黑化", "change"),
    "knowledge_inconsistency": ("矛盾", "不一致", "conflict", "inconsistent"),
}
EPISODE = ("season_id", "episode_id")
_LIST = "array<string>"


def stage(name: Column) -> Column:
    """full or preview, white space and case aside; anything else is legacy_unknown."""
    s = F.lower(T.strip(name))
    return F.when(s.isin("full", "preview"), s).otherwise("legacy_unknown")


def of_run(run: Column, expected: str) -> Column:
    """Whether a run id is the expected one; a blank one expects nothing."""
    return F.lit(True) if not expected.strip() else F.coalesce(T.strip(run) == expected.strip(), F.lit(False))


def _items(rows: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...], place: Column) -> DataFrame:
    sets = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.array().cast(_LIST)).alias("list")) for f in fields])
    each = rows.select(*keys, place.alias("place"), F.explode(sets).alias("s")).select(*keys, "place", "s.field", F.posexplode("s.list").alias("pos", "item"))
    return each.groupBy(*keys, "field", "item").agg(F.min(F.struct("place", "pos")).alias("at"))


def _lists(items: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    in_order = lambda f: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("at", "item")))), lambda x: x["item"])
    return items.groupBy(*keys).agg(*[in_order(f).alias(f) for f in fields])


def _filled(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return rows.select(*[F.coalesce(F.col(c), F.array().cast(_LIST)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def episode_contents(chunks: DataFrame, run: str = "", wanted: str = "full") -> DataFrame:
    """Per episode: FIELDS (distinct, in order of file name and place), insight_summary, aggregation_warnings, and counts of files.

    chunks: season_id, episode_id, file_name, readable, valid, extraction_stage, extraction_run_id, insight_summary, FIELDS. Files that can't be
    read, are of another run or invalid leave a warning; those of another stage are skipped without. wanted="preview": previews only.
    """
    name = F.lower("file_name")
    right = stage(F.col("extraction_stage")) == wanted
    told = F.when(~F.coalesce("readable", F.lit(True)), "chunk_read_failed:").when(~right, None).when(~of_run(F.col("extraction_run_id"), run), "chunk_run_mismatch:").when(~F.coalesce("valid", F.lit(True)), "chunk_validation_failed:")
    rows = chunks.withColumn("told", told).withColumn("used", F.coalesce("readable", F.lit(True)) & right & F.col("told").isNull())
    counts = rows.groupBy(*EPISODE).agg(
        F.count("*").alias("total_chunk_files"),
        F.sum(F.col("used").cast("long")).alias("full_chunks"),
        F.sum((~F.col("used")).cast("long")).alias("skipped_chunks"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("told").isNotNull(), F.struct(name.alias("n"), F.concat("told", "file_name").alias("w"))))), lambda x: x["w"]).alias("warned"),
    )
    used = rows.filter("used")
    lists = _lists(_items(used, EPISODE, FIELDS, name), EPISODE, FIELDS)
    said = used.filter(T.strip("insight_summary") != "").select(*EPISODE, name.alias("place"), T.strip("insight_summary").alias("item")).groupBy(*EPISODE, "item").agg(F.min("place").alias("place"))
    said = said.groupBy(*EPISODE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]), " | ").alias("insight_summary"))
    none = F.when(F.col("full_chunks") == 0, F.array(F.concat_ws("", F.lit("no_full_chunks:"), F.concat_ws("/", *EPISODE)))).otherwise(F.array().cast(_LIST))
    out = counts.join(lists, list(EPISODE), "left").join(said, list(EPISODE), "left")
    out = out.withColumn("aggregation_warnings", F.array_distinct(F.concat("warned", none))).drop("warned")
    return _filled(out, FIELDS).withColumn("insight_summary", F.coalesce("insight_summary", F.lit("")))


def episode_summaries(contents: DataFrame) -> DataFrame:
    """The summary of each episode: its lists under the names of a summary."""
    names = {"behavior_traits": "character_summaries", "relationship_interactions": "relationship_changes", "facts": "major_events", "conflicts": "open_conflicts", "character_state_changes": "growth_signals"}
    return contents.select(*EPISODE, *[F.col(a).alias(b) for a, b in names.items()], "insight_summary", "aggregation_warnings")


def season_contents(manifest: DataFrame, contents: DataFrame, run: str = "") -> DataFrame:
    """Per season of the manifest (season_id, episode_id): FIELDS over its episodes in order of name without case, warnings and counts.

    contents: as of episode_contents, with extraction_stage and extraction_run_id (null: full, of this run) and readable. Episodes without
    contents, unreadable ones and those not full or of another run leave a warning.
    """
    name = F.lower("episode_id")
    rows = manifest.select(*EPISODE).distinct().join(contents.withColumn("found", F.lit(True)), list(EPISODE), "left")
    right = (stage(F.coalesce("extraction_stage", F.lit("full"))) == "full") & (F.col("extraction_run_id").isNull() | of_run(F.col("extraction_run_id"), run))
    told = F.when(F.col("found").isNull(), "episode_content_missing:").when(~F.coalesce("readable", F.lit(True)), "episode_content_read_failed:").when(~right, "episode_content_not_full:")
    rows = rows.withColumn("told", told)
    # An episode's own warnings follow the warning about it.
    warned = F.concat(F.when(F.col("told").isNotNull(), F.array(F.concat("told", "episode_id"))).otherwise(F.array().cast(_LIST)), F.when(F.col("told").isNull(), F.coalesce("aggregation_warnings", F.array().cast(_LIST))).otherwise(F.array().cast(_LIST)))
    counts = rows.groupBy("season_id").agg(
        F.count("*").alias("total_episodes"),
        F.sum(F.col("told").isNull().cast("long")).alias("full_episodes"),
        F.sum(F.col("told").isNotNull().cast("long")).alias("skipped_episodes"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(name.alias("n"), "episode_id", warned.alias("w")))), lambda x: x["w"])).alias("warned"),
    )
    lists = _lists(_items(rows.filter("told is null"), ("season_id",), FIELDS, F.struct(name.alias("n"), F.col("episode_id"))), ("season_id",), FIELDS)
    none = F.when(F.col("full_episodes") == 0, F.array(F.concat(F.lit("no_full_episode_contents:"), "season_id"))).otherwise(F.array().cast(_LIST))
    out = counts.join(lists, "season_id", "left").withColumn("aggregation_warnings", F.array_distinct(F.concat("warned", none))).drop("warned")
    return _filled(out, FIELDS)


def season_summaries(contents: DataFrame, seasons: DataFrame) -> DataFrame:
    """Per season: background (each episode with facts and all of them) and its conflicts as unresolved threads."""
    lines = contents.filter(F.size("facts") > 0).select("season_id", F.lower("episode_id").alias("n"), F.concat("episode_id", F.lit(": "), F.array_join("facts", "; ")).alias("line"))
    told = lines.groupBy("season_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " | ").alias("background"))
    return seasons.select("season_id", F.col("conflicts").alias("unresolved_threads")).join(told, "season_id", "left").fillna({"background": ""})


def run_totals(contents: DataFrame) -> DataFrame:
    """Counts over a run: episodes with and without chunks of their own, and seasons with at least one that has."""
    ok = F.col("full_chunks") > 0
    return contents.agg(F.sum(ok.cast("long")).alias("episodes"), F.sum((~ok).cast("long")).alias("failed_episodes"), F.countDistinct(F.when(ok, F.col("season_id"))).alias("seasons"))


def match_terms(name: str, aliases: list[str]) -> list[str]:
    """A name and its aliases, trimmed, first ones of those equal without case."""
    out: dict[str, str] = {}
    for x in (name, *aliases):
        if x and x.strip():
            out.setdefault(x.strip().casefold(), x.strip())
    return list(out.values())


def related(items: Column, terms: list[str], all_without: bool = False) -> Column:
    """An array's trimmed texts that hold one of the terms; without a usable term none, or all."""
    if all_without and not any(len(t.strip()) >= 2 for t in terms):
        return T.trimmed(items)
    return F.filter(T.trimmed(items), lambda x: T.has_term(x, terms))


def timeline(contents: DataFrame, terms: list[str]) -> DataFrame:
    """What each episode adds to a character's state: bucket, place, season_id, episode_id, parts, evidence_count, new_conflicts, n_conflicts.

    An episode with an item of evidence that holds a term is a row; the counts run over all rows up to it. parts is its line
    of the summary (none if only conflicts name the character), new_conflicts those that no earlier row has.
    """
    c = contents.select(*EPISODE, *[related(F.col(f), terms).alias(f) for f in STATE])
    c = c.withColumn("n", sum((F.size(f) for f in STATE), F.lit(0))).filter("n > 0")
    shown = F.concat(*SUMMARY)
    line = F.array_join(F.when(F.size(shown) > 0, shown).otherwise(F.col("facts")), "; ")
    return timed(c.select(*EPISODE, F.when(line != "", F.array(line)).otherwise(F.array().cast(_LIST)).alias("parts"), "n", "conflicts"))


def timed(rows: DataFrame) -> DataFrame:
    """The timeline of rows (season_id, episode_id, parts, n, conflicts), one an episode, in the order of seasons and episodes."""
    rows = placed(rows, [F.lower("season_id"), F.lower("episode_id"), *map(F.col, EPISODE)], {"evidence_count": F.col("n")}, "states")
    first = F.struct("place", "pos", "bucket", *EPISODE)
    new = rows.select("place", "bucket", *EPISODE, F.posexplode("conflicts").alias("pos", "value")).groupBy("value").agg(F.min(first).alias("f"))
    new = new.groupBy("f.place").agg(F.transform(F.array_sort(F.collect_list(F.struct("f.pos", "value"))), lambda x: x["value"]).alias("new_conflicts"))
    rows = rows.drop("conflicts", "n").join(new, "place", "left").withColumn("new_conflicts", F.coalesce("new_conflicts", F.array().cast(_LIST)))
    rows = written(rows, "timeline")
    # The buckets are the same, so their running sums need no second range shuffle.
    return running(rows, "place", {"n_conflicts": F.size("new_conflicts")})


def assembled(rows: DataFrame, asked: DataFrame, joiner: str = "; ") -> DataFrame:
    """The whole states (season_id, episode_id, summary, evidence_count, conflicts) at the asked rows of a timeline.

    A state's text grows with its place, so ask for those that are needed; the timeline itself has what each one adds.
    """
    items = lambda c: rows.select("bucket", "place", F.posexplode(c).alias("pos", "value"))
    asked = asked.select("bucket", "place", *EPISODE, "evidence_count")
    out = asked.join(prefixes(items("parts"), asked, "parts"), "place", "left").join(prefixes(items("new_conflicts"), asked, "conflicts"), "place", "left")
    return out.select(*EPISODE, F.coalesce(F.array_join("parts", joiner), F.lit("")).alias("summary"), "evidence_count", F.coalesce("conflicts", F.array().cast(_LIST)).alias("conflicts"))


def _chained(joiners: tuple[bytes, bytes]):
    """SHA-256 of what two list columns hold up to each row: a running hash of each, read out at every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, begun = [hashlib.sha256(), hashlib.sha256()], [False, False]
        for batch in batches:
            out = [[], []]
            for i, c in enumerate(("parts", "new_conflicts")):
                for items in batch.column(c):
                    for item in items.as_py():
                        if begun[i]:
                            hashes[i].update(joiners[i])
                        hashes[i].update(item.encode())
                        begun[i] = True
                    out[i].append(hashes[i].hexdigest())
            kept = [batch.column(c) for c in (*EPISODE, "place", "evidence_count", "n_conflicts")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, out)], names=[*EPISODE, "place", "evidence_count", "n_conflicts", "summary", "conflicts"])

    return run


def digests(rows: DataFrame, joiner: str = "; ", between: str = " | ") -> DataFrame:
    """The whole states of a timeline as SHA-256 of their texts: season_id, episode_id, place, evidence_count, n_conflicts, summary, conflicts.

    No state's text is built: what each row adds is hashed once, in order, so work and disk grow with the timeline. A SHA-256 is a chain over
    all bytes before it, so one task follows it, a batch at a time.
    """
    ordered = rows.select(*EPISODE, "place", "evidence_count", "n_conflicts", "parts", "new_conflicts").repartition(1).sortWithinPartitions("place")
    return ordered.mapInArrow(_chained((joiner.encode(), between.encode())), "season_id string, episode_id string, place long, evidence_count long, n_conflicts long, summary string, conflicts string")


def states(contents: DataFrame, terms: list[str]) -> DataFrame:
    """The whole state of a character after each episode that adds evidence: summary, evidence_count, conflicts (distinct so far)."""
    rows = timeline(contents, terms)
    return assembled(rows, rows)


def last_state(rows: DataFrame) -> DataFrame:
    """The final state of a timeline, of which only the last row is put together; no row without a state."""
    return final_state(assembled(rows, rows.join(rows.agg(F.max("place").alias("place")), "place")))


def season_states(rows: DataFrame) -> DataFrame:
    """Per season of a timeline: the number of states and the last one."""
    seasons = rows.groupBy("season_id").agg(F.count("*").alias("n_states"), F.max("place").alias("place"))
    return seasons.select("season_id", "n_states").join(assembled(rows, rows.join(seasons.select("place"), "place")), "season_id").select("season_id", "n_states", "episode_id", "summary", "evidence_count", "conflicts")


def season_digests(rows: DataFrame) -> DataFrame:
    """Per season of a timeline: the number of states and the last one, as of digests."""
    last = F.max_by(F.struct("episode_id", "evidence_count", "summary", "conflicts"), "place")
    return digests(rows).groupBy("season_id").agg(F.count("*").alias("n_states"), last.alias("s")).select("season_id", "n_states", "s.*")


def final_state(states_: DataFrame) -> DataFrame:
    """The last of whole states: parts of the summary trimmed and distinct, distinct conflicts; no row without a state."""
    order = F.struct(F.lower("season_id"), F.lower("episode_id"), *EPISODE)
    last = states_.agg(F.max_by(F.struct("summary", "evidence_count", "conflicts"), order).alias("s")).filter("s is not null").select("s.*")
    parts = F.array_distinct(T.trimmed(F.split("summary", ";")))
    return last.select(F.array_join(parts, "; ").alias("summary"), F.greatest(F.lit(0), F.col("evidence_count")).alias("evidence_count"), F.array_distinct(T.trimmed(F.col("conflicts"))).alias("conflicts"))


def stage_states(states_: DataFrame) -> DataFrame:
    """Per season: the number of whole states and the last one."""
    order = F.struct(F.lower("episode_id"), F.col("episode_id"))
    return states_.groupBy("season_id").agg(F.count("*").alias("n_states"), F.max_by(F.struct("episode_id", "summary", "evidence_count", "conflicts"), order).alias("s")).select("season_id", "n_states", "s.*")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))


def layers(contents: DataFrame, terms: list[str]) -> DataFrame:
    """Episodes with evidence of a character, each once: direct, else causal or mention, with fields, terms, summary, refs and warnings.

    Direct fields decide first; else mentions, with the targets that name the character, are causal if one holds a word of causes.
    """
    named = F.filter(T.trimmed(F.col("targets")), lambda x: T.has_term(x, terms))
    entry = lambda f, items: F.struct(F.lit(f).alias("field"), items.alias("items"))
    some = lambda entries: F.filter(F.array(*entries), lambda e: F.size(e["items"]) > 0)
    c = contents.withColumn("direct", some([entry(f, related(F.col(f), terms, True)) for f in DIRECT]))
    c = c.withColumn("mention", some([*[entry(f, related(F.col(f), terms, True)) for f in MENTION if f in contents.columns], entry("targets", named)]))
    c = c.withColumn("by_field", F.when(F.size("direct") > 0, F.col("direct")).otherwise(F.col("mention"))).filter(F.size("by_field") > 0)
    items = F.flatten(F.transform("by_field", lambda e: e["items"]))
    layer = F.when(F.size("direct") > 0, "direct").when(_any(F.array_join(items, " "), CAUSAL), "causal").otherwise("mention")
    held = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: (F.length(t) >= 2) & F.exists(items, lambda x: F.contains(F.lower(x), F.lower(t))))
    summary = T.clip(F.array_join(T.capped(items, 6), "; "), 900)
    return c.select(*EPISODE, layer.alias("layer"), F.transform("by_field", lambda e: e["field"]).alias("source_fields"), held.alias("match_terms"), summary.alias("evidence_summary"), T.capped(F.col("evidence_refs"), 20).alias("refs"), F.col("aggregation_warnings").alias("warnings"))


def conflict_groups(contents: DataFrame, terms: list[str], most: int = 20) -> DataFrame:
    """The first most conflicts of a character, distinct without case, with their episode, severity, explanations and whether they need review."""
    rows = contents.select(*EPISODE, F.posexplode(related(F.col("conflicts"), terms, True)).alias("pos", "item")).withColumn("description", T.clip(F.col("item"), 500)).filter("description <> ''")
    first = F.struct(F.lower("season_id").alias("s"), F.lower("episode_id").alias("e"), "season_id", "episode_id", "pos", "description")
    groups = rows.groupBy(F.lower("description").alias("key")).agg(F.min(first).alias("f")).orderBy("f").limit(most).select("f.*")
    severity = F.when(_any(F.col("description"), UNRESOLVED), "review").otherwise("info")
    found = F.filter(F.array(*[F.when(_any(F.col("description"), words), F.lit(label)) for label, words in EXPLANATIONS.items()]), lambda x: x.isNotNull())
    labels = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("needs_human_review")))
    return groups.select("description", F.concat_ws("/", "season_id", "episode_id").alias("source_episode"), severity.alias("severity"), labels.alias("candidate_explanations"), (severity != "info").alias("needs_review"))


def review_reasons(layers_: DataFrame, groups: DataFrame, alias_source: str = "", alias_confidence: str = "", repaired: bool = False) -> DataFrame:
    """Why a card needs review, in fixed order: one row a reason."""
    found = layers_.agg(F.coalesce(F.bool_or(F.col("layer") == "direct"), F.lit(False)).alias("direct"), F.coalesce(F.bool_or(F.size("warnings") > 0), F.lit(False)).alias("warned"))
    checked = groups.agg(F.coalesce(F.bool_or("needs_review"), F.lit(False)).alias("conflict"))
    low = F.lit(alias_source == "ai" and alias_confidence in ("low", "none"))
    tests = [(~F.col("direct"), "no_direct_evidence"), (low, "alias_resolution_low_confidence"), (F.col("warned"), "knowledge_base_has_warnings"), (F.col("conflict"), "conflict_requires_review"), (F.lit(repaired), "ai_json_repaired")]
    rows = F.filter(F.array(*[F.when(t, F.struct(F.lit(i).alias("at"), F.lit(r).alias("reason"))) for i, (t, r) in enumerate(tests)]), lambda x: x.isNotNull())
    # Both sides are one row.
    return found.join(checked, F.lit(True)).select(F.explode(rows).alias("r")).select("r.at", "r.reason")
