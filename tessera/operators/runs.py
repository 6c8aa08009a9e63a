"""Runs over a project: counts, warnings, transcripts of materials, earlier seasons, states of sources and samples of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.joins import overlapping


def counts(events: DataFrame, level: str, status: str, names: tuple[str, ...]) -> DataFrame:
    """Rows of each level by status, as columns; statuses that aren't named count in total only."""
    return events.groupBy(level).agg(F.count("*").alias("total"), *[F.sum((F.col(status) == n).cast("long")).alias(n) for n in names])


def warnings(rows: DataFrame, by: str, place: str, listed: str) -> DataFrame:
    """Per key: distinct warnings of its lists in the order that they first appear."""
    each = rows.select(by, F.col(place).alias("place"), F.posexplode(T.trimmed(F.col(listed))).alias("pos", "warning"))
    first = each.groupBy(by, "warning").agg(F.min(F.struct("place", "pos")).alias("at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "warning"))), lambda x: x["warning"]).alias("warnings"))


def material_transcripts(materials: DataFrame, ranges: DataFrame, segments: DataFrame, plain: DataFrame, most: int = 4000, bucket: float = 60.0) -> DataFrame:
    """What is said in each material (episode, material): the segments of its first range, by time, else the episode's plain text if it is one of its materials.

    ranges: episode, pos, path, start, end. segments: episode, segment, start, end (0: open), text. plain: episode, path, text. Paths are equal without case; texts
    longer than most characters end in three dots.
    """
    low = lambda c: F.lower(F.col(c))
    first = ranges.groupBy("episode", low("path").alias("key")).agg(F.min_by(F.struct("start", "end"), "pos").alias("r"))
    wanted = materials.select("episode", "material", low("material").alias("key")).join(first, ["episode", "key"], "left")
    spans = overlapping(wanted.filter("r is not null").select("episode", F.col("material").alias("range_id"), F.col("r.start").alias("lo"), F.col("r.end").alias("hi")), segments.select("episode", F.col("segment").alias("span_id"), "start", "end"), "episode", bucket)
    line = F.concat(F.lit("["), T.clock_minutes(F.col("start")), F.lit("-"), T.clock_minutes(F.col("end")), F.lit("] "), T.strip("text"))
    lines = segments.filter(T.strip("text") != "").select("episode", F.col("segment").alias("span_id"), line.alias("line"))
    told = spans.select("episode", F.col("range_id").alias("material"), "span_id").join(lines, ["episode", "span_id"])
    told = told.groupBy("episode", "material").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_id", "line"))), lambda x: x["line"]), "\n").alias("told"))
    whole = plain.select("episode", low("path").alias("key"), F.col("text").alias("whole")).dropDuplicates(["episode", "key"])
    out = wanted.join(told, ["episode", "material"], "left").join(whole, ["episode", "key"], "left")
    text = F.when(F.col("r").isNotNull(), F.coalesce("told", F.lit(""))).otherwise(F.coalesce("whole", F.lit("")))
    cut = F.concat(F.rtrim(F.substring(text, 1, max(most - 3, 0))), F.lit("..."))
    return out.select("episode", "material", F.when(F.length(text) <= most, text).otherwise(cut).alias("text"))


def earlier_seasons(seasons: DataFrame, project: str, place: str, season: str, background: str) -> DataFrame:
    """Each season of a project with the backgrounds of all before it in order, those that are there; a project's seasons are few."""
    before = Window.partitionBy(project).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    found = F.collect_list(F.when(T.strip(background) != "", F.struct(F.col(season).alias("season"), F.col(background).alias("background")))).over(before)
    return seasons.select(project, season, found.alias("earlier"))


def state_for(states: DataFrame, season: str, place: str, name: str, terms: list[str]) -> DataFrame:
    """Per season the first state (a row of states) whose name holds one of the terms, or is held by one, in any case."""
    low = F.lower(T.strip(name))
    fits = F.exists(F.array(*[F.lit(t.strip().lower()) for t in terms if len(t.strip()) >= 2]), lambda t: F.contains(low, t) | F.contains(t, low)) if any(len(t.strip()) >= 2 for t in terms) else F.lit(False)
    rest = [c for c in states.columns if c != season]
    return states.filter(fits & (low != "")).groupBy(season).agg(F.min_by(F.struct(*rest), place).alias("_state")).select(season, *[F.col("_state").getField(c).alias(c) for c in rest])


def source_states(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """new, stale, processed or raw_cleaned of each source by its files in the project.

    sources: source. targets: source, raw_exists, cleaned, processed, has_material (of a cleaned file), newer (the source's file is newer than its copy).
    """
    sums = targets.groupBy("source").agg(
        F.count("*").alias("n"), F.bool_and("cleaned").alias("cleaned"), F.bool_and("has_material").alias("kept"), F.sum(F.col("raw_exists").cast("long")).alias("raw"),
        F.bool_or(F.col("raw_exists") & F.col("newer")).alias("newer"), F.bool_and(~F.col("raw_exists") | F.col("processed")).alias("done"),
    )
    state = F.when(F.col("n").isNull(), "new").when(F.col("cleaned") & F.col("kept"), "raw_cleaned").when(F.col("raw") == 0, "new").when(F.col("raw") < F.col("n"), "stale").when(F.col("newer"), "stale").when(F.col("done"), "processed").otherwise("stale")
    return sources.join(sums, "source", "left").select("source", state.alias("status"))


def copy_policy(inside: Column, absolute: Column, exists: Column, size: Column, most: int) -> Column:
    """How a sample treats a source file: copy_allowed, index_only_large, missing, outside_project or unsafe_path."""
    return F.when(~inside, F.when(absolute, "outside_project").otherwise("unsafe_path")).when(~exists, "missing").when(size <= most, "copy_allowed").otherwise("index_only_large")


def packaged(refs: DataFrame, include: bool, most: int) -> DataFrame:
    """Per sample: labels copied, indexed and missing in order, and warnings.

    refs: sample, pos, label, policy, exists, size.
    """
    p, label = F.col("policy"), F.col("label")
    barred = ~p.isin("copy_allowed", "index_only_large", "missing")
    large = F.lit(include) & F.col("exists") & (F.col("size") > most)
    kind = F.when(p == "missing", "missing").when(barred, "indexed").when(F.lit(not include), "indexed").when(~F.col("exists"), "missing").when(large, "indexed").otherwise("copied")
    told = F.when(barred, F.concat(F.lit("material not copied due to "), p, F.lit(": "), label)).when((kind == "indexed") & large, F.concat(F.lit("material exceeds copy limit and was indexed only: "), label))
    name = F.when(kind == "copied", F.concat(F.lit("materials/"), T.archive_name(T.material_label(label)))).otherwise(label)
    rows = refs.select("sample", "pos", kind.alias("kind"), name.alias("name"), told.alias("told"))
    pick = lambda c, on: F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("pos", F.col(c).alias("v"))))), lambda x: x["v"])
    return rows.groupBy("sample").agg(*[pick("name", F.col("kind") == k).alias(k) for k in ("copied", "indexed", "missing")], pick("told", F.col("told").isNotNull()).alias("warnings"))


def traces(refs: DataFrame, by: str) -> DataFrame:
    """Lineage per key: distinct materials, units and derived artifacts, materials by medium, and the kind of source.

    refs: by, pos, kind (material, unit, derived), id, path, media_type. A material is one by its id, else its path. One medium is the kind of source, several are
    mixed, none is unknown.
    """
    key = F.when(F.col("kind") == "material", F.coalesce(F.when(T.strip("id") != "", T.strip("id")), F.col("path"))).otherwise(T.strip("id"))
    distinct = refs.withColumn("key", key).filter("key <> ''").groupBy(by, "kind", "key").agg(F.min("pos").alias("pos"), F.min_by(F.coalesce("media_type", F.lit("")), "pos").alias("media_type"))
    of = lambda k: F.sum((F.col("kind") == k).cast("long"))
    in_order = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "key")))), lambda x: x["key"])
    sums = distinct.groupBy(by).agg(of("material").alias("materials"), of("unit").alias("units"), of("derived").alias("derived"), in_order("unit").alias("unit_refs"))
    media = distinct.filter((F.col("kind") == "material") & (T.strip("media_type") != "")).groupBy(by, "media_type").agg(F.count("*").alias("n"))
    told = media.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("media_type", "n")))).alias("media_counts"))
    out = sums.join(told, by, "left").withColumn("media_counts", F.coalesce("media_counts", F.create_map().cast("map<string,bigint>")))
    names = F.map_keys("media_counts")
    return out.withColumn("source_kind", F.when(F.size(names) == 1, F.get(names, F.lit(0))).when(F.size(names) > 1, "mixed").otherwise("unknown"))


def unit_events(units: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    """One event a unit: completed, no_result, failed (with the first failure), unsupported or skipped; a failing unit touches no other.

    units: unit_id, handler (null: unsupported), skipped. results: unit_id, chunks. failures: unit_id, pos, error.
    """
    done = results.groupBy("unit_id").agg(F.sum("chunks").alias("chunks"))
    failed = failures.groupBy("unit_id").agg(F.min_by("error", "pos").alias("error"), F.count("*").alias("failures"))
    rows = units.join(done, "unit_id", "left").join(failed, "unit_id", "left")
    event = F.when(F.col("handler").isNull(), "unsupported").when(F.coalesce("skipped", F.lit(False)), "skipped").when(F.col("chunks") > 0, "completed").when(F.col("error").isNotNull(), "failed").otherwise("no_result")
    return rows.select("unit_id", event.alias("event"), F.when(event == "failed", F.col("error")).alias("error"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


def earlier_chunks(chunks: DataFrame, by: list[str], order: str, insight: str, last: int = 3) -> DataFrame:
    """chunks with how many of their episode come before, and the last few insights of those; an episode's chunks are few."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    said = F.collect_list(F.when(T.strip(insight) != "", T.strip(insight))).over(before)
    return chunks.select(*by, order, F.count("*").over(before).alias("earlier"), F.reverse(F.slice(F.reverse(said), 1, last)).alias("insights"))


def merge_inputs(manifest: DataFrame, contents: DataFrame, summaries: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Episodes with contents and summary of one run, and the expected ones that lack either."""
    both = contents.join(summaries.withColumnRenamed("run", "summary_run"), keys).filter(F.col("run") == F.col("summary_run")).drop("summary_run")
    return both, manifest.select(*keys).distinct().join(both.select(*keys), keys, "left_anti")
