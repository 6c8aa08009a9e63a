"""A knowledge base of JSON files as a Spark data source: planned by season, pruned by filters, written with commit and abort.

The folder of a project holds source_manifest.json, extraction_runs/<run>/plan.json, seasons/<season>/ with its contents and
episodes/<episode>/ with theirs and chunks/<chunk>.json, and card folders. Each file is a row; its place says kind, project_id, season_id,
episode_id and item_id (a chunk, run or card). One partition is a season, a project's runs or cards: the driver lists no episodes.
Filters on these columns, pushed down or given as options of the same names, keep folders and files from being listed and read.

Writing puts each target beside its place under a name of the task; commit moves all of them there (an older file becomes the backup), and
abort, or a task that fails, leaves no target. An existing target is kept unless the option overwrite is true; the option log
names a folder for a row (target, status) of each. The driver moves the targets, so it holds their names: write what one run publishes, not a corpus.

Defined results: a file that is no JSON object, a null text included, is a row like any other, told apart by current(); null ids: the
file lies above that level; a row whose kind lacks an id it needs is refused.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

#: File names of each kind, by the ids that its place needs.
PLACES = {
    "source_manifest": "source_manifest.json",
    "run_plan": "extraction_runs/{item_id}/plan.json",
    "season_content": "seasons/{season_id}/season_content.json",
    "season_summary": "seasons/{season_id}/season_summary.json",
    "stage_states": "seasons/{season_id}/character_stage_states.json",
    "episode_content": "seasons/{season_id}/episodes/{episode_id}/episode_content.json",
    "preview_episode_content": "seasons/{season_id}/episodes/{episode_id}/preview__episode_content.json",
    "episode_summary": "seasons/{season_id}/episodes/{episode_id}/episode_summary.json",
    "episode_transcript": "seasons/{season_id}/episodes/{episode_id}/episode_transcript.json",
    "preview_chunk": "seasons/{season_id}/episodes/{episode_id}/chunks/preview__{item_id}.json",
    "chunk": "seasons/{season_id}/episodes/{episode_id}/chunks/{item_id}.json",
    "card": "character_cards/{item_id}/card.json",
    "preview_card": "preview_character_cards/{item_id}/card.json",
}
KEYS = ("kind", "project_id", "season_id", "episode_id", "item_id")
PATTERNS = {kind: re.compile(re.sub(r"\\{(\w+)\\}", r"(?P<\1>[^/]+)", re.escape(place)) + r"(?P<backup>\.bak)?") for kind, place in PLACES.items()}
_ROWS = pa.schema([*[(k, pa.string()) for k in KEYS], ("path", pa.string()), ("modified", pa.timestamp("us", tz="UTC")), ("backup", pa.bool_()), ("text", pa.string())])
#: Targets moved at once.
MOVERS = 16


def _files(root: str):
    """The file system of a path, local or of a store, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _listed(system, folder: str) -> list:
    from pyarrow import fs

    return sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda x: x.path)


@dataclass
class Part(InputPartition):
    project: str
    #: Below the project, and the season if it is one.
    folder: str
    season: str | None


class Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.wanted = {k: {options[k]} for k in KEYS if k in options}

    def _takes(self, **found: str | None) -> bool:
        return all(k not in self.wanted or v in self.wanted[k] for k, v in found.items())

    def partitions(self):
        system, root = _files(self.root)
        tops, out = {p.split("/")[0] for k, p in PLACES.items() if self._takes(kind=k)}, []
        below = any("{season_id}" in PLACES[k] for k in PLACES if self._takes(kind=k))
        for project in (x for x in _listed(system, root) if not x.is_file and self._takes(project_id=x.base_name)):
            if self._takes(season_id=None, episode_id=None):
                out += [Part(project.base_name, t, None) for t in sorted(tops - {"seasons"})]
            if below:
                out += [Part(project.base_name, f"seasons/{s.base_name}", s.base_name) for s in _listed(system, f"{project.path}/seasons") if not s.is_file and self._takes(season_id=s.base_name)]
        return out or [Part("", "", None)]

    def _walk(self, system, folder: str, place: str) -> Iterator[tuple]:
        """Files below a folder with their places; folders of unwanted episodes, runs and cards stay unread."""
        for x in _listed(system, folder):
            here = f"{place}/{x.base_name}"
            depth = here.split("/")
            if x.is_file:
                yield x, here
            elif not (depth[0] == "seasons" and len(depth) == 4 and not self._takes(episode_id=depth[3]) or depth[0] != "seasons" and len(depth) == 2 and not self._takes(item_id=depth[1])):
                yield from self._walk(system, x.path, here)

    def read(self, part):
        if not part.folder:
            return
        system, root = _files(self.root)
        top = f"{root}/{part.project}/{part.folder}"
        one = system.get_file_info([top, f"{top}.bak"]) if part.folder.endswith(".json") else []
        for x, place in [(x, x.path.removeprefix(f"{root}/{part.project}/")) for x in one if x.is_file] or self._walk(system, top, part.folder):
            for kind, pattern in PATTERNS.items():
                found = pattern.fullmatch(place)
                if not found:
                    continue
                ids = {"kind": kind, "project_id": part.project, "season_id": None, "episode_id": None, "item_id": None} | {k: v for k, v in found.groupdict().items() if k != "backup"}
                if self._takes(**ids):
                    with system.open_input_stream(x.path) as f:
                        raw = f.read()
                    try:
                        text = raw.decode("utf-8-sig")
                    except UnicodeDecodeError:
                        text = None
                    row = ids | {"path": f"{part.project}/{place}", "modified": x.mtime, "backup": bool(found["backup"]), "text": text}
                    # A batch a file: a task holds one at a time.
                    yield pa.RecordBatch.from_pylist([row], schema=_ROWS)
                break


class PushedReader(Reader):
    """A reader that takes filters; Spark refuses one while its setting for that is off."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in KEYS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted.get(name, values) & values


@dataclass
class Written(WriterCommitMessage):
    """(place, temporary name or None where the target is kept) of each row of a task."""

    targets: list


class Writer(DataSourceWriter):
    def __init__(self, options):
        self.root, self.overwrite, self.log = options["path"].rstrip("/"), options.get("overwrite", "false").lower() == "true", options.get("log")
        self.job = uuid.uuid4().hex

    def write(self, rows):
        from pyspark import TaskContext

        system, root = _files(self.root)
        done, made, mark = [], set(), f"{self.job}-{TaskContext.get().taskAttemptId()}"
        try:
            for row in rows:
                ids = {k: row[k] for k in KEYS if k in row.__fields__}
                place = PLACES[ids["kind"]].format(**{k: v for k, v in ids.items() if v})
                parts = [ids["project_id"], *place.split("/")]
                if any(p in (None, "", ".", "..") or "\\" in p for p in parts) or any(v and "/" in v for v in ids.values()):
                    raise ValueError(f"no safe place for {ids}")
                target = f"{root}/{'/'.join(parts)}"
                if system.get_file_info(target).is_file and not self.overwrite:
                    done.append((target, None))
                    continue
                folder, _, name = target.rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                done.append((target, f"{folder}/.{name}.{mark}"))
                with system.open_output_stream(done[-1][1]) as f:
                    f.write((row["text"] or "").encode())
        except BaseException:
            self._drop(system, done)
            raise
        return Written(done)

    @staticmethod
    def _drop(system, done: list) -> None:
        for _, name in done:
            if name and system.get_file_info(name).is_file:
                system.delete_file(name)

    def commit(self, messages):
        system, _ = _files(self.root)
        targets: dict[str, list] = {}
        for target, name in (x for m in messages if m for x in m.targets):
            targets.setdefault(target, []).append(name)

        def publish(target: str) -> list[dict]:
            for name in filter(None, targets[target]):
                if system.get_file_info(target).is_file:
                    system.move(target, f"{target}.bak")
                system.move(name, target)
            return [{"target": target, "status": "written" if name else "target_exists"} for name in targets[target]]

        # Targets are moved beside each other, what several rows write to one in turn.
        with ThreadPoolExecutor(MOVERS) as movers:
            told = [x for one in movers.map(publish, targets) for x in one]
        if self.log:
            system.create_dir(self.log, recursive=True)
            with system.open_output_stream(f"{self.log}/{self.job}.json") as f:
                f.write("".join(json.dumps(x) + "\n" for x in told).encode())

    def abort(self, messages):
        system, _ = _files(self.root)
        for m in messages:
            if m:
                self._drop(system, m.targets)


class KnowledgeBase(DataSource):
    @classmethod
    def name(cls):
        return "knowledge_base"

    def schema(self):
        return "kind string, project_id string, season_id string, episode_id string, item_id string, path string, modified timestamp, backup boolean, text string"

    def reader(self, schema):
        return (PushedReader if self.options.get("pushdown") == "true" else Reader)(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def store(spark: SparkSession, root: str, **wanted: str) -> DataFrame:
    """The files of a knowledge base. wanted: values of kind, project_id, season_id, episode_id or item_id; others aren't listed.

    Filters on the DataFrame are pushed down too where spark.sql.python.filterPushdown.enabled is set now.
    """
    spark.dataSource.register(KnowledgeBase)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("knowledge_base").options(pushdown=pushdown, **wanted).load(root)


def save(rows: DataFrame, root: str, overwrite: bool = False, log: str | None = None) -> None:
    """Write rows (kind, project_id, season_id, episode_id, item_id, text) to their places, all or none."""
    rows.sparkSession.dataSource.register(KnowledgeBase)
    names = [*KEYS, "text"]
    rows.select(*[F.col(c).cast("string").alias(c) for c in names]).write.format("knowledge_base").mode("append").options(overwrite=str(overwrite).lower(), **({"log": log} if log else {})).save(root)


def current(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid copy of each target (a JSON object; of several the newest, the file before its backup) and issues (path, backup_available).

    A target whose own file is corrupt is an issue, also where its backup stands in.
    """
    rows = files.withColumn("valid", F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("text")), F.lit("OBJECT")), F.lit(False))).withColumn("path", F.regexp_replace("path", "[.]bak$", ""))
    rest = [c for c in files.columns if c != "path"]
    rank = F.struct("modified", (~F.col("backup")).cast("int"))
    targets = rows.groupBy("path").agg(F.max_by(F.struct(*rest), F.when(F.col("valid"), rank)).alias("f"), F.bool_or("valid").alias("some"), F.bool_or(~F.col("backup") & ~F.col("valid")).alias("corrupt"), F.bool_or(F.col("backup") & F.col("valid")).alias("backup_available"))
    good = targets.filter("some").select("path", *[F.col("f").getField(c).alias(c) for c in rest])
    return good.select(*files.columns), targets.filter("corrupt").select("path", "backup_available")


def stage_characters(files: DataFrame) -> DataFrame:
    """Season files of states as season_id, character, stage_states, final_state (JSON texts); files of one character, the older form, are read alike."""
    j = F.try_parse_json("text")
    get = lambda p, kind: F.try_variant_get(j, p, kind)
    season = F.coalesce(get("$.season_id", "string"), F.col("season_id"))
    many = F.map_entries(get("$.characters", "map<string,variant>"))
    name = get("$.character", "string")
    old = F.array(F.struct(name.alias("key"), F.parse_json(F.to_json(F.struct(get("$.stage_states", "variant").alias("stage_states"), get("$.final_state", "variant").alias("final_state")))).alias("value")))
    some = F.when(many.isNotNull(), many).when(F.coalesce(name, F.lit("")) != "", old)
    part = lambda p, none: F.coalesce(F.to_json(F.try_variant_get("c.value", p, "variant")), F.lit(none))
    rows = files.filter("kind = 'stage_states'").select(season.alias("season_id"), F.explode(some).alias("c"))
    return rows.select("season_id", F.col("c.key").alias("character"), part("$.stage_states", "[]").alias("stage_states"), part("$.final_state", "{}").alias("final_state"))


def card_summaries(files: DataFrame) -> DataFrame:
    """Official cards of current files, newest first: card_id, display_name, tags, compile_status, cover_path, warnings, updated_at."""
    j = F.try_parse_json("text")
    text = lambda p: F.coalesce(F.try_variant_get(j, p, "string"), F.lit(""))
    many = lambda p: F.coalesce(F.try_variant_get(j, p, "array<string>"), F.array().cast("array<string>"))
    some = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs])
    cover = F.when(text("$.assets.cover_path") != "", F.concat_ws("/", F.regexp_replace("path", "/[^/]*$", ""), text("$.assets.cover_path"))).otherwise("")
    rows = files.filter("kind = 'card'").filter(F.coalesce(some(F.lower(text("$.card_kind"))), F.lit("official")) == "official")
    out = rows.select(
        F.col("item_id").alias("card_id"), F.coalesce(some(text("$.identity.display_name"), text("$.identity.character_name")), F.col("item_id")).alias("display_name"), many("$.user_metadata.tags").alias("tags"), text("$.compile_status").alias("compile_status"),
        cover.alias("cover_path"), F.concat(many("$.quality.warnings"), many("$.evidence.warnings")).alias("warnings"), F.try_to_timestamp(text("$.updated_at")).alias("updated_at"),
    )
    return out.orderBy(F.desc("updated_at"), "card_id")


#: Forms of a source's and a material's hash.
SOURCE_HASH, FINGERPRINT = r"^[0-9a-f]{64}$", r"^sha256:[0-9a-f]{64}$"


def reusable(manifests: DataFrame, sources: DataFrame, derived: DataFrame) -> DataFrame:
    """Each source (raw_path, hash) with the newest manifest that still holds: raw_path, manifest (null: to be made anew), reason.

    manifests: path, modified, text (JSON). derived: path, size, fingerprint of the files that are there. A manifest holds if its hash is the
    source's and all its derived files are there as it says.
    """
    j = F.try_parse_json("text")
    get = lambda p, kind="string": F.try_variant_get(j, p, kind)
    records = get("$.derived_materials", "array<struct<material_relative_path:string,size_bytes:bigint,fingerprint:string>>")
    raw = F.regexp_replace(F.translate(get("$.source_raw_path"), "\\", "/"), "^[.]?/+", "")
    rows = manifests.select(F.col("path").alias("manifest"), "modified", raw.alias("raw_path"), get("$.source_hash").alias("hash"), records.alias("records"))
    shaped = F.rlike("hash", F.lit(SOURCE_HASH)) & (F.coalesce(F.size("records"), F.lit(0)) > 0)
    rows = rows.withColumn("shaped", F.coalesce(shaped, F.lit(False)))
    each = rows.filter("shaped").select("manifest", F.explode("records").alias("r"))
    path = F.col("r.material_relative_path")
    safe = F.coalesce((path != "") & ~F.rlike(path, F.lit(r"^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")) & F.rlike("r.fingerprint", F.lit(FINGERPRINT)) & (F.col("r.size_bytes") >= 0), F.lit(False))
    there = derived.select("path", "size", "fingerprint").distinct().withColumn("there", F.lit(True))
    each = each.select("manifest", path.alias("path"), F.col("r.size_bytes").alias("size"), F.col("r.fingerprint").alias("fingerprint"), safe.alias("safe")).join(there, ["path", "size", "fingerprint"], "left")
    whole = each.groupBy("manifest").agg(F.bool_and(F.col("safe") & F.coalesce("there", F.lit(False))).alias("whole"))
    rows = sources.select("raw_path", F.col("hash").alias("now")).join(rows.join(whole, "manifest", "left"), "raw_path", "left")
    why = F.when(F.col("manifest").isNull(), "manifest_missing").when(~F.col("shaped"), "manifest_invalid").when(F.col("hash") != F.col("now"), "source_changed").when(~F.coalesce("whole", F.lit(False)), "derived_files_changed")
    rows = rows.withColumn("why", why)
    good = F.col("why").isNull() & F.col("manifest").isNotNull()
    best = rows.groupBy("raw_path").agg(F.max_by("manifest", F.when(good, F.struct("modified", "manifest"))).alias("manifest"), F.max_by("why", F.struct(F.coalesce("modified", F.lit(0).cast("timestamp")), F.coalesce("manifest", F.lit("")))).alias("why"), F.bool_or(good).alias("some"))
    return best.select("raw_path", F.when(F.col("some"), F.col("manifest")).alias("manifest"), F.when(F.col("some"), "reused").otherwise(F.col("why")).alias("reason"))


def field(path: str, kind: str = "string") -> Column:
    """A value of a file's JSON."""
    return F.try_variant_get(F.try_parse_json("text"), path, kind)
