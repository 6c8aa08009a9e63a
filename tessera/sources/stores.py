"""Stored records: manifests of preprocessing, project configurations, imported cards and samples of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def material_index(manifests: DataFrame, raw: DataFrame) -> DataFrame:
    """Preprocessed files by path with where they come from: of complete manifests whose raw file still has their hash; of two for a path the later one.

    manifests: manifest, pos, source_raw_path, source_hash, output_root, preprocessor, source_suffix, complete, derived (array of material_relative_path, source_entry_path,
    content_form_hint). raw: path, hash.
    """
    good = manifests.filter(F.col("complete") & F.rlike("source_hash", F.lit("^[0-9a-f]{64}$")) & (F.trim("source_raw_path") != "") & (F.trim("output_root") != ""))
    current = good.join(raw.select(F.col("path").alias("source_raw_path"), F.col("hash").alias("source_hash")), ["source_raw_path", "source_hash"], "left_semi")
    rows = current.select("pos", "source_raw_path", "source_hash", "output_root", "preprocessor", F.regexp_replace("source_suffix", r"^\.+", "").alias("container_format"), F.posexplode("derived").alias("at", "d"))
    path = F.col("d.material_relative_path")
    unsafe = F.rlike(path, F.lit(r"^/|^$|(^|/)\.\.?(/|$)"))
    kept = rows.filter(~unsafe & F.startswith(path, F.concat("output_root", F.lit("/"))))
    entry = F.struct(F.col("source_raw_path").alias("raw_path"), "preprocessor", F.col("d.source_entry_path").alias("entry"), "container_format", "source_hash", F.col("d.content_form_hint").alias("hint"))
    return kept.groupBy(path.alias("path")).agg(F.max_by(entry, F.struct("pos", "at")).alias("m")).select("path", "m.*")


def configs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Configurations (path, project_id, name, updated_at), newest first, and issues (path, issue), of files (path, text) of JSON."""
    j = F.try_parse_json("text")
    get = lambda k: F.trim(F.try_variant_get(j, f"$.{k}", "string"))
    rows = files.select("path", get("project_id").alias("project_id"), get("name").alias("name"), F.try_to_timestamp(get("updated_at")).alias("updated_at"), F.startswith(F.schema_of_variant(j), F.lit("OBJECT")).alias("object"))
    issue = F.when(~F.coalesce("object", F.lit(False)), "not_a_json_object").when(F.coalesce("project_id", F.lit("")) == "", "project_id_missing").when(F.col("updated_at").isNull(), "updated_at_invalid")
    rows = rows.withColumn("issue", issue)
    return rows.filter("issue is null").select("path", "project_id", "name", "updated_at").orderBy(F.desc("updated_at"), "path"), rows.filter("issue is not null").select("path", "issue")


def imported(cards: DataFrame, project: str, tag: str, taken: DataFrame) -> DataFrame:
    """Cards (path, text: JSON) as rows of a project: card_id (from the name, numbered where it is taken), imported_card_id, name, compile_status, error.

    A card without the format tag or a name field is an error. taken: card_id. PREVIEW becomes DRAFT.
    """
    j = F.try_parse_json("text")
    get = lambda k: F.coalesce(F.trim(F.try_variant_get(j, f"$.{k}", "string")), F.lit(""))
    some = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs])
    rows = cards.select("path", get("card_id").alias("imported_card_id"), F.coalesce(some(get("identity.character_name"), get("identity.display_name")), F.lit("Imported Character")).alias("name"), get("compile_status").alias("state"), F.when(j.isNull(), "card_unreadable").when(get("format") != tag, "card_format_unknown").alias("error"))
    key = F.lower(F.regexp_replace(F.regexp_replace("name", r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""))
    rows = rows.withColumn("stem", F.when(key == "", "card").otherwise(key))
    named = _numbered(rows.filter("error is null"), taken)
    status = F.when(F.col("state") == "PREVIEW", "DRAFT").otherwise(F.col("state"))
    out = named.select("path", F.lit(project).alias("project_id"), "card_id", "imported_card_id", "name", status.alias("compile_status"), "error")
    bad = rows.filter("error is not null").select("path", F.lit(project).alias("project_id"), F.lit(None).cast("string").alias("card_id"), "imported_card_id", "name", F.lit(None).cast("string").alias("compile_status"), "error")
    return out.unionByName(bad)


def _numbered(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """rows (path, stem, others) with card_id: the stem, or the stem and the first number from 2 that is free, in order of path.

    An id is free unless it is taken, or is itself the stem of a row, so no two rows meet whatever their stems are.
    """
    stems = rows.select("stem").distinct()
    used = taken.select("card_id").distinct()
    claimed = used.unionByName(stems.select(F.col("stem").alias("card_id"))).distinct()
    last = lambda i: F.regexp_extract("card_id", r"^(.+)-([1-9][0-9]{0,17})$", i)
    blocked = claimed.filter(last(2).try_cast("long") >= 2).select(last(1).alias("stem"), last(2).cast("long").alias("no"))
    blocked = blocked.unionByName(used.select(F.col("card_id").alias("stem"), F.lit(1).cast("long").alias("no"))).join(stems, "stem", "left_semi")
    # k - 1 free numbers lie below a card's, so it passes all blocked numbers with fewer free ones below them.
    by = Window.partitionBy("stem")
    gaps = blocked.withColumn("at", F.col("no") - F.row_number().over(by.orderBy("no"))).select("stem", "at", F.lit(1).alias("blocks"), F.lit(None).cast("string").alias("path"))
    cards = rows.withColumn("at", F.row_number().over(by.orderBy("path")).cast("long")).select("stem", "at", F.lit(0).alias("blocks"), "path")
    both = gaps.unionByName(cards).withColumn("no", F.col("at") + F.sum("blocks").over(by.orderBy("at", "blocks").rowsBetween(Window.unboundedPreceding, 0)))
    numbers = both.filter("blocks = 0").select("stem", "path", "no")
    return rows.join(numbers, ["stem", "path"]).withColumn("card_id", F.when(F.col("no") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", F.col("no").cast("string"))))


#: Lengths of a failure record's texts.
LIMITS = {"prompt_purpose": 120, "provider": 80, "model_name": 120, "error_type": 120, "error_summary": 500}


def failure_records(requests: DataFrame, salt: str) -> DataFrame:
    """Requests (project_id, source_path, metadata as a map, and the columns of LIMITS) as records without secrets, with sample_hash.

    The hash is of the salt and the record as JSON with keys in order.
    """
    texts = {c: T.clean(F.col(c), n) for c, n in LIMITS.items()}
    rows = requests.select("project_id", *[v.alias(c) for c, v in texts.items()], T.clean(T.display_path(F.col("source_path")), 300).alias("source_path"), F.map_from_entries(F.array_sort(F.map_entries(T.safe_metadata(F.col("metadata"))))).alias("metadata"))
    names = sorted(rows.columns)
    return rows.withColumn("sample_hash", record_hash(F.struct(*names), salt))


def record_hash(record: Column, salt: str) -> Column:
    """16 hex digits of the SHA-256 of salt:JSON; the record's fields must be in order of name."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.to_json(record, {"ignoreNullFields": "false"})), 256), 1, 16)
