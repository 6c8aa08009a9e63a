"""Cards of characters as rows: summaries, search, names, warnings, dialogues and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evidence as E
from tessera.operators.order import dense_rank, listed, placed

#: Ranks of a version's stage.
STAGES = {"alpha": 0, "beta": 1, "rc": 2, "release": 3}


def summary(cards: DataFrame) -> DataFrame:
    """cards with display_name (else the character's name, else the id) and warnings (those of quality, then of evidence)."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return cards.withColumn("display_name", F.coalesce(some("display_name"), some("character_name"), F.col("card_id"))).withColumn("warnings", F.concat("quality_warnings", "evidence_warnings"))


def search(cards: DataFrame, query: str = "", status: str | None = None, tag: str | None = None) -> DataFrame:
    """Cards of a status (DRAFT takes EMPTY as well), with a tag, whose names, aliases, tags, notes or states hold the query in any case."""
    kept = F.lit(True) if status is None else F.col("compile_status").isin("DRAFT", "EMPTY") if status == "DRAFT" else F.col("compile_status") == status
    tagged = F.array_contains("tags", tag) if tag else F.lit(True)
    hay = F.lower(F.concat_ws(" ", "display_name", "character_name", F.array_join("aliases", " "), F.array_join("tags", " "), "notes", "compile_status", "compile_source", "compile_variant"))
    return cards.filter(kept & tagged & F.contains(hay, F.lit(query.lower())))


def tags(cards: DataFrame) -> DataFrame:
    """Distinct tags, in order without case."""
    return cards.select(F.explode("tags").alias("tag")).distinct().orderBy(F.lower("tag"), "tag")


def compile_warnings(quality: Column, evidence: Column, summary_text: Column, count: Column, stale: tuple[str, ...]) -> Column:
    """Distinct warnings without stale ones, and what is missing."""
    kept = F.filter(F.concat(quality, evidence), lambda w: ~w.isin(*stale) if stale else F.lit(True))
    missing = F.filter(F.array(F.when(T.strip(F.coalesce(summary_text, F.lit(""))) == "", "summary is empty"), F.when(count <= 0, "no evidence was matched")), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(kept, missing))


def joined_aliases(aliases: Column, new: Column, names: tuple[Column, ...]) -> Column:
    """aliases with the new ones that neither they nor the protected names have, without case."""
    low = lambda c: F.lower(T.strip(c))
    taken = F.concat(F.array(*[low(n) for n in names]), F.transform(aliases, low))
    fresh = F.filter(T.folded_distinct(new), lambda x: ~F.array_contains(taken, F.lower(x)))
    return F.concat(aliases, fresh)


#: Aliases that are looked for at once.
PROPOSALS = 500


def confirmed_aliases(aliases: DataFrame, targets: DataFrame, most: int = 8) -> DataFrame:
    """The first most distinct aliases (pos, alias) that stand in a target's text (name and target).

    PROPOSALS aliases at a time are one expression, and targets are read once for these and never joined in pairs.
    """
    firsts = aliases.select("pos", T.strip("alias").alias("alias")).filter("alias <> ''").groupBy(F.lower("alias").alias("key")).agg(F.min(F.struct("pos", "alias")).alias("f"))
    firsts = placed(firsts, [F.col("f")], name="aliases").select("place", "key", "f.pos", "f.alias")
    text = F.lower(F.concat_ws(" ", "candidate_name", "target"))
    found, begin, total = [], 1, firsts.count()
    # Block by block in order, until enough stand in a target.
    while begin <= total and len(found) < most:
        proposals = firsts.filter(F.col("place").between(begin, begin + PROPOSALS - 1)).orderBy("place").collect()
        held = targets.agg(*[F.coalesce(F.bool_or(F.contains(text, F.lit(r.key))), F.lit(False)).alias(f"a{i}") for i, r in enumerate(proposals)]).first()
        found += [(r.pos, r.alias) for r, there in zip(proposals, held) if there]
        begin += PROPOSALS
    return aliases.sparkSession.createDataFrame(found[:most], aliases.select("pos", "alias").schema)


def roles(dialogues: Column) -> Column:
    """Dialogues (structs with messages of role and content) with roles trimmed and in lower case."""
    return F.transform(dialogues, lambda d: d.withField("messages", F.transform(d["messages"], lambda m: m.withField("role", F.lower(T.strip(m["role"]))))))


def filled_dialogues(preset: Column, example: Column, wanted: Column) -> Column:
    """(preset, example, warning): usable dialogues of each list, filled from the other up to the wanted number and cut there; null wants nothing."""
    usable = lambda c: F.filter(c, lambda d: F.size(d["messages"]) > 0)
    p, e = usable(preset), usable(example)
    missing = lambda own: F.greatest(wanted - F.size(own), F.lit(0))
    full_p = F.concat(p, F.slice(e, F.lit(1), missing(p)))
    full_e = F.concat(e, F.slice(full_p, F.lit(1), missing(e)))
    cut = lambda c: F.slice(c, F.lit(1), wanted)
    short = F.concat(F.lit("requested "), wanted.cast("string"), F.lit(" dialogue sample group(s), but the model returned "), F.size(cut(full_p)).cast("string"))
    plain = F.struct(preset.alias("preset"), example.alias("example"), F.lit("").alias("warning"))
    done = F.struct(cut(full_p).alias("preset"), cut(full_e).alias("example"), F.when(F.size(cut(full_p)) < wanted, short).otherwise("").alias("warning"))
    return F.when(wanted.isNull(), plain).otherwise(done)


def version_key(tag: Column) -> Column:
    """An orderable key of v1.2.3, with -alpha, -beta or -rc and a number; null for anything else, and for numbers of more than 38 digits."""
    found = r"(?i)^v?([0-9]+)\.([0-9]+)\.([0-9]+)(?:-(alpha|beta|rc)(?:\.([0-9]+))?)?$"
    part = lambda i: F.regexp_extract(T.strip(tag), found, i)
    number = lambda i: part(i).try_cast("decimal(38,0)")
    rank = F.lit(STAGES["release"])
    for stage, r in STAGES.items():
        rank = F.when(F.lower(part(4)) == stage, r).otherwise(rank)
    numbers = [number(i) for i in (1, 2, 3)]
    last = F.when(part(5) == "", F.lit(0).cast("decimal(38,0)")).otherwise(number(5))
    known = F.rlike(T.strip(tag), F.lit(found)) & F.coalesce(*[F.when(n.isNull(), False) for n in (*numbers, last)], F.lit(True))
    return F.when(known, F.struct(*[n.alias(c) for n, c in zip(numbers, ("major", "minor", "patch"))], rank.alias("stage"), last.alias("number")))


def ranked_versions(tags: DataFrame, tag: str) -> DataFrame:
    """tags with rank: the dense rank of the version in a column, from the oldest; rows that are no version go."""
    rows = tags.withColumn("_version", version_key(F.col(tag))).filter("_version is not null")
    return dense_rank(rows, "_version").drop("_version")


#: Rows of a preview's head that are folded at once.
HEAD = 256


def _head(rows: DataFrame) -> list[tuple[int, str]]:
    """The places after which a preview's summary is no longer than the longest part, and that summary: (0, "") first.

    Only such a summary can equal a part. Each change makes it longer, so there are no more of them than the longest part has characters.
    """
    longest = rows.agg(F.max(F.array_max(F.transform("parts", F.length)))).first()[0] or 0
    changes, now, at = [(0, "")], "", 0
    while len(now) <= longest:
        # The next row with a part that isn't the summary, and what follows it.
        at = rows.filter((F.col("place") > at) & F.exists("parts", lambda x: x != F.lit(now))).agg(F.min("place")).first()[0]
        if at is None:
            break
        for r in rows.filter((F.col("place") >= at) & (F.size("parts") > 0)).select("place", "parts").orderBy("place").limit(HEAD).collect():
            at, left = r.place, [p for p in r.parts if p != now]
            if left:
                now = "; ".join([*[now] * bool(now), *left])
                changes.append((at, now))
            if len(now) > longest:
                break
    return changes


def preview_timeline(contents: DataFrame, name: str) -> DataFrame:
    """What each episode adds to a preview's state, as evidence.timeline has it; all episodes are rows, and evidence counts facts.

    contents: as of evidence.episode_contents. A name of one character or less takes all items. An episode's parts are distinct, and one
    that equals the whole summary before it adds nothing.
    """
    fields = ("facts", "behavior_traits", "dialogue_style", "relationship_interactions", "character_state_changes", "conflicts")
    rows = contents.select("season_id", "episode_id", *[E.related(F.col(f), [name], True).alias(f) for f in fields])
    shown = F.concat("behavior_traits", "dialogue_style", "relationship_interactions", "character_state_changes")
    rows = rows.select("season_id", "episode_id", F.array_distinct(F.when(F.size(shown) > 0, shown).otherwise(F.col("facts"))).alias("parts"), F.size("facts").alias("n"), "conflicts")
    rows = E.timed(rows)
    changes = _head(rows)
    known = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(s).alias("now")) for p, s in changes])
    before = F.element_at(F.filter(known, lambda c: c["place"] < F.col("place")), -1)["now"]
    return rows.withColumn("parts", F.filter("parts", lambda x: x != before))


def preview_states(contents: DataFrame, name: str) -> DataFrame:
    """The preview's whole state after each episode in order: summary (earlier summary first), evidence_count (facts), conflicts."""
    rows = preview_timeline(contents, name)
    return E.assembled(rows, rows)


def applied_state(contents: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """What a card took in, one row: its seasons, episodes and refs in order, distinct, and traits.

    chunks (season_id, episode_id, file_name, extraction_run_id): also included_chunks and included_runs.
    """
    at = [F.lower("season_id"), F.lower("episode_id")]
    episode = F.concat_ws("/", "season_id", "episode_id")
    each = lambda c: contents.select("season_id", "episode_id", F.posexplode(c).alias("pos", "v"))
    parts = [
        listed(contents, "season_id", at, "included_seasons"),
        listed(contents.withColumn("episode", episode), "episode", at, "included_episodes"),
        listed(each("behavior_traits"), "v", [*at, F.col("pos")], "personality_traits"),
        listed(each("evidence_refs"), "v", [*at, F.col("pos")], "refs"),
    ]
    if chunks is not None:
        files = chunks.withColumn("chunk", F.concat_ws("/", "season_id", "episode_id", F.regexp_replace("file_name", "[.][^.]*$", "")))
        parts += [listed(files, "chunk", [*at, F.lower("file_name")], "included_chunks"), listed(files, "extraction_run_id", [*at, F.lower("file_name")], "included_runs")]
    out = parts[0]
    for one in parts[1:]:
        # Each side is one row.
        out = out.join(one, F.lit(True))
    return out


def markdown(cards: DataFrame) -> Column:
    """A card as Markdown: its columns name, status, source, aliases, tags, notes, cover_path, summary, long_description, personality, personality_traits, speech_style, warnings, evidence_count, refs."""
    text = lambda title, c: F.when(T.strip(c) != "", F.concat(F.lit(f"\n## {title}\n"), T.strip(c)))
    bullets = lambda c: F.array_join(F.transform(F.filter(F.col(c), lambda x: T.strip(x) != ""), lambda x: F.concat(F.lit("- "), x)), "\n")
    some = lambda c: F.when(c != "", c)
    listed = lambda title, c: F.when(F.size(c) > 0, F.concat_ws("\n", F.lit(f"\n## {title}"), some(bullets(c))))
    named = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"- {title}: "), F.array_join(c, ", ")))
    nature = F.when((T.strip("personality") != "") | (F.size("personality_traits") > 0), F.concat_ws("\n", F.lit("\n## Personality"), some(T.strip("personality")), some(bullets("personality_traits"))))
    evidence = F.concat_ws("\n", F.lit("\n## Evidence"), F.concat(F.lit("- Evidence count: "), F.col("evidence_count").cast("string")), some(bullets("refs")))
    return F.concat(
        F.concat_ws("\n", F.concat(F.lit("# "), F.col("name"), F.lit("\n")), F.concat(F.lit("- Status: "), F.col("status")), F.concat(F.lit("- Source: "), F.col("source")), named("Aliases", "aliases"), named("Tags", "tags"), text("Notes", F.col("notes")),
                    F.when(F.col("cover_path") != "", F.concat(F.lit("\n## Cover\n"), F.col("cover_path"))), text("Summary", F.col("summary")), text("Description", F.col("long_description")), nature, listed("Speech Style", "speech_style"), listed("Compile Notes", "warnings"), evidence),
        F.lit("\n"),
    )


def escaped(text: Column) -> Column:
    """A text for HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def exchange_json(cards: DataFrame) -> Column:
    """(payload, warnings): a card in the exchange format of version 2, with fallbacks; warnings tell what only extensions keep.

    Columns: as for markdown, and scenario, scenario_default, first_message, creator_notes, system_prompt.
    """
    some = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(""))
    data = F.struct(
        F.col("name").alias("name"), some(F.col("long_description"), F.col("summary")).alias("description"), some(F.col("personality"), F.array_join("personality_traits", "\n")).alias("personality"), some(F.col("scenario"), F.col("scenario_default")).alias("scenario"),
        F.col("first_message").alias("first_mes"), some(F.col("creator_notes"), F.col("notes")).alias("creator_notes"), F.col("system_prompt").alias("system_prompt"), F.col("tags").alias("tags"),
    )
    payload = F.to_json(F.struct(F.lit("chara_card_v2").alias("spec"), F.lit("2.0").alias("spec_version"), data.alias("data")))
    told = F.filter(F.array(F.when(F.size("refs") > 0, F.lit("evidence refs stored in extensions"))), lambda x: x.isNotNull())
    return F.struct(payload.alias("payload"), told.alias("warnings"))
