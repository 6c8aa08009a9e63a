"""Scalar text functions: Column -> Column, all inside the JVM; a null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts that count one token a character, and the estimate's margin in tenths.
WIDE = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"
NARROW = r"[^\s\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]{1,4}"
MARGIN_TENTHS = 12
#: White space of any kind.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SENTENCE = "[.!?]"


def strip(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def clip(text: Column, limit: int) -> Column:
    """One space for each run of white space, no outer space, cut to limit characters with three dots at the end."""
    return _cut(_flat(text), limit)


def _flat(text: Column) -> Column:
    # A single plain space stays as it is: it need not be replaced by itself.
    return F.trim(F.regexp_replace(text, f"{BLANK}{{2,}}|{BLANK[:-1]}&&[^ ]]", " "))


def _cut(flat: Column, limit: int) -> Column:
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, max(0, limit - 3)), F.lit("...")))


def token_estimate(text: Column) -> Column:
    """A token for each wide character and each four characters, begun, of other runs; plus the margin, rounded up."""
    # A run of other characters falls into pieces of up to four, so counting pieces rounds each run up.
    total = F.regexp_count(text, F.lit(WIDE)) + F.regexp_count(text, F.lit(NARROW))
    return F.floor((total * MARGIN_TENTHS + 9) / 10).cast("long")


def stable_id(kind: str | Column, path: Column) -> Column:
    """The first 12 hex digits of the SHA-1 of kind:path."""
    return F.substring(F.sha1(F.concat_ws(":", kind if isinstance(kind, Column) else F.lit(kind), path)), 1, 12)


#: Query keys whose values are masked; so are keys that end in _token.
SENSITIVE_KEYS = ("access_key", "access_key_id", "access_token", "api_key", "apikey", "authorization", "key", "password", "secret", "signature", "token")
#: Parts of metadata keys whose values are hidden.
HIDDEN_KEYS = ("api_key", "apikey", "token", "secret", "password")


def _replaced(text: Column, mark: str, pattern: str, by: str) -> Column:
    """A pattern replaced; texts without the mark that each match holds aren't searched."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, pattern, by)).otherwise(t))


def redact(text: Column, secrets: tuple[str, ...] = (), proxy: tuple[str, str] | None = None) -> Column:
    """User information in URLs, bearer tokens and sk- keys masked; then a proxy's URL by its own masked form, and secrets of three characters or more."""
    text = _replaced(text, "://", r"([A-Za-z][A-Za-z0-9+.-]*://)([^/\s:@]+(?::[^/\s@]*)?@)", "$1***:***@")
    text = _replaced(text, "Bearer", r"(Authorization:\s*Bearer\s+|Bearer\s+)([A-Za-z0-9._~+/=-]+)", "$1***")
    text = _replaced(text, "sk-", r"\bsk-[A-Za-z0-9_-]{8,}\b", "sk-***")
    if proxy and all(proxy):
        text = F.replace(text, F.lit(proxy[0]), F.lit(proxy[1]))
    for secret in secrets:
        if len(secret) >= 3:
            text = F.replace(text, F.lit(secret), F.lit("***"))
    return text


def mask_tokens(text: Column) -> Column:
    """Quoted hexadecimal values of token = "..." masked."""
    return F.regexp_replace(text, r'(token\s*=\s*")[0-9a-fA-F]+(")', "$1***$2")


def _encoded(part: Column) -> Column:
    return F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~"))


def sanitize_url(url: Column) -> Column:
    """A URL with user information and the values of sensitive query keys masked, other keys kept and encoded anew."""
    parts = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda i: F.regexp_extract(url, parts, i)
    place, query = part(2), part(4)
    user, host = F.regexp_extract(place, r"(?s)^(.*)@", 1), F.regexp_extract(place, r"([^@]*)$", 1)
    place = F.when((user != "") & (user != ":"), F.concat(F.lit("***:***@"), F.lower(host))).otherwise(place)

    def pair(p: Column) -> Column:
        plain = lambda x: F.coalesce(F.try_url_decode(x), x)
        key, value = plain(F.regexp_extract(p, r"(?s)^([^=]*)", 1)), plain(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1))
        name = F.replace(F.lower(F.trim(key)), F.lit("-"), F.lit("_"))
        masked = name.isin(*SENSITIVE_KEYS) | F.endswith(name, F.lit("_token"))
        return F.concat(_encoded(key), F.lit("="), F.when(masked, "***").otherwise(_encoded(value)))

    pairs = F.array_join(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair), "&")
    lead = lambda value, before, after="": F.when(value != "", F.concat(F.lit(before), value, F.lit(after))).otherwise("")
    return F.concat(lead(part(1), "", ":"), lead(place, "//"), part(3), lead(pairs, "?"), lead(part(5), "#"))


def mask_query(url: Column, keys: tuple[str, ...]) -> Column:
    """Values of the query keys masked, others kept."""
    return F.regexp_replace(url, rf"([?&](?:{'|'.join(keys)})=)[^&#]*", "$1***")


def slug(text: Column, empty: str = "project") -> Column:
    """Runs of characters other than letters, digits, dot, line and dash become one underscore; none of these at the ends."""
    out = F.regexp_replace(F.regexp_replace(text, r"[^0-9A-Za-z._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(out == "", empty).otherwise(out)


def archive_name(path: Column) -> Column:
    """A path that is safe inside an archive: forward slashes, no empty, dot or parent parts."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise("material")


def material_label(path: Column) -> Column:
    """A path without outer slashes and without its leading materials/ or raw/."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", ""), "^(?:materials|raw)/", "")


def display_path(path: Column) -> Column:
    """A relative path with forward slashes; of an absolute one only the name."""
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.lit("<outside_project>/"), name)).otherwise(F.translate(path, "\\", "/"))


def compact_time(moment: Column) -> Column:
    """A timestamp as yyyymmddThhmmssZ in UTC; a text that is none gives its first 15 letters and digits, or unknown_time."""
    at = F.try_to_timestamp(F.trim(moment))
    plain = F.substring(F.regexp_replace(F.trim(moment), "[^0-9A-Za-z]+", ""), 1, 15)
    utc = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")
    return F.coalesce(utc, F.when(plain != "", plain), F.lit("unknown_time"))


def _whole(seconds: Column) -> Column:
    return F.greatest(F.floor(seconds), F.lit(0)).cast("long")


def clock(seconds: Column) -> Column:
    """hh:mm:ss.mmm of a number of seconds, hours as long as they are; negative counts as 0."""
    ms = F.greatest(F.bround(seconds * 1000), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock_minutes(seconds: Column) -> Column:
    """mm:ss, cut to whole seconds."""
    return F.format_string("%02d:%02d", F.floor(_whole(seconds) / 60), _whole(seconds) % 60)


def clock_whole(seconds: Column) -> Column:
    """hh:mm:ss, cut to whole seconds."""
    w = _whole(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(w / 3600), F.floor(w / 60) % 60, w % 60)


def short_number(value: Column) -> Column:
    """Three decimals without closing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", value), "0+$", ""), r"\.$", "")


def clock_seconds(value: Column, scale: int) -> Column:
    """Seconds of h:m:s with a fraction after a dot or comma; its first three digits count in units of 1 / scale. Else null."""
    found = r"^\s*\+?(\d+)\s*:\s*(\d+)\s*:\s*(\d+)(?:[.,](\d*)\d*)?\s*$"
    part = lambda i: F.regexp_extract(value, found, i)
    fraction = F.when(part(4) == "", 0.0).otherwise(F.substring(part(4), 1, 3).try_cast("double") / scale)
    return F.when(F.rlike(value, F.lit(found)), part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double") + fraction)


def seconds_of(value: Column, parts: int) -> Column:
    """Seconds of mm:ss (two parts) or hh:mm:ss (three); 0 for anything else."""
    items = F.split(F.trim(value), ":")
    numbers = F.transform(items, lambda p: F.trim(p).try_cast("long"))
    good = (F.size(items) == parts) & F.forall(numbers, lambda x: x.isNotNull())
    return F.coalesce(F.when(good, F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a * 60 + x)), F.lit(0)).cast("double")


def natural_key(name: Column) -> Column:
    """An orderable key: runs of digits by value and before text, other runs in lower case."""
    parts = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda p: p.rlike("^[0-9]")
    # By value: more digits (without leading zeros) are more, as many go by the digits.
    digits = lambda p: F.when(number(p), F.regexp_replace(p, "^0+(?=.)", ""))
    return F.transform(parts, lambda p: F.struct(F.when(number(p), 0).otherwise(1).alias("kind"), F.length(digits(p)).alias("size"), digits(p).alias("number"), F.lower(p).alias("text")))


def has_term(text: Column, terms: list[str]) -> Column:
    """Whether the text holds one of the terms, in any case; terms of one character count for nothing."""
    out = F.lit(False)
    for term in terms:
        if len(term) >= 2:
            out = out | F.contains(F.lower(text), F.lit(term.lower()))
    return F.coalesce(out, F.lit(False))


#: Phrases by which a model's answer is a refusal.
REFUSALS = (
    "i can't assist with", "i cannot assist with", "i can't help with", "i cannot help with", "i'm unable to assist", "i am unable to assist", "i must refuse",
    "我不能协助", "我无法协助", "我不能帮助", "我无法帮助", "我必须拒绝", "お手伝いできません", "対応できません",
)


def refuses(text: Column, markers: tuple[str, ...] | list[str] = REFUSALS, most: int = 4000) -> Column:
    """Whether a short text holds a marker of refusal, white space and case aside; a text of more than most characters never does."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.coalesce((F.length(flat) <= most) & has_term(flat, list(markers)), F.lit(False))


#: Least, target and most output tokens of each purpose, tokens for each item after the first, and the divisor of input tokens.
BUDGETS = {
    "formal_episode_content_merge": (2048, 4096, 16384, 512, 8),
    "formal_episode_summary": (1024, 2048, 8192, 128, 16),
    "formal_season_content_merge": (4096, 8192, 32768, 1024, 8),
    "formal_season_summary": (2048, 4096, 16384, 256, 16),
}


def output_budget(purpose: str, items: Column, tokens: Column, context: Column | None = None, reserved: Column | None = None, margin: int = 1024) -> Column:
    """(budget, warning): output tokens for so many items and input tokens, within the purpose's bounds and what a context window leaves.

    A window that leaves less than the purpose's least gives the least and a warning; a null or non-positive window is none.
    """
    least, target, most, per_item, divisor = BUDGETS[purpose]
    wanted = target + F.greatest(items - 1, F.lit(0)) * per_item + F.greatest(F.floor(tokens / divisor), F.lit(0))
    wanted = F.least(F.greatest(wanted, F.lit(least)), F.lit(most)).cast("long")
    room = (context if context is not None else F.lit(None).cast("long")) - (reserved if reserved is not None else F.lit(0)) - margin
    bounded = (context > 0) if context is not None else F.lit(False)
    budget = F.when(~F.coalesce(bounded, F.lit(False)), wanted).when(room < least, F.lit(least)).otherwise(F.least(wanted, room))
    says = F.concat(F.lit(f"text_merge_output_budget_below_minimum:purpose={purpose},requested="), wanted.cast("string"), F.lit(",available="), room.cast("string"), F.lit(f",minimum={least}"))
    return F.struct(budget.cast("long").alias("budget"), F.when(F.coalesce(bounded, F.lit(False)) & (room < least), says).otherwise("").alias("warning"))


def tokens_per_minute(value: Column) -> Column:
    """Output tokens a minute: steps of 128 from 128 to 8,192; 2,048 where there is no positive number."""
    n = value.try_cast("long")
    return F.when(n > 0, F.least(F.lit(8192), F.greatest(F.lit(128), F.bround(n / 128) * 128))).otherwise(2048).cast("long")


def video_tokens(per_minute: Column, seconds: Column) -> Column:
    """Output tokens for a video of so many seconds; 60 where there is no positive number."""
    duration = seconds.try_cast("double")
    return F.greatest(F.lit(1), F.floor(tokens_per_minute(per_minute) * F.when(duration > 0, duration).otherwise(60.0) / 60.0 + 0.5)).cast("long")


def recommended_per_minute(seconds: Column, required: Column, least: int) -> Column:
    """Output tokens a minute that give the required tokens over a video, in steps of 128 up to 8,192."""
    wanted = F.greatest(required, F.lit(least)) * 60.0 / F.when(seconds > 0, seconds).otherwise(60.0)
    return F.least(F.lit(8192), F.greatest(F.lit(128), F.ceil(wanted / 128) * 128)).cast("long")


def rendered(template: Column, values: Column) -> Column:
    """A template with {name} replaced by values (a map of texts); names without a value stay, doubled braces are single ones."""
    pieces = F.regexp_extract_all(template, F.lit(r"(\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}])"), F.lit(1))

    def piece(p: Column) -> Column:
        name = F.substring(p, F.lit(2), F.greatest(F.length(p) - 2, F.lit(0)))
        return F.when(p == "{{", "{").when(p == "}}", "}").when(F.startswith(p, F.lit("{")) & (F.length(p) > 2), F.coalesce(F.element_at(values, name), p)).otherwise(p)

    return F.array_join(F.transform(pieces, piece), "")


def trimmed(items: Column) -> Column:
    """An array's texts, trimmed, without nulls and empty ones."""
    return F.filter(F.transform(items, strip), lambda x: x != "")


def string_list(value: Column) -> Column:
    """A JSON value as texts: a list's trimmed texts, a single text as a list of one; anything else is empty."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    texts = trimmed(F.from_json(value, "array<string>"))
    one = strip(F.try_variant_get(v, "$", "string"))
    return F.when(F.startswith(kind, F.lit("ARRAY")), texts).when((kind == "STRING") & (one != ""), F.array(one)).otherwise(F.array().cast("array<string>"))


def folded_distinct(items: Column) -> Column:
    """Trimmed texts, first ones of those equal without case, in order."""
    clean = trimmed(items)
    keys = F.transform(clean, lambda x: F.lower(x))
    return F.filter(clean, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def capped(items: Column, most: int, chars: int | None = None) -> Column:
    """The first most distinct trimmed texts, each clipped to so many characters."""
    out = F.slice(F.array_distinct(trimmed(items)), 1, most)
    return F.transform(out, lambda x: clip(x, chars)) if chars else out


def merged(old: Column, new: Column) -> Column:
    """Two maps as one; where both have a key, the new value."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def relative_path(path: Column, root: str) -> Column:
    """A path below root, with forward slashes; one outside stays whole."""
    flat = F.translate(path, "\\", "/")
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(flat, F.lit(base)), F.substring(flat, len(base) + 1, 1 << 30)).otherwise(flat)


def sensitive_key(key: Column) -> Column:
    return F.exists(F.array(*[F.lit(k) for k in HIDDEN_KEYS]), lambda k: F.contains(F.lower(key), k))


def clean(text: Column, limit: int) -> Column:
    """A redacted text on one line, cut to limit characters."""
    return let(_flat(redact(text)), lambda flat: _cut(flat, limit))


def safe_metadata(values: Column, limit: int = 300) -> Column:
    """A map of texts without blank keys, values of sensitive keys hidden, others cleaned; of keys that are equal when trimmed, the last."""
    entries = F.filter(F.transform(F.map_entries(values), lambda e: F.struct(strip(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"] != "")
    last = lambda es, keys: F.filter(es, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    kept = let(entries, lambda es: let(F.transform(es, lambda e: e["key"]), lambda keys: last(es, keys)))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], F.when(sensitive_key(e["key"]), "<redacted>").otherwise(clean(e["value"], limit)))))


def safe_list(items: Column, most: int = 20, limit: int = 160) -> Column:
    return F.transform(F.slice(items, 1, most), lambda x: clean(x, limit))


def safe_map(values: Column, most: int = 20, limit: int = 160) -> Column:
    """The first most entries, without those of sensitive keys, values cleaned."""
    kept = F.filter(F.slice(F.map_entries(values), 1, most), lambda e: ~sensitive_key(e["key"]))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], clean(e["value"], limit))))


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (idx, start, part): windows of size characters, each overlap before the last one's end; blank parts stay out."""
    n, step = F.length(text), size - overlap
    count = F.when(n <= size, F.when(n > 0, 1).otherwise(0)).otherwise(F.ceil((n - overlap) / step)).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(at, lambda i: F.struct(i.alias("idx"), (i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("part")))
    return F.filter(parts, lambda p: F.trim(p["part"]) != "")


def let(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Where a chunk ends, in order of preference.
MARKERS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " ")


def chunks(text: Column, size: int, overlap: int = 0, most: int = 128) -> Column:
    """(parts, warnings): parts (idx from 1, start, stop, part) end after the last marker of the best kind in the last two
    fifths of size characters, else there; the next one begins overlap characters before. Blank parts stay out, after most parts a warning tells what is left; a null text has none.

    One fold over at most as many steps as the text can have chunks; each step looks at one window of the text.
    """
    n = F.length(text)
    least = max(1, int(size * 0.6) + 1 - overlap)
    # Blank parts take steps as well.
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(n / least).cast("int") + 1))
    part = "struct<idx:int,start:int,stop:int,part:string>"
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("full"), F.array().cast(f"array<{part}>").alias("parts"))

    def end_of(at: Column) -> Column:
        hard = at + size
        low = at + max(1, int(size * 0.6))

        def marked(window: Column) -> Column:
            last = lambda m: F.length(window) - F.instr(F.reverse(window), m[::-1]) - len(m) + 1
            out = F.when(F.instr(window, MARKERS[0]) > 0, low + last(MARKERS[0]) + len(MARKERS[0]))
            for m in MARKERS[1:]:
                out = out.when(F.instr(window, m) > 0, low + last(m) + len(m))
            return out.otherwise(hard)

        return F.when(hard >= n, n).otherwise(let(F.substring(text, low + 1, hard - low), marked)).cast("int")

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]

        def cut(stop: Column) -> Column:
            def kept(value: Column) -> Column:
                row = F.struct((F.size(acc["parts"]) + 1).alias("idx"), at.alias("start"), stop.alias("stop"), value.alias("part")).cast(part)
                return F.when(F.rlike(value, F.lit(r"\S")), F.concat(acc["parts"], F.array(row))).otherwise(acc["parts"])

            after = F.when(stop >= n, n).otherwise(F.greatest(at + 1, stop - overlap)).cast("int")
            return F.struct(after.alias("at"), F.lit(False).alias("full"), let(F.substring(text, at + 1, stop - at), kept).alias("parts"))

        stopped = F.struct(at.alias("at"), F.lit(True).alias("full"), acc["parts"].alias("parts"))
        return F.when((at >= n) | acc["full"], acc).when(F.size(acc["parts"]) >= most, stopped).otherwise(let(end_of(at), cut))

    return let(F.aggregate(steps, begin, step), lambda done: _chunked(done, n, most))


def _chunked(done: Column, n: Column, most: int) -> Column:
    left = F.concat(F.lit(f"text_chunk_limit_reached:max_chunks={most}:remaining_chars="), (n - done["at"]).cast("string"))
    split = F.concat(F.lit("text_split_into_chunks:count="), F.size(done["parts"]).cast("string"))
    warnings = F.when(done["full"], F.array(left)).when(F.size(done["parts"]) > 1, F.array(split)).otherwise(F.array().cast("array<string>"))
    return F.struct(done["parts"].alias("parts"), warnings.alias("warnings"))


def sentences(text: Column) -> Column:
    """Array of the text's sentences, trimmed, none empty; null: none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), "\n", " "), SENTENCE)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
