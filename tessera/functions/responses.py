"""Answers of models: JSON found in text, choices, finish reasons, token usage, failures and event streams."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Markers of a provider's refusal, and of what it can't do.
POLICY = ("content_filter", "content policy", "content safety", "data inspection", "datainspectionfailed", "inappropriate content", "moderation", "policy violation", "safety refusal")
UNSUPPORTED = ("does not support", "not supported", "unsupported capability", "unsupported modality")
#: Markers of a refusal in the message of an error without a category.
LEGACY_POLICY = ("content safety", "data inspection", "datainspectionfailed", "inappropriate content")
#: Categories of failures; those that a change of prompt may mend, and those that a person must see.
CATEGORIES = ("provider_policy_refusal", "model_text_refusal", "unsupported_capability", "output_truncated", "json_parse_failure", "transport_or_auth_failure", "user_override_regression", "content_requires_manual_review", "local_processing_failure", "unknown_failure")
TUNING = ("provider_policy_refusal", "model_text_refusal")
MANUAL = (*TUNING, "content_requires_manual_review")
#: Exceptions with a category of their own, and their reason codes.
EXCEPTIONS = {
    "model_text_refusal": ("model_text_refusal", "model_text_marker"),
    "output_truncated": ("output_truncated", "output_limit_finish_reason"),
    "json_parse": ("json_parse_failure", "formal_json_parse_error"),
    "user_override": ("user_override_regression", "explicit_override_error"),
    "manual_review": ("content_requires_manual_review", "explicit_manual_review"),
    "audio_transcription": ("local_processing_failure", "audio_transcription_error"),
    "local": ("local_processing_failure", "local_processing_error"),
}

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def _objects(text: str) -> Iterator[tuple[int, int, dict]]:
    """Start, end and value of every JSON object that begins at a brace of text."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                yield at, end, value
        except (json.JSONDecodeError, RecursionError):
            pass
        at = text.find("{", at + 1)


def _whole(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except (json.JSONDecodeError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def last_object(text: str | None) -> str | None:
    """The text's JSON object: the whole text, else the last that begins at one of its braces (it can be an inner one)."""
    text = (text or "").strip()
    found = _whole(text)
    if found is None:
        for _, _, found in _objects(text):
            pass
    return None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True)


def found_object(text: Column) -> Column:
    """last_object() of each text, as JSON with sorted keys; null where there is none."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(last_object)

    return run(text)


def repaired(text: str | None, expected: frozenset[str]) -> tuple[str, list[str]] | None:
    """The best JSON object of a text and what was repaired: most expected keys, then earliest, then longest; first of equals."""
    stripped = (text or "").strip().lstrip("\ufeff")
    best = None
    for candidate, first in [*((m[1].strip(), ["code_block"]) for m in FENCE.finditer(stripped)), (stripped, [])]:
        plain = re.sub(r"^json\r?\n\s*", "", candidate, flags=re.I)
        without = re.sub(r",(\s*[}\]])", r"\1", plain)
        for variant, second in [(plain, []), (without, ["trailing_comma"])][: 1 + (without != plain)]:
            variant = variant.strip()
            options = [(0, len(variant), v, []) for v in [_whole(variant)] if v is not None]
            # The span of an object is counted from its own start, as its end is.
            options += [(a, b - a, v, ["embedded_json"] if a > 0 or b - a < len(variant) else []) for a, b, v in _objects(variant)]
            for start, span, value, third in options:
                score = (len(expected & value.keys()), -start, span)
                if best is None or score > best[0]:
                    best = (score, value, list(dict.fromkeys([*first, *second, *third])))
    return best and (json.dumps(best[1], ensure_ascii=False, sort_keys=True), best[2])


def repaired_object(text: Column, expected: tuple[str, ...] = ()) -> Column:
    """(payload, repairs) of the best JSON object in a text, fences, language prefixes and trailing commas aside; null where there is none."""
    keys = frozenset(expected)

    @pandas_udf("payload string, repairs array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [repaired(t, keys) for t in texts]
        return pd.DataFrame({"payload": [f and f[0] for f in found], "repairs": [f and f[1] for f in found]})

    out = run(text)
    return F.when(out["payload"].isNotNull(), out)


def _get(raw: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(raw), path, kind)


def finish_reason(raw: Column) -> Column:
    """Lower-case finish reason of the first choice, at the top or below output."""
    return F.lower(F.trim(F.coalesce(_get(raw, "$.choices[0].finish_reason"), _get(raw, "$.output.choices[0].finish_reason"), F.lit(""))))


def _content(raw: Column, path: str, separator: str) -> Column:
    """A text, or the texts of a list of parts; null where neither is there."""
    value = _get(raw, path, "variant")
    kind = F.schema_of_variant(value)
    parts = F.filter(F.transform(F.from_json(F.to_json(value), "array<struct<text:string>>"), lambda p: p["text"]), lambda t: t.isNotNull())
    return F.when(kind == "STRING", _get(raw, path)).when(F.startswith(kind, F.lit("ARRAY")) & (F.size(parts) > 0), F.array_join(parts, separator))


def message(raw: Column) -> Column:
    """(content, failure) of a response: the first choice's text, or model_text_refusal, or json_parse_failure."""
    refused = F.trim(F.coalesce(_get(raw, "$.choices[0].message.refusal"), F.lit(""))) != ""
    content = F.when(~refused, _content(raw, "$.choices[0].message.content", "\n"))
    failure = F.when(refused, "model_text_refusal").when(content.isNull(), "json_parse_failure").otherwise("")
    return F.struct(content.alias("content"), failure.alias("failure"))


def delta(raw: Column) -> Column:
    """The text that an event of a stream adds; empty where it adds none."""
    return F.coalesce(_content(raw, "$.choices[0].delta.content", ""), F.lit(""))


def usage(raw: Column) -> Column:
    """(prompt_tokens, completion_tokens, total_tokens) of a response by either naming; a missing total is the sum of the two."""
    n = lambda *names: F.coalesce(*[_get(raw, f"$.usage.{x}", "bigint") for x in names])
    prompt, completion = n("prompt_tokens", "input_tokens"), n("completion_tokens", "output_tokens")
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.coalesce(n("total_tokens"), prompt + completion).alias("total_tokens"))


def usage_totals(rows: DataFrame, by: str, used: str) -> DataFrame:
    """Token usage (a column as of usage) summed by key, as (by, token_key, tokens); keys that sum to 0 stay out."""
    keys = ("prompt_tokens", "completion_tokens", "total_tokens")
    sums = rows.groupBy(by).agg(*[F.sum(F.coalesce(F.col(f"{used}.{k}"), F.lit(0))).alias(k) for k in keys])
    return sums.unpivot(by, list(keys), "token_key", "tokens").filter("tokens <> 0")


def stream_events(lines: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """Server-sent events of a stream's lines (by, order, line) as (by, event, data): data lines up to a blank one, joined; none after [DONE].

    Lines are those of one response, so a key's rows are few.
    """
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    text = F.regexp_replace(line, r"\r$", "")
    rows = lines.select(by, F.col(order).alias("at"), text.alias("line")).withColumn("at", F.col("at"))
    so_far = Window.partitionBy(by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("event", F.coalesce(F.sum((F.col("line") == "").cast("int")).over(so_far), F.lit(0)))
    data = rows.filter(F.startswith("line", F.lit("data:"))).withColumn("value", F.regexp_replace("line", "^data: ?", ""))
    events = data.groupBy(by, "event").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("data"))
    ended = events.filter("data = '[DONE]'").groupBy(by).agg(F.min("event").alias("last"))
    return events.join(ended, by, "left").filter("last IS NULL OR event < last").drop("last")


def error_details(body: Column) -> Column:
    """(code, message) of an error body: of its error object or of itself; a body that is no JSON object is the message."""
    v = F.try_parse_json(body)
    is_object = lambda x: F.coalesce(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.lit(False))
    inner = is_object(F.try_variant_get(v, "$.error", "variant"))
    at = lambda name: F.when(inner, _get(body, f"$.error.{name}")).otherwise(_get(body, f"$.{name}"))
    some = lambda *values: F.trim(F.coalesce(*[F.when(x != "", x) for x in values], F.lit("")))
    code = F.when(is_object(v), some(at("code"), at("type"))).otherwise("")
    says = F.when(is_object(v), some(at("message"), _get(body, "$.message"))).otherwise(F.coalesce(body, F.lit("")))
    return F.struct(code.alias("code"), says.alias("message"))


def _any(text: Column, markers: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))


def provider_failure(status: Column, code: Column, says: Column) -> Column:
    """policy refusal, unsupported capability, transport failure (where there is a status) or empty."""
    signal = F.lower(F.concat_ws(" ", F.coalesce(code, F.lit("")), F.coalesce(says, F.lit(""))))
    return F.when(_any(signal, POLICY), "provider_policy_refusal").when(_any(signal, UNSUPPORTED), "unsupported_capability").when(status.isNotNull(), "transport_or_auth_failure").otherwise("")


def failure(kind: Column, category: Column, says: Column) -> Column:
    """(category, reason_code, prompt_tuning_candidate, requires_manual_review) of an exception's kind, its category if it has one, and message.

    kind: one of EXCEPTIONS, model_call, or anything else.
    """
    text = F.lower(F.coalesce(says, F.lit("")))
    row = lambda what, reason: F.struct(what.alias("category"), F.lit(reason).alias("reason_code"))
    called = F.when(category.isin(*CATEGORIES), row(category, "middleware_category"))
    called = called.when(_any(text, LEGACY_POLICY), row(F.lit("provider_policy_refusal"), "legacy_policy_marker"))
    called = called.otherwise(row(F.lit("transport_or_auth_failure"), "model_call_error"))
    out = F.when(kind == "model_call", called)
    for name, (what, reason) in EXCEPTIONS.items():
        out = out.when(kind == name, row(F.lit(what), reason))
    out = out.otherwise(row(F.lit("unknown_failure"), "unclassified_exception"))
    is_in = lambda names: out["category"].isin(*names)
    return F.struct(out["category"].alias("category"), out["reason_code"].alias("reason_code"), is_in(TUNING).alias("prompt_tuning_candidate"), is_in(MANUAL).alias("requires_manual_review"))
