"""Provider replies: what a chat completion says, whether it may be used, and what it cost in tokens.

Replies are texts; they are parsed once as variants, and each rule is a column.
The first broken rule names the error, and a row with one has no translation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

#: Keys that a translation may come under instead of `normal`.
ALTERNATIVES = ("answer", "translation", "text", "result", "output")


def kind(v: Column) -> Column:
    """The type of a variant: OBJECT, ARRAY, STRING, BIGINT, ...; null if there is none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def string(v: Column) -> Column:
    """The value of a variant that is a string, else null."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def translation(content: Column) -> Column:
    """struct(normal, compact) of a reply's JSON object, as variants.

    Without a key `normal`, the first alternative key that holds a string or an
    object with a string `normal` counts, a string that is such an object too;
    without one, the only string of the object.
    """
    said = lambda v: F.struct(at(v, "$.normal").alias("normal"), at(v, "$.compact").alias("compact"))
    alone = lambda v: F.struct(v.alias("normal"), F.lit(None).cast("variant").alias("compact"))
    found = F.when(at(content, "$.normal").isNotNull(), said(content))
    for key in ALTERNATIVES:
        v = at(content, f"$.{key}")
        inner = F.try_parse_json(string(v))
        found = found.when(kind(at(v, "$.normal")) == "STRING", said(v)).when((kind(inner) == "OBJECT") & (kind(at(inner, "$.normal")) == "STRING"), said(inner)).when(kind(v) == "STRING", alone(v))
    values = F.map_values(F.from_json(F.to_json(content), "map<string,variant>"))
    strings = F.filter(values, lambda v: kind(v) == "STRING")
    return found.when(F.size(strings) == 1, alone(F.get(strings, F.lit(0)))).otherwise(F.struct(F.lit(None).cast("variant").alias("normal"), F.lit(None).cast("variant").alias("compact")))


def count_of(usage: Column, field: str) -> tuple[Column, Column]:
    """(whether the field is there, its value if it is an integer from 0)."""
    v = at(usage, f"$.{field}")
    n = F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))
    return v.isNotNull(), F.when(n >= 0, n)


def usage(raw: Column, provider: str) -> Column:
    """struct(valid, input_tokens, cached_tokens, output_tokens) of a reply's usage; null counts if it has none or it is wrong."""
    has_in, given = count_of(raw, "prompt_tokens")
    has_out, output = count_of(raw, "completion_tokens")
    has_all, total = count_of(raw, "total_tokens")
    ok = (kind(raw) == "OBJECT") & has_in & has_out & given.isNotNull() & output.isNotNull()
    cached = F.lit(0).cast("bigint")
    if provider in ("deepseek", "kimi"):
        has, n = count_of(raw, "prompt_cache_hit_tokens" if provider == "deepseek" else "cached_tokens")
        cached = F.when(has, n).otherwise(cached)
        ok = ok & (~has | n.isNotNull())
    if provider == "deepseek":
        has, missed = count_of(raw, "prompt_cache_miss_tokens")
        ok = ok & (~has | F.coalesce(cached + missed == given, F.lit(False)))
    ok = ok & (~has_all | F.coalesce(total == given + output, F.lit(False))) & (cached <= given)
    ok = F.coalesce(ok, F.lit(False)) | raw.isNull()
    value = lambda c: F.when(ok & raw.isNotNull(), c)
    return F.struct(ok.alias("valid"), value(given).alias("input_tokens"), value(cached).alias("cached_tokens"), value(output).alias("output_tokens"))


def uncached(input_tokens: Column, cached: Column) -> Column:
    """Input tokens that weren't cached; null where the counts can't be."""
    return F.when((cached >= 0) & (cached <= input_tokens), input_tokens - cached)


def parse(replies: DataFrame, provider: str = "deepseek", status: str = "status", body: str = "body", expected: str = "expected") -> DataFrame:
    """replies with kind (ok, retry, permanent), error_type, detail, normal, compact and the usage counts.

    expected: array of the placeholders that a translation has to hold.
    """
    rows = replies.withColumn("_p", F.try_parse_json(body))
    rows = rows.withColumns({"_u": usage(at(F.col("_p"), "$.usage"), provider), "_c": at(F.col("_p"), "$.choices[0]")})
    rows = rows.withColumns({"_said": string(at(F.col("_c"), "$.message.content")), "_stop": F.coalesce(string(at(F.col("_c"), "$.finish_reason")) == "stop", F.lit(False))})
    rows = rows.withColumn("_t", F.try_parse_json("_said")).withColumn("_f", translation(F.col("_t")))
    rows = rows.withColumns({"_n": string(F.col("_f.normal")), "_k": F.when(F.trim(string(F.col("_f.compact"))) != "", string(F.col("_f.compact")))})
    wrong = lambda c: F.size(X.placeholder_issues(c, F.col(expected))["missing"]) + F.size(X.placeholder_issues(c, F.col(expected))["duplicated"]) + F.size(X.placeholder_issues(c, F.col(expected))["unknown"]) > 0
    state = X.status_kind(F.col(status))
    error = (
        F.when(state != "ok", "provider_http_error")
        .when(F.coalesce(kind(F.col("_p")) != "OBJECT", F.lit(True)), "invalid_json_response")
        .when(~F.col("_u.valid"), "invalid_usage")
        .when(F.coalesce(kind(F.col("_c")) != "OBJECT", F.lit(True)), "missing_choices")
        .when(~F.col("_stop"), "incomplete_response")
        .when(F.coalesce(F.trim("_said"), F.lit("")) == "", "empty_response")
        .when(F.col("_t").isNull(), "invalid_json_response")
        .when((kind(F.col("_t")) != "OBJECT") | F.col("_n").isNull(), "invalid_translation_fields")
        .when(F.trim("_n") == "", "empty_translation_fields")
        .when(wrong(F.col("_n")) | F.coalesce(wrong(F.col("_k")), F.lit(False)), "placeholder_validation_error")
    )
    rows = rows.withColumns({"error_type": error, "kind": F.when(state != "ok", state).when(error.isNull(), "ok").otherwise("retry")})
    told = F.coalesce(string(at(F.col("_p"), "$.error.message")), string(at(F.col("_p"), "$.error.code")), string(at(F.col("_p"), "$.error")), string(at(F.col("_p"), "$.message")), F.nullif(F.trim(body), F.lit("")))
    rows = rows.withColumns({"detail": F.when(state != "ok", X.redact(told)), **{c: F.when(F.col("error_type").isNull(), F.col(k)) for c, k in (("normal", "_n"), ("compact", "_k"))}, **{c: F.col(f"_u.{c}") for c in ("input_tokens", "cached_tokens", "output_tokens")}})
    return rows.drop("_p", "_u", "_c", "_said", "_stop", "_t", "_f", "_n", "_k")


def endpoint_used(statuses: Column, start: Column) -> Column:
    """Which base address answers a call, from 0: the first from `start` on that isn't busy (429), or the last; later calls start there."""
    later = F.slice(statuses, start + 1, F.greatest(F.size(statuses) - start, F.lit(1)))
    free = F.array_position(F.transform(later, lambda s: s == 429), F.lit(False)).cast("int")
    return F.when(free > 0, start + free - 1).otherwise(F.size(statuses) - 1)


def model_ids(replies: DataFrame, body: str = "body") -> DataFrame:
    """(id) of the models that a listing names, each once, in order."""
    found = F.from_json(F.to_json(at(F.try_parse_json(body), "$.data")), "array<variant>")
    names = replies.select(F.explode(found).alias("m")).select(F.trim(string(at(F.col("m"), "$.id"))).alias("id"))
    return names.where("id <> ''").distinct().orderBy("id")


def base_urls(urls: Column) -> Column:
    """Different addresses without slashes at their ends, in order."""
    return F.array_distinct(F.transform(urls, lambda u: F.regexp_replace(u, "/+$", "")))


#: Marks of field names that hold secrets, and names with "token" that don't.
SECRET_MARKS = ("accesstoken", "apikey", "authtoken", "authorization", "bearertoken", "credential", "passphrase", "password", "privatekey", "refreshtoken", "secret")
SAFE_TOKENS = (
    "cachedinputtokens", "cachedtokens", "completiontokens", "contextwindowtokens", "inputtokens", "maxinputtokens", "maxoutputtokens", "maxtokens", "outputtokens",
    "promptcachehittokens", "promptcachemisstokens", "prompttokens", "protectedtokencount", "tokencount", "tokenizer", "tokenizerversion", "totaltokens", "uncachedinputtokens",
)
#: Fixed value: texts that are keys.
SECRET_VALUE = r"(?i)^(?:Bearer\s+\S{8,}|sk-[a-z0-9_-]{8,}|api[-_]?key(?:[-_:][a-z0-9_-]+)+)$"


def secret_field(name: Column) -> Column:
    """Whether a configuration's field name says that it holds a secret."""
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    marked = F.lit(False)
    for mark in SECRET_MARKS:
        marked = marked | plain.contains(mark)
    return marked | (plain.contains("token") & ~plain.isin(*SAFE_TOKENS))


def secret_value(value: Column) -> Column:
    return F.trim(value).rlike(SECRET_VALUE)


def holds_secret(configuration: Column) -> Column:
    """Whether a JSON text has a secret's field name or value at any depth, by its quoted strings and those before a colon.

    Strings are matched as they are written, escapes included.
    """
    quoted = r'"((?:[^"\\]|\\.)*)"'
    names = F.regexp_extract_all(configuration, F.lit(quoted + r"\s*:"), F.lit(1))
    values = F.regexp_extract_all(F.regexp_replace(configuration, quoted + r"\s*:", ""), F.lit(quoted), F.lit(1))
    return F.exists(names, secret_field) | F.exists(values, secret_value)


def clean_status(status: Column) -> Column:
    return F.when(status.between(100, 599), status)


def clean_segment_id(id_: Column) -> Column:
    return F.when(id_.rlike("^[a-zA-Z0-9][a-zA-Z0-9_.:-]{0,127}$"), id_)


def clean_attempts(n: Column) -> Column:
    return F.when(n > 0, n)


#: What a model is told, for a part of a document and for a whole text; {} is the language.
SEGMENT_PROMPT = (
    "Translate one protected academic-paper segment into {}. Translate only the current segment; use the section title and neighboring context only for terminology and coherence, and never copy neighboring context"
    " into the translation. Follow relevant glossary entries exactly. Preserve every listed placeholder exactly once and unchanged. Preserve all claims, citations, variables, units, and technical meaning."
    " Return JSON only, with exactly two string fields: normal for the complete natural translation and compact for an equally complete but more concise layout candidate."
)
TEXT_PROMPT = (
    "Translate the current protected text into {}. Translate only the supplied text. Preserve every listed placeholder exactly once and unchanged, and preserve all claims, citations, variables, units, URLs, and technical"
    " meaning. Return JSON only, with exactly two string fields: normal for the complete natural translation and compact for an equally complete but more concise alternative."
)


def messages(target: Column, source: Column, text: Column, tokens: Column, context: Column, whole_text: Column) -> Column:
    """array of struct(role, content): the two messages of a chat request; context is a JSON object."""
    said = [F.replace(F.lit(p), F.lit("{}"), X.language_name(target)) for p in (TEXT_PROMPT, SEGMENT_PROMPT)]
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1_000_000_000)
    value = lambda c: F.regexp_replace(quoted(c), r"\]$", "")
    user = F.concat(F.lit('{"protected_tokens": '), F.to_json(tokens), F.lit(', "segment_context": '), context, F.lit(', "source_language": '), value(source), F.lit(', "source_text": '), value(text), F.lit(', "target_language": '), value(target), F.lit("}"))
    return F.array(F.struct(F.lit("system").alias("role"), F.when(whole_text, said[0]).otherwise(said[1]).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


#: What a report says about its limits.
LIMITS = ("White fill is used when removing source text regions.", "The local CJK font is referenced at runtime and is not bundled with the project.")


def limitations(provider: Column) -> Column:
    first = F.when(provider == "mock", "Mock Chinese is synthetic and must not be evaluated for translation quality.").otherwise(F.concat(F.lit("Source text is transmitted to the selected external provider: "), provider, F.lit(".")))
    return F.array(first, *map(F.lit, LIMITS))
