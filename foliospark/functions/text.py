"""Column functions on texts. Patterns take Unicode white space and digits where (?U) says so."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

#: Language names by code, for prompts.
LANGUAGES = {"zh-CN": "Simplified Chinese", "zh-TW": "Traditional Chinese", "en": "English", "ja": "Japanese", "ko": "Korean", "fr": "French", "es": "Spanish", "de": "German", "ru": "Russian", "pt": "Portuguese"}
#: Languages whose words are written apart.
WORD_SEGMENTED = ("en", "fr", "es", "de", "ru", "pt", "it", "nl", "pl", "sv", "tr", "id", "vi", "ko")
#: HTTP statuses after which a call isn't tried again.
PERMANENT = (400, 401, 402, 403, 404, 422)


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def normal(text: Column) -> Column:
    """NFKC. No built-in function has it; only texts with other characters than ASCII go to an Arrow-batched one."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKC")

    return F.coalesce(F.pandas_udf(run, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def display(text: Column) -> Column:
    """NFKC with white space collapsed, NUL as a blank; null as empty."""
    return collapse(normal(F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit(" "))))


def shortened(text: Column, limit: int) -> Column:
    """At most limit characters, an ellipsis at the end of a cut text."""
    return clip(text, limit, "…")


def preview(text: Column, limit: int = 120) -> Column:
    """What a list shows of a text: the first 4096 characters, for display, shortened."""
    return shortened(display(F.substring(text, 1, 4096)), limit)


def clip(text: Column, limit: int, mark: str = "...") -> Column:
    """At most limit characters, the mark at the end of a cut text."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - len(mark))), F.lit(mark))).otherwise(text)


def ends_sentence(text: Column) -> Column:
    return F.rtrim(text).rlike("[.!?;:][\\])}\"'’”]*$")


def starts_lower(text: Column) -> Column:
    return F.regexp_replace(text, "^[ (\\[{\"'‘“]+", "").rlike(r"^\p{Ll}")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def is_prose(text: Column) -> Column:
    """Mostly letters with some words: running text, or the rest of a sentence with more figures."""
    letters, digits, math, words = count(text, r"\p{L}"), count(text, r"\p{Nd}"), count(text, r"[=∑∫√±×÷≤≥≈≠∞^_{}]"), count(text, "[A-Za-z]{3,}")
    signal = letters + digits + math
    share = lambda least: (signal > 0) & (letters >= least * signal)
    usual = (words >= 4) & share(0.82) & (digits <= F.greatest(F.lit(4), F.bround(letters * 0.12)))
    rest = (F.length(text) <= 100) & (words >= 2) & share(0.65) & (digits <= F.greatest(F.lit(12), F.bround(letters * 0.4)))
    return usual | rest


def language_name(code: Column) -> Column:
    """The name that a prompt uses: by the code as given or in lower case, else the code itself; Simplified Chinese without one."""
    plain = F.trim(F.coalesce(code, F.lit("")))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(names[plain], names[F.lower(plain)], F.nullif(plain, F.lit("")), F.lit(LANGUAGES["zh-CN"]))


def base_language(code: Column) -> Column:
    return F.split_part(F.lower(F.trim(F.coalesce(code, F.lit("")))), F.lit("-"), F.lit(1))


def is_word_segmented(code: Column) -> Column:
    return base_language(code).isin(*WORD_SEGMENTED)


def status_kind(status: Column) -> Column:
    """ok, permanent or retry, of an HTTP status."""
    return F.when(status.between(200, 299), "ok").when(status.isin(*PERMANENT), "permanent").when(status.isin(408, 429) | status.between(500, 599), "retry").otherwise("permanent")


def redact(text: Column, limit: int = 200) -> Column:
    """A message without keys and bearer tokens, cut to a limit."""
    return F.left(F.trim(F.regexp_replace(text, r"(?i)(?:sk-[a-z0-9_-]{6,}|Bearer\s+\S+)", "[REDACTED]")), F.lit(limit))


def safe_message(text: Column, secret: Column, generic: str, limit: int = 300) -> Column:
    """A message that may be shown: the secret replaced; a generic one if it is empty or still looks like a key."""
    plain = F.when(F.coalesce(secret, F.lit("")) != "", F.replace(text, secret, F.lit("[REDACTED]"))).otherwise(text)
    return F.when((F.coalesce(plain, F.lit("")) == "") | F.lower(plain).contains("sk-") | F.lower(plain).contains("bearer "), F.lit(generic)).otherwise(F.left(plain, F.lit(limit)))


def is_plain_http_url(url: Column) -> Column:
    """An absolute http(s) address without user, query, fragment, white space and control characters."""
    return F.coalesce(url.rlike(r"^(?i:https?)://(?:[A-Za-z0-9](?:[A-Za-z0-9\-.]*[A-Za-z0-9])?|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?(?:/[^\s?#@\x00-\x1f\x7f]*)?$"), F.lit(False))


def placeholder_issues(text: Column, expected: Column) -> Column:
    """struct(missing, duplicated, unknown): sorted arrays of placeholders, against the expected ones."""
    found = F.regexp_extract_all(text, F.lit("⟦PT[0-9]{4}⟧"), F.lit(0))
    times = lambda p: F.length(text) - F.length(F.replace(text, p, F.lit("")))
    return F.struct(
        F.array_sort(F.array_except(expected, found)).alias("missing"),
        F.array_sort(F.filter(expected, lambda p: times(p) > F.length(p))).alias("duplicated"),
        F.array_sort(F.array_except(found, expected)).alias("unknown"),
    )


def restore(text: Column, tokens: Column) -> Column:
    """Placeholders put back one after another, in the tokens' order."""
    return F.aggregate(tokens, text, lambda t, k: F.replace(t, k["placeholder"], k["value"]))


def title_is_usable(title: Column, stem: Column) -> Column:
    """Whether a file's own title says something."""
    t = F.lower(display(title))
    return ~((F.length(t) < 5) | (t == F.lower(display(stem))) | t.isin("untitled", "document", "microsoft word") | t.startswith("microsoft word -"))


def is_visual_title(title: Column) -> Column:
    """Whether a line on a page can be its title: 5 to 600 characters with a letter, no address and no section's name."""
    t = F.lower(title)
    return F.length(title).between(5, 600) & title.rlike(r"\p{L}") & ~t.rlike("^(?:arxiv:|doi:|https?://)") & ~F.contains(title, F.lit("@")) & ~t.isin("abstract", "introduction", "references")


def shown_title(visual: Column, own: Column, stem: Column, limit: int = 240) -> Column:
    """The title to list a file under: that of its first page, its own if it says something, or the file's name."""
    name = F.nullif(display(stem), F.lit(""))
    return shortened(F.coalesce(F.nullif(visual, F.lit("")), F.when(title_is_usable(own, stem), display(own)), name, F.lit("未命名论文")), limit)
