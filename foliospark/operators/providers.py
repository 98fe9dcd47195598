"""Providers by name, the checks of a request, translating in batches that stay, and the gates of a round trip."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from . import translate as TR

#: Names of providers, and the most characters of a text and of a selection.
NAMES = ("mock", "deepseek", "kimi", "zhipu", "compatible")
MOST_TEXT, MOST_SELECTED = 20_000, 300
MODES = ("standalone_text", "selected_text")

#: Made by name on executors; a name is never replaced by another.
_makers: dict[str, Callable[[dict], TR.Provider]] = {}


def register(name: str, make: Callable[[dict], TR.Provider]) -> None:
    if name not in NAMES:
        raise ValueError(f"unknown provider: {name}")
    _makers[name] = make


def mock(options: dict) -> TR.Provider:
    factor = float(options.get("length_factor", 1.0))

    def said(text: str, more: float) -> str:
        n = max(1, round(len("".join((text or "").split())) * 0.55 * factor * more))
        return (TR.SAMPLE * n)[:n]

    return lambda batch: pd.DataFrame({"cache_key": batch["cache_key"], "normal": [said(t, 1.0) for t in batch["text"]], "compact": [said(t, 0.82) for t in batch["text"]]})


register("mock", mock)


def maker(name: str, options: dict | None = None) -> Callable[[], TR.Provider]:
    """What builds a task's provider; remote ones have to be registered, since there is no client here."""
    name, options = name.lower(), options or {}
    if name not in NAMES:
        raise ValueError(f"unknown provider: {name}")
    if name != "compatible" and {"base_url", "api_key_env"} & options.keys():
        raise ValueError("an address and a key's name are for compatible providers only")
    if name not in _makers:
        raise ValueError(f"no client is registered for {name}")
    make = _makers[name]
    return lambda: make(options)


def request_problem(text: Column, mode: Column, provider: Column, has_key: Column, base_url: Column, model: Column, source: Column, target: Column) -> Column:
    """The first rule that a text request breaks; null if it may be sent."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(blank(text), "empty_text").when(F.length(text) > MOST_TEXT, "text_too_long").when((mode == "selected_text") & (F.length(text) > MOST_SELECTED), "selection_too_long")
        .when(~F.coalesce(mode.isin(*MODES), F.lit(False)), "unknown_mode").when(~F.coalesce(provider.isin(*NAMES), F.lit(False)), "unknown_provider").when((provider != "mock") & ~F.coalesce(has_key, F.lit(False)), "missing_key")
        .when((provider == "compatible") & (blank(base_url) | blank(model)), "missing_address_or_model").when((provider == "compatible") & ~X.is_plain_http_url(base_url), "bad_address").when(blank(source) | blank(target), "missing_language")
    )


def translate_in_batches(spark: SparkSession, requests: DataFrame, cache_path: str, make: Callable[[], TR.Provider], batches: int = 8) -> DataFrame:
    """Results of requests (cache_key, text), a batch of keys after another; each batch is in the cache once it is done.

    A failure stops the run, and what was done stays: the next run asks for the rest only.
    """
    from ..sources.sinks import read_cache, write_cache

    def cached() -> DataFrame:
        try:
            return read_cache(spark, cache_path)[0]
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return spark.createDataFrame([], "cache_key string, provider string, normal string, compact string")

    for k in range(batches):
        part = requests.where(F.pmod(F.xxhash64("cache_key"), F.lit(batches)) == k)
        _, fresh = TR.translate(part, cached(), make)
        write_cache(fresh.withColumn("provider", F.lit("run")).select("cache_key", "provider", "normal", "compact"), cache_path)
    return requests.join(cached().drop("provider"), "cache_key", "left")


def round_trip_gates(quality: DataFrame, skipped: DataFrame) -> DataFrame:
    """quality of reports.round_trip with the five gates, by name, and passed. skipped: (doc_id) of documents with regions that weren't drawn."""
    from .quality import gate

    none = skipped.select("doc_id").distinct().withColumn("_skipped", F.lit(True))
    rows = quality.join(none, "doc_id", "left").withColumns({"no_skipped_regions": F.col("_skipped").isNull(), "text_similarity_at_least_0_98": F.col("mean_text_similarity") >= 0.98}).drop("_skipped")
    return gate(rows, ["same_page_count", "same_page_dimensions", "links_preserved", "no_skipped_regions", "text_similarity_at_least_0_98"])
