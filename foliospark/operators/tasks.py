"""The task list: an event log of task rows, read as the latest row of each task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .quality import latest

KEPT = ("id", "kind", "title", "provider", "status", "message", "created_at", "updated_at", "character_count")
UNSEEN = "文本内容不可用"


def current(events: DataFrame) -> DataFrame:
    """The tasks that aren't deleted, each by its last event: events (id, seq, deleted, ...)."""
    return latest(events.where("id IS NOT NULL"), "id", F.col("seq")).where(~F.coalesce("deleted", F.lit(False))).drop("deleted", "seq")


def queued_pdf(id_: Column, path: Column, folder: Column, provider: Column, now: Column, title: Column) -> Column:
    """The first event of a task on a file."""
    return F.struct(id_.alias("id"), F.lit("pdf").alias("kind"), title.alias("title"), F.lit(True).alias("title_resolved"), provider.alias("provider"), F.lit("queued").alias("status"), now.alias("created_at"), now.alias("updated_at"), path.alias("source_path"), folder.alias("output_dir"))


def finished_text(id_: Column, text: Column, provider: Column, now: Column) -> Column:
    """The only event of a translated text; its body is a row of its own table."""
    return F.struct(id_.alias("id"), F.lit("text").alias("kind"), F.lit("文本翻译").alias("title"), provider.alias("provider"), F.lit("completed").alias("status"), now.alias("created_at"), now.alias("updated_at"), F.length(text).cast("long").alias("character_count"))


def summaries(tasks: DataFrame, bodies: DataFrame) -> DataFrame:
    """Tasks as a list shows them, last change first; texts with a preview of their body (id, text)."""
    shown = tasks.join(bodies.select("id", X.preview(F.col("text")).alias("preview")), "id", "left")
    preview = F.when(F.col("kind") == "text", F.coalesce(F.nullif("preview", F.lit("")), F.lit(UNSEEN)))
    return shown.select(*[c for c in KEPT if c in tasks.columns], preview.alias("preview")).orderBy(F.desc("updated_at"), "id")


def detail(tasks: DataFrame, bodies: DataFrame, ids: DataFrame) -> DataFrame:
    """The asked tasks (id) with the whole bodies of texts."""
    return ids.select("id").distinct().join(tasks, "id").join(bodies.select("id", F.col("text").alias("source_text")), "id", "left")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def named_by_file(title: Column, path: Column, resolved: Column) -> Column:
    """Whether a title is only the file's name, and a better one hasn't been looked for."""
    shown, name = F.lower(X.display(title)), F.regexp_extract(path, "([^/]*)$", 1)
    return ~F.coalesce(resolved, F.lit(False)) & ((shown == "") | F.coalesce((path != "") & shown.isin(F.lower(name), F.lower(stem(path))), F.lit(False)))


def with_titles(tasks: DataFrame, titles: DataFrame) -> DataFrame:
    """Tasks on files that are named by the file get the found title (source_path, found), once."""
    due = (F.col("kind") == "pdf") & named_by_file(F.col("title"), F.col("source_path"), F.col("title_resolved")) & (F.coalesce("source_path", F.lit("")) != "")
    rows = tasks.join(titles.select("source_path", "found"), "source_path", "left").withColumn("_due", due)
    return rows.withColumns({"title": F.when(F.col("_due"), F.coalesce(F.nullif("found", F.lit("")), F.col("title"))).otherwise(F.col("title")), "title_resolved": F.col("_due") | F.coalesce("title_resolved", F.lit(False))}).drop("_due", "found")


def removed(ids: DataFrame, seq: Column) -> DataFrame:
    """Events that delete tasks; a file's own task doesn't touch the file."""
    return ids.select("id", seq.alias("seq"), F.lit(True).alias("deleted"))


def may_remove(tasks: DataFrame) -> DataFrame:
    """Tasks that may be deleted: not those at work."""
    return tasks.where(~F.col("status").isin("queued", "running"))


def source_paths(tasks: DataFrame, active_only: bool = False) -> DataFrame:
    """The different files that tasks are on."""
    rows = tasks.where((F.col("kind") == "pdf") & (F.coalesce("source_path", F.lit("")) != ""))
    return (rows.where(F.col("status").isin("queued", "running")) if active_only else rows).select("source_path").distinct()


def retained_paths(*of: DataFrame) -> DataFrame:
    """All paths that some table still needs, each once."""
    out = of[0].select("source_path")
    for more in of[1:]:
        out = out.union(more.select("source_path"))
    return out.distinct()


def public_report(report: Column) -> Column:
    """What may be shown of a report (a JSON text): whether it passed, overflows, overlaps and the least font size."""
    v = F.try_parse_json(report)
    whole = lambda path: F.coalesce(F.try_variant_get(v, path, "bigint"), F.lit(0).cast("bigint"))
    return F.when(
        v.isNotNull(),
        F.struct(
            F.coalesce(F.try_variant_get(v, "$.passed", "boolean"), F.lit(False)).alias("passed"), whole("$.layout.overflow_flow_count").alias("overflow_count"),
            whole("$.layout_safety.counts.translated_overlap").alias("overlap_count"), F.try_variant_get(v, "$.layout.minimum_font_size", "double").alias("minimum_font_size"),
        ),
    )
