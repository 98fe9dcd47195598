"""Comparing recognised with true text, reading maps, gates, task lists and storage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X


def order_similarity(a: Column, b: Column) -> Column:
    """How well the tokens of two texts follow each other."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, (p or "").split(), (q or "").split(), autojunk=False).ratio() for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(run, "double")(a, b)


def page_text(regions: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): a page's text in reading order, the rest by place."""
    item = F.struct(F.col("reading_order").isNull().alias("late"), "reading_order", "y0", "x0", "region_ord", "source_text")
    rows = regions.where(F.coalesce("source_text", F.lit("")) != "").groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("doc_id", "page_no", X.collapse(X.normal(F.array_join(F.transform("items", lambda i: i["source_text"]), " "))).alias("text"))


def character_errors(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, page_no, text, truth) with edits, truth_chars and chars."""
    return pairs.select("doc_id", "page_no", F.levenshtein("text", "truth").cast("long").alias("edits"), F.length("truth").cast("long").alias("truth_chars"), F.length("text").cast("long").alias("chars"), F.size(F.split("truth", " ")).alias("tokens"), "text", "truth")


def ocr_quality(pairs: DataFrame, most_errors: float = 0.12, least_order: float = 0.85, coverage: tuple[float, float] = (0.80, 1.20)) -> DataFrame:
    """A row for each document: error rate, order, coverage, the rules it breaks, passed."""
    rows = character_errors(pairs).withColumn("order", order_similarity(F.col("text"), F.col("truth")))
    whole = rows.groupBy("doc_id").agg(
        (F.sum("edits") / F.greatest(F.sum("truth_chars"), F.lit(1))).alias("character_error_rate"), (F.sum(F.col("order") * F.col("tokens")) / F.greatest(F.sum("tokens"), F.lit(1))).alias("token_order"),
        (F.sum("chars") / F.greatest(F.sum("truth_chars"), F.lit(1))).alias("character_coverage"),
    )
    broken = F.array(F.when(F.col("character_error_rate") > most_errors, "character_error_rate"), F.when(F.col("token_order") < least_order, "token_order"), F.when(~F.col("character_coverage").between(*coverage), "character_coverage"))
    return whole.withColumn("violations", F.filter(broken, lambda v: v.isNotNull())).withColumn("passed", F.size("violations") == 0)


def ems(text: Column) -> Column:
    """A text's width in ems, by the advances of the layout: 1 for wide characters, 0.5 for others."""
    wide = F.regexp_count(text, F.lit(r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{20000}-\x{3FFFD}]"))
    return 0.5 * (F.length(text) + wide)


def reading_map(flows: DataFrame, regions: DataFrame, placed: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, page_no, paragraph): each page's paragraphs with their source and line boxes; those without a box are left out."""
    rows = flows.select("doc_id", "flow_ord", "flow_id", "type", "source_text", "translatable", F.posexplode("region_ids").alias("pos", "region_id"))
    box = F.array(*[F.round(c, 3) for c in ("x0", "y0", "x1", "y1")])
    source = rows.join(regions.select("doc_id", "region_id", "page_no", box.alias("box")), ["doc_id", "region_id"]).groupBy("doc_id", "flow_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("pos", "box"))).alias("s"))
    size = F.col("font_size")
    line = F.array(F.round("x", 3), F.round(F.col("baseline") - 0.95 * size, 3), F.round(F.col("x") + size * ems(F.col("text")), 3), F.round(F.col("baseline") + 0.15 * size, 3))
    target = placed.groupBy("doc_id", "flow_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("box")))).alias("t"), F.max("variant").alias("variant"))
    both = source.join(target, ["doc_id", "flow_id", "page_no"], "full").where("s IS NOT NULL OR t IS NOT NULL")
    said = flows.where("translatable").select("doc_id", "flow_id", "flow_ord", "type", "source_text").join(results.select("doc_id", "flow_id", "normal", "compact"), ["doc_id", "flow_id"])
    none = F.array().cast("array<array<double>>")
    boxes = lambda c: F.coalesce(F.transform(c, lambda i: i["box"]), none)
    return said.join(both, ["doc_id", "flow_id"]).select("doc_id", "page_no", F.struct("flow_id", "type", F.col("flow_ord").alias("order"), "source_text", F.when(F.col("variant") == "compact", F.col("compact")).otherwise(F.col("normal")).alias("translation"), boxes("s").alias("source_boxes"), boxes("t").alias("translation_boxes")).alias("paragraph"))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key, by an aggregation that keeps one row a key and task."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")


def weighted_lower_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value whose running weight reaches half. Equal values are summed first, so a group's rows are its different values."""
    sums = rows.where(f"{weight} > 0 AND {value} IS NOT NULL").groupBy(*by, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*by)
    run = sums.withColumns({"so_far": F.sum("w").over(w.orderBy(value)), "all": F.sum("w").over(w)})
    return run.where("2 * so_far >= all").groupBy(*by).agg(F.min(value).alias("lower_median"))


def top_titles(regions: DataFrame) -> DataFrame:
    """(doc_id, title): the best candidate on a first page by size, width and height on the page; the first of equal ones."""
    text, body, reach = X.display(F.col("source_text")), F.col("body_size"), 0.48 * F.col("page_height")
    large = (body <= 0) | (F.coalesce("font_size", F.lit(0.0)) >= F.greatest(F.lit(11.0), 1.18 * body))
    size = F.coalesce("font_size", F.lit(0.0)) / F.when(body > 0, body).otherwise(10.0)
    wide = F.least(F.lit(1.0), (F.col("x1") - F.col("x0")) / F.greatest(F.lit(1.0), F.col("page_width")))
    high = 1 - F.least(F.lit(1.0), F.col("y0") / F.greatest(F.lit(1.0), reach))
    rows = regions.where((F.col("page_no") == 1) & (F.col("y0") <= reach) & large).withColumn("_title", text).where(X.is_visual_title(F.col("_title")))
    return rows.groupBy("doc_id").agg(F.max_by("_title", F.struct(4 * size + wide + high, -F.col("region_ord"))).alias("title"))


def gate(results: DataFrame, gates: list[str], by: str = "doc_id") -> DataFrame:
    """passed where every gate column is true; the failed ones by name."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(F.col(g), F.lit(False)), g) for g in gates]), lambda g: g.isNotNull())
    return results.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


def publish(new: DataFrame, gates: DataFrame, path: str, by: str = "doc_id") -> DataFrame:
    """Write rows whose key passed every gate, a folder for each run; what was published before stays as it was."""
    import uuid

    target = f"{path}/run={uuid.uuid4().hex}"
    new.join(gates.where("passed").select(by), by, "left_semi").write.parquet(target)
    return new.sparkSession.read.parquet(target)


def unreferenced(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Files (path) below none of the kept paths' folders: by equality on every parent folder, not by prefix scans."""
    parts = F.split("path", "/")
    parents = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up"))
    used = parents.join(kept.select(F.col("path").alias("up")).distinct(), "up", "left_semi").select("path").distinct()
    return files.join(used, "path", "left_anti")
