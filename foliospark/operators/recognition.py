"""Recognised lines as regions: from polygons in pixels to boxes on the page, beside native text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G
from .ocr_plan import without_duplicates


def box_of(polygon: Column, clip: Column, pixels: Column, page_width: Column, page_height: Column) -> Column:
    """The box of a polygon (array of struct x, y in pixels of a rendered clip), on the page and within it."""
    x = F.transform(polygon, lambda p: clip["x0"] + p["x"] * (G.width(clip) / pixels["width"]))
    y = F.transform(polygon, lambda p: clip["y0"] + p["y"] * (G.height(clip) / pixels["height"]))
    on = lambda v, end: F.greatest(F.lit(0.0), F.least(end, v))
    return F.struct(on(F.array_min(x), page_width).alias("x0"), on(F.array_min(y), page_height).alias("y0"), on(F.array_max(x), page_width).alias("x1"), on(F.array_max(y), page_height).alias("y1"))


def proposed(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page_no, line_no, text, confidence, polygon, clip, pixels, page size) with box, font_size and rejected: blank ones and slivers."""
    rows = lines.withColumn("b", box_of(F.col("polygon"), F.col("clip"), F.col("pixels"), F.col("page_width"), F.col("page_height")))
    rejected = (F.trim(F.coalesce("text", F.lit(""))) == "") | (F.col("b.x1") - F.col("b.x0") < 0.5) | (F.col("b.y1") - F.col("b.y0") < 0.5)
    rows = rows.withColumns({"rejected": rejected, "font_size": F.greatest(F.lit(6.0), (F.col("b.y1") - F.col("b.y0")) * 0.78), "content_confidence": F.round("confidence", 4)})
    return rows.select("*", "b.*").drop("b")


def image_candidates(regions: DataFrame) -> DataFrame:
    """Images that are large enough to hold text."""
    area = F.greatest(F.lit(1.0), F.col("page_width") * F.col("page_height"))
    wide, high = G.width(G.box()) / F.greatest(F.lit(1.0), F.col("page_width")), G.height(G.box()) / F.greatest(F.lit(1.0), F.col("page_height"))
    return regions.where((F.col("native_block_type") == "image") & (wide >= 0.25) & (high >= 0.12) & (G.width(G.box()) * G.height(G.box()) / area >= 0.08))


def with_scan_background(regions: DataFrame) -> DataFrame:
    """Images over three fifths of a page are its scan."""
    area = F.greatest(F.lit(1.0), F.col("page_width") * F.col("page_height"))
    scan = (F.col("native_block_type") == "image") & (G.width(G.box()) * G.height(G.box()) / area >= 0.60)
    return regions.withColumn("ocr_background", F.coalesce("ocr_background", F.lit(False)) | F.coalesce(scan, F.lit(False)))


def text_heavy(lines: DataFrame, by: list[str]) -> DataFrame:
    """Keys of the images whose lines are worth keeping: three at least, of 80 characters, at a mean confidence of 0.8."""
    chars = F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", "")))
    return lines.groupBy(*by).agg(F.count("*").alias("n"), chars.alias("chars"), F.avg("confidence").alias("sure")).where("n >= 3 AND chars >= 80 AND sure >= 0.8").select(*by)


def numbered(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines with region_id, numbered on after a page's recognised regions."""
    there = regions.where("content_source = 'paddleocr'").groupBy("doc_id", "page_no").agg(F.count("*").alias("_had"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("line_no")) - 1 + F.coalesce("_had", F.lit(0))
    rows = lines.join(there, ["doc_id", "page_no"], "left").withColumn("_n", nth)
    return rows.withColumn("region_id", F.concat(F.lit("p"), "page_no", F.lit("-ocr-"), "_n")).drop("_n", "_had")


def added(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """The recognised lines that become regions of their pages: not rejected, not there as native text, numbered on."""
    native = regions.where("content_source = 'native_pdf' AND coalesce(source_text, '') <> ''")
    rows = proposed(lines).where("NOT rejected").withColumn("region_ord", F.col("line_no"))
    return numbered(without_duplicates(rows, native).drop("region_ord"), regions)


def run_counters(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, pages, lines, rejected, recognised, duplicates) of a run."""
    seen = proposed(lines).groupBy("doc_id").agg(F.count_distinct("page_no").alias("candidate_pages"), F.count("*").alias("lines"), F.count_if("rejected").alias("rejected_lines"))
    got = kept.groupBy("doc_id").agg(F.count_distinct("page_no").alias("recognized_pages"), F.count("*").alias("recognized_lines"))
    out = seen.join(got, "doc_id", "left").fillna(0, ["recognized_pages", "recognized_lines"])
    return out.withColumn("duplicate_lines", F.col("lines") - F.col("rejected_lines") - F.col("recognized_lines"))


def redaction_box(regions: DataFrame) -> DataFrame:
    """regions with rx0..ry1: what is wiped before a translation is drawn, recognised text with a margin, within the page."""
    ocr = F.col("content_source") == "paddleocr"
    dx, dy = F.when(ocr, 2.0).otherwise(0.0), F.when(ocr, 1.25).otherwise(0.0)
    return regions.withColumns({"rx0": F.greatest(F.lit(0.0), F.col("x0") - dx), "ry0": F.greatest(F.lit(0.0), F.col("y0") - dy), "rx1": F.least("page_width", F.col("x1") + dx), "ry1": F.least("page_height", F.col("y1") + dy)})


def redactions(regions: DataFrame, drawn: DataFrame) -> DataFrame:
    """(doc_id, page_no, region_ord, pieces, cutouts) of the drawn regions (doc_id, region_id): what is wiped of each, around protected boxes.

    A page's protected boxes are an array beside its regions, bounded by the sheet.
    """
    guard = ~F.col("translatable") & ~F.coalesce("ocr_background", F.lit(False))
    wide = F.struct(*[(F.col(c) + d).alias(c) for c, d in (("x0", -0.5), ("y0", -0.5), ("x1", 0.5), ("y1", 0.5))], F.col("region_ord").alias("o"))
    page = Window.partitionBy("doc_id", "page_no")
    rows = redaction_box(regions).withColumn("_guards", F.array_sort(F.collect_list(F.when(guard, wide)).over(page), lambda a, b: a["o"] - b["o"]))
    rows = rows.join(drawn.select("doc_id", "region_id").distinct(), ["doc_id", "region_id"], "left_semi")
    own = F.struct(F.col("rx0").alias("x0"), F.col("ry0").alias("y0"), F.col("rx1").alias("x1"), F.col("ry1").alias("y1"))
    return rows.select("doc_id", "page_no", "region_ord", G.cut_out(own, F.col("_guards")).alias("pieces"), G.cut_outs(own, F.col("_guards")).alias("cutouts"))
