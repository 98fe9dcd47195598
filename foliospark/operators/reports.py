"""Statistics of a job's parts, its report, and what a viewer looks up in it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from .quality import order_similarity


def protection_stats(segments: DataFrame, validations: DataFrame) -> DataFrame:
    """One row a document: segments (tokens array), and validations (restored, missing, duplicated, unknown)."""
    of = segments.groupBy("doc_id").agg(F.count("*").alias("segment_count"), F.count_if(F.size("tokens") > 0).alias("protected_segment_count"), F.sum(F.size("tokens")).cast("long").alias("token_count"))
    bad = ("missing", "duplicated", "unknown")
    passed = F.size("missing") + F.size("duplicated") + F.size("unknown") == 0
    found = validations.groupBy("doc_id").agg(F.sum("restored").cast("long").alias("restored_token_count"), *[F.sum(F.size(c)).cast("long").alias(f"{c}_token_count") for c in bad], F.bool_and(passed).alias("passed"))
    counts = ["restored_token_count", *(f"{c}_token_count" for c in bad)]
    return of.join(found, "doc_id", "left").fillna(0, counts).withColumn("passed", F.coalesce("passed", F.lit(True)))


def flow_fonts(flows: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, flow_id, font_size, bold): the median of a flow's region sizes, and whether half of them are bold."""
    rows = flows.select("doc_id", "flow_id", "type", F.explode("region_ids").alias("region_id")).join(regions.select("doc_id", "region_id", "font_size", "flags"), ["doc_id", "region_id"], "left")
    size = F.median(F.when(F.col("font_size") > 0, F.col("font_size")))
    heavy = F.coalesce(F.avg(F.when(F.col("flags").isNotNull(), (F.col("flags").bitwiseAND(16) != 0).cast("int"))) >= 0.5, F.lit(False))
    return rows.groupBy("doc_id", "flow_id").agg(F.coalesce(size, F.lit(10.0)).alias("font_size"), (F.first("type").isin("title", "heading") | heavy).alias("bold"))


def layout_stats(placed: DataFrame, floor: float) -> DataFrame:
    """One row a document over its laid-out lines: flows that fit, compact and reduced ones, least size and scale, what is left over."""
    flows = placed.groupBy("doc_id", "flow_id").agg(F.bool_and("fit").alias("fit"), F.max("variant").alias("variant"), F.min("font_size").alias("size"), F.max("original_size").alias("was"), F.count("*").alias("lines"), F.max("rest_chars").alias("rest"), F.max("blocked_slots").alias("blocked"))
    smaller = F.col("size") < F.col("was")
    return flows.groupBy("doc_id").agg(
        F.count("*").alias("flow_count"), F.count_if("fit").alias("fit_flow_count"), F.count_if(~F.col("fit")).alias("overflow_flow_count"), F.count_if(F.col("variant") == "compact").alias("compact_flow_count"),
        F.count_if(smaller).alias("reduced_font_flow_count"), F.round(F.min("size"), 3).alias("minimum_font_size"), F.lit(floor).alias("minimum_font_scale_floor"),
        F.round(F.min(F.col("size") / F.greatest(F.lit(0.001), F.col("was"))), 4).alias("minimum_font_scale"), F.count_if(smaller & (F.col("size") < 6)).alias("new_sub_6pt_flow_count"),
        F.sum("lines").cast("long").alias("line_count"), F.sum("rest").cast("long").alias("overflow_characters"), F.sum("blocked").cast("long").alias("blocked_line_slot_count"),
    )


def font_style(name: Column, flags: Column) -> Column:
    """struct(family, bold, italic, builtin) of a font's name and flags."""
    n = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("+"), F.lit(""))
    of = F.coalesce(flags, F.lit(0))
    bold = (of.bitwiseAND(16) != 0) | n.rlike("bold|cmbx|cmssbx|-bd|black")
    italic = (of.bitwiseAND(2) != 0) | n.rlike("italic|oblique|cmti|cmmi|-it")
    family = F.when(n.rlike("courier|mono|cmtt"), "courier").when(n.rlike("helvetica|arial|sans|cmss"), "arial").otherwise("times")
    start = F.when(family == "courier", "co").when(family == "arial", "he").otherwise("ti")
    plain = F.when(family == "courier", "cour").when(family == "arial", "helv").otherwise("tiro")
    builtin = F.when(~bold & ~italic, plain).otherwise(F.concat(start, F.when(bold & italic, "bi").when(bold, "bo").otherwise("it")))
    return F.struct(family.alias("family"), bold.alias("bold"), italic.alias("italic"), builtin.alias("builtin"))


def rgb(color: Column) -> Column:
    """struct(r, g, b) from 0 to 1 of a colour as one number."""
    part = lambda shift: F.shiftright(color, shift).bitwiseAND(255) / 255
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def font_counts(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """(doc_id, spans, fonts): how many spans each font draws, as a map."""
    each = spans.groupBy(by, "font").agg(F.count("*").alias("n"))
    return each.groupBy(by).agg(F.sum("n").cast("long").alias("spans"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("font", "n")))).alias("fonts"))


def round_trip(source: DataFrame, output: DataFrame) -> DataFrame:
    """One row a document: pages (doc_id, page_no, text, width, height, links, samples) of both files, compared where both have the page.

    samples: the grey values of a page as binary; a difference over 8 counts as
    changed. They are compared in Arrow batches, a page at a time.
    """
    def gap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None or len(x) != len(y):
                out.append((1.0, 1.0))
                continue
            d = np.abs(np.frombuffer(x, np.uint8).astype(np.int16) - np.frombuffer(y, np.uint8))
            out.append((round(float(d.sum()) / (255 * max(1, len(d))), 6), round(float((d > 8).sum()) / max(1, len(d)), 6)))
        return pd.DataFrame(out, columns=["error", "changed"])

    text = lambda c: X.collapse(X.normal(F.coalesce(c, F.lit(""))))
    a = source.select("doc_id", "page_no", text(F.col("text")).alias("text"), "width", "height", "samples")
    b = output.select("doc_id", "page_no", text(F.col("text")).alias("text2"), F.col("width").alias("width2"), F.col("height").alias("height2"), F.col("samples").alias("samples2"))
    both = a.join(b, ["doc_id", "page_no"]).withColumn("g", F.pandas_udf(gap, "struct<error:double,changed:double>")("samples", "samples2"))
    both = both.withColumns({"same": (F.col("width") == F.col("width2")) & (F.col("height") == F.col("height2")), "alike": F.round(order_similarity(F.col("text"), F.col("text2")), 6)})
    pages = both.groupBy("doc_id").agg(F.bool_and("same").alias("same_page_dimensions"), F.round(F.avg("alike"), 6).alias("mean_text_similarity"), F.round(F.avg("g.error"), 6).alias("mean_visual_error"), F.round(F.avg("g.changed"), 6).alias("mean_changed_fraction"))
    size = lambda rows, k: rows.groupBy("doc_id").agg(F.count("*").alias(f"{k}_page_count"), F.sum("links").cast("long").alias(f"{k}_link_count"))
    out = size(source, "source").join(size(output, "output"), "doc_id").join(pages, "doc_id", "left")
    return out.withColumns({"same_page_count": F.col("source_page_count") == F.col("output_page_count"), "links_preserved": F.col("source_link_count") == F.col("output_link_count")})


def paired_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """The n-th page of one document beside the n-th of another, up to the shorter one: by position, not by number."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    place = lambda rows: rows.withColumn("place", F.row_number().over(order))
    return place(a).select("doc_id", "place", F.col("page_no"), F.col("text")).join(place(b).select("doc_id", "place", F.col("page_no").alias("page_no2"), F.col("text").alias("truth")), ["doc_id", "place"])


def inspection(pages: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, report): a document's page table and counts as Markdown. pages: (doc_id, page_no, regions, translatable, action); stats: of the flows."""
    line = F.concat(F.lit("| "), F.col("page_no").cast("string"), F.lit(" | "), F.col("regions").cast("string"), F.lit(" | "), F.col("translatable").cast("string"), F.lit(" | "), F.col("action"), F.lit(" |"))
    table = pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    item = lambda name, c: F.concat(F.lit(f"- {name}: "), F.coalesce(F.col(c), F.lit(0)).cast("string"))
    head = F.concat_ws("\n", F.lit("# PDF inspection report"), F.lit(""), item("Pages", "n"), item("Text flows", "flow_count"), item("Merged flows", "merged_flow_count"), item("Cross-column continuations", "cross_column_edges"), item("Cross-page continuations", "cross_page_edges"), item("Dehyphenation decisions", "dehyphenation_count"), F.lit(""), F.lit("## Page summary"), F.lit(""), F.lit("| Page | Regions | Translatable | OCR action |"), F.lit("| ---: | ---: | ---: | --- |"), F.col("lines"), F.lit(""))
    return table.join(stats, "doc_id", "left").select("doc_id", head.alias("report"))


# ------------------------------------------------------------------- viewer


def page_window(page: Column, pages: Column, radius: int = 2) -> Column:
    """The pages around one, within a document; none of an empty document."""
    at = F.least(F.greatest(page, F.lit(1)), pages)
    return F.when(pages > 0, F.sequence(F.greatest(F.lit(1), at - radius), F.least(pages, at + radius))).otherwise(F.array().cast("array<int>"))


def page_changes(wanted: Column, held: Column) -> Column:
    """struct(kept, missing, dropped) of the pages that a viewer holds."""
    return F.struct(F.array_intersect(held, wanted).alias("kept"), F.array_except(wanted, held).alias("missing"), F.array_except(held, wanted).alias("dropped"))


def paragraph_at(points: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """points (doc_id, page_no, point_id, x, y, tolerance) with flow_id: the first paragraph, by order, one of whose boxes (x0, y0, x1, y1) holds the point.

    A page's paragraphs are bounded by the sheet; points meet their own page's only.
    """
    t = F.col("tolerance")
    hit = (F.col("x") >= F.col("x0") - t) & (F.col("x") <= F.col("x1") + t) & (F.col("y") >= F.col("y0") - t) & (F.col("y") <= F.col("y1") + t)
    found = points.join(paragraphs, ["doc_id", "page_no"]).where(hit).groupBy("doc_id", "page_no", "point_id").agg(F.min_by("flow_id", "order").alias("flow_id"))
    return points.join(found, ["doc_id", "page_no", "point_id"], "left")


def selections(points: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, page_no, selection_id, flow_id) of selections whose points all lie in one paragraph."""
    rows = paragraph_at(points, paragraphs).groupBy("doc_id", "page_no", "selection_id").agg(F.bool_and(F.col("flow_id").isNotNull()).alias("all"), F.count_distinct("flow_id").alias("n"), F.min("flow_id").alias("flow_id"))
    return rows.where("all AND n = 1").select("doc_id", "page_no", "selection_id", "flow_id")


def selected_text(text: Column) -> Column:
    """What is translated of a selection: 300 characters, blanks collapsed; null if nothing is left."""
    return F.nullif(F.left(X.collapse(text), F.lit(300)), F.lit(""))


def linked_page(page: Column, pages: Column) -> Column:
    """Where the other side shows a paragraph: the same page if it is there, else its first."""
    return F.when(F.array_contains(pages, page), page).otherwise(F.get(pages, F.lit(0)))
