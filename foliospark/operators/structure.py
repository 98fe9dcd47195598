"""Page structure: what each region is, its column and its reading order.

All rules look at one page at a time, so regions are dealt out once by (doc_id,
page_no) and every rule is a window over that partitioning: captions, formulas
and headings of a page are collected beside its regions, and spatial tests
run against these arrays. A page holds what fits a sheet of paper, so the
arrays are bounded by nature, not by a cap. No page is joined with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from ..functions import geometry as G, text as X

PROTECTED = ("figure", "figure_text", "table_text", "formula", "header", "footer", "page_number")
MATH = "[=∑∫√λσφ±×÷≤≥≈≠∞^_{}⌊⌋ˆ˜−∈∥|<>•/]"
LAST = 1_000_000  # the reading order of regions without one


def page() -> WindowSpec:
    return Window.partitionBy("doc_id", "page_no")


def has_text() -> Column:
    return F.coalesce(F.col("source_text"), F.lit("")) != ""


def relabel(rows: DataFrame, when: Column, kind: str | Column, rule: str | Column, confidence: float, translatable: bool | None = None) -> DataFrame:
    """Give the rows that fit another type, with the rule that did it."""
    when = F.coalesce(when, F.lit(False))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    new = {"type": lit(kind), "structure_rule": lit(rule), "confidence": F.lit(confidence)} | ({} if translatable is None else {"translatable": F.lit(translatable)})
    flagged = rows.withColumn("_hit", when)
    return flagged.withColumns({k: F.when(F.col("_hit"), v).otherwise(F.col(k)) for k, v in new.items()}).drop("_hit")


def base_type(y0: Column, y1: Column, page_height: Column, size: Column, body: Column, text: Column) -> Column:
    """The type by place and size alone; the first rule that fits counts."""
    return (
        F.when(F.trim(text).rlike("^[0-9]+$") & (y0 >= 0.82 * page_height), "page_number").when(y1 <= 0.08 * page_height, "header").when(y0 >= 0.92 * page_height, "footer")
        .when((body > 0) & (size >= 1.35 * body) & (y0 <= 0.45 * page_height), "title").when((body > 0) & (size >= 1.15 * body), "heading").otherwise("paragraph")
    )


def with_body_size(rows: DataFrame) -> DataFrame:
    """body_size: the page's median font size, each region weighted by its lines; 0 if no region counts."""
    counts = F.col("font_size").isNotNull() & (G.width(G.box()) >= 0.22 * F.col("page_width")) & ~F.col("type").isin("title", "header", "footer")
    lines = F.coalesce("line_count", F.greatest(F.lit(1), F.bround(G.height(G.box()) / F.col("font_size")).cast("int")))
    sizes = F.flatten(F.collect_list(F.when(counts, F.array_repeat("font_size", F.least(lines, F.lit(50))))).over(page()))
    # the median of the page's sorted sizes
    sorted_ = F.array_sort(sizes)
    n = F.size(F.col("_sizes"))
    middle = (F.get("_sizes", F.floor((n - 1) / 2).cast("int")) + F.get("_sizes", F.floor(n / 2).cast("int"))) / 2
    return rows.withColumn("_sizes", sorted_).withColumn("body_size", F.coalesce(F.when(n > 0, middle), F.lit(0.0))).drop("_sizes")


def special_regions(rows: DataFrame) -> DataFrame:
    """Margin marks, captions, numbered headings and footnotes."""
    rows = rows.withColumn("_text", X.collapse(F.col("source_text"))).withColumn("_open", (F.col("_text") != "") & (F.col("type") != "figure"))
    upright = F.col("_open") & (G.height(G.box()) > 2.2 * G.width(G.box())) & (F.col("x0") < 0.12 * F.col("page_width"))
    rows = rows.withColumn("_mark", F.coalesce(upright, F.lit(False)))
    rows = relabel(rows, F.col("_mark"), "header", "vertical_margin_mark", 0.95, translatable=False)
    still = F.col("_open") & ~F.col("_mark")
    figure = F.col("_text").rlike(r"(?iU)^(?:figure|fig\.)\s*\d+[.:]?\s*")
    a_table = F.col("_text").rlike(r"(?iU)^table\s*[ivxlcdm\d]+[.:]?\s*")
    bold = F.col("flags").isNull() | (F.col("flags").bitwiseAND(16) != 0)
    numbered = (F.col("type") == "paragraph") & F.col("_text").rlike(r"^\d+(?:\.\d+)*\.?\s+[A-Z][^.!?]{0,100}$") & (F.length("_text") <= 110) & bold
    case = F.when(still & figure, 1).when(still & a_table, 2).when(still & numbered, 3)
    rows = rows.withColumn("_case", case)
    rows = relabel(rows, F.col("_case") == 1, "figure_caption", "figure_caption_prefix", 0.95)
    rows = relabel(rows, F.col("_case") == 2, "table_caption", "table_caption_prefix", 0.95)
    rows = relabel(rows, F.col("_case") == 3, "heading", "numbered_bold_heading", 0.85)
    low = still & (F.col("body_size") > 0) & (F.col("font_size") <= 0.86 * F.col("body_size")) & (F.col("y0") >= 0.82 * F.col("page_height")) & (G.width(G.box()) <= 0.48 * F.col("page_width")) & (F.col("type") == "paragraph")
    return relabel(rows, low, "footnote", "small_bottom_text", 0.8).drop("_mark", "_case")


def front_matter(rows: DataFrame) -> DataFrame:
    """Text between the title and the abstract: the first is the author, the rest affiliations."""
    bottom = F.max(F.when(F.col("type") == "title", F.col("y1"))).over(page())
    top = F.min(F.when((F.col("type") == "heading") & (F.lower("_text") == "abstract"), F.col("y0"))).over(page())
    rows = rows.withColumns({"_top": bottom, "_end": top})
    rows = rows.withColumn("_front", F.coalesce(has_text() & (F.col("type") == "paragraph") & (F.col("y0") >= F.col("_top")) & (F.col("y1") <= F.col("_end")), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("doc_id", "page_no", "_front").orderBy("y0", "region_ord")) == 1
    rows = rows.withColumn("_nth", first)
    plain = ~F.col("_text").contains("@") & ~F.lower("_text").contains("http")
    rows = relabel(rows, F.col("_front"), F.when(F.col("_nth"), "author").otherwise("affiliation"), "between_title_and_abstract", 0.8)
    return rows.withColumn("translatable", F.when(F.col("_front"), plain).otherwise(F.col("translatable"))).drop("_top", "_end", "_front", "_nth")


def collected(kind: Column, *fields: str) -> Column:
    """A page's boxes of a kind, in the order of extraction."""
    return F.transform(F.array_sort(F.collect_list(F.when(kind, F.struct("region_ord", G.box().alias("b"), *fields))).over(page())), lambda x: x)


def figure_text(rows: DataFrame) -> DataFrame:
    """Small text over a figure's caption. Text recognised in an accepted page scan isn't a figure's."""
    rows = rows.withColumns({"_caps": collected(F.col("type") == "figure_caption"), "_backs": collected(F.coalesce("ocr_background", F.lit(False)), "region_id")})
    small = F.coalesce((F.col("body_size") > 0) & (F.col("font_size") < 0.92 * F.col("body_size")), F.lit(False))
    by_id = F.exists("_backs", lambda k: k["region_id"] == F.col("ocr_source_region_id"))
    scan = (F.col("content_source") == "paddleocr") & F.when(F.col("ocr_source_region_id").isNotNull(), by_id).otherwise(F.exists("_backs", lambda k: G.inside(G.box(), k["b"])))

    def fits(cap: Column) -> Column:
        c = cap["b"]
        top = F.greatest(F.lit(0.0), c["y0"] - 0.75 * F.col("page_height"))
        return (F.col("y0") >= top) & (F.col("y1") <= c["y1"] + 2) & (G.overlap_x(G.box(), c) > 0) & ((G.width(G.box()) <= 0.78 * G.width(c)) | small)

    hit = has_text() & (F.col("type") == "paragraph") & ~F.coalesce(scan, F.lit(False)) & F.exists("_caps", fits)
    return relabel(rows, hit, "figure_text", "text_inside_figure_above_caption", 0.82, translatable=False).drop("_caps", "_backs")


def table_text(rows: DataFrame) -> DataFrame:
    """Small, dense or short text near a table's caption; the first caption in extraction order says on which side."""
    rows = rows.withColumn("_caps", collected(F.col("type") == "table_caption"))
    small = F.coalesce((F.col("body_size") > 0) & (F.col("font_size") < 0.92 * F.col("body_size")), F.lit(False))
    numbers, words = X.count(F.col("_text"), r"\d+(?:\.\d+)?"), X.count(F.col("_text"), "[A-Za-z]{2,}")

    def fits(cap: Column) -> Column:
        c = cap["b"]
        top, bottom = F.greatest(F.lit(0.0), c["y0"] - 0.35 * F.col("page_height")), F.least(F.col("page_height"), c["y1"] + 0.35 * F.col("page_height"))
        dense = (numbers >= 3) & (numbers >= 0.5 * words)
        label = (F.length("_text") <= 80) & (words <= 10) & (G.width(G.box()) <= 0.45 * G.width(c))
        return (F.col("y0") >= top) & (F.col("y1") <= bottom) & (G.overlap_x(G.box(), c) > 0) & (small | ((G.width(G.box()) <= 0.9 * G.width(c)) & (dense | label)))

    rows = rows.withColumn("_cap", F.when(has_text() & (F.col("type") == "paragraph"), F.get(F.filter("_caps", fits), F.lit(0))))
    side = F.when(F.col("y1") <= F.col("_cap.b.y0") + 2, "table_text_above_caption").otherwise("table_text_below_caption")
    return relabel(rows, F.col("_cap").isNotNull(), "table_text", side, 0.78, translatable=False).drop("_caps", "_cap")


def formulas(rows: DataFrame) -> DataFrame:
    """Formulas by their signs, then the short pieces beside them, and beside those, until nothing is added.

    The closure is a fold over the page's short pieces, made once a page: each
    step adds the pieces next to those that the last one added.
    """
    t = F.col("_text")
    compact = F.length(F.regexp_replace(t, r"(?U)\s+", ""))
    words, signs, control = X.count(t, "[A-Za-z]{3,}"), X.count(t, MATH), X.count(F.coalesce("source_text", F.lit("")), r"[\x00-\x08\x0E-\x1B]")
    figure = t.rlike(r"\p{Nd}")
    seed = (F.length(t) <= 240) & (
        (control > 0) | (t.contains("=") & (signs >= 2) & (words <= 12)) | ((signs >= 4) & (words <= 8)) | ((signs >= 2) & (F.length(t) <= 80) & (words <= 3))
        | ((signs >= 1) & (F.length(t) <= 12) & (words <= 2)) | ((compact <= 16) & figure & (words <= 1)) | ((F.col("type") == "heading") & (F.length(t) <= 40) & (signs >= 2))
    )
    rows = relabel(rows, has_text() & F.col("type").isin("paragraph", "heading") & seed, "formula", "math_symbol_density", 0.78, translatable=False)
    piece = (words <= 2) & ((compact <= 16) | ((compact <= 50) & ((signs > 0) | figure))) & ~F.lower(t).rlike("^(note|for|if) ")
    label = (F.length(t) <= 40) & t.endswith(":")
    rows = rows.withColumn("_piece", F.coalesce(has_text() & (F.col("type") == "paragraph") & (piece | label), F.lit(False)))
    rows = rows.withColumns({"_seeds": collected(F.col("type") == "formula"), "_pieces": collected(F.col("_piece"))})
    beside = lambda front: lambda p: F.exists(front, lambda k: G.near(p["b"], k["b"], 16, 24))
    ords = lambda x: F.transform(x, lambda p: p["region_ord"])

    def step(s: Column, _: Column) -> Column:
        new = F.filter(s["left"], beside(s["front"]))
        left = F.filter(s["left"], lambda p: ~F.array_contains(ords(new), p["region_ord"]))
        return F.when(F.size(s["front"]) == 0, s).otherwise(F.struct(left.alias("left"), new.alias("front"), F.concat(s["added"], ords(new)).alias("added")))

    start = F.struct(F.col("_pieces").alias("left"), F.col("_seeds").alias("front"), F.array().cast("array<int>").alias("added"))
    added = F.aggregate(F.sequence(F.lit(1), F.size("_pieces")), start, step, lambda s: s["added"])
    some = (F.size("_seeds") > 0) & (F.size("_pieces") > 0) & (F.row_number().over(page().orderBy("region_ord")) == 1)
    rows = rows.withColumn("_made", some).withColumn("_added", F.when(F.col("_made"), added))
    rows = rows.withColumn("_added", F.first("_added", ignorenulls=True).over(page()))
    return relabel(rows, F.col("_piece") & F.array_contains("_added", F.col("region_ord")), "formula", "adjacent_formula_fragment", 0.74, translatable=False).drop("_piece", "_seeds", "_pieces", "_made", "_added")


def columns(rows: DataFrame) -> DataFrame:
    """two_columns for the page, and each region's column: 0 across the page, 1, 2, or null for what isn't body."""
    body = has_text() & ~F.col("type").isin(*PROTECTED)
    middle, half = (F.col("x0") + F.col("x1")) / 2, F.col("page_width") / 2
    tall = F.when(F.col("content_source") == "paddleocr", 6).otherwise(12)
    real = body & G.width(G.box()).between(0.22 * F.col("page_width"), 0.48 * F.col("page_width")) & (G.height(G.box()) >= tall)
    left, right = (F.count_if(F.coalesce(real & side, F.lit(False))).over(page()) for side in (middle < half, middle >= half))
    rows = rows.withColumns({"_l": left, "_r": right})
    two = ((F.col("_l") >= 2) & (F.col("_r") >= 1)) | ((F.col("_l") >= 1) & (F.col("_r") >= 2))
    across = F.col("type").isin("title", "author", "affiliation") | ((F.col("x0") < half) & (F.col("x1") > half) & (G.width(G.box()) >= 0.36 * F.col("page_width")))
    column = F.when(F.col("type").isin(*PROTECTED), F.lit(None).cast("int")).when(across, 0).when(~F.col("two_columns"), 1).when(middle < half, 1).otherwise(2)
    return rows.withColumn("two_columns", two).withColumn("column_index", column).drop("_l", "_r")


def abstracts(rows: DataFrame) -> DataFrame:
    """Paragraphs below an abstract's heading and above the next heading of its column."""
    rows = rows.withColumn("_heads", F.array_sort(F.collect_list(F.when(F.col("type") == "heading", F.struct("y0", "y1", F.lower("_text").alias("t"), "column_index", "region_ord"))).over(page())))

    def holds(h: Column) -> Column:
        later = F.filter("_heads", lambda k: k["column_index"].eqNullSafe(h["column_index"]) & (k["y0"] > h["y0"]))
        end = F.coalesce(F.array_min(F.transform(later, lambda k: k["y0"])), F.col("page_height"))
        return (h["t"] == "abstract") & h["column_index"].eqNullSafe(F.col("column_index")) & (F.col("y0") >= h["y1"]) & (F.col("y0") < end)

    hit = (F.col("type") == "paragraph") & F.exists("_heads", holds)
    return relabel(rows, hit, "abstract", "between_abstract_and_next_heading", 0.85).drop("_heads")


def reading_order(rows: DataFrame) -> DataFrame:
    """reading_order from 1: wide regions on top, the columns, wide regions below; null for the rest."""
    body = has_text() & ~F.col("type").isin(*PROTECTED) & F.col("column_index").isNotNull()
    top = F.coalesce(F.min(F.when(has_text() & F.col("column_index").isin(1, 2), F.col("y0"))).over(page()), F.col("page_height"))
    bucket = F.when(F.col("column_index") > 0, F.col("column_index")).when(F.col("y0") <= F.col("_top") + 12, 0).otherwise(3)
    rows = rows.withColumn("_top", top).withColumn("_body", body)
    order = Window.partitionBy("doc_id", "page_no").orderBy((~F.col("_body")).cast("int"), bucket, "y0", "x0", "region_ord")
    return rows.withColumn("_n", F.row_number().over(order)).withColumn("reading_order", F.when(F.col("_body"), F.col("_n")).cast("int")).drop("_n", "_top", "_body")


def sequence(rows: DataFrame) -> DataFrame:
    """rows with position: a page's regions as they are read, those without an order behind them by place."""
    order = Window.partitionBy("doc_id", "page_no").orderBy(F.col("reading_order").isNull(), "reading_order", "y0", "x0", "region_ord")
    return rows.withColumn("position", F.row_number().over(order))


def references(rows: DataFrame) -> DataFrame:
    """Entries after a references heading, up to the next heading, over the pages of a document.

    Headings are rare, so they alone are put in order by document; a region then
    finds the last one before it by a window over the document's regions.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no", F.coalesce("reading_order", F.lit(LAST)), "region_ord")
    head = F.col("type").isin("title", "heading")
    starts = head & F.lower("_text").isin("references", "reference")
    rows = rows.withColumns({"_head": head, "_on": F.last(F.when(head, starts), ignorenulls=True).over(order)})
    rows = rows.withColumn("_was", F.last(F.when(F.col("_head"), F.col("_on")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    closing = F.col("_head") & ~F.col("_on") & F.coalesce("_was", F.lit(False))
    rows = rows.withColumn("structure_rule", F.when(closing, "post_references_section").otherwise(F.col("structure_rule")))
    rows = relabel(rows, F.col("_head") & F.col("_on"), "heading", "references_heading", 0.95)
    return relabel(rows, ~F.col("_head") & F.col("_on") & F.col("type").isin("paragraph", "footnote"), "reference", "after_references_heading", 0.9, translatable=False).drop("_head", "_on", "_was")


def recover(regions: DataFrame) -> DataFrame:
    """All passes over regions, in their order."""
    rows = with_body_size(regions.withColumn("structure_rule", F.lit(None).cast("string")))
    for step in (special_regions, front_matter, figure_text, table_text, formulas, columns, abstracts, reading_order, references):
        rows = step(rows)
    return rows.drop("_text", "_open")


def page_layout(rows: DataFrame) -> DataFrame:
    """A row for each page: its layout, body font size and how sure that is."""
    two = F.max("two_columns")
    return rows.groupBy("doc_id", "page_no").agg(F.when(two, "two_column").otherwise("single_column").alias("layout"), F.max("body_size").alias("body_font_size"), F.when(two, 0.72).otherwise(0.6).alias("structure_confidence"), F.count("*").alias("regions"))
