"""Which pages need text recognition: measures of a page, then one ordered decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

POLICY = {"reliable_chars": 80, "sparse_chars": 12, "min_quality": 0.85, "scan_coverage": 0.60, "min_ocr_chars": 40, "min_ocr_confidence": 0.80}


def coverage(boxes: DataFrame) -> DataFrame:
    """(doc_id, page_no, coverage): share of a page that the union of its boxes covers.

    Slabs between neighbouring x edges; in each, intervals of y are merged by a
    running maximum of their ends.
    """
    key = ["doc_id", "page_no"]
    clip = lambda c, most: F.greatest(F.lit(0.0), F.least(F.col(most), F.col(c)))
    b = boxes.select(*key, "page_width", "page_height", *[clip(c, "page_width" if c[0] == "x" else "page_height").alias(c) for c in ("x0", "y0", "x1", "y1")]).where("x1 > x0 AND y1 > y0")
    xs = b.select(*key, F.explode(F.array("x0", "x1")).alias("left")).distinct()
    slabs = xs.withColumn("right", F.lead("left").over(Window.partitionBy(*key).orderBy("left"))).where("right IS NOT NULL")
    hit = slabs.join(b, key).where("x0 < right AND x1 > left")
    w = Window.partitionBy(*key, "left").orderBy("y0", "y1")
    top = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = hit.withColumn("covered", F.greatest(F.lit(0.0), F.col("y1") - F.greatest("y0", F.coalesce(top, F.col("y0")))) * (F.col("right") - F.col("left")))
    return part.groupBy(*key).agg(F.least(F.lit(1.0), F.sum("covered") / F.max(F.col("page_width") * F.col("page_height"))).alias("coverage"))


def diagnostics(regions: DataFrame) -> DataFrame:
    """A row for each page with what the decision looks at."""
    text = F.regexp_replace(F.coalesce("source_text", F.lit("")), r"(?U)\s", "")
    native, ocr = F.col("content_source") == "native_pdf", F.col("content_source") == "paddleocr"
    some = F.coalesce("source_text", F.lit("")) != ""
    chars = F.length(text)
    good = chars - F.regexp_count(text, F.lit(r"[\x{FFFD}\p{Cc}\p{Cs}\p{Co}]"))
    total = lambda when, what: F.coalesce(F.sum(F.when(when & some, what)), F.lit(0)).cast("long")
    page = regions.groupBy("doc_id", "page_no").agg(
        total(native, chars).alias("native_chars"), F.count_if(native & some).alias("native_regions"), total(native, good).alias("good_chars"), F.max(F.greatest("drawing_count", F.lit(0))).alias("drawings"),
        total(ocr, chars).alias("ocr_chars"), F.count_if(ocr & some).alias("ocr_regions"), F.coalesce(F.avg(F.when(ocr & some, F.col("confidence"))), F.lit(0.0)).alias("ocr_confidence"),
    )
    page = page.withColumn("quality", F.when(F.col("native_chars") > 0, F.col("good_chars") / F.col("native_chars")).otherwise(1.0)).drop("good_chars")
    covered = coverage(regions.where("native_block_type = 'image'"))
    return page.join(covered, ["doc_id", "page_no"], "left").fillna(0.0, ["coverage"])


def decide(pages: DataFrame, policy: dict[str, float] | None = None) -> DataFrame:
    """action, reason and confidence; the first rule that fits counts."""
    p = POLICY | (policy or {})
    n, ocr, sure, scan = F.col("native_chars"), F.col("ocr_chars"), F.col("ocr_confidence"), F.col("coverage") >= p["scan_coverage"]

    def outcome(action: str, reason: str, confidence) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"), (confidence if isinstance(confidence, Column) else F.lit(float(confidence))).alias("confidence"))

    read = (ocr >= p["min_ocr_chars"]) & (sure >= p["min_ocr_confidence"])
    odd = (n > 0) & (F.col("quality") < p["min_quality"])
    case = (
        F.when(read & (n > 0), outcome("use_mixed", "confident_native_and_local_ocr", sure)).when(read, outcome("use_ocr", "confident_local_ocr", sure)).when(ocr > 0, outcome("review", "insufficient_local_ocr", sure))
        .when(odd & scan, outcome("run_ocr", "unreliable_native_text", 0.9)).when(odd, outcome("review", "unreliable_native_text", 0.7)).when(n >= p["reliable_chars"], outcome("keep_native", "reliable_native_text", 0.98))
        .when(scan & (n <= p["sparse_chars"]), outcome("run_ocr", "scan_like_page_without_native_text", 0.95)).when(scan, outcome("review", "sparse_text_over_large_raster", 0.75))
        .when(n > 0, outcome("keep_native", "sparse_native_text_without_scan_evidence", 0.8)).when(F.col("drawings") > 0, outcome("review", "vector_content_without_native_text", 0.7))
        .when(F.col("coverage") > 0, outcome("review", "raster_content_without_page_scan_evidence", 0.65)).otherwise(outcome("skip_blank", "empty_page", 0.98))
    )
    return pages.withColumn("_d", case).select("*", "_d.*").drop("_d")


def summary(decided: DataFrame) -> DataFrame:
    """A row for each document: pages by action, and those that block a translation."""
    actions = ("keep_native", "run_ocr", "use_ocr", "use_mixed", "review", "skip_blank")
    blocking = F.array_sort(F.collect_list(F.when(F.col("action").isin("run_ocr", "review"), F.col("page_no"))))
    return decided.groupBy("doc_id").agg(F.count("*").alias("pages"), *[F.count_if(F.col("action") == a).alias(a) for a in actions], blocking.alias("blocking_pages"))


def with_decisions(regions: DataFrame, decided: DataFrame) -> DataFrame:
    """regions with their page's action and reason."""
    return regions.join(decided.select("doc_id", "page_no", "action", "reason"), ["doc_id", "page_no"], "left")


def blocked(decided: DataFrame) -> DataFrame:
    """(doc_id, page_no) of pages that stand against a translation."""
    return decided.where(F.col("action").isin("run_ocr", "review")).select("doc_id", "page_no")


def unblocked(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows (doc_id, ...) to translate; a document with a blocked page is an error, before any provider is called."""
    bad = blocked(decided).groupBy("doc_id").agg(F.min("page_no").alias("_page"))
    checked = rows.join(bad, "doc_id", "left")
    ok = F.when(F.col("_page").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a page has to be recognised or reviewed first: "), F.col("_page").cast("string"))))
    return checked.where(ok).drop("_page")


def without_duplicates(ocr: DataFrame, native: DataFrame) -> DataFrame:
    """OCR lines of which less than half lies on a native region of the page."""
    from ..functions import geometry as G

    a, b = ocr.withColumn("_a", G.box()), native.select("doc_id", "page_no", G.box().alias("_b"))
    own = F.greatest(F.lit(1.0), G.width(F.col("_a")) * G.height(F.col("_a")))
    return a.join(b, (a["doc_id"] == b["doc_id"]) & (a["page_no"] == b["page_no"]) & (G.intersection(F.col("_a"), F.col("_b")) >= 0.5 * own), "left_anti").drop("_a")
