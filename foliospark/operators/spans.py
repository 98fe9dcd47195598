"""Native lines and spans of blocks: array<struct<bbox, spans array<struct<text, font, size, flags, color>>>> beside a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def flat(lines: Column) -> Column:
    """All spans of a block, in order."""
    return F.flatten(F.transform(lines, lambda x: x["spans"]))


def drawn(lines: Column) -> Column:
    """The spans that hold text."""
    return F.filter(flat(lines), lambda s: F.coalesce(s["text"], F.lit("")) != "")


def block_text(lines: Column) -> Column:
    """The lines' texts, each its spans in a row, without empty lines."""
    texts = F.transform(lines, lambda x: F.trim(F.array_join(F.transform(x["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), "")))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def block_style(lines: Column) -> Column:
    """struct(font, size, flags, color, largest): the style of the longest span, the first of equal ones, and the largest size."""
    spans = flat(lines)
    best = F.element_at(F.array_sort(F.transform(spans, lambda s, i: F.struct((-F.length(F.coalesce(s["text"], F.lit("")))).alias("n"), i.alias("i"), s["font"].alias("font"), s["size"].alias("size"), s["flags"].alias("flags"), s["color"].alias("color")))), 1)
    largest = F.array_max(F.transform(spans, lambda s: F.coalesce(s["size"], F.lit(0.0))))
    return F.when(F.size(spans) > 0, F.struct(F.nullif(best["font"], F.lit("")).alias("font"), F.nullif(best["size"], F.lit(0.0)).alias("size"), F.coalesce(best["flags"], F.lit(0)).alias("flags"), best["color"].alias("color"), largest.alias("largest")))


def body_sizes(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, body_size): the median size of a page's spans; 0 without any. blocks: (doc_id, page_no, lines)."""
    sizes = blocks.select("doc_id", "page_no", F.explode_outer(flat(F.col("lines"))).alias("s"))
    return sizes.groupBy("doc_id", "page_no").agg(F.coalesce(F.median(F.when(F.col("s.size") > 0, F.col("s.size"))), F.lit(0.0)).alias("body_size"))


def visual_lines(centres: Column, font_size: Column, height: Column) -> Column:
    """How many lines one sees: a new one where the middles of native lines part by over a third of the font; else by a region's height."""
    gap = F.greatest(F.lit(1.0), 0.35 * F.coalesce(font_size, F.lit(0.0)))
    order = F.array_sort(centres)
    steps = F.zip_with(F.slice(order, F.lit(2), F.greatest(F.size(order) - 1, F.lit(0))), order, lambda a, b: F.when(a - b > gap, 1).otherwise(0))
    seen = 1 + F.aggregate(steps, F.lit(0), lambda n, x: n + x)
    by_height = F.when(F.coalesce(font_size, F.lit(0.0)) > 0, F.greatest(F.lit(1), F.bround(height / font_size).cast("int"))).otherwise(1)
    return F.when(F.coalesce(F.size(centres), F.lit(0)) > 0, seen).otherwise(by_height)
