"""Document structure as tables: regions of pages, made from plain tables or read from JSON.

A region row has its page's size, so page-level operators need no join. Ids are
(doc_id, page_no, region_ord); region_ord is the order of extraction and breaks every tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

REGION = (
    "doc_id long, page_no int, region_ord int, region_id string, type string, x0 double, y0 double, x1 double, y1 double, source_text string,"
    " font_size double, flags int, translatable boolean, confidence double, content_source string, native_block_type string,"
    " ocr_background boolean, ocr_source_region_id string, line_count int, page_width double, page_height double, drawing_count int"
)

PER_PAGE, PER_COLUMN = 40, 20
WIDTH, HEIGHT = 600.0, 800.0


def regions_from_documents(docs: DataFrame) -> DataFrame:
    """A region for each line that isn't blank, laid out in two columns of twenty slots; integer arithmetic only."""
    lines = docs.select(F.col("doc_id").cast("long"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.where(F.trim("line") != "")
    slot, size = F.col("pos") % PER_PAGE, F.length("line")
    rows = lines.withColumns({"page_no": F.floor(F.col("pos") / PER_PAGE).cast("int") + 1, "slot": slot, "n": size})
    x0 = F.when(F.col("slot") < PER_COLUMN, 50).otherwise(320)
    y0 = 80 + (F.col("slot") % PER_COLUMN) * 34
    font = F.when(F.col("n") < 40, 12).otherwise(10)
    return rows.select(
        "doc_id", "page_no", F.col("pos").cast("int").alias("region_ord"), F.concat(F.lit("p"), "page_no", F.lit("-text-"), "slot").alias("region_id"),
        F.when((F.col("pos") == 0) & (F.col("n") < 80), "heading").otherwise("paragraph").alias("type"),
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + F.least(F.lit(230), 40 + F.col("n") * 2)).cast("double").alias("x1"), (y0 + 10 + (F.col("n") % 3) * 10).cast("double").alias("y1"),
        F.col("line").alias("source_text"), font.cast("double").alias("font_size"), F.when(F.col("n") % 7 == 0, 16).otherwise(0).alias("flags"), F.lit(True).alias("translatable"), F.lit(1.0).alias("confidence"),
        F.lit("native_pdf").alias("content_source"), F.lit("text").alias("native_block_type"), F.lit(False).alias("ocr_background"), F.lit(None).cast("string").alias("ocr_source_region_id"), F.lit(1).alias("line_count"),
        F.lit(WIDTH).alias("page_width"), F.lit(HEIGHT).alias("page_height"), F.lit(0).alias("drawing_count"),
    )


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions stored as JSON rows; a row that isn't an object of this shape fails the read."""
    return spark.read.schema(REGION).option("mode", "FAILFAST").json(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of a JSON object of terms."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias("source", "target"))


def glossary_problems(terms: DataFrame, most_terms: int = 500, longest: int = 200) -> DataFrame:
    """(rule, count) of the rules that a glossary breaks; no row if it is fine."""
    blank = F.count_if(F.coalesce(F.trim("source"), F.lit("")) == F.lit("")) + F.count_if(F.coalesce(F.trim("target"), F.lit("")) == F.lit(""))
    long = F.count_if((F.length("source") > longest) | (F.length("target") > longest))
    again = F.count(F.lower("source")) - F.count_distinct(F.lower("source"))
    many = F.greatest(F.count("*") - most_terms, F.lit(0))
    found = terms.agg(F.array(*[F.struct(F.lit(k).alias("rule"), v.cast("long").alias("count")) for k, v in (("blank", blank), ("too_long", long), ("duplicate", again), ("too_many", many))]).alias("r"))
    return found.select(F.inline("r")).where("count > 0")


def directory_usage(spark: SparkSession, path: str) -> DataFrame:
    """Number and bytes of the files below a folder, by its own listing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
