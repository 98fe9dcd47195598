"""The registered queries of the document engine, over the driver's tables, and DuckDB SQL with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import geometry as G, protect as P, text as X
from ..operators import flows as FL, layout as L, ocr_plan as O, quality as Q, structure as S, translate as TR
from ..sources import ir
from ..streaming import jobs as J
from .store import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.regions_from_documents(table(spark, sf_dir, "documents"))


def ir_regions(spark, sf_dir):
    return regions(spark, sf_dir).select("doc_id", "page_no", "region_ord", "type", "x0", "y0", "x1", "y1", "font_size", F.length("source_text").alias("chars"))


def body_sizes(spark, sf_dir):
    return S.with_body_size(regions(spark, sf_dir)).groupBy("doc_id", "page_no").agg(F.max("body_size").alias("body_size"), F.count("*").alias("regions"))


def special_regions(spark, sf_dir):
    rows = S.special_regions(S.with_body_size(regions(spark, sf_dir).withColumn("structure_rule", F.lit(None).cast("string"))))
    return rows.select("doc_id", "page_no", "region_ord", "type", "structure_rule", "confidence")


def formula_seeds(spark, sf_dir):
    rows = regions(spark, sf_dir).withColumns({"structure_rule": F.lit(None).cast("string"), "_text": X.collapse(F.col("source_text"))})
    return S.formulas(rows).where("structure_rule = 'math_symbol_density'").select("doc_id", "page_no", "region_ord")


def reading_order(spark, sf_dir):
    rows = S.reading_order(S.columns(regions(spark, sf_dir)))
    return rows.select("doc_id", "page_no", "region_ord", "two_columns", "column_index", "reading_order")


def _structured(spark, sf_dir) -> DataFrame:
    """Recovered regions, written once: edges, flows and layout read them several times."""
    return written(S.recover(_continued(regions(spark, sf_dir))), "regions")


def structure(spark, sf_dir):
    return S.recover(regions(spark, sf_dir)).select("doc_id", "page_no", "region_ord", "region_id", "type", "structure_rule", "confidence", "translatable", "column_index", "reading_order")


def page_layouts(spark, sf_dir):
    return S.page_layout(S.columns(S.with_body_size(regions(spark, sf_dir))))


def _wide(rows: DataFrame) -> DataFrame:
    """Boxes that overlap, so that unions and collisions have something to do."""
    return rows.withColumns({"x1": F.col("x1") + 120, "y1": F.col("y1") + 20})


def coverage(spark, sf_dir):
    out = O.coverage(_wide(regions(spark, sf_dir)))
    return out.select("doc_id", "page_no", F.bround(F.col("coverage") * 480000).cast("long").alias("area"))


def ocr_diagnostics(spark, sf_dir):
    rows = regions(spark, sf_dir).withColumn("content_source", F.when(F.col("region_ord") % 3 == 0, "paddleocr").otherwise("native_pdf"))
    out = O.decide(O.diagnostics(rows.withColumn("confidence", F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(1.0))))
    return out.select("doc_id", "page_no", "native_chars", "native_regions", "ocr_chars", "ocr_regions", "action", "reason")


def ocr_summary(spark, sf_dir):
    out = O.summary(O.decide(O.diagnostics(regions(spark, sf_dir).withColumn("content_source", F.when(F.col("page_no") % 2 == 0, "paddleocr").otherwise("native_pdf")).withColumn("confidence", F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(1.0)))))
    return out.withColumn("blocking_pages", F.array_join("blocking_pages", ","))


def without_duplicates(spark, sf_dir):
    rows = regions(spark, sf_dir)
    moved = rows.where("region_ord % 2 = 0").withColumns({"y0": F.col("y0") + 4, "y1": F.col("y1") + 24})
    return O.without_duplicates(moved, rows.where("region_ord % 2 = 1 OR region_ord % 4 = 0")).select("doc_id", "page_no", "region_ord")


def _continued(rows: DataFrame) -> DataFrame:
    """Regions most of which go on with the sentence of the one before, across columns and pages: lower-case starts, no full stop at the end."""
    open_end = F.regexp_replace(F.col("source_text"), r"[^\p{L}\p{Nd}]+$", "")
    lower = F.lower(F.regexp_replace(open_end, r"^[^\p{L}]+", ""))
    text = F.when(F.col("region_ord") % 6 == 0, open_end).when(F.col("region_ord") % 6 == 5, F.concat(lower, F.lit("."))).otherwise(lower)
    return rows.withColumn("source_text", text).where("source_text <> ''")


def _ordered(spark, sf_dir) -> DataFrame:
    return written(S.reading_order(S.columns(_continued(regions(spark, sf_dir)))), "ordered")


def flow_edges(spark, sf_dir):
    return FL.edges(_ordered(spark, sf_dir))


def flows(spark, sf_dir):
    out = FL.flows(_ordered(spark, sf_dir))
    return out.select("doc_id", "flow_id", "type", F.size("region_ids").alias("regions"), F.array_join("page_numbers", ",").alias("pages"), F.md5(F.col("source_text").cast("binary")).alias("text_md5"), "translatable", "confidence")


def flow_stats(spark, sf_dir):
    rows = _ordered(spark, sf_dir)
    links = written(FL.edges(rows), "edges")
    return FL.flow_stats(FL.flows(rows, links), links)


def lexicon(spark, sf_dir):
    rows = S.reading_order(S.columns(regions(spark, sf_dir)))
    return FL.lexicon(rows).groupBy("doc_id").agg(F.count("*").alias("words"))


def _turns(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("flow_ord"), F.concat(F.lit("flow-"), "turn").alias("flow_id"), F.when(F.col("role") == "system", "heading").otherwise("paragraph").alias("type"), F.col("text").alias("source_text"), F.lit(True).alias("translatable"))


def contexts(spark, sf_dir):
    return TR.contexts(_turns(spark, sf_dir)).select("doc_id", "flow_ord", "section_title", "previous", "next", F.size("clipped").alias("clipped"))


def _terms(spark, sf_dir) -> DataFrame:
    word = F.lower(F.regexp_extract("text", "([A-Za-z]{3,})", 1))
    return table(spark, sf_dir, "benchmark").select(word.alias("source")).where("source <> ''").distinct().withColumn("target", F.upper("source"))


def glossary_hits(spark, sf_dir):
    rows = TR.contexts(_turns(spark, sf_dir), _terms(spark, sf_dir), most_terms=None)
    return rows.select("doc_id", "flow_ord", F.size("glossary").alias("hits"), F.array_join(F.transform("glossary", lambda g: g["source"]), ",").alias("terms"))


def context_stats(spark, sf_dir):
    return TR.context_stats(TR.contexts(_turns(spark, sf_dir)))


def protected_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.lit(" see ["), F.col("doc_id").cast("string"), F.lit("] at www.example.org/a")))
    return docs.select("doc_id", *[v.alias(k) for k, v in P.simple_counts(F.col("text")).items()])


def protected_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("p", P.protect(F.col("text")))
    back = X.restore(F.col("p.text"), F.col("p.tokens"))
    return docs.select("doc_id", F.size("p.tokens").alias("tokens"), (back == F.col("text")).alias("restored"))


def placeholder_issues(spark, sf_dir):
    mark = lambda n: F.concat(F.lit("⟦PT"), F.lpad((n % 7).cast("string"), 4, "0"), F.lit("⟧"))
    text = F.concat(F.coalesce("text", F.lit("")), mark(F.col("doc_id")), mark(F.col("doc_id") * 3), mark(F.col("n_chars")))
    rows = table(spark, sf_dir, "documents").select("doc_id", X.placeholder_issues(text, F.array(F.lit("⟦PT0001⟧"), F.lit("⟦PT0002⟧"), F.lit("⟦PT0003⟧"))).alias("i"))
    return rows.select("doc_id", *[F.array_join(f"i.{k}", ",").alias(k) for k in ("missing", "duplicated", "unknown")])


def _calls(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    calls = rows.select("l_orderkey", "l_returnflag", (F.col("l_quantity") * 100).cast("long").alias("input_tokens"), (F.col("l_quantity") * F.round(F.col("l_discount") * 100)).cast("long").alias("cached_tokens"), F.floor("l_extendedprice").cast("long").alias("output_tokens"))
    return calls.withColumn("cost", TR.cost(F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens"), "deepseek")).withColumn("currency", F.lit("USD"))


def usage_by_flag(spark, sf_dir):
    out = TR.usage(_calls(spark, sf_dir), ["l_returnflag"])
    return out.select("l_returnflag", "calls", "input_tokens", "cached_tokens", "output_tokens", (F.col("cost") * 1_000_000).cast("decimal(38,6)").cast("double").alias("cost_micro"), "cost_complete")


def usage_by_job(spark, sf_dir):
    lost = _calls(spark, sf_dir).withColumn("cost", F.when(F.col("input_tokens") > 300, F.col("cost")))
    out = TR.usage(lost, ["l_orderkey"])
    return out.select("l_orderkey", "calls", "input_tokens", "cost_complete", F.coalesce(F.round(F.col("cost") * 10_000_000_000).cast("long"), F.lit(-1)).alias("cost_units"))


def weighted_medians(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("size"), F.col("l_linenumber").cast("long").alias("lines"))
    return Q.weighted_lower_median(rows, ["l_returnflag", "l_linestatus"], "size", "lines")


def job_states(spark, sf_dir):
    return J.job_states(table(spark, sf_dir, "events")).select("user_id", "event_id", "state")


def events_by_window(spark, sf_dir):
    out = J.events_by_window(table(spark, sf_dir, "events"))
    return out.select(F.unix_timestamp("window.start").alias("start_s"), "event_type", "n")


def job_transitions(spark, sf_dir):
    return J.transitions(table(spark, sf_dir, "events"))


def settled_events(spark, sf_dir):
    return J.settled(table(spark, sf_dir, "events")).select("user_id", F.unix_timestamp("burst.start").alias("start_s"), "n", "event_type")


def character_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumn("text", F.regexp_replace("text", "[^ -~]", ""))
    pairs = rows.join(rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("truth")), "item_id")
    return Q.character_errors(pairs.select(F.col("item_id").alias("doc_id"), F.lit(1).alias("page_no"), "text", "truth")).select("doc_id", "edits", "truth_chars", "chars")


def ocr_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return Q.ocr_quality(rows.select(F.col("item_id").alias("doc_id"), F.lit(1).alias("page_no"), F.regexp_replace("text", "s ", " ").alias("text"), F.col("text").alias("truth")))


def box_collisions(spark, sf_dir):
    rows = _wide(regions(spark, sf_dir)).select("doc_id", "page_no", "region_ord", G.box().alias("b"))
    w = Window.partitionBy("doc_id", "page_no")
    all_ = rows.withColumn("others", F.collect_list(F.struct("region_ord", "b")).over(w))
    n = F.size(F.filter("others", lambda o: (o["region_ord"] > F.col("region_ord")) & G.overlaps(F.col("b"), o["b"])))
    return all_.groupBy("doc_id", "page_no").agg(F.sum(n).alias("collisions"))


def cut_outs(spark, sf_dir):
    rows = regions(spark, sf_dir)
    blocker = F.struct((F.col("x0") + 10).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x0") + 50).alias("x1"), (F.col("y0") + 8).alias("y1"))
    second = F.struct((F.col("x0") + 40).alias("x0"), (F.col("y0") - 5).alias("y0"), (F.col("x0") + 70).alias("x1"), (F.col("y1") + 5).alias("y1"))
    area = lambda p: F.aggregate(p, F.lit(0.0), lambda a, b: a + G.width(b) * G.height(b))
    return rows.select("doc_id", "region_ord", F.round(area(G.cut_out(G.box(), F.array(blocker, second)))).cast("long").alias("area"))


def plain_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.is_plain_http_url(F.col("url")).alias("plain"))


def cache_misses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    asked = docs.withColumn("cache_key", F.sha2("text", 256))
    cache = asked.where("source = 'src0'").select("cache_key").distinct()
    missing = asked.join(cache, "cache_key", "left_anti")
    return missing.groupBy("source").agg(F.count("*").alias("requests"), F.count_distinct("cache_key").alias("calls"))


def mock_lengths(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return docs.select("conv_id", "turn", F.length(TR.mock_text(F.col("text"), 1.0, 0.5)).alias("chars"))


def gated(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 0).alias("harmless"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    g = Q.gate(docs.join(labels, "doc_id", "left"), ["quality", "harmless"])
    return g.select("doc_id", "source", "passed", F.array_join("failed", ",").alias("failed"))


def titles(spark, sf_dir):
    return Q.top_titles(S.with_body_size(regions(spark, sf_dir)))


def _laid_out(spark, sf_dir):
    rows = _structured(spark, sf_dir)
    made = FL.flows(rows).where("translatable")
    size = rows.select("doc_id", F.col("region_id").alias("first"), "font_size")
    asked = made.withColumn("first", F.element_at("region_ids", 1)).join(size, ["doc_id", "first"])
    asked = asked.withColumns({"normal": TR.mock_text(F.col("source_text")), "compact": TR.mock_text(F.col("source_text"), 0.82)})
    asked = written(asked, "asked")
    return rows, asked, written(L.lay_out(asked.select("doc_id", "flow_ord", "flow_id", "type", "region_ids", "normal", "compact", "font_size"), rows), "placed")


def layout(spark, sf_dir):
    return _laid_out(spark, sf_dir)[2]


def layout_safety(spark, sf_dir):
    rows, asked, placed = _laid_out(spark, sf_dir)
    return L.validate(placed, rows, asked)


def reading_map(spark, sf_dir):
    rows, asked, placed = _laid_out(spark, sf_dir)
    out = Q.reading_map(asked, rows, placed, asked)
    return out.select("doc_id", "page_no", "paragraph.*")


def translation_summary(spark, sf_dir):
    """The flagship: structure, flows, placeholders, a mock translation, restoring, and a gate for each document."""
    made = FL.flows(_structured(spark, sf_dir)).where("translatable")
    rows = made.withColumn("p", P.protect(F.col("source_text")))
    rows = rows.withColumn("normal", TR.mock_text(F.col("p.text")))
    issues = X.placeholder_issues(F.col("normal"), F.transform(F.col("p.tokens"), lambda t: t["placeholder"]))
    rows = rows.withColumns({"issues": issues, "restored": X.restore(F.col("normal"), F.col("p.tokens"))})
    fine = (F.size("issues.missing") == 0) & (F.size("issues.duplicated") == 0) & (F.size("issues.unknown") == 0)
    return rows.groupBy("doc_id").agg(F.count("*").alias("flows"), F.sum(F.size("p.tokens")).alias("tokens"), F.sum(F.length("restored")).alias("chars"), F.bool_and(fine).alias("passed"))


QUERIES = {
    f.__name__: f
    for f in (
        ir_regions, body_sizes, special_regions, formula_seeds, reading_order, structure, page_layouts, coverage, ocr_diagnostics, ocr_summary, without_duplicates, flow_edges, flows, flow_stats, lexicon, contexts, glossary_hits, context_stats,
        protected_counts, protected_round_trip, placeholder_issues, usage_by_flag, usage_by_job, weighted_medians, job_states, events_by_window, job_transitions, settled_events, character_errors, ocr_quality, box_collisions, cut_outs, plain_urls, cache_misses, mock_lengths, gated,
        titles, layout, layout_safety, reading_map, translation_summary,
    )
}

_IR = """l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
r AS (SELECT doc_id, (pos // 40 + 1)::INT AS page_no, pos::INT AS region_ord, line AS source_text, length(line) AS n,
  CASE WHEN pos = 0 AND length(line) < 80 THEN 'heading' ELSE 'paragraph' END AS type, (CASE WHEN pos % 40 < 20 THEN 50 ELSE 320 END)::DOUBLE AS x0, (80 + (pos % 20) * 34)::DOUBLE AS y0,
  ((CASE WHEN pos % 40 < 20 THEN 50 ELSE 320 END) + least(230, 40 + length(line) * 2))::DOUBLE AS x1, (80 + (pos % 20) * 34 + 10 + (length(line) % 3) * 10)::DOUBLE AS y1,
  (CASE WHEN length(line) < 40 THEN 12 ELSE 10 END)::DOUBLE AS font_size, CASE WHEN length(line) % 7 = 0 THEN 16 ELSE 0 END AS flags FROM l WHERE trim(line) <> '')"""
_COLS = """k AS (SELECT *, coalesce((lc >= 2 AND rc >= 1) OR (lc >= 1 AND rc >= 2), false) AS two_columns FROM (SELECT *,
  count(*) FILTER (x1 - x0 BETWEEN 132 AND 288 AND y1 - y0 >= 12 AND (x0 + x1) / 2 < 300) OVER p AS lc, count(*) FILTER (x1 - x0 BETWEEN 132 AND 288 AND y1 - y0 >= 12 AND (x0 + x1) / 2 >= 300) OVER p AS rc
  FROM r WINDOW p AS (PARTITION BY doc_id, page_no))),
c AS (SELECT *, (CASE WHEN NOT two_columns THEN 1 WHEN (x0 + x1) / 2 < 300 THEN 1 ELSE 2 END)::INT AS column_index FROM k)"""
_PROSE = """x AS (SELECT *, CASE WHEN region_ord % 6 = 0 THEN o WHEN region_ord % 6 = 5 THEN lo || '.' ELSE lo END AS t FROM (SELECT *, lower(regexp_replace(o, '^[^\\p{L}]+', '')) AS lo FROM (SELECT *, regexp_replace(source_text, '[^\\p{L}\\p{Nd}]+$', '') AS o FROM r))),
v AS (SELECT *, len(regexp_extract_all(t, '\\p{L}')) AS lt, len(regexp_extract_all(t, '\\p{Nd}')) AS dg, len(regexp_extract_all(t, '[=∑∫√±×÷≤≥≈≠∞^_{}]')) AS mt, len(regexp_extract_all(t, '[A-Za-z]{3,}')) AS wd FROM x WHERE t <> ''),
k AS (SELECT *, coalesce((lc >= 2 AND rc >= 1) OR (lc >= 1 AND rc >= 2), false) AS two_columns FROM (SELECT *,
  count(*) FILTER (x1 - x0 BETWEEN 132 AND 288 AND y1 - y0 >= 12 AND (x0 + x1) / 2 < 300) OVER p AS lc, count(*) FILTER (x1 - x0 BETWEEN 132 AND 288 AND y1 - y0 >= 12 AND (x0 + x1) / 2 >= 300) OVER p AS rc FROM v WINDOW p AS (PARTITION BY doc_id, page_no))),
c AS (SELECT *, 'p' || page_no || '-text-' || region_ord % 40 AS id, (CASE WHEN NOT two_columns THEN 1 WHEN (x0 + x1) / 2 < 300 THEN 1 ELSE 2 END)::INT AS col,
  (lt + dg + mt > 0 AND wd >= 4 AND lt >= 0.82 * (lt + dg + mt) AND dg <= greatest(4, round_even(lt * 0.12, 0))) OR (lt + dg + mt > 0 AND length(t) <= 100 AND wd >= 2 AND lt >= 0.65 * (lt + dg + mt) AND dg <= greatest(12, round_even(lt * 0.4, 0))) AS prose,
  regexp_matches(t, '[.!?;:][\\])}"''’”]*$') AS stops, regexp_matches(t, '^\\p{Ll}') AS low FROM k),
m AS (SELECT *, lag(row) OVER (PARTITION BY doc_id ORDER BY page_no, col, y0, x0, region_ord) AS p FROM (SELECT *, c AS row FROM c)),
j AS (SELECT doc_id, p.id AS prev_id, id AS next_id, CASE WHEN p.page_no = page_no AND p.col = col THEN 'same_column' WHEN p.page_no = page_no THEN 'cross_column' ELSE 'cross_page' END AS boundary, y0, p.y1 AS py1, p.font_size AS pf, region_ord FROM m
  WHERE p IS NOT NULL AND type = 'paragraph' AND p.type = 'paragraph' AND prose AND p.prose AND NOT p.stops AND low AND font_size / p.font_size BETWEEN 0.82 AND 1.22),
e AS (SELECT *, CASE boundary WHEN 'same_column' THEN 0.88 WHEN 'cross_column' THEN 0.84 ELSE 0.8 END::DOUBLE AS confidence FROM j WHERE CASE boundary WHEN 'same_column' THEN y0 - py1 <= greatest(8, pf * 1.8) WHEN 'cross_column' THEN py1 >= 576 AND y0 <= 440 ELSE py1 >= 576 AND y0 <= 240 END),
h AS (SELECT c.*, e.confidence AS sure, sum(CASE WHEN e.doc_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY c.doc_id ORDER BY c.page_no, c.col, c.y0, c.x0, c.region_ord) AS g FROM c LEFT JOIN e ON c.doc_id = e.doc_id AND c.id = e.next_id AND c.region_ord = e.region_ord),
f AS (SELECT doc_id, g, arg_min(id, (page_no, col, y0, x0, region_ord)) AS head, arg_min(type, (page_no, col, y0, x0, region_ord)) AS type, count(*) AS n, list_distinct(list(page_no)) AS pages, string_agg(trim(t), ' ' ORDER BY page_no, col, y0, x0, region_ord) AS said, coalesce(min(sure), 1.0)::DOUBLE AS confidence FROM h GROUP BY doc_id, g)"""
_WIDE = "b AS (SELECT doc_id, page_no, region_ord, x0, y0, x1 + 120 AS x1, y1 + 20 AS y1 FROM r)"
_TURNS = "t AS (SELECT conv_id AS doc_id, turn AS flow_ord, CASE WHEN role = 'system' THEN 'heading' ELSE 'paragraph' END AS type, text FROM conversations WHERE trim(text) <> '')"
_CLIP = "CASE WHEN length({0}) > 600 THEN rtrim(left({0}, 597), ' ') || '...' ELSE {0} END"
_AROUND = """s AS (SELECT *, {'o': flow_ord, 't': trim(regexp_replace(text, '\\s+', ' ', 'g'))} AS own FROM t),
w AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN own END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY flow_ord ROWS UNBOUNDED PRECEDING) AS h, lag(own) OVER (PARTITION BY doc_id ORDER BY flow_ord) AS p, lead(own) OVER (PARTITION BY doc_id ORDER BY flow_ord) AS n FROM s)"""

ORACLE_SQL = {
    "ir_regions": f"WITH {_IR} SELECT doc_id, page_no, region_ord, type, x0, y0, x1, y1, font_size, n AS chars FROM r",
    "body_sizes": f"WITH {_IR} SELECT doc_id, page_no, coalesce(median(font_size) FILTER (x1 - x0 >= 132), 0) AS body_size, count(*) AS regions FROM r GROUP BY ALL",
    "special_regions": f"""WITH {_IR}, body AS (SELECT doc_id, page_no, coalesce(median(font_size) FILTER (x1 - x0 >= 132), 0) AS body FROM r GROUP BY ALL),
s AS (SELECT r.*, body, trim(regexp_replace(source_text, '\\s+', ' ', 'g')) AS t FROM r JOIN body USING (doc_id, page_no)),
m AS (SELECT *, CASE WHEN y1 - y0 > 2.2 * (x1 - x0) AND x0 < 72 THEN 0 WHEN regexp_matches(t, '^(?i:figure|fig\\.)\\s*\\d+[.:]?\\s*') THEN 1 WHEN regexp_matches(t, '^(?i:table)\\s*(?i:[ivxlcdm\\d]+)[.:]?\\s*') THEN 2
  WHEN type = 'paragraph' AND regexp_matches(t, '^\\d+(?:\\.\\d+)*\\.?\\s+[A-Z][^.!?]{{0,100}}$') AND length(t) <= 110 AND flags & 16 <> 0 THEN 3 ELSE 9 END AS k FROM s WHERE t <> '')
SELECT doc_id, page_no, region_ord, CASE WHEN low THEN 'footnote' ELSE CASE k WHEN 0 THEN 'header' WHEN 1 THEN 'figure_caption' WHEN 2 THEN 'table_caption' WHEN 3 THEN 'heading' ELSE type END END AS type,
  CASE WHEN low THEN 'small_bottom_text' ELSE CASE k WHEN 0 THEN 'vertical_margin_mark' WHEN 1 THEN 'figure_caption_prefix' WHEN 2 THEN 'table_caption_prefix' WHEN 3 THEN 'numbered_bold_heading' END END AS structure_rule,
  (CASE WHEN low THEN 0.8 ELSE CASE k WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 2 THEN 0.95 WHEN 3 THEN 0.85 ELSE 1.0 END END)::DOUBLE AS confidence
FROM (SELECT *, k = 9 AND type = 'paragraph' AND body > 0 AND font_size <= 0.86 * body AND y0 >= 656 AND x1 - x0 <= 288 AS low FROM m)""",
    "page_layouts": f"""WITH {_IR}, {_COLS}, b AS (SELECT doc_id, page_no, coalesce(median(font_size) FILTER (x1 - x0 >= 132), 0) AS body FROM r GROUP BY ALL)
SELECT doc_id, page_no, CASE WHEN bool_or(two_columns) THEN 'two_column' ELSE 'single_column' END AS layout, any_value(body)::DOUBLE AS body_font_size, CASE WHEN bool_or(two_columns) THEN 0.72 ELSE 0.6 END::DOUBLE AS structure_confidence, count(*) AS regions FROM c JOIN b USING (doc_id, page_no) GROUP BY ALL""",
    "formula_seeds": f"""WITH {_IR}, s AS (SELECT *, trim(regexp_replace(source_text, '\\s+', ' ', 'g')) AS t FROM r),
f AS (SELECT *, len(regexp_extract_all(t, '[A-Za-z]{{3,}}')) AS w, length(t) - length(regexp_replace(t, '[=∑∫√λσφ±×÷≤≥≈≠∞^_{{}}⌊⌋ˆ˜−∈∥|<>•/]', '', 'g')) AS m, length(regexp_replace(t, '\\s+', '', 'g')) AS c, regexp_matches(source_text, '[\\x00-\\x08\\x0E-\\x1B]') AS ctl FROM s)
SELECT doc_id, page_no, region_ord FROM f WHERE length(t) <= 240 AND (ctl OR (contains(t, '=') AND m >= 2 AND w <= 12) OR (m >= 4 AND w <= 8) OR (m >= 2 AND length(t) <= 80 AND w <= 3) OR (m >= 1 AND length(t) <= 12 AND w <= 2) OR (c <= 16 AND regexp_matches(t, '\\pN') AND w <= 1) OR (type = 'heading' AND length(t) <= 40 AND m >= 2))""",
    "reading_order": f"WITH {_IR}, {_COLS} SELECT doc_id, page_no, region_ord, two_columns, column_index, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY column_index, y0, x0, region_ord))::INT AS reading_order FROM c",
    "coverage": f"""WITH {_IR}, {_WIDE}, q AS (SELECT doc_id, page_no, greatest(0, least(600, x0)) AS x0, greatest(0, least(800, y0)) AS y0, greatest(0, least(600, x1)) AS x1, greatest(0, least(800, y1)) AS y1 FROM b),
xs AS (SELECT doc_id, page_no, x0 AS x FROM q UNION SELECT doc_id, page_no, x1 FROM q), ys AS (SELECT doc_id, page_no, y0 AS y FROM q UNION SELECT doc_id, page_no, y1 FROM q),
sx AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, page_no ORDER BY x) AS xe FROM xs), sy AS (SELECT *, lead(y) OVER (PARTITION BY doc_id, page_no ORDER BY y) AS ye FROM ys)
SELECT doc_id, page_no, sum((xe - x) * (ye - y))::BIGINT AS area FROM sx JOIN sy USING (doc_id, page_no) WHERE EXISTS (SELECT 1 FROM q WHERE q.doc_id = sx.doc_id AND q.page_no = sx.page_no AND q.x0 <= x AND q.x1 >= xe AND q.y0 <= y AND q.y1 >= ye) GROUP BY ALL""",
    "ocr_diagnostics": f"""WITH {_IR}, s AS (SELECT *, region_ord % 3 = 0 AS ocr, length(regexp_replace(source_text, '\\s', '', 'g')) AS ch FROM r),
p AS (SELECT doc_id, page_no, coalesce(sum(ch) FILTER (NOT ocr), 0)::BIGINT AS native_chars, count(*) FILTER (NOT ocr) AS native_regions, coalesce(sum(ch) FILTER (ocr), 0)::BIGINT AS ocr_chars, count(*) FILTER (ocr) AS ocr_regions FROM s GROUP BY ALL),
a AS (SELECT *, CASE WHEN ocr_chars >= 40 AND doc_id % 2 <> 0 THEN CASE WHEN native_chars > 0 THEN 1 ELSE 2 END WHEN ocr_chars > 0 THEN 3 WHEN native_chars >= 80 THEN 4 WHEN native_chars > 0 THEN 5 ELSE 6 END AS k FROM p)
SELECT doc_id, page_no, native_chars, native_regions, ocr_chars, ocr_regions, CASE k WHEN 1 THEN 'use_mixed' WHEN 2 THEN 'use_ocr' WHEN 3 THEN 'review' WHEN 4 THEN 'keep_native' WHEN 5 THEN 'keep_native' ELSE 'skip_blank' END AS action,
  CASE k WHEN 1 THEN 'confident_native_and_local_ocr' WHEN 2 THEN 'confident_local_ocr' WHEN 3 THEN 'insufficient_local_ocr' WHEN 4 THEN 'reliable_native_text' WHEN 5 THEN 'sparse_native_text_without_scan_evidence' ELSE 'empty_page' END AS reason FROM a""",
    "without_duplicates": f"""WITH {_IR}, o AS (SELECT doc_id, page_no, region_ord, x0, y0 + 4 AS y0, x1, y1 + 24 AS y1 FROM r WHERE region_ord % 2 = 0)
SELECT doc_id, page_no, region_ord FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = o.doc_id AND r.page_no = o.page_no AND (r.region_ord % 2 = 1 OR r.region_ord % 4 = 0)
  AND greatest(0, least(o.x1, r.x1) - greatest(o.x0, r.x0)) * greatest(0, least(o.y1, r.y1) - greatest(o.y0, r.y0)) >= 0.5 * (o.x1 - o.x0) * (o.y1 - o.y0))""",
    "flow_edges": f"WITH {_IR}, {_PROSE} SELECT doc_id, prev_id, next_id, boundary, confidence FROM e",
    "flows": f"WITH {_IR}, {_PROSE} SELECT doc_id, 'flow-' || head AS flow_id, type, n::INT AS regions, array_to_string(list_sort(pages), ',') AS pages, md5(trim(regexp_replace(said, '\\s+', ' ', 'g'))) AS text_md5, true AS translatable, confidence FROM f",
    "flow_stats": f"""WITH {_IR}, {_PROSE}, s AS (SELECT doc_id, count(*) AS flow_count, count(*) FILTER (n > 1) AS merged_flow_count FROM f GROUP BY doc_id), b AS (SELECT doc_id, count(*) FILTER (boundary = 'cross_column') AS cc, count(*) FILTER (boundary = 'cross_page') AS cp, count(*) FILTER (boundary = 'same_column') AS sc FROM e GROUP BY doc_id)
SELECT doc_id, flow_count, merged_flow_count, 0::BIGINT AS ocr_merged_flow_count, 0::BIGINT AS dehyphenation_count, coalesce(cc, 0) AS cross_column_edges, coalesce(cp, 0) AS cross_page_edges, coalesce(sc, 0) AS same_column_edges, 0::BIGINT AS ocr_line_edges FROM s LEFT JOIN b USING (doc_id)""",
    "ocr_summary": f"""WITH {_IR}, p AS (SELECT doc_id, page_no, sum(length(regexp_replace(source_text, '\\s', '', 'g'))) AS ch FROM r GROUP BY ALL),
a AS (SELECT *, CASE WHEN page_no % 2 = 1 THEN 'keep_native' WHEN ch >= 40 AND doc_id % 2 <> 0 THEN 'use_ocr' ELSE 'review' END AS a FROM p)
SELECT doc_id, count(*) AS pages, count(*) FILTER (a = 'keep_native') AS keep_native, 0::BIGINT AS run_ocr, count(*) FILTER (a = 'use_ocr') AS use_ocr, 0::BIGINT AS use_mixed, count(*) FILTER (a = 'review') AS review, 0::BIGINT AS skip_blank, coalesce(string_agg(CASE WHEN a = 'review' THEN page_no END, ',' ORDER BY page_no), '') AS blocking_pages FROM a GROUP BY doc_id""",
    "titles": f"""WITH {_IR}, body AS (SELECT doc_id, page_no, coalesce(median(font_size) FILTER (x1 - x0 >= 132), 0) AS body FROM r GROUP BY ALL),
s AS (SELECT doc_id, region_ord, trim(regexp_replace(source_text, '\\s+', ' ', 'g')) AS t, 4 * font_size / (CASE WHEN body > 0 THEN body ELSE 10 END) + least(1, (x1 - x0) / 600) + 1 - least(1, y0 / 384) AS score FROM r JOIN body USING (doc_id, page_no) WHERE page_no = 1 AND y0 <= 384 AND (body <= 0 OR font_size >= greatest(11, 1.18 * body)))
SELECT doc_id, arg_max(t, (round(score, 9), -region_ord)) AS title FROM s WHERE length(t) BETWEEN 5 AND 600 AND regexp_matches(t, '\\p{{L}}') AND NOT regexp_matches(lower(t), '^(?:arxiv:|doi:|https?://)') AND NOT contains(t, '@') AND lower(t) NOT IN ('abstract', 'introduction', 'references') GROUP BY doc_id""",
    "lexicon": f"WITH {_IR}, w AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(source_text, '[A-Za-z][A-Za-z-]{{2,}}'))) AS w FROM r) SELECT doc_id, count(*) AS words FROM w WHERE NOT contains(w, '-') GROUP BY doc_id",
    "contexts": f"WITH {_TURNS}, {_AROUND} SELECT doc_id, flow_ord, {_CLIP.format('h.t')} AS section_title, {_CLIP.format('p.t')} AS previous, {_CLIP.format('n.t')} AS next, (coalesce(length(h.t) > 600, false)::INT + coalesce(length(p.t) > 600, false)::INT + coalesce(length(n.t) > 600, false)::INT) AS clipped FROM w",
    "glossary_hits": f"WITH {_TURNS}, g AS (SELECT DISTINCT lower(regexp_extract(text, '([A-Za-z]{{3,}})', 1)) AS s FROM benchmark WHERE regexp_matches(text, '[A-Za-z]{{3,}}')) "
    "SELECT doc_id, flow_ord, count(s)::INT AS hits, coalesce(string_agg(s, ',' ORDER BY s), '') AS terms FROM t LEFT JOIN g ON contains(lower(text), s) GROUP BY doc_id, flow_ord",
    "context_stats": f"WITH {_TURNS}, {_AROUND}, c AS (SELECT doc_id, count(DISTINCT o) AS cut FROM (SELECT doc_id, p.o AS o FROM w WHERE length(p.t) > 600 UNION ALL SELECT doc_id, n.o FROM w WHERE length(n.t) > 600) GROUP BY doc_id) "
    "SELECT doc_id, count(*) AS flows, count(h.t) AS section_title_count, count(p.t) AS previous_count, count(n.t) AS next_count, 0::BIGINT AS glossary_term_count, count(DISTINCT CASE WHEN length(h.t) > 600 THEN h.o END) AS clipped_heading_count, coalesce(any_value(c.cut), 0)::BIGINT AS clipped_neighbor_count FROM w LEFT JOIN c USING (doc_id) GROUP BY doc_id",
    "protected_counts": r"""WITH d AS (SELECT doc_id, text || ' see [' || doc_id::VARCHAR || '] at www.example.org/a' AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(coalesce(t, ''), '\$[^$\n]{1,200}\$'))::BIGINT AS latex, len(regexp_extract_all(coalesce(t, ''), '(?i)\[(?:\s*\d+[a-z]?\s*(?:[-,;]\s*\d+[a-z]?\s*)*)\]'))::BIGINT AS citation, len(regexp_extract_all(coalesce(t, ''), '(?i)(?:https?://|www\.)[^\s<>\[\]{}]+'))::BIGINT AS url FROM d""",
    "placeholder_issues": """WITH d AS (SELECT doc_id, ['⟦PT' || lpad((doc_id % 7)::VARCHAR, 4, '0') || '⟧', '⟦PT' || lpad((doc_id * 3 % 7)::VARCHAR, 4, '0') || '⟧', '⟦PT' || lpad((n_chars % 7)::VARCHAR, 4, '0') || '⟧'] AS f, ['⟦PT0001⟧', '⟦PT0002⟧', '⟦PT0003⟧'] AS e FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(e, lambda x: NOT list_contains(f, x))), ',') AS missing, array_to_string(list_sort(list_filter(e, lambda x: len(list_filter(f, lambda y: y = x)) > 1)), ',') AS duplicated,
  array_to_string(list_sort(list_distinct(list_filter(f, lambda x: NOT list_contains(e, x)))), ',') AS unknown FROM d""",
    "usage_by_flag": """WITH c AS (SELECT l_returnflag, (l_quantity * 100)::BIGINT AS i, (l_quantity * round(l_discount * 100))::BIGINT AS h, floor(l_extendedprice)::BIGINT AS o FROM lineitem)
SELECT l_returnflag, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(h)::BIGINT AS cached_tokens, sum(o)::BIGINT AS output_tokens, (sum(h * 28 + (i - h) * 1400 + o * 2800)::HUGEINT / 10000)::DOUBLE AS cost_micro, true AS cost_complete FROM c GROUP BY l_returnflag""",
    "usage_by_job": """WITH c AS (SELECT l_orderkey, (l_quantity * 100)::BIGINT AS i, (l_quantity * round(l_discount * 100))::BIGINT AS h, floor(l_extendedprice)::BIGINT AS o FROM lineitem)
SELECT l_orderkey, count(*) AS calls, sum(i)::BIGINT AS input_tokens, min(i) > 300 AS cost_complete, (CASE WHEN min(i) > 300 THEN sum(h * 28 + (i - h) * 1400 + o * 2800) ELSE -1 END)::BIGINT AS cost_units FROM c GROUP BY l_orderkey""",
    "weighted_medians": """WITH s AS (SELECT l_returnflag, l_linestatus, l_quantity AS size, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY size) AS so_far, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM s)
SELECT l_returnflag, l_linestatus, min(size) AS lower_median FROM c WHERE 2 * so_far >= total GROUP BY ALL""",
    "job_states": """SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'review' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""",
    "events_by_window": "SELECT (epoch(ts)::BIGINT // 3600 * 3600)::BIGINT AS start_s, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS ts, event_type FROM events) GROUP BY ALL",
    "job_transitions": """WITH s AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 4 ELSE 3 END AS k FROM events),
b AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM s) SELECT user_id, event_id, (['queued', 'running', 'completed', 'review', 'failed'])[p + 1] AS before, (['queued', 'running', 'completed', 'review', 'failed'])[k + 1] AS state, p < 2 AND k > p AS allowed FROM b WHERE p <> k""",
    "settled_events": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER u < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n, arg_max(event_type, (ts, event_id)) AS event_type FROM s GROUP BY user_id, k""",
    "character_errors": "SELECT a.item_id AS doc_id, levenshtein(a.text, b.text)::BIGINT AS edits, length(b.text)::BIGINT AS truth_chars, length(a.text)::BIGINT AS chars FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM benchmark) a JOIN (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM benchmark) b ON b.item_id = a.item_id + 1",
    "box_collisions": f"WITH {_IR}, {_WIDE} SELECT a.doc_id, a.page_no, count(c.region_ord) AS collisions FROM b a LEFT JOIN b c ON a.doc_id = c.doc_id AND a.page_no = c.page_no AND c.region_ord > a.region_ord AND a.x0 < c.x1 AND a.x1 > c.x0 AND a.y0 < c.y1 AND a.y1 > c.y0 GROUP BY a.doc_id, a.page_no",
    "plain_urls": r"SELECT page_id, coalesce(regexp_matches(url, '^(?i:https?)://(?:[A-Za-z0-9](?:[A-Za-z0-9\-.]*[A-Za-z0-9])?|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?(?:/[^\s?#@\x00-\x1f\x7f]*)?$'), false) AS plain FROM pages",
    "cache_misses": "SELECT source, count(*) AS requests, count(DISTINCT text) AS calls FROM documents WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.source = 'src0' AND c.text = documents.text) GROUP BY source",
    "mock_lengths": "SELECT conv_id, turn, greatest(1, round_even(length(regexp_replace(text, '\\s', '', 'g')) * 0.5, 0))::INT AS chars FROM conversations",
    "gated": """SELECT d.doc_id, source, coalesce(quality = 1 AND toxic = 0, false) AS passed, array_to_string(list_filter([CASE WHEN NOT coalesce(quality = 1, false) THEN 'quality' END, CASE WHEN NOT coalesce(toxic = 0, false) THEN 'harmless' END], lambda x: x IS NOT NULL), ',') AS failed FROM documents d LEFT JOIN labels USING (doc_id)""",
}
