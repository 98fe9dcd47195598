"""Registered queries of replies, tasks, recognition, reports and the viewer, and DuckDB SQL with the same results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G, text as X
from ..operators import ocr_plan as O, providers as PR, recognition as R, replies as RP, reports as RE, spans as SP, structure as S, tasks as T, translate as TR
from ..sources import ir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.regions_from_documents(table(spark, sf_dir, "documents"))


def chosen(values: list, n: Column) -> Column:
    """The value that a row's number says, in turn."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def _reply(content, usage=None, finish="stop", **more) -> str:
    return json.dumps({"choices": [{"finish_reason": finish, "message": {"content": content if isinstance(content, str) else json.dumps(content)}}], **({} if usage is None else {"usage": usage}), **more})


_FINE = {"prompt_tokens": 30, "completion_tokens": 4, "prompt_cache_hit_tokens": 10, "prompt_cache_miss_tokens": 20, "total_tokens": 34}
#: Replies of every kind: status and body.
REPLIES = [
    (200, _reply({"normal": "n ⟦PT0001⟧", "compact": "c ⟦PT0001⟧"}, _FINE)),
    (200, _reply({"normal": "n ⟦PT0001⟧", "compact": " "}, {"prompt_tokens": 5, "completion_tokens": 1})),
    (200, _reply({"answer": "a ⟦PT0001⟧"})),
    (200, _reply({"answer": {"normal": "b ⟦PT0001⟧", "compact": "⟦PT0001⟧"}})),
    (200, _reply({"translation": json.dumps({"normal": "d ⟦PT0001⟧"})})),
    (200, _reply({"other": "e ⟦PT0001⟧", "n": 5})),
    (200, _reply({"other": "f", "more": "g"})),
    (200, _reply({"answer": 7, "text": "h ⟦PT0001⟧"})),
    (200, _reply({"normal": 5})),
    (200, _reply({"normal": "  "})),
    (200, _reply({"normal": "no placeholder"})),
    (200, _reply({"normal": "⟦PT0001⟧ ⟦PT0001⟧"})),
    (200, _reply({"normal": "⟦PT0001⟧ ⟦PT0002⟧"})),
    (200, _reply("[1, 2]")),
    (200, _reply("not json")),
    (200, _reply("  ")),
    (200, _reply({"normal": "n ⟦PT0001⟧"}, _FINE, "length")),
    (200, json.dumps({"choices": [], "usage": _FINE})),
    (200, "<html>"),
    (200, "[]"),
    (200, _reply({"normal": "n ⟦PT0001⟧"}, {"prompt_tokens": True, "completion_tokens": 1})),
    (200, _reply({"normal": "n ⟦PT0001⟧"}, {"prompt_tokens": 5})),
    (200, _reply({"normal": "n ⟦PT0001⟧"}, _FINE | {"total_tokens": 35})),
    (200, _reply({"normal": "n ⟦PT0001⟧"}, _FINE | {"prompt_cache_miss_tokens": 21})),
    (200, _reply({"normal": "n ⟦PT0001⟧"}, {"prompt_tokens": 5, "completion_tokens": 1, "prompt_cache_hit_tokens": 6})),
    (429, json.dumps({"error": {"message": "slow down, Bearer abcdef"}})),
    (401, json.dumps({"error": "bad key sk-abcdef123456"})),
    (503, json.dumps({"message": "away"})),
    (418, "teapot"),
]


def reply_parsing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", chosen([s for s, _ in REPLIES], F.col("doc_id")).alias("status"), chosen([b for _, b in REPLIES], F.col("doc_id")).alias("body"), F.array(F.lit("⟦PT0001⟧")).alias("expected"))
    out = RP.parse(rows, "deepseek")
    return out.select("doc_id", "kind", "error_type", "detail", "normal", "compact", "input_tokens", "cached_tokens", "output_tokens", RP.uncached(F.col("input_tokens"), F.col("cached_tokens")).alias("uncached_tokens"))


LISTING = [json.dumps({"data": [{"id": " m2 "}, {"id": "m1"}, {"id": 5}, {"id": " "}, "x"]}), json.dumps({"data": [{"id": "m1"}, {"id": "m3"}]}), json.dumps({"models": []}), "no json"]


def model_ids(spark, sf_dir):
    return RP.model_ids(table(spark, sf_dir, "documents").select(chosen(LISTING, F.col("doc_id")).alias("body")))


def endpoints(spark, sf_dir):
    statuses = F.array(F.when(F.col("doc_id") % 2 == 0, 429).otherwise(200), F.when(F.col("doc_id") % 3 == 0, 429).otherwise(503), F.lit(429))
    urls = RP.base_urls(F.array(F.lit("https://a.example/v1/"), F.concat(F.lit("https://b.example"), F.repeat(F.lit("/"), (F.col("doc_id") % 3).cast("int"))), F.lit("https://a.example/v1")))
    return table(spark, sf_dir, "documents").select("doc_id", RP.endpoint_used(statuses, (F.col("doc_id") % 2).cast("int")).alias("used"), F.array_join(urls, " ").alias("urls"))


CONFIGURATIONS = [
    json.dumps(x)
    for x in ({"provider": "mock", "max_tokens": 5}, {"provider": "p", "api-Key": "x"}, {"a": {"b": [{"session_token": "x"}]}}, {"a": ["Bearer abcdefgh1"]}, {"a": "sk-abc"}, {"a": " sk-abcdefgh99 "}, {"a": {"promptTokens": 3, "x": "api_key:main"}}, {"note": "the password is not here"}, {"Pass Word": 1})
]


def configurations(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", chosen(CONFIGURATIONS, F.col("doc_id")).alias("c"))
    return rows.select("doc_id", RP.holds_secret(F.col("c")).alias("holds_secret"))


def clean_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 700).cast("int").alias("s"), chosen(["flow-p1-text-2", "", "-x", "a b", "p:1.2_3", "é", "x" * 129], F.col("doc_id")).alias("i"), ((F.col("doc_id") % 5) - 1).cast("int").alias("a"))
    return rows.select("doc_id", RP.clean_status(F.col("s")).alias("status"), RP.clean_segment_id(F.col("i")).alias("segment_id"), RP.clean_attempts(F.col("a")).alias("attempts"))


CODES = ["zh-CN", " en ", "EN", "ko-KR", "Zh-TW", "pt", "", "xx-YY", "RU", "id"]


def languages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", chosen(CODES, F.col("doc_id")).alias("c"))
    return rows.select("doc_id", X.language_name(F.col("c")).alias("name"), X.base_language(F.col("c")).alias("base"), X.is_word_segmented(F.col("c")).alias("segmented"))


def chat_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("t", F.regexp_replace("text", "[^ -~]", " "))
    m = RP.messages(F.lit("de"), F.lit("en"), F.col("t"), F.array(F.lit("⟦PT0001⟧")), F.lit('{"section_title": ""}'), F.col("turn") % 2 == 0)
    return rows.select("conv_id", "turn", F.length(m[0]["content"]).alias("system_chars"), F.md5(m[1]["content"].cast("binary")).alias("user_md5"))


MESSAGES = ["", "key abc123 is wrong", "got sk-1", "Bearer x", "plain failure", "long " + "x" * 400]


def safe_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", chosen(MESSAGES, F.col("doc_id")).alias("m"))
    said = X.safe_message(F.col("m"), F.lit("abc123"), "failed, check the configuration")
    notes = F.array_join(RP.limitations(F.when(F.col("doc_id") % 2 == 0, "mock").otherwise("kimi")), " ")
    return rows.select("doc_id", said.alias("said"), X.redact(F.col("m")).alias("detail"), F.length(notes).alias("limit_chars"))


def _tasks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A log of task events (odd users' tasks are on files, some are deleted) and the bodies of the texts."""
    e = table(spark, sf_dir, "events")
    pdf = F.col("user_id") % 2 == 1
    path = F.concat(F.lit("/in/paper "), "user_id", F.lit(".v1.pdf"))
    title = F.when(~pdf, "文本翻译").when(F.col("user_id") % 3 == 0, F.concat(F.lit("PAPER  "), "user_id", F.lit(".v1"))).when(F.col("user_id") % 3 == 1, F.lit("")).otherwise("A real title")
    state = F.when(~pdf, "completed").when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("completed")
    log = e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), ((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0)).alias("deleted"), F.when(pdf, "pdf").otherwise("text").alias("kind"), title.alias("title"), (F.col("user_id") % 5 == 0).alias("title_resolved"), F.lit("mock").alias("provider"), state.alias("status"), F.col("ts").cast("string").alias("created_at"), F.col("event_id").alias("updated_at"), F.when(pdf, path).alias("source_path"))
    bodies = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.min(F.regexp_replace("text", r"[^ -~\n]", "")).alias("text"))
    return log, bodies


def task_list(spark, sf_dir):
    log, bodies = _tasks(spark, sf_dir)
    return T.summaries(T.current(log), bodies).select("id", "kind", "title", "status", "updated_at", "preview")


def task_details(spark, sf_dir):
    log, bodies = _tasks(spark, sf_dir)
    tasks = T.current(log)
    return T.detail(tasks, bodies, T.may_remove(tasks).select("id")).select("id", "status", F.length("source_text").alias("chars"))


def task_titles(spark, sf_dir):
    log, _ = _tasks(spark, sf_dir)
    tasks = T.current(log)
    visual = F.when(F.col("id").cast("long") % 4 == 1, F.concat(F.lit("Found on page "), "id"))
    own = chosen(["untitled", "Microsoft Word - x.doc", "Its own title", "abc"], F.col("id").cast("long"))
    found = T.source_paths(tasks).join(tasks.select("source_path", "id"), "source_path").select("source_path", X.shown_title(visual, own, T.stem(F.col("source_path"))).alias("found"))
    return T.with_titles(tasks.where("kind = 'pdf'"), found).select("id", "title", "title_resolved")


def retained_paths(spark, sf_dir):
    log, _ = _tasks(spark, sf_dir)
    tasks = T.current(log)
    more = table(spark, sf_dir, "customer").select(F.concat(F.lit("/in/paper "), F.col("c_custkey"), F.lit(".v1.pdf")).alias("source_path"))
    return T.retained_paths(T.source_paths(tasks), T.source_paths(tasks, active_only=True), more)


REPORTS = [json.dumps({"passed": True, "layout": {"overflow_flow_count": 2, "minimum_font_size": 6.5}, "layout_safety": {"counts": {"translated_overlap": 1}}}), json.dumps({"layout": {}}), "broken", json.dumps({"passed": False, "layout_safety": {"counts": {}}})]


def public_reports(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.public_report(chosen(REPORTS, F.col("doc_id"))).alias("r")).select("doc_id", "r.*")


def _lines(spark, sf_dir) -> DataFrame:
    """Recognised lines: those of documents at double size in pixels, a third of them shifted, some blank or thin."""
    rows = regions(spark, sf_dir)
    dy = F.when(F.col("region_ord") % 3 == 0, 40).otherwise(12)
    x0, y0, x1 = 2 * F.col("x0"), 2 * (F.col("y0") + dy), 2 * F.col("x1")
    y1 = F.when(F.col("region_ord") % 7 == 0, y0 + 0.5).otherwise(2 * (F.col("y1") + dy))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    clip = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(800.0).alias("y1"))
    return rows.select("doc_id", "page_no", F.col("region_ord").alias("line_no"), F.when(F.col("region_ord") % 11 == 0, " ").otherwise(F.col("source_text")).alias("text"), (0.7 + (F.col("region_ord") % 4) / 10).alias("confidence"), F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)).alias("polygon"), clip.alias("clip"), F.struct(F.lit(1200).alias("width"), F.lit(1600).alias("height")).alias("pixels"), "page_width", "page_height")


def recognised_regions(spark, sf_dir):
    return R.added(_lines(spark, sf_dir), regions(spark, sf_dir)).select("doc_id", "page_no", "line_no", "region_id", "x0", "y0", "x1", "y1", F.round("font_size", 6).alias("font_size"), "content_confidence")


def recognition_runs(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return R.run_counters(lines, R.added(lines, regions(spark, sf_dir)))


def text_heavy_pages(spark, sf_dir):
    return R.text_heavy(_lines(spark, sf_dir), ["doc_id", "page_no"])


def _images(spark, sf_dir) -> DataFrame:
    rows = regions(spark, sf_dir)
    return rows.withColumns({"native_block_type": F.when(F.col("region_ord") % 2 == 0, "image").otherwise("text"), "x1": F.col("x1") + (F.col("region_ord") % 5) * 90, "y1": F.col("y1") + (F.col("region_ord") % 7) * 120})


def image_candidates(spark, sf_dir):
    rows = _images(spark, sf_dir)
    scans = R.with_scan_background(rows).select("doc_id", "page_no", "region_ord", "ocr_background")
    return R.image_candidates(rows).select("doc_id", "page_no", "region_ord").join(scans, ["doc_id", "page_no", "region_ord"])


def redactions(spark, sf_dir):
    rows = regions(spark, sf_dir).withColumns({"content_source": F.when(F.col("region_ord") % 2 == 0, "paddleocr").otherwise("native_pdf"), "translatable": F.col("region_ord") % 4 != 3, "y1": F.col("y1") + 30})
    out = R.redactions(rows, rows.where("translatable").select("doc_id", "region_id"))
    area = F.aggregate("pieces", F.lit(0.0), lambda a, p: a + G.width(p) * G.height(p))
    return out.select("doc_id", "page_no", "region_ord", F.bround(area * 10000).cast("long").alias("area"), "cutouts")


def protection_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    mark = lambda n: F.concat(F.lit("⟦PT000"), n.cast("string"), F.lit("⟧"))
    expected = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(mark(F.col("turn") % 3), mark(F.col("turn") % 3 + 1)))
    rows = rows.withColumn("tokens", expected).withColumn("said", F.concat(mark(F.col("turn") % 5), F.lit(" "), mark(F.col("turn") % 2 + 1)))
    v = rows.withColumn("i", X.placeholder_issues(F.col("said"), F.col("tokens"))).select("doc_id", (F.size("tokens") - F.size("i.missing")).alias("restored"), "i.*")
    return RE.protection_stats(rows, v)


def _chains(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Regions, and flows of three neighbours each."""
    rows = regions(spark, sf_dir).withColumn("region_id", F.concat(F.lit("p"), "page_no", F.lit("-"), "region_ord"))
    made = rows.groupBy("doc_id", F.floor(F.col("region_ord") / 3).alias("k")).agg(F.min_by("type", "region_ord").alias("type"), F.array_sort(F.collect_list(F.struct("region_ord", "region_id"))).alias("r"))
    return rows, made.select("doc_id", F.concat(F.lit("flow-"), "k").alias("flow_id"), "type", F.transform("r", lambda x: x["region_id"]).alias("region_ids"))


def flow_fonts(spark, sf_dir):
    rows, made = _chains(spark, sf_dir)
    return RE.flow_fonts(made, rows)


def layout_stats(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    placed = l.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("flow-"), F.col("l_linenumber") % 3).alias("flow_id"), (F.col("l_quantity") < 45).alias("fit"), F.when(F.col("l_returnflag") == "N", "compact").otherwise("normal").alias("variant"), (4 + F.col("l_linenumber") % 5).cast("double").alias("font_size"), F.lit(8.0).alias("original_size"), F.floor("l_quantity").cast("int").alias("rest_chars"), (F.col("l_linenumber") % 2).cast("int").alias("blocked_slots"))
    return RE.layout_stats(placed, 0.65)


FONTS = ["ABCDEF+CMBX10", "Helvetica-Oblique", "CourierNew,BoldItalic", "Times-Roman", "CMTI8", "Arial-Black", "DejaVuSansMono-Bd", None, "x-it"]


def font_styles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", chosen(FONTS, F.col("doc_id")).alias("font"), (F.col("doc_id") % 32).cast("int").alias("flags"), (F.col("doc_id") * 65793 % 16777216).cast("int").alias("color"))
    return rows.select("doc_id", RE.font_style(F.col("font"), F.col("flags")).alias("s"), RE.rgb(F.col("color")).alias("c")).select("doc_id", "s.*", *[F.round(f"c.{k}", 6).alias(k) for k in "rgb"])


def font_counts(spark, sf_dir):
    out = RE.font_counts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("font")))
    return out.select("doc_id", "spans", F.array_join(F.transform(F.map_entries("fonts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("fonts"))


def paired_pages(spark, sf_dir):
    rows = regions(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.min_by("source_text", "region_ord").alias("text"))
    return RE.paired_pages(rows.where("page_no > 1"), rows).select("doc_id", "place", "page_no", "page_no2", F.md5(F.col("truth").cast("binary")).alias("truth_md5"))


def inspection_reports(spark, sf_dir):
    pages = regions(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.count("*").alias("regions"), F.count_if(F.col("region_ord") % 2 == 0).alias("translatable"), F.lit("keep_native").alias("action"))
    stats = pages.groupBy("doc_id").agg(F.sum("regions").alias("flow_count"), F.lit(0).alias("merged_flow_count"), F.lit(1).alias("cross_column_edges"), F.lit(2).alias("cross_page_edges"), F.lit(3).alias("dehyphenation_count"))
    return RE.inspection(pages, stats).select("doc_id", F.length("report").alias("chars"), F.md5(F.col("report").cast("binary")).alias("report_md5"))


def page_windows(spark, sf_dir):
    n = F.col("doc_id").cast("int")
    rows = table(spark, sf_dir, "documents").select("doc_id", RE.page_window(n % 13 - 1, n % 7).alias("a"), RE.page_window(n % 5 + 1, n % 7).alias("b"))
    rows = rows.select("doc_id", "a", RE.page_changes(F.array_union("a", "b"), F.array(F.lit(1), F.lit(9), F.lit(4))).alias("c"), RE.linked_page(n % 6, F.col("b")).alias("linked"))
    return rows.select("doc_id", F.array_join("a", ",").alias("pages"), *[F.array_join(f"c.{k}", ",").alias(k) for k in ("kept", "missing", "dropped")], "linked")


def _points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    boxes = regions(spark, sf_dir).select("doc_id", "page_no", F.col("region_ord").alias("order"), F.concat(F.lit("flow-"), F.floor(F.col("region_ord") / 2)).alias("flow_id"), "x0", "y0", "x1", "y1")
    p = F.posexplode(F.array(*[F.lit(float(x)) for x in (60, 200, 330, 599)]))
    points = boxes.select("doc_id", "page_no", "order", F.col("y0").alias("top"), p.alias("k", "x"))
    return points.select("doc_id", "page_no", (F.col("order") * 4 + F.col("k")).alias("point_id"), F.col("order").alias("selection_id"), "x", (F.col("top") + 11 + F.col("k") * 2).alias("y"), F.lit(3.0).alias("tolerance")), boxes


def paragraph_hits(spark, sf_dir):
    return RE.paragraph_at(*_points(spark, sf_dir)).select("doc_id", "page_no", "point_id", "flow_id")


def selections(spark, sf_dir):
    points, boxes = _points(spark, sf_dir)
    return RE.selections(points.where("point_id % 4 < 2"), boxes)


def glossary_problems(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.concat(F.when(F.col("doc_id") % 2 == 0, "Term").otherwise("term"), F.floor(F.col("doc_id") / 2))).alias("source"), F.repeat(F.lit("x"), (F.col("doc_id") % 210).cast("int")).alias("target"))
    return ir.glossary_problems(terms)


def base_types(spark, sf_dir):
    rows = regions(spark, sf_dir).withColumns({"y0": F.col("y0") - 70 + (F.col("region_ord") % 3) * 60, "y1": F.col("y1") - 75 + (F.col("region_ord") % 3) * 60, "font_size": 8.0 + F.col("region_ord") % 7, "source_text": F.when(F.col("region_ord") % 4 == 0, " 12 ").otherwise(F.col("source_text"))})
    return rows.select("doc_id", "page_no", "region_ord", S.base_type(F.col("y0"), F.col("y1"), F.col("page_height"), F.col("font_size"), F.lit(10.0), F.col("source_text")).alias("type"))


def page_texts(spark, sf_dir):
    from ..operators.quality import page_text

    rows = regions(spark, sf_dir).withColumns({"reading_order": F.when(F.col("region_ord") % 5 != 0, F.col("region_ord") % 17), "source_text": F.regexp_replace("source_text", "[^ -~]", "")})
    return page_text(rows).select("doc_id", "page_no", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def cached_translations(spark, sf_dir):
    """Requests through the cache and a provider: each key that the cache lacks is asked for once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    asked = docs.withColumn("cache_key", TR.cache_key("mock", "v2", "zh-CN", F.col("text"), F.array().cast("array<string>"), F.lit("")))
    cache = asked.where("source = 'src0'").groupBy("cache_key").agg(F.lit("from cache").alias("normal"), F.lit(None).cast("string").alias("compact"))

    def make():
        return lambda batch: batch.assign(normal=batch["text"].str.len().astype(str), compact=None)

    results, _ = TR.translate(asked, cache, make)
    return results.select("doc_id", "normal")


def unreferenced_files(spark, sf_dir):
    from ..operators.quality import unreferenced

    files = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.concat_ws("/", F.lit("/up"), F.col("doc_id") % 50, F.col("doc_id") % 7, "doc_id").alias("path"))
    kept = table(spark, sf_dir, "customer").select(F.concat_ws("/", F.lit("/up"), F.col("c_custkey") % 90, F.col("c_custkey") % 3).alias("path"))
    return unreferenced(files, kept).select("path")


def _blocks(spark, sf_dir) -> DataFrame:
    """A block for each document: its lines, and their words as spans of sizes by length."""
    words = lambda line: F.transform(F.split(line, " "), lambda w: F.struct(F.concat(w, F.lit(" ")).alias("text"), F.concat(F.lit("f"), F.length(w) % 3).alias("font"), (F.length(w) % 5 + 8).cast("double").alias("size"), (F.length(w) % 2 * 16).alias("flags"), F.lit(0).alias("color")))
    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.select("doc_id", F.lit(1).alias("page_no"), F.transform(F.split(F.regexp_replace("text", r"[^ -~\n]", ""), "\n"), lambda x: F.struct(words(x).alias("spans"))).alias("lines"))


def block_styles(spark, sf_dir):
    rows = _blocks(spark, sf_dir)
    out = rows.select("doc_id", F.md5(SP.block_text(F.col("lines")).cast("binary")).alias("text_md5"), F.size(SP.drawn(F.col("lines"))).alias("spans"), SP.block_style(F.col("lines")).alias("s"))
    return out.join(SP.body_sizes(rows).select("doc_id", "body_size"), "doc_id").select("doc_id", "text_md5", "spans", "s.font", "s.size", "s.flags", "s.largest", "body_size")


def visual_lines(spark, sf_dir):
    rows = regions(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.collect_list(F.when(F.col("region_ord") % 4 != 0, (F.col("y0") + F.col("y1")) / 2)).alias("centres"), F.max("font_size").alias("font"), F.max("y1").alias("h"))
    return rows.select("doc_id", "page_no", SP.visual_lines(F.col("centres"), F.col("font"), F.col("h")).alias("lines"))


def request_checks(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents")
    mode, provider, url = chosen(["standalone_text", "selected_text", "other"], n), chosen(["mock", "kimi", "compatible", "nobody"], n), chosen(["https://a.example/v1", "", "ftp://x"], F.floor(n / 4))
    return rows.select("doc_id", PR.request_problem(F.col("text"), mode, provider, F.floor(n / 3) % 2 == 0, url, F.lit("m"), F.lit("en"), chosen(["de", " "], F.floor(n / 7))).alias("problem"))


def round_trip_gates(spark, sf_dir):
    """Pages of documents against themselves, less a page, with a text changed, or with another size."""
    rows = regions(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.min_by("source_text", "region_ord").alias("text"), F.lit(600.0).alias("width"), F.lit(1).alias("links"))
    rows = rows.withColumns({"height": F.lit(800.0), "samples": F.col("text").cast("binary")})
    k = F.col("doc_id") % 5
    out = rows.where((k != 1) | (F.col("page_no") < 2)).withColumns({"text": F.when(k == 2, "zzzzzzzz").otherwise(F.col("text")), "height": F.when(k == 3, 801.0).otherwise(800.0)})
    got = PR.round_trip_gates(RE.round_trip(rows, out), rows.where(k == 4).select("doc_id"))
    return got.select("doc_id", "source_page_count", "output_page_count", "passed", F.array_join("failed", ",").alias("failed"), "mean_changed_fraction")


def rounded_boxes(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    box = F.array(F.col("l_quantity") / 7, F.col("l_tax"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")), F.when(F.col("l_linenumber") == 4, float("nan")).otherwise(F.col("l_quantity")))
    b = G.rounded_box(F.when(F.col("l_linenumber") == 5, F.slice(box, 1, 3)).otherwise(box))
    return l.groupBy("l_orderkey").agg(F.count(b).alias("boxes"), F.bround(F.sum(F.coalesce(b[0], F.lit(0.0))) * 1000).cast("long").alias("x0_sum"))


def region_sequence(spark, sf_dir):
    rows = regions(spark, sf_dir).withColumn("reading_order", F.when(F.col("region_ord") % 4 != 1, 100 - F.col("region_ord")))
    return S.sequence(rows).select("doc_id", "page_no", "region_ord", "position")


def page_decisions(spark, sf_dir):
    rows = regions(spark, sf_dir).withColumns({"content_source": F.when(F.col("page_no") % 2 == 0, "paddleocr").otherwise("native_pdf"), "confidence": F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(1.0)})
    decided = O.decide(O.diagnostics(rows))
    free = decided.join(O.blocked(decided).select("doc_id").distinct(), "doc_id", "left_anti")
    return O.unblocked(O.with_decisions(rows, decided).join(free.select("doc_id").distinct(), "doc_id", "left_semi"), free).groupBy("doc_id", "action").agg(F.count("*").alias("regions"))


QUERIES = {
    f.__name__: f
    for f in (
        reply_parsing, model_ids, endpoints, configurations, clean_fields, languages, chat_messages, safe_messages, task_list, task_details, task_titles, retained_paths, public_reports, recognised_regions, recognition_runs,
        text_heavy_pages, image_candidates, redactions, protection_stats, flow_fonts, layout_stats, font_styles, font_counts, paired_pages, inspection_reports, page_windows, paragraph_hits, selections, glossary_problems,
        base_types, page_texts, cached_translations, unreferenced_files, block_styles, visual_lines, request_checks, round_trip_gates, rounded_boxes, region_sequence, page_decisions,
    )
}
