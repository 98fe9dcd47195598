"""Document engine: literal cases, invariants, and SQL on the smallest tables."""

import os

import pytest
from pyspark.sql import Row, functions as F

from foliospark.functions import geometry as G, protect as P, text as X
from foliospark.operators import flows as FL, layout as L, ocr_plan as O, quality as Q, structure as S, translate as TR
from foliospark.plans import queries
from foliospark.sources import ir

SF = "/root/testdata/sf0.001"


def regions(spark, *rows, width=600.0, height=800.0):
    """Region rows from short dicts."""
    base = dict(doc_id=1, page_no=1, type="paragraph", font_size=10.0, flags=0, translatable=True, confidence=1.0, content_source="native_pdf", native_block_type="text", ocr_background=False, ocr_source_region_id=None, line_count=None, page_width=width, page_height=height, drawing_count=0, reading_order=None, column_index=None)
    made = []
    for k, r in enumerate(rows):
        x0, y0, x1, y1 = r["box"]
        made.append(base | dict(region_ord=k, region_id=f"r{k}", source_text="") | {a: b for a, b in r.items() if a != "box"} | dict(x0=float(x0), y0=float(y0), x1=float(x1), y1=float(y1)))
    from pyspark.sql.types import StructType

    full = StructType.fromDDL(ir.REGION + ", reading_order int, column_index int")
    return spark.createDataFrame([tuple(m[f.name] for f in full.fields) for m in made], full)


def plain(df):
    return df.drop("reading_order", "column_index")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hyphens(spark):
    text = one(spark, FL.joined_lines(F.array(*map(F.lit, ["The model is im-", "proved and state-", "of-the-art."])), F.array().cast("array<string>")))
    assert text["text"] == "The model is improved and state-of-the-art."
    assert [d["action"] for d in text["decisions"]] == ["remove", "preserve"]


def test_flow_across_columns(spark):
    rows = regions(spark, dict(box=(50, 620, 280, 760), source_text="The scientific paragraph continues smoothly", reading_order=1, column_index=1), dict(box=(320, 80, 550, 220), source_text="and goes across the next column.", reading_order=2, column_index=2))
    made = FL.flows(rows).collect()
    assert [(r["flow_id"], r["region_ids"]) for r in made] == [("flow-r0", ["r0", "r1"])]
    assert FL.edges(rows).first()["boundary"] == "cross_column"


def test_unlike_fonts_stay_apart(spark):
    rows = regions(spark, dict(box=(50, 620, 280, 760), source_text="The paragraph continues here", reading_order=1, column_index=1), dict(box=(320, 80, 550, 120), source_text="method score accuracy values", font_size=7.0, reading_order=2, column_index=2))
    assert FL.flows(rows).count() == 2


def test_flow_across_pages(spark):
    rows = regions(spark, dict(box=(320, 620, 550, 760), source_text="The long paragraph continues smoothly", reading_order=1, column_index=2), dict(box=(50, 80, 280, 220), page_no=2, source_text="and ends on the following page.", reading_order=1, column_index=1))
    made = FL.flows(rows).collect()
    assert len(made) == 1 and made[0]["page_numbers"] == [1, 2] and made[0]["confidence"] == 0.8


def test_recognised_lines_make_a_paragraph(spark):
    line = lambda box: dict(box=box, source_text="some words on this line", content_source="paddleocr", font_size=8.0, reading_order=1, column_index=0)
    rows = regions(spark, *[line(b) | dict(reading_order=k) for k, b in enumerate([(50, 80, 330, 90), (50, 94, 350, 104), (50, 108, 245, 118)])], width=400.0, height=600.0)
    assert [r["boundary"] for r in FL.edges(rows).collect()] == ["ocr_same_paragraph"] * 2
    assert FL.flows(rows).count() == 1


def test_tables_and_captions(spark):
    body = dict(box=(50, 400, 280, 520), source_text="Body text of the paper in full width here")
    rows = regions(spark, dict(box=(50, 100, 280, 125), source_text="Table 1. Results"), dict(box=(70, 140, 260, 170), source_text="a 1 b 2", font_size=7.0), body, body | dict(box=(320, 400, 550, 520)))
    kinds = [r["type"] for r in S.recover(plain(rows)).orderBy("region_ord").collect()]
    assert kinds[:3] == ["table_caption", "table_text", "paragraph"]


def test_formula_closure(spark):
    rows = regions(spark, dict(box=(50, 74, 104, 84), source_text="loss function:"), dict(box=(79, 95, 90, 109), source_text="S2\nX"), dict(box=(79, 114, 90, 119), source_text="i=0"), dict(box=(105, 102, 110, 109), source_text="p"), dict(box=(50, 245, 280, 300), source_text="Plain prose stays a paragraph here, for sure."))
    assert [r["type"] for r in S.recover(plain(rows)).orderBy("region_ord").collect()] == ["formula"] * 4 + ["paragraph"]


def test_references_end_at_the_next_heading(spark):
    text = lambda y, t, kind="paragraph", page=1: dict(box=(50, y, 280, y + 20), source_text=t, type=kind, page_no=page)
    rows = regions(spark, text(100, "References", "heading"), text(140, "An entry of the list, with a name."), text(100, "Another entry of the list, a name.", page=2), text(140, "A. Object Detection Baselines", "heading", 2), text(180, "This paragraph of the appendix is translated.", page=2))
    got = S.recover(plain(rows)).orderBy("region_ord").collect()
    assert [r["type"] for r in got] == ["heading", "reference", "reference", "heading", "paragraph"]
    assert [r["translatable"] for r in got] == [True, False, False, True, True]


def test_pages_for_recognition(spark):
    image = dict(native_block_type="image", type="figure", source_text=None)
    rows = regions(spark, dict(box=(0, 0, 100, 100), source_text="A" * 120), dict(box=(0, 0, 240, 600), page_no=2, **image), dict(box=(160, 0, 400, 600), page_no=2, **image), dict(box=(0, 0, 50, 50), page_no=3, source_text="" * 120), dict(box=(0, 0, 50, 50), page_no=4, source_text="Appendix"), dict(box=(0, 0, 1, 1), page_no=5, source_text=None, drawing_count=3), dict(box=(0, 0, 1, 1), page_no=6, source_text=None), width=400.0, height=600.0)
    got = O.decide(O.diagnostics(rows)).orderBy("page_no").collect()
    assert [r["action"] for r in got] == ["keep_native", "run_ocr", "review", "keep_native", "review", "skip_blank"]
    assert got[1]["coverage"] == 1.0 and got[2]["quality"] == 0.0
    assert O.summary(O.decide(O.diagnostics(rows))).first()["blocking_pages"] == [2, 3, 5]


def test_placeholders(spark):
    source = "See [12, 14-16], DOI 10.1000/xyz.123, https://example.org/a, x_i, λ, 10 ms and 95%."
    got = spark.createDataFrame([(source,), (None,)], "t string").select("t", P.protect(F.col("t")).alias("p")).select("t", "p", X.restore(F.col("p.text"), F.col("p.tokens")).alias("back")).collect()
    assert [t["kind"] for t in got[0]["p"]["tokens"]] == ["citation", "doi", "url", "variable", "variable", "unit", "unit"]
    assert got[0]["back"] == source and got[1]["back"] is None
    issues = one(spark, X.placeholder_issues(F.lit("译文⟦PT0001⟧⟦PT0001⟧⟦PT0003⟧⟦PT9999⟧"), F.array(*[F.lit(f"⟦PT000{k}⟧") for k in (1, 2, 3)])))
    assert (issues["missing"], issues["duplicated"], issues["unknown"]) == (["⟦PT0002⟧"], ["⟦PT0001⟧"], ["⟦PT9999⟧"])


def test_boxes(spark):
    box = lambda *b: G.box(*map(lambda v: F.lit(float(v)), b))
    assert not one(spark, G.overlaps(box(0, 0, 10, 10), box(10, 0, 20, 10)))
    assert one(spark, G.overlaps(box(0, 0, 10, 10), box(10, 0, 20, 10), 0.25))
    parts = one(spark, G.cut_out(box(50, 100, 270, 200), F.array(box(140, 145, 260, 170))))
    assert len(parts) == 4 and sum((p["x1"] - p["x0"]) * (p["y1"] - p["y0"]) for p in parts) == 19000.0


def test_cost_and_usage(spark):
    n = lambda x: F.lit(x)
    assert float(one(spark, TR.cost(n(1_000_000), n(250_000), n(100_000), "deepseek"))) == pytest.approx(0.1337)
    assert float(one(spark, TR.cost(n(1_000_000), n(250_000), n(100_000), "kimi"))) == pytest.approx(7.85)


def test_cache_and_retries(spark):
    asked = spark.createDataFrame([("s1", "k1", "first"), ("s2", "k2", "second"), ("s3", "k1", "first")], "segment_id string, cache_key string, text string")
    cache = spark.createDataFrame([], "cache_key string, normal string, compact string")
    make = lambda: lambda b: b.assign(normal=b["text"].str.upper(), compact=b["text"])
    got, fresh = TR.translate(asked, cache, make)
    assert fresh.count() == 2 and {r["segment_id"]: r["normal"] for r in got.collect()} == {"s1": "FIRST", "s2": "SECOND", "s3": "FIRST"}
    assert TR.translate(asked, fresh, make)[1].count() == 0
    waits, left = [], [2]

    def flaky(batch):
        left[0] -= 1
        if left[0] >= 0:
            raise OSError
        return batch

    assert TR.with_retries(flaky, 3, 0.1, 2, 1, sleep=waits.append)("x") == "x" and waits == [0.1, 0.2]
    now = [0.0]
    waits.clear()
    slow = TR.with_retries(lambda b: b, 1, interval=0.5, sleep=waits.append, clock=lambda: now[0])
    for _ in range(3):
        slow("x")
    assert waits == [0.5, 0.5]


def test_layout_fits_or_overflows(spark):
    def run(box, text):
        rows = plain(regions(spark, dict(box=box, source_text="x"), dict(box=(40, 500, 160, 520), type="formula", translatable=False)))
        asked = spark.createDataFrame([(1, 1, "flow-r0", ["r0"], text, text, 10.0)], "doc_id long, flow_ord int, flow_id string, region_ids array<string>, normal string, compact string, font_size double")
        placed = L.lay_out(asked, rows)
        return placed.collect(), L.validate(placed, rows, asked).first()

    lines, report = run((40, 40, 260, 160), "译文" * 20)
    assert lines and all(r["fit"] for r in lines) and report["passed"] and report["violations"] == []
    lines, report = run((40, 40, 60, 48), "译文" * 20)
    assert not lines[0]["fit"] and report["violations"][0] == "overflow"
    assert L.take_line("译文，译", 20.0, 10.0, False) == ("译", "文，译")


def test_ocr_quality(spark):
    pairs = spark.createDataFrame([(1, 1, "the whole network detects object in large images quickly", "the whole network detects objects in large images quickly"), (2, 1, "academic evidence", "a very long text about many other things " * 3)], "doc_id long, page_no int, text string, truth string")
    got = {r["doc_id"]: r for r in Q.ocr_quality(pairs).collect()}
    assert got[1]["passed"] and 0 < got[1]["character_error_rate"] < 0.1
    assert {"character_error_rate", "character_coverage"} <= set(got[2]["violations"])


def test_latest_and_storage(spark):
    rows = spark.createDataFrame([("a", 1, "queued"), ("a", 3, "failed"), ("a", 2, "running"), ("b", 1, "queued")], "id string, at int, status string")
    assert {r["id"]: r["status"] for r in Q.latest(rows, "id", F.col("at")).collect()} == {"a": "failed", "b": "queued"}
    files = spark.createDataFrame([("/u/1/a.pdf",), ("/u/2/b.pdf",), ("/u/10/c.pdf",)], "path string")
    assert {r["path"] for r in Q.unreferenced(files, spark.createDataFrame([("/u/1",)], "path string")).collect()} == {"/u/2/b.pdf", "/u/10/c.pdf"}


def test_stream_keeps_last_states(spark, tmp_path):
    from foliospark.streaming import jobs as J

    batch = spark.createDataFrame([Row(event_id=k, ts=__import__("datetime").datetime(2024, 1, 1, 0, k), user_id=k % 3, event_type=["signup", "view", "purchase", "error"][k % 4]) for k in range(12)])
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    query = J.run_job_states(J.read_events(spark, f"{tmp_path}/in", batch.schema, 1), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(120)
    key = lambda df: sorted((r["user_id"], r["event_id"], r["state"]) for r in df.collect())
    assert key(J.current_states(spark, f"{tmp_path}/out")) == key(J.job_states(batch))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["special_regions", "reading_order", "coverage", "contexts", "placeholder_issues", "usage_by_job", "weighted_medians", "gated"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "lineitem", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    tidy = lambda df: df[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert tidy(got).equals(tidy(want))


def test_large_glossaries_drop_no_flow(spark, tmp_path):
    turns = [(1, 0, "user", "Wordab and wordzz"), (1, 1, "user", "nothing"), (2, 0, "user", "wordba")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(k, f"word{a}{b} more") for k, (a, b) in enumerate((a, b) for a in letters for b in letters)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["flow_ord"]): r["terms"] for r in queries.glossary_hits(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): "wordab,wordzz", (1, 1): "", (2, 0): "wordba"}
    with pytest.raises(Exception, match="at most 500 terms"):
        TR.contexts(queries._turns(spark, str(tmp_path)), queries._terms(spark, str(tmp_path))).collect()


def test_cut_outs_of_all_regions(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join("some words " * (k % 4 + 1) for k in range(23)), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    boxes = {r["region_ord"]: tuple(int(r[c]) for c in ("x0", "y0", "x1", "y1")) for r in queries.regions(spark, str(tmp_path)).collect()}
    want = {}
    for k, (x0, y0, x1, y1) in boxes.items():
        cut = lambda x, y: (x0 + 10 <= x < x0 + 50 and y0 + 2 <= y < y0 + 8) or x0 + 40 <= x < x0 + 70  # noqa: B023, E731
        want[k] = sum(not cut(x, y) for x in range(x0, x1) for y in range(y0, y1))
    got = {r["region_ord"]: r["area"] for r in queries.cut_outs(spark, str(tmp_path)).collect()}
    assert len(got) == 23 and got == want


def test_placeholders_late_in_a_text(spark, tmp_path):
    late = "word " * 20 + "⟦PT0001⟧ ⟦PT0005⟧"
    spark.createDataFrame([(2, late, 3), (2, None, 3)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r)[1:] for r in queries.placeholder_issues(spark, str(tmp_path)).collect()}
    mark = "⟦PT000{}⟧".format
    assert got == {("", "", f"{mark(5)},{mark(6)}"), (mark(1), "", mark(6))}
