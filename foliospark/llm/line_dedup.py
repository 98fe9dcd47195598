"""Line dedup: of equal and nearly equal lines the first stays.

Lines are the parts of a text between line breaks; the order is that of
(doc_id, hash of the text, line number). A line goes if an equal line comes before it. A
line of at least `least` characters also goes if another line of at least
`least` characters, within `edits` edits of it, comes before it anywhere.

Near lines are found by a segment-partition edit join. A line of length l is
split into edits + 1 segments; a line within reach of it holds one of them
unchanged, near the segment's place. So each line is indexed under its segments
and probes, for each length up to its own and at most `edits` less, the
substrings at the places that the segments can have moved to. Candidates are
verified by banded bit-parallel edit distance.

DataFrame functions only. Lines are written once as numbers: their
place, hash and keys. All keys are then reduced to those with two different
lines, by an aggregation with partial results, so that a line's copies meet
nowhere; only lines with such a key are fetched as texts. Sketches of
character counts, of which each edit changes two by one at most, are part of the join's
condition, and a pair is formed at the first segment that it shares: so unlike
lines of a common segment, and pairs of several, make no further rows.

A key of over DEAL lines, such as a template's, is hot. Its lines get marks
besides: the parity of their pairs of characters in 64 classes, four times.
What lines have in common cancels out in the difference of two marks, and an
edit changes four bits of it at most. And the lines indexed under a hot key are
dealt out in chunks of about DEAL, each a key of its own that all probes visit,
so that its work is spread over tasks.

Defined cases: null and empty texts have no line, and stay as they are; lines
without a word stay, so blank lines aren't duplicates; rows of equal doc_id
and text lose the same lines; a null doc_id comes last; an empty table gives no
rows; other columns are passed on, whatever their names, but for n_lines,
n_equal and n_near, which are replaced. Lines are told apart by 128 bits of
hashes, and in candidate pairs by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import FEW_BYTES, few, fresh, scratch, table, written

EDITS, LEAST = 2, 30
DEAL = 1024  # lines that one task compares with all probes of their key
CHARACTERS = ("enirastodhlucmpg", "fbywvk0123456789")  # counted in the two longs of a sketch, four bits each
CODES = (0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000)  # of a count modulo eight: one more or less changes one bit


def let(value: Column, body) -> Column:
    """body of value, with value evaluated once."""
    return F.transform(F.array(value), body).getItem(0)


def bound(length: Column, k: int, edits: int) -> Column:
    """Where segment k of edits + 1 begins, from 0; so segment edits + 1 is the line's end."""
    return F.lit(0) if k == 0 else length if k == edits + 1 else F.call_function("div", length * k, F.lit(edits + 1)).cast("int")


def keys_of(line: Column, length: Column, edits: int) -> list[Column]:
    """Hashes of (segment, its line's length, substring) to probe; the first edits + 1 are the segments, to index a line under.

    The expressions are kept short: generated code of over 8000 bytes would not be compiled.
    """
    own, more = [], []
    for gap in range(edits + 1):
        of = length - gap if gap else length
        for k in range(edits + 1):
            start = bound(of, k, edits)
            size = bound(of, k + 1, edits) - start if k else bound(of, 1, edits)
            for shift in range(max(-k, gap - (edits - k)), min(k, gap + (edits - k)) + 1):
                key = F.xxhash64(of * (edits + 1) + k, F.substring(line, start + (shift + 1), size))
                (own if gap == shift == 0 else more).append(key)
    return own + more


def shifted(bits: Column, by: Column) -> Column:
    return F.call_function("shiftleft", bits.cast("long"), by.cast("int"))


def sketch(line: Column) -> list[Column]:
    """Counts of CHARACTERS, in CODES."""

    def of(low: Column, characters: str) -> Column:
        code = lambda x: F.get(F.array(*map(F.lit, CODES)), (F.length(low) - F.length(F.replace(low, x, F.lit("")))).bitwiseAND(7))
        parts = F.transform(F.array(*map(F.lit, characters)), lambda x, i: shifted(code(x), 4 * i))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    first, second = CHARACTERS
    return [let(F.lower(line), lambda low: of(low, first)), let(F.lower(line), lambda low: of(low, second))]


def sketch_gap(a: list[Column], b: list[Column]) -> Column:
    """The least that the counts of two sketches differ by in all."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))


def marks(line: Column) -> Column:
    """Four longs: of each pair of neighbouring characters a bit in each is turned over."""

    def of(x: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(x) - 2), lambda i: F.xxhash64(F.get(x, i), F.get(x, i + 1)))

        def parity(hashes: Column, k: int) -> Column:
            bit = lambda h: shifted(F.lit(1), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63).cast("long")))
            return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(bit(h)))

        def turn(hashes: Column) -> Column:
            return F.array(*[parity(hashes, k) for k in range(4)])

        return let(pairs, turn)

    return let(F.split(line, ""), of)


def within_edits(long: Column, short: Column, edits: int) -> Column:
    """Whether two strings, the first at least as long and by at most `edits` longer, are within `edits` edits.

    Bit-parallel over the 2 * edits + 1 diagonals of the band: bit k of a
    vector stands for character i - edits + k of the long string when
    character i of the short one is read. Needs edits < len(long).
    """
    full = F.lit((1 << (2 * edits + 1)) - 1)
    top, below = 1 << 2 * edits, 1 << (2 * edits - 1) if edits else 0

    def body(chars: Column) -> Column:
        a, b = chars["a"], chars["b"]
        n = F.size(a)

        def step(s: Column, c: Column, i: Column) -> Column:
            match = F.lit(0)
            for k in range(2 * edits + 1):
                at = i - edits + k
                match = match + F.when((at >= 0) & (F.get(a, at) == c), 1 << k).otherwise(0)

            def third(v: Column) -> Column:
                d, hp, hn = v["d"], v["hp"], v["hn"]
                down = F.shiftright(d, 1)
                diagonal = F.when(d.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
                flat = F.when(hp.bitwiseAND(s["h"]) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(s["h"]) != 0, 1).otherwise(0)
                first = i < n - edits
                return F.struct(
                    hn.bitwiseOR(full.bitwiseXOR(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"),
                    (s["n"] + F.when(first, diagonal).otherwise(flat)).alias("n"), F.when(first, s["h"]).otherwise(F.shiftright(s["h"], 1)).alias("h"), (s["i"] + 1).alias("i"),
                )

            def second(d: Column) -> Column:
                hp = s["vn"].bitwiseOR(full.bitwiseXOR(d.bitwiseOR(s["vp"])))
                return let(F.struct(d.alias("d"), hp.alias("hp"), d.bitwiseAND(s["vp"]).alias("hn")), third)

            def first_(x: Column) -> Column:
                carry = (x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseAND(full)
                return let(carry.bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]), second)

            return let(match, first_)

        start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("n"), F.lit(below).alias("h"), F.lit(0).alias("i"))
        return F.aggregate(b, start, lambda s, c: step(s, c, s["i"]), lambda s: s["n"])

    chars = F.struct(F.split(long, "").alias("a"), F.split(short, "").alias("b"))
    return let(chars, body) <= edits


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, place, line, id): every line with a word. version tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    rows = rows.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("id", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")))


def lines_of(docs: DataFrame, edits: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, place, id, n, keys), written without texts: all later passes but one read these numbers."""
    rows = texts_of(docs, id_col, text_col).withColumn("n", F.length("line"))
    keys = F.when(F.col("n") >= least, F.array(*keys_of(F.col("line"), F.col("n"), edits)))
    return written(rows.select("doc_id", "version", "place", "id", "n", keys.alias("keys")), "lines")[0]


def order() -> Column:
    """A line's place in the corpus."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version", "place")


def near_lines(lines: DataFrame, texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """(id, other): different lines within reach of each other, each pair once."""
    # up to the fetch of texts, half an id does: lines that share it meet as candidates under both lines' keys
    long = lines.where("keys IS NOT NULL").select(F.col("id.a").alias("half"), "keys")
    live = long.select("half", F.explode("keys").alias("key")).groupBy("key").agg(F.min("half").alias("lo"), F.max("half").alias("hi")).where("lo <> hi").select("key")
    live, _ = written(live, "live")
    hits = long.select("half", F.explode("keys").alias("key")).join(few(live), "key").distinct()
    hits, _ = written(hits, "hits")
    hot, _ = written(hits.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > DEAL).select("key", F.ceil(F.col("n") / DEAL).cast("int").alias("chunks")), "hot")
    some = not hot.isEmpty()
    dealt = hits.join(few(hot), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))) if some else hits.withColumn("chunks", F.lit(1))
    ids, _ = written(dealt.groupBy("half").agg((F.max("chunks") > 1).alias("marked")), "ids")
    said = texts.select("id", F.col("id.a").alias("half"), "line").join(few(ids), "half").groupBy("id", "half").agg(F.any_value("line").alias("line"), F.any_value("marked").alias("marked")).withColumn("n", F.length("line"))
    one, two = sketch(F.col("line"))
    said, _ = written(said.select("id", "half", "line", "n", F.array(*keys_of(F.col("line"), F.col("n"), edits)).alias("keys"), one.alias("one"), two.alias("two"), F.when(F.col("marked"), marks(F.col("line"))).alias("marks")), "said")
    found = dealt.join(said, "half")
    # a line is indexed under its segments; a pair is formed at the first segment that both have
    place = F.array_position(F.slice("keys", 1, edits + 1), F.col("key"))
    a = found.withColumn("place", place).where("place > 0").select("key", F.col("id").alias("other"), F.col("n").alias("m"), F.col("line").alias("short"), F.slice("keys", F.lit(1), F.greatest(F.col("place") - 1, F.lit(0)).cast("int")).alias("before"), F.col("one").alias("one2"), F.col("two").alias("two2"), F.col("marks").alias("marks2"), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
    found = found.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))) if some else found.withColumn("chunk", F.lit(0))
    longer = (F.col("n") > F.col("m")) | (F.col("id") > F.col("other"))
    like = sketch_gap([F.col("one"), F.col("two")], [F.col("one2"), F.col("two2")]) <= 2 * edits
    cond = (F.col("id") != F.col("other")) & (F.col("n") >= F.col("m")) & (F.col("n") - F.col("m") <= edits) & longer
    if some:
        for k in range(4):
            cond = cond & F.coalesce(F.bit_count(F.get("marks", F.lit(k)).bitwiseXOR(F.get("marks2", F.lit(k)))) <= 4 * edits, F.lit(True))
    pairs = found.join(a, ["key", "chunk"]).where(cond & like & ~F.arrays_overlap("keys", "before"))
    return pairs.where(within_edits(F.col("line"), F.col("short"), edits)).select("id", "other")


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col less its duplicate lines, and n_lines, n_equal, n_near: lines with a word, and those that went as equal or near ones."""
    with scratch(docs.sparkSession):
        lines = lines_of(docs, edits, least, id_col, text_col)
        pairs, _ = written(near_lines(lines, texts_of(docs, id_col, text_col), edits), "pairs")
        firsts, _ = written(lines.select("id", order().alias("at")).groupBy("id").agg(F.min("at").alias("first"), F.count("*").alias("n")), "firsts")
        both = pairs.union(pairs.select("other", "id"))
        at = both.select("id").distinct().join(firsts, "id").select("id", "first")
        before = both.join(at, "id").join(at.select(F.col("id").alias("other"), F.col("first").alias("earlier")), "other").where("earlier < first").select("id").distinct()
        near, _ = written(before, "near")
        # lines that may go: all but the first of equal ones, and near ones
        some = firsts.where("n > 1").select("id", "first").join(near.withColumn("near", F.lit(True)), "id", "full").select("id", "first", F.coalesce("near", F.lit(False)).alias("near"))
        some, _ = written(some, "some")
        going = lines.select("id", "doc_id", "version", "place", order().alias("at")).join(few(some, FEW_BYTES // 4), "id").withColumn("equal", F.coalesce(F.col("at") > F.col("first"), F.lit(False))).where("equal OR near")
        going = going.groupBy("doc_id", "version", "place").agg(F.any_value("equal").alias("equal"))  # repeated rows have each line twice
        out = ["n_lines", "n_equal", "n_near"]
        n_equal, n_near, places, own, which = fresh([*docs.columns, *out], "equal", "near", "places", "own", "which")
        gone = going.groupBy("doc_id", "version").agg(F.collect_list("place").alias(places), F.count_if("equal").alias(n_equal), F.count_if(~F.col("equal")).alias(n_near))
        gone, _ = written(gone.select(F.col("doc_id").alias(own), F.col("version").alias(which), places, n_equal, n_near), "gone", keep=True)
    size = gone.agg(F.sum(F.lit(64) + 4 * F.size(places))).first()[0] or 0
    text = F.col(text_col).cast("string")
    rows = docs.join(F.broadcast(gone) if size <= FEW_BYTES else gone, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(which)), "left")
    parts = F.split(text, "\n")
    keep = let(F.struct(parts.alias("x"), F.col(places).alias("gone")), lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["x"]) - 1), s["gone"]), lambda i: F.get(s["x"], i)), "\n"))
    count = F.size(F.filter(parts, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    told = {"n_lines": F.when(text.isNull(), F.lit(0)).otherwise(count).cast("long"), "n_equal": F.coalesce(n_equal, F.lit(0)).cast("long"), "n_near": F.coalesce(n_near, F.lit(0)).cast("long"), text_col: F.when(F.col(places).isNull(), text).otherwise(keep)}
    return rows.withColumns(told).drop(own, which, places, n_equal, n_near)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_equal", "n_near", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def sql(docs: str = "documents", edits: int = EDITS, least: int = LEAST) -> str:
    """The same in DuckDB SQL: candidates share a third at any shift in reach; the text is put together again."""
    parts, reach = edits + 1, range(-edits, edits + 1)
    shifts = ", ".join(f"({d})" for d in reach)
    return rf"""
WITH d AS (SELECT *, md5(text) AS version FROM {docs}),
l AS (SELECT doc_id, version, generate_subscripts(x, 1) - 1 AS place, unnest(x) AS line FROM (SELECT DISTINCT doc_id, version, string_split(text, chr(10)) AS x FROM d WHERE text IS NOT NULL)),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS MATERIALIZED (SELECT line, min(ROW(doc_id IS NULL, doc_id, version, place)) AS first, length(line) AS n FROM w GROUP BY line),
long AS (SELECT * FROM f WHERE n >= {least}),
seg AS (SELECT line, n, k, k * (n // {parts}) + greatest(0, k - ({parts} - n % {parts})) AS start, n // {parts} + CASE WHEN k >= {parts} - n % {parts} THEN 1 ELSE 0 END AS size FROM long, range({parts}) AS r(k)),
idx AS (SELECT line, n, k, start, size, substr(line, (start + 1)::BIGINT, size::BIGINT) AS part FROM seg),
prb AS (SELECT line, m AS n, k, s.start + shift AS place, substr(line, (s.start + shift + 1)::BIGINT, s.size::BIGINT) AS part
  FROM (SELECT line, n - gap AS m, k, k * ((n - gap) // {parts}) + greatest(0, k - ({parts} - (n - gap) % {parts})) AS start, (n - gap) // {parts} + CASE WHEN k >= {parts} - (n - gap) % {parts} THEN 1 ELSE 0 END AS size
        FROM long, range({parts}) AS r(k), range({edits + 1}) AS g(gap)) s, (VALUES {shifts}) AS o(shift) WHERE s.start + shift >= 0),
c AS (SELECT DISTINCT p.line AS a, i.line AS b FROM prb p JOIN idx i ON p.k = i.k AND p.n = i.n AND p.part = i.part AND p.line <> i.line),
e AS (SELECT a, b FROM c WHERE levenshtein(a, b) <= {edits}),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
near AS (SELECT DISTINCT u.a AS line FROM u JOIN f x ON x.line = u.a JOIN f y ON y.line = u.b WHERE y.first < x.first),
j AS (SELECT w.*, ROW(doc_id IS NULL, doc_id, version, place) > f.first AS equal, near.line IS NOT NULL AS near FROM w JOIN f USING (line) LEFT JOIN near USING (line)),
k AS (SELECT l.doc_id, l.version, count(j.line)::BIGINT AS n_lines, count(*) FILTER (coalesce(equal, false))::BIGINT AS n_equal, count(*) FILTER (coalesce(near AND NOT equal, false))::BIGINT AS n_near,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (NOT coalesce(equal OR near, false)), '') AS kept FROM l LEFT JOIN j ON l.doc_id IS NOT DISTINCT FROM j.doc_id AND l.version = j.version AND l.place = j.place GROUP BY l.doc_id, l.version)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_equal, 0)::BIGINT AS n_equal, coalesce(n_near, 0)::BIGINT AS n_near, length(kept)::BIGINT AS kept_chars, md5(kept) AS kept_md5
FROM d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.version = k.version
"""


ORACLE_SQL = sql()
