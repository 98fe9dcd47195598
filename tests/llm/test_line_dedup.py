import random

import pytest
from pyspark.sql import functions as F

from foliospark.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def changed(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        match rng.randrange(3):
            case 0:
                out[at] = rng.choice("abcdé ")
            case 1:
                del out[at]
            case 2:
                out.insert(at, rng.choice("abcdé "))
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_band_agrees_with_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(8, 50)))
        b = changed(rng, a, rng.randrange(0, 6))
        long, short = (a, b) if len(a) >= len(b) else (b, a)
        if len(long) - len(short) <= edits and len(short) > edits:
            pairs.append((long, short))
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("near", line_dedup.within_edits(F.col("a"), F.col("b"), edits)).collect()
    assert len(got) > 100
    for r in got:
        assert r["near"] == (distance(r["a"], r["b"]) <= edits), (r["a"], r["b"])


def expected(docs, edits, least):
    """Brute force over all lines."""
    seen = sorted({(i is None, i or 0, __import__("hashlib").md5(t.encode()).hexdigest(), k, x) for i, t in docs if t is not None for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\f\v")})
    first = {}
    for s in seen:
        first.setdefault(s[4], s)
    gone = set()
    for s in seen:
        if first[s[4]] < s:
            gone.add(s)
        elif len(s[4]) >= least and any(len(y) >= least and first[y] < first[s[4]] and abs(len(y) - len(s[4])) <= edits and distance(y, s[4]) <= edits for y in first if y != s[4]):
            gone.add(s)
        elif len(s[4]) >= least:
            pass
    near = {x for x in first if len(x) >= least and any(len(y) >= least and y != x and first[y] < first[x] and distance(y, x) <= edits for y in first)}
    gone |= {s for s in seen if s[4] in near}
    out = []
    for i, t in docs:
        if t is None:
            out.append((i, None))
            continue
        h = __import__("hashlib").md5(t.encode()).hexdigest()
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i is None, i or 0, h, k, x) not in gone)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(25, 60))) for _ in range(30)]
    docs = []
    for i in range(40):
        lines = [changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randrange(1, 6))] + rng.choice([[], [""], ["x"], ["  "]])
        docs.append((i, "\n".join(lines)))
    docs += [(None, docs[0][1]), (3, docs[3][1]), (50, None), (51, ""), (52, "a" * 5000), (53, "a" * 5001)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text")
    assert sorted(((r[0], r[1]) for r in out.collect()), key=str) == expected(docs, 2, 30)


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, id long, line string, key int")
    assert line_dedup.dedup_lines(none).count() == 0
    some = spark.createDataFrame([(1, "one line of some thirty characters\nx", 7, "l", 1), (2, "one line of some thirty charactera\nx", 8, None, None)], none.schema)
    got = sorted(line_dedup.dedup_lines(some).collect(), key=lambda r: r["doc_id"])
    assert [(r["text"], r["n_equal"], r["n_near"], r["id"]) for r in got] == [("one line of some thirty characters\nx", 0, 0, 7), ("", 1, 1, 8)]


def test_hot_segments_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "DEAL", 8)
    rng = random.Random(6)
    docs = [(i, f"2024-01-01 request number {rng.randrange(10**4):08d} was done in good time") for i in range(150)]
    docs += [(200 + i, changed(rng, docs[i][1], rng.choice([1, 2, 3]))) for i in range(30)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text")
    assert sorted(((r[0], r[1]) for r in out.collect()), key=str) == expected(docs, 2, 30)


def test_sketches_bound_edits(spark):
    rng = random.Random(8)
    rows = []
    for k in range(200):
        a = "".join(rng.choice("aabcdeeé 0123456789") for _ in range(rng.randrange(30, 60)))
        rows.append((a, changed(rng, a, k % 3)))
    one, two = (line_dedup.sketch(F.col(c)) for c in "ab")
    got = spark.createDataFrame(rows, "a string, b string").select(line_dedup.sketch_gap(one, two).alias("gap")).collect()
    assert all(r["gap"] <= 2 * (k % 3) for k, r in enumerate(got)) and any(r["gap"] == 4 for r in got)


def test_marks_bound_edits(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(200):
        a = "".join(rng.choice("abcdé 0123456789") for _ in range(rng.randrange(30, 60)))
        rows.append((a, changed(rng, a, 2)))
    got = spark.createDataFrame(rows, "a string, b string").select(line_dedup.marks(F.col("a")).alias("a"), line_dedup.marks(F.col("b")).alias("b")).collect()
    assert all(((x ^ y) & (1 << 64) - 1).bit_count() <= 8 for r in got for x, y in zip(r["a"], r["b"]))


def test_clashing_columns(spark):
    names = ["_gone", "_equal", "_id", "_version", "_near", "equal", "near", "places", "own", "which", "version", "place", "n_near"]
    schema = "doc_id long, text string, " + ", ".join(f"`{x}` int" for x in names)
    line = "one line of some thirty characters"
    docs = spark.createDataFrame([(k, line, *range(len(names))) for k in (1, 2)], schema)
    got = sorted(line_dedup.dedup_lines(docs).collect(), key=lambda r: r["doc_id"])
    assert [(r["text"], r["_gone"], r["near"], r["which"], r["n_near"]) for r in got] == [(line, 0, 6, 9, 0), ("", 0, 6, 9, 0)]
