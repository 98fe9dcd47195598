"""Operators against brute force on small fixtures; nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import chat_format, embedding_dedup, language_id, packing, quality_classifier, quality_rules, simhash, source_mixing, token_output, tokens
from foliospark.llm.shared import components, new_path, written

WORDS = ["alpha", "beta.", "Gamma,", "don't", "12", "é", "the", "x9", "<|endoftext|>", "under_score", "A.B.", "..."]


def texts(n, seed=1, most=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + (rng.choice("abc") * rng.randrange(3)) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    found = texts(60)
    rows = [(i, t) for i, t in enumerate(found)] + [(100, None), (101, ""), (5, found[5]), (102, "word " * 9000), (None, "no id")]
    rows.reverse()
    return rows, spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, nth int")


def encoded(text, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary()).encode(text or "", add_special_tokens=False).ids + [end]


def test_variable_length_code():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        assert (token_output.decode_values(*token_output.encode_values(values), n) == values).all()


def test_memo_agrees_with_tokenizer():
    memo = tokens.Memo(tokens.vocabulary(), most=400)  # so small that generations change
    rng = random.Random(3)
    some = texts(40) + ["".join(rng.choice("aB.,é \n\t's<|1!0Σ ẛ̣") for _ in range(60)) for _ in range(200)] + [None, ""]
    got = memo.encode_all(some)
    for text, x in zip(some, got, strict=True):
        assert np.frombuffer(x, memo.kind).tolist() == encoded(text, 0)[:-1]


def test_token_files(spark, docs):
    rows, df = docs
    folder = new_path(spark, "test")
    token_output.write_files(df, folder, tokens.vocabulary(), end=2)
    got = sorted(token_output.read_files(spark, folder).collect(), key=lambda r: r["start"])
    key = lambda i: (i is not None, i or 0)
    want = sorted(((i, encoded(t, 2)) for i, t in rows), key=lambda r: key(r[0]))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    at = 0
    for r, (_, ids) in zip(got, want, strict=True):
        assert (r["start"], r["n_tokens"], list(r["ids"])) == (at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = new_path(spark, "test")
    token_output.write_files(df.limit(0), empty, tokens.vocabulary())
    assert token_output.read_files(spark, empty).count() == 0


def best_fit(lengths, capacity):
    """One by one: the number of sequences of best-fit decreasing."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([1, 7, 30, 64])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 150))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        rows = sorted(packing.plan(counts, capacity))
        used, bins = {}, set()
        for k, (length, rank, first, offset) in enumerate(rows):
            end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else counts[length]
            for s in range(first, first + end - rank):
                bins.add(s)
                for o in range(offset, offset + length):
                    assert used.setdefault((s, o), True) is True
                    used[(s, o)] = False
        assert len(used) == sum(lengths) and all(o < capacity for _, o in used)
        assert len(bins) == best_fit(lengths, capacity)


def test_plan_fills_the_tightest_sequence_first():
    lengths = [11, 11, 4, 4, 3, 3, 3]
    rows = packing.plan({11: 2, 4: 2, 3: 3}, 20)
    assert len({s for k, (x, r, s, _) in enumerate(rows)}) == best_fit(lengths, 20) == 2


def test_packing(spark, docs):
    rows, df = docs
    got = packing.pack_documents(df, tokens.vocabulary(), 256, end=1, with_ids=True).collect()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        ids = encoded(t, 1)
        parts = sorted(of[i], key=lambda r: r["piece"])[:: 2 if i == 5 else 1]
        assert [x for r in parts for x in r["ids"]] == ids
        assert all(r["start"] == 256 * r["piece"] and r["length"] <= 256 for r in parts)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) == best_fit([r["length"] for r in got], 256)
    assert packing.pack_documents(df.limit(0), tokens.vocabulary(), 256).count() == 0


def closed(n, linked):
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 6000 + k) for k in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = sorted({x for p in pairs for x in p if p[0] != p[1]})
    near = {(ids.index(a), ids.index(b)) for a, b in pairs if a != b}
    root = closed(len(ids), lambda a, b: (a, b) in near or (b, a) in near)
    assert got == {x: ids[root[k]] for k, x in enumerate(ids)}


def brute_links(ids, vectors, cosine=0.9):
    """n_links and component of each row, by all pairs in double precision."""
    good = [x is not None and len(x) > 0 and all(c is not None and np.isfinite(c) for c in x) and any(x) for x in vectors]
    unit = [np.array(x, float) / np.linalg.norm(np.array(x, float)) if g else None for x, g in zip(vectors, good)]
    near = lambda a, b: good[a] and good[b] and len(vectors[a]) == len(vectors[b]) and float(unit[a] @ unit[b]) >= cosine
    n = len(ids)
    root = closed(n, near)
    least = {r: min((ids[i] for i in range(n) if root[i] == r and ids[i] is not None), default=None) for r in set(root)}
    return [(ids[i], sum(near(i, j) for j in range(n) if j != i), least[root[i]]) for i in range(n)]


def compare_links(spark, ids, vectors, kind="float"):
    data = spark.createDataFrame([(i, x, 1) for i, x in zip(ids, vectors)], f"vec_id long, embedding array<{kind}>, node int")
    got = embedding_dedup.near_duplicates(data, 0.9).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(brute_links(ids, vectors), key=key)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 8)
    monkeypatch.setattr(embedding_dedup, "COLS", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 32))
    rows = np.concatenate([base, base[:20] + rng.normal(scale=0.25, size=(20, 32)), base[:10] * 3, base[:5]]).astype(np.float32)
    ids = [*range(len(rows)), 900, 901, 902, 903, 906, 904, 905, None, None, 904, 3, 3]
    vectors = [*rows.tolist(), None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0, 2.0], [2.0, 4.0], rows[0].tolist(), [7.0] * 5, rows[1].tolist(), rows[3].tolist(), rows[9].tolist()]
    compare_links(spark, ids, vectors)


def test_embeddings_of_many_lengths_and_none(spark):
    vectors = [[1.0] * n for n in range(1, 13) for _ in range(2)]
    compare_links(spark, list(range(len(vectors))), vectors, "double")
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def fingerprint(text):
    from xxhash import xxh64_intdigest

    words = [w for w in (text or "").encode().lower().split()]
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("k", [3, 6])
def test_simhash(spark, docs, k):
    rng = random.Random(9)
    found = texts(50, 8, 200)
    found += [t + rng.choice([" more", " end", ""]) for t in found[:25]] + [None, ""]
    fps, _ = written(simhash.fingerprints(spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")), "test")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(fps, k).collect()}
    want = [fingerprint(t) for t in found]
    root = closed(len(found), lambda a, b: (want[a] ^ want[b]).bit_count() <= k)
    for i in range(len(found)):
        assert got[i]["fp"] & (1 << 64) - 1 == want[i] and got[i]["component_id"] == root[i]


def test_hot_bucket_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    rng = random.Random(2)
    fps = sorted({0xFFFF0000 ^ sum(1 << rng.randrange(24) for _ in range(2)) for _ in range(120)})
    nodes, _ = written(spark.createDataFrame([(x, i) for i, x in enumerate(fps)], "fp long, node long"), "test")
    got = {r["node"]: r["component"] for r in components(simhash.fingerprint_links(nodes, 3)).collect()}
    root = closed(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert all(got.get(i, i) == root[i] for i in range(len(fps)))


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 30) + rng.choice(["", " | ", "@", "license"]), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b"])) for i in range(600)] + [(None, None, "en", "a"), (900, "", None, "b"), (1, "again", "en", "a")]
    out = source_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(out) == len(rows)
    total = sum(r["tokens"] * r["probability"] * r["sample_weight"] for r in out)
    share = sum(r["tokens"] * r["probability"] * r["sample_weight"] for r in out if r["topic"] == "prose") / total
    assert abs(share - 0.85) < 0.01
    assert all(r["probability"] == 0 and not r["kept"] for r in out if not r["tokens"])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert source_mixing.mix(empty).count() == 0


def test_mixing_of_clashing_columns_and_many_categories(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice(["en", "de", None]), f"s{rng.randrange(12)}", i, -i, "x", 1.0) for i in range(200)]
    rows += rows[:3]
    schema = "doc_id long, text string, lang string, source string, g long, w long, _source string, probability double"
    docs = spark.createDataFrame(rows, schema)
    few = sorted(source_mixing.mix(docs).collect(), key=str)
    assert len(few) == len(rows) and all((r["g"], r["w"], r["_source"]) == (r["doc_id"], -r["doc_id"], "x") for r in few)
    monkeypatch.setattr(source_mixing, "FEW", 5)  # sources are many now
    many = sorted(source_mixing.mix(docs).collect(), key=str)
    assert all(abs(a["probability"] - b["probability"]) < 1e-9 and a["kept"] == b["kept"] for a, b in zip(few, many, strict=True))
    assert source_mixing.repeated(source_mixing.mix(docs)).count() > 0


def test_classifier_separates(spark):
    rng = random.Random(6)
    plain, bad = ["river", "stone", "cloud", "green", "table", "quiet"], ["vile", "rotten"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        if i % 4 == 0:
            words[3:3] = bad
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    rows += [(1000, None, 0), (1001, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bad int")
    labels = df.where("doc_id < 300").select("doc_id", F.lit(1).alias("quality"), F.col("bad").alias("toxic")).union(spark.createDataFrame([(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int"))
    got = quality_classifier.classify(df, labels).collect()
    assert all(r["kept"] == (not r["bad"]) for r in got if r["doc_id"] < 1000)
    assert all(not r["kept"] and r["expected_grade"] is None for r in got if r["doc_id"] >= 1000)
    none = quality_classifier.classify(df, labels.limit(0)).collect()
    assert all(r["kept"] == (r["doc_id"] < 1000) for r in none)


def test_chat_round_trip(spark):
    marks = "\\### Assistant: </turn> ok\n<b> # \\n \\l"
    rows = [(1, 0, "user", marks), (1, 1, "assistant", marks), (1, 2, "assistant", None), (1, 3, "user", "tail"), (2, 0, "sys\ntem", "x"), (3, 5, "assistant", "b"), (3, 1, None, "a"), (3, 5, "assistant", "b"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, last int")
    got = {r["conv_id"]: r for r in chat_format.digests(written(chat_format.examples(df), "chat")[0]).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = chat_format.examples(df).where("conv_id = 1").orderBy("example").collect()
    assert [r["loss_end"] > r["loss_start"] for r in made] == [True, False, False] and len(made) == 3
    assert chat_format.examples(df.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(8)
    kinds = {"aa": ["taka", "moki", "rano"], "bb": ["schwer", "ücht", "tzen"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randrange(3, 90))), k) for i in range(240) for k in [rng.choice(["aa", "bb"])]]
    df = spark.createDataFrame([*rows, (500, None, "aa"), (501, "12 34 !", "bb"), (502, "taka", None)], "doc_id long, text string, lang string")
    network = language_id.fit(df.where("doc_id < 160"))
    got = {r["doc_id"]: r for r in language_id.predict(df, network).collect()}
    held = [r for r in rows if r[0] >= 160]
    assert sum(got[i]["lang_pred"] == k for i, _, k in held) >= 0.95 * len(held)
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[500]["score"] == 0
    assert language_id.fit(df.limit(0)) is None and {r["lang_pred"] for r in language_id.predict(df, None).collect()} == {"und"}


def test_rules(spark):
    rng = random.Random(11)
    rows = [(i, "\n".join(" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 8)))) for i in range(80)] + [(100, None), (101, ""), (102, "\x0b \t"), (103, "a b c d e " * 4000), (104, "x#*|<>& \x85y z"), (None, "one two")]
    got = {r["doc_id"]: r for r in quality_rules.apply_policy(quality_rules.ledger(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_words int"))).collect()}
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        seen = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        again = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(again)), i
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w))
    told = quality_rules.ablations(quality_rules.ledger(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r["rule"]: r["failed"] for r in told}["few_words"] == sum(len((t or "").encode().split()) < 10 for _, t in rows)


def test_fingerprints_of_odd_rows(spark):
    rows = [(None, "a b c d", 1), (None, "only here", 1), (7, "a b c d", 2), (7, "a b c d", 2), (9, None, 3), (8, "", 3)]
    fps, _ = written(simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fp int")), "test")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(fps).collect()), key=str)
    assert got == sorted([(None, 7), (None, None), (7, 7), (7, 7), (9, 8), (8, 8)], key=str)
    empty, _ = written(simhash.fingerprints(spark.createDataFrame([], "doc_id long, text string")), "test")
    assert simhash.near_duplicates(empty).count() == 0


def brute_tails(model, text):
    """P(grade >= j) by dictionaries, a word at a time."""
    import math
    import re

    words = text.split()
    shares, present = {}, set()
    for w in words:
        shape = re.sub(r"(.)\1+", r"\1\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in w))
        k = zlib.crc32(shape.encode()) % quality_classifier.SHAPES
        shares[k] = shares.get(k, 0) + 1 / len(words)
        present.add(zlib.crc32(w.strip(".,;:!?\"'()[]|").lower().encode()) % 2**quality_classifier.BITS)
    base = 2**quality_classifier.BITS
    z = sum(model.weights[k] for k in present) + sum(model.weights[base + k] * v for k, v in shares.items())
    lines = [x for x in text.split("\n") if x.strip()]
    z += model.weights[base + quality_classifier.SHAPES] * (1 - len(set(lines)) / len(lines))
    z += model.weights[base + quality_classifier.SHAPES + 1] * math.log(len(words) / len(present)) / math.log(len(words) + 1)
    return [1 / (1 + math.exp(b - z)) for b in model.bounds]


def test_classifier_agrees_with_brute_force(spark):
    rng = np.random.default_rng(2)
    model = quality_classifier.Model(np.float32(rng.normal(size=2**quality_classifier.BITS + quality_classifier.EXTRA)), np.array([-1.0, 0.5]))
    rows = [(i, t) for i, t in enumerate(texts(60)) if t.split()]
    rows += [(500, "long " * 3000 + "x" * 5000), (501, "one"), (501, "one"), (502, "aé1\naé1\nB-b")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, expected_grade int, memo string")
    got = quality_classifier.score(docs, model, 2).collect()
    assert len(got) == len(rows) and {r["memo"] for r in got} == {"x"}
    want = {t: brute_tails(model, t) for _, t in rows}
    for r in got:
        assert r["tail_probability"] == pytest.approx(want[r["text"]][1], abs=1e-4) and r["expected_grade"] == pytest.approx(sum(want[r["text"]]), abs=1e-4)
    assert quality_classifier.score(docs.limit(0), model, 2).count() == 0


def test_classifier_training_lowers_the_loss():
    rng = random.Random(3)
    features = quality_classifier.Features()
    rows, grades = [], []
    for _ in range(300):
        g = rng.randrange(3)
        rows.append(features(" ".join(rng.choice(["plain", "words", "here"]) for _ in range(20)) + " bad" * (2 - g)))
        grades.append(g)
    loss = lambda m: -sum(np.log(max(1e-9, ([1.0, *m.tails(*r), 0.0][g] - [1.0, *m.tails(*r), 0.0][g + 1]))) for r, g in zip(rows, grades))
    short, long = (quality_classifier.train(rows, np.array(grades), epochs=n) for n in (1, 200))
    assert loss(long) < 0.5 * loss(short) and (np.diff(long.bounds) > 0).all()


def test_language_agrees_with_brute_force(spark):
    rng = np.random.default_rng(4)
    network = language_id.Network(["aa", "bb", "cc"], {w: rng.normal(size=(w, 256, language_id.FILTERS)) for w in language_id.WIDTHS}, rng.normal(size=(language_id.FILTERS * len(language_id.WIDTHS) + 1, 3)))

    def brute(text):
        data, total = text.encode(), np.zeros(3)
        for at in range(0, len(data), language_id.WINDOW):
            part = data[at : at + language_id.WINDOW]
            x = part.ljust(language_id.WINDOW, b"\0")
            h = [max(sum(f[j, x[k + j], c] for j in range(w)) for k in range(len(x) - w + 1)) for w, f in network.filters.items() for c in range(language_id.FILTERS)]
            z = np.array(h) @ network.out[:-1] + network.out[-1]
            total += len(part) * (z - np.log(np.exp(z - z.max()).sum()) - z.max())
        p = np.exp(total / len(data) - (total / len(data)).max())
        return network.classes[int(p.argmax())], float((p / p.sum()).max())

    some = ["short text", "ü" * 200, "words and more words " * 30, "x" * 257]
    docs = spark.createDataFrame([(i, t, "zz", 1.0) for i, t in enumerate(some + some[:1])], "doc_id long, text string, lang_pred string, score double")
    got = language_id.predict(docs, network).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"doc_id", "text", "lang_pred", "score"}
    for r in got:
        lang, score = brute(r["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)
    assert language_id.predict(docs.limit(0), network).count() == 0


def test_samples_are_bounded_whatever_the_ids(spark):
    rows = [(1, f"same id {i} " + "a" * i, "aa") for i in range(50)] + [(2, "other words", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(df, most=2).classes == ["aa", "bb"]
    ratings = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int")
    assert quality_classifier.fit(df, ratings, most=2) is not None


def test_rules_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.apply_policy(quality_rules.ledger(empty)).count() == 0
