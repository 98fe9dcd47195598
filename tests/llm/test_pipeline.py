import random

import corpus_pipeline
from foliospark.llm import simhash


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 8)))
    texts = [" ".join(word() for _ in range(rng.randrange(60, 90))) for _ in range(160)]
    rows = [(i, t + (" rotten vile" if i % 5 == 0 else ""), "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    shared = "this very passage is the same in many of the documents that are here"
    rows = [(i, t + ("\n" + shared if i % 7 == 1 else ""), lang, s, n) for i, t, lang, s, n in rows]
    near = rows[3][1].split()
    near[10] = "changedword"
    rows += [(500, rows[1][1], "en", "s0", 1), (501, " ".join(near), "en", "s1", 1), (502, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.classify(spark, docs, str(tmp_path))
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and ids == {i for i, t, *_ in rows if t and "rotten" not in t}
    lines = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, kept, "").collect()}
    assert 500 not in lines and sum(shared in t for t in lines.values()) == 1
    out = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in lines.items()], docs.schema)
    left = {r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, out, "").collect()}
    assert left == set(lines) - {501}
    mixed = corpus_pipeline.mix(spark, out, "")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= set(lines)
    packed = corpus_pipeline.pack(spark, out, "").collect()
    assert {r["doc_id"] for r in packed} == set(lines)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["classify", "dedup_lines", "dedup_documents", "mix", "pack"]


def test_mix_meets_targets_in_kept_tokens(spark):
    from foliospark.llm.source_mixing import TARGETS

    rng = random.Random(6)
    rows, ends = [], {"prose": "", "notice": " license", "contact": " a@b", "table": " | "}
    for i in range(6000):  # rare categories need weights above one, and one source is hot
        kind = rng.choices(list(ends), [96, 1, 1, 2])[0]
        rows.append((i, "word " * rng.randrange(5, 40) + "end" + ends[kind], rng.choices(["en", "de", "fr", "es"], [80, 8, 7, 5])[0], rng.choices(["hot", "s1", "s2"], [8, 1, 1])[0], 1, kind))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kinds = {r[0]: r[5] for r in rows}
    kept = corpus_pipeline.mix(spark, docs, "").collect()
    tokens = lambda r: r["text"].count(" ") + 1
    total = sum(map(tokens, kept))
    for name, of in (("source", lambda r: r["source"]), ("lang", lambda r: r["lang"]), ("topic", lambda r: kinds[r["doc_id"]])):
        found = {of(r) for r in kept}
        want = {x: TARGETS[name].named.get(x, TARGETS[name].default) for x in found}
        for x in found:
            share = sum(tokens(r) for r in kept if of(r) == x) / total
            assert abs(share - want[x] / sum(want.values())) < 0.02, (name, x, share)
    assert abs(total / sum(map(tokens, docs.collect())) - 1) < 0.05


def pairs_of(rng, lows, n=20, size=400):
    """Pairs of texts with a similarity of five-word shingle sets just above each of lows, and the similarity."""
    out = []
    for low in lows:
        for _ in range(n):
            a = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            b, best = list(a), None
            for k in rng.sample(range(size), size):
                b[k] = f"x{rng.randrange(10**6)}"
                sets = [{tuple(x[i : i + 5]) for i in range(size - 4)} for x in (a, b)]
                now = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
                if now < low:
                    break
                best = (" ".join(a), " ".join(b), now)
            out.append(best)
    return out


def kept_ids(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted((r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()), key=str)


def test_near_copies_close_to_the_bound_are_found(spark):
    pairs = pairs_of(random.Random(7), (0.8, 0.9, 0.95))
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    assert set(kept_ids(spark, rows)) == {2 * i for i in range(len(pairs))}


def test_links_are_verified_on_whole_sets(spark):
    import numpy as np

    from foliospark.llm import simhash_sets

    rng = np.random.default_rng(8)
    for common, linked in ((316, False), (319, False), (320, True), (324, True)):  # of 400 in the union
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            a, b = np.sort(x[: 400 - (400 - common) // 2]), np.sort(np.concatenate([x[:common], x[400 - (400 - common) // 2 :]]))
            assert bool(simhash_sets.star(np.array([1, 2]), [a, b], 0.8)[0]) == linked
    # one shingle, repeated, is most of both texts, so their fingerprints are equal; the rest is different
    texts = ["same " * 200 + " ".join(f"{c}{k}" for k in range(60)) for c in "xy"]
    found = [simhash.fingerprint(simhash.hashes(simhash.words_of(t), 5)) for t in texts]
    assert found[0] == found[1] and kept_ids(spark, list(enumerate(texts))) == [0, 1]


def test_rows_without_ids_and_repeated_rows(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(None, text("a")), (None, text("b")), (1, text("c")), (1, text("c")), (2, text("d")), (3, text("d")), (3, text("e")), (None, text("e")), (None, text("f")), (None, text("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"][0]) for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()), key=lambda r: r[1])
    assert got == [(None, "a"), (None, "b"), (1, "c"), (2, "d"), (3, "e"), (None, "f")]


def test_recall_by_band(spark):
    """Close to all near copies with a similarity of 0.8 or more are found, whatever their length."""
    import numpy as np

    from foliospark.llm import simhash_sets as S

    rng = np.random.default_rng(5)
    sample = rng.integers(0, 2, (600, S.BITS), dtype=np.uint8)
    p = S.differing(0.8)
    most = S.math.ceil(S.FILTER * p + S.FAR * S.math.sqrt(S.FILTER * p * (1 - p)))
    for n in (1000, 10**6, 10**9):
        probes = S.plan(sample, n, 0.8)
        for size in (10, 100, 2000):
            for low in (0.8, 0.9):
                hit = 0
                for _ in range(150):
                    x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
                    common = S.math.ceil(low * size)
                    half = common + (size - common) // 2
                    prints = S.long_fingerprints([x[:half], np.concatenate([x[:common], x[half:]])])
                    bits = np.unpackbits(prints[:, : S.BITS // 8], axis=1, bitorder="little")
                    near = np.bitwise_count(prints[0, S.BITS // 8 :] ^ prints[1, S.BITS // 8 :]).sum() <= most
                    hit += near and any((bits[0, g] != bits[1, g]).sum() <= 2 * t for g, t in probes)
                assert hit >= 148, (n, size, low, hit)


def test_hot_buckets_and_groups_are_dealt_out(spark, monkeypatch):
    from foliospark.llm import simhash_sets

    monkeypatch.setattr(simhash_sets, "BUCKET_ROWS", 8)
    monkeypatch.setattr(simhash_sets, "RUN_ROWS", 8)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"{i}y{k}" for k in range(50))) for i in range(20)]
    assert kept_ids(spark, rows) == sorted([0, *range(100, 120)], key=str)


def test_stages_of_empty_tables_long_texts_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _uid int, _node int, g int, topic string, equal int, memo string"
    extra = (1, 2, 3, "prose", 4, "m")
    rows = [(1, "plain words of a text " * 5000, "en", "s", 1, *extra), (2, "other words of a text", "en", "s", 1, *extra), (None, "third words of a text", None, None, None, *extra)]
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        assert out and {r["doc_id"] for r in out} <= {1, 2, None}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_packed_pieces_agree_with_brute_force(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from foliospark.llm import tokens

    rows = [(i, "word " * n) for i, n in enumerate([1, 40, 5000, 9000, 300])] + [(9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["doc_id"], r["piece"]): r for r in corpus_pipeline.pack(spark, docs, "").collect()}
    tokenizer = Tokenizer.from_file(tokens.vocabulary())
    want = {}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))
    assert {k: (r["start"], r["length"], r["ids_crc32"]) for k, r in got.items()} == want
