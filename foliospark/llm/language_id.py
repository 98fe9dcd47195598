"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, the last one padded.
Filters of several widths slide over a window; each filter's maximum goes into
a softmax layer. A text's language is that of the highest mean log probability
over all its windows, weighted by their bytes. Training is numpy on the driver,
on a bounded sample of rows: at most `most` labelled documents, chosen by a hash
of their id, with all their windows. A document's windows share one weight, so
long texts don't outweigh others.

Defined cases: null, empty and letterless texts are `und` with score 0; null
labels aren't learned from; without any label every text is `und`; repeated
rows are predicted as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
AT_ONCE = 512


@dataclass
class Network:
    classes: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    out: np.ndarray  # (filters of all widths + 1, classes); the last row is the bias

    def log_probabilities(self, windows: np.ndarray, tables: dict) -> np.ndarray:
        """(n, classes) of windows (n, WINDOW) of bytes."""
        return log_softmax(_pooled(windows, tables) @ self.out[:-1] + self.out[-1])

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Filters by pairs of neighbouring bytes, so that a width of four costs two look-ups a place."""
        made = {}
        for w, f in self.filters.items():
            pairs = [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, w - 1, 2)]
            made[w] = [np.ascontiguousarray(x, np.float32) for x in pairs + ([f[w - 1]] if w % 2 else [])]
        return made


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _pooled(windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
    x = windows.astype(np.int32)
    pair = x[:, :-1] * 256 + x[:, 1:]
    got = []
    for w, parts in tables.items():
        n = x.shape[1] - w + 1
        total = parts[0].take(pair[:, :n], 0)
        for j, part in enumerate(parts[1:], 1):
            total += part.take(pair[:, 2 * j : 2 * j + n] if len(part) == 65536 else x[:, 2 * j : 2 * j + n], 0)
        got.append(total.max(1))
    return np.concatenate(got, 1)


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text and the bytes in each."""
    n = -(-len(data) // WINDOW)
    padded = np.zeros(n * WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    size = np.full(n, WINDOW)
    size[-1] = len(data) - (n - 1) * WINDOW
    return padded.reshape(n, WINDOW), size


def train(windows: np.ndarray, labels: np.ndarray, classes: list[str], share: np.ndarray | None = None, steps: int = 600, rate: float = 0.02, batch: int = 64, seed: int = 7) -> Network:
    """Adam on the cross entropy of batches drawn by share, alike for each class; a maximum passes its gradient to the place it was found at."""
    rng = np.random.default_rng(seed)
    filters = {w: rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)) for w in WIDTHS}
    out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS) + 1, len(classes)))
    share = np.ones(len(labels)) if share is None else share
    chance = share / np.bincount(labels, share, len(classes))[labels]
    chance /= chance.sum()
    params = [*filters.values(), out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        at = rng.choice(len(labels), batch, p=chance)
        x, y = windows[at].astype(np.int64), labels[at]
        pooled, where = [], {}
        for w, f in filters.items():
            n = x.shape[1] - w + 1
            total = sum(f[j].take(x[:, j : j + n], 0) for j in range(w))
            where[w] = total.argmax(1)
            pooled.append(np.take_along_axis(total, where[w][:, None, :], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        d = np.exp(log_softmax(h @ out[:-1] + out[-1]))
        d[np.arange(len(y)), y] -= 1
        d /= len(at)
        back = d @ out[:-1].T
        grads = []
        for k, (w, f) in enumerate(filters.items()):
            g = np.zeros_like(f)
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(x, where[w] + j, 1), np.arange(FILTERS)[None, :]), own)
            grads.append(g)
        grads.append(np.concatenate([h.T @ d, d.sum(0, keepdims=True)]))
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Network(classes, filters, out)


def fit(labelled: DataFrame, most: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on at most `most` documents with a label, chosen by a hash of their id; None if there are none."""

    def cut(batches):
        for b in batches:
            rows = [(part.tobytes(), lang, 1 / len(parts)) for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for parts in [windows_of((text or "\0").encode("utf-8", "surrogatepass"))[0]] for part in parts]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["window", "lang", "share"])

    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    ids = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    found = rows.where("lang IS NOT NULL AND text IS NOT NULL").join(F.broadcast(ids), "id", "left_semi")  # ids: at most `most`
    one = found.groupBy("id").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("x"))  # an id's rows may be many
    got = one.select("x.text", "x.lang").mapInArrow(cut, "window binary, lang string, share double").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "window", "share"])
    classes = sorted(set(got["lang"]))
    windows = np.stack([np.frombuffer(x, np.uint8) for x in got["window"]])
    labels = np.searchsorted(classes, got["lang"])
    return train(windows, labels, classes, got["share"].to_numpy())


def predict(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, from the whole text alone."""
    schema = docs.drop("lang_pred", "score").schema
    names = schema.fieldNames()

    def run(batches):
        tables = network.tables() if network else None

        def scores(texts):
            """(language, score) of each text, many windows at once."""
            sums = np.zeros((len(texts), len(network.classes)))
            total = np.zeros(len(texts))
            held, sizes, owners, count = [], [], [], 0

            def flush():
                x, size, owner = np.concatenate(held), np.concatenate(sizes), np.concatenate(owners)
                for lo in range(0, len(x), AT_ONCE):
                    hi = lo + AT_ONCE
                    np.add.at(sums, owner[lo:hi], network.log_probabilities(x[lo:hi], tables) * size[lo:hi, None])
                np.add.at(total, owner, size)

            for i, text in enumerate(texts):
                if text and any(map(str.isalpha, text)):
                    x, size = windows_of(text.encode("utf-8", "surrogatepass"))
                    held.append(x), sizes.append(size), owners.append(np.full(len(x), i))
                    count += len(x)
                    if count >= 4 * AT_ONCE:
                        flush()
                        held, sizes, owners, count = [], [], [], 0
            if held:
                flush()
            some = total > 0
            p = np.exp(log_softmax(sums / np.maximum(total, 1)[:, None]))
            best = p.argmax(1)
            return [network.classes[k] if s else "und" for k, s in zip(best, some, strict=True)], np.where(some, np.minimum(p.max(1), 1.0), 0.0)

        for b in batches:
            texts = b.column(names.index(text_col)).to_pylist()
            langs, score = scores(texts) if network else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.record_batch([*b.columns, pa.array(langs, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return docs.select(*[F.col(f"`{x}`") for x in names]).mapInArrow(run, StructType([*schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), network).drop("text")
