"""Quality by ordinal regression: a cumulative-link model over hashed text.

Graded ratings 0 < 1 < ... < g share one weight vector w over hashed features;
ordered thresholds b_1 < ... < b_g part the grades: P(grade >= j) =
sigmoid(w.x - b_j). A document gets its expected grade, the sum of these, and
the tail probability P(grade >= tail), which selects.

Features of a whole text: the presence of its words (lower case, signs at the
ends taken off), and the shares of word shapes (Xx, X!!, |, ...), repeated
words and repeated lines. Fitting is numpy on the driver, on at most `most`
rated documents chosen by a hash of their id, one row of each; features in fewer than LEAST of
them, or as frequent in the top grade as elsewhere, have no weight.

Defined cases: null and empty texts have no words and are rejected; null
ratings aren't learned from; without two grades to learn from, every document
with a word gets a tail probability of 1 and is kept; repeated rows are
scored as often as they occur; other columns are passed on.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import table

BITS = 18
SHAPES = 64  # hash classes of word shapes
MEMO = 400_000
LEAST = 8
EVEN = 0.7  # log odds up to this count as even
EXTRA = SHAPES + 2  # dense features behind the hashed ones

_STRIP = ".,;:!?\"'()[]|"
_RUNS = re.compile(r"(.)\1+")


def _code(word: str) -> int:
    """A word's hashed feature and shape class in one number."""
    plain = word.strip(_STRIP).lower()
    marks = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    shape = _RUNS.sub(r"\1\1", marks)
    bucket = zlib.crc32(plain.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
    return bucket * SHAPES + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES


class Features:
    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(hashed features present, dense shares) of a text; None without a word."""
        words = text.split() if text else []
        if not words:
            return None
        memo = self.memo
        try:
            codes = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for x in set(words).difference(memo):
                memo[x] = _code(x)
            codes = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        buckets = np.unique(codes // SHAPES)
        dense = np.empty(EXTRA)
        dense[:SHAPES] = np.bincount(codes % SHAPES, minlength=SHAPES) / len(words)
        lines = [x for x in text.split("\n") if x.strip()]
        dense[-2] = 1 - len(set(lines)) / len(lines)
        dense[-1] = np.log(len(words) / len(buckets)) / np.log(len(words) + 1)  # words said again, at any length
        return buckets, dense


@dataclass
class Model:
    weights: np.ndarray  # of hashed, then of dense features
    bounds: np.ndarray  # ascending

    def tails(self, buckets: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = self.weights[buckets].sum() + dense @ self.weights[-EXTRA:]
        return 1 / (1 + np.exp(np.clip(self.bounds - z, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = 200, rate: float = 0.1, l2: float = 3e-4) -> Model:
    """Full-batch Adam on the likelihood of the grades, each grade with the same total weight's square root."""
    top = int(grades.max())
    size = np.array([len(r[0]) for r in rows])
    flat, owner = np.concatenate([r[0] for r in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), size)
    dense = np.stack([r[1] for r in rows]).astype(np.float64)
    often = np.bincount(flat, minlength=1 << BITS) >= LEAST
    kept = often[flat]
    ids, flat = np.unique(flat[kept], return_inverse=True)
    owner = owner[kept]
    # a feature's scale is how far its log odds of a top grade are from even, shrunk for rare ones
    good = grades == top
    in_good, in_rest = np.bincount(flat, good[owner], len(ids)), np.bincount(flat, ~good[owner], len(ids))
    odds = np.log((in_good + 2) / (good.sum() + 4)) - np.log((in_rest + 2) / ((~good).sum() + 4))
    scale = np.maximum(np.abs(odds) - EVEN, 0)
    w, v, gaps = np.zeros(len(ids)), np.zeros(EXTRA), np.zeros(top)  # bounds: gaps[0], then sums of exp(gaps)
    gaps[0] = -1.0
    share = np.bincount(grades, minlength=top + 1)
    weight = 1 / np.sqrt(np.maximum(share, 1))[grades]
    weight /= weight.sum()
    params = [w, v, gaps]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        z = np.bincount(owner, (w * scale)[flat], len(rows)) + dense @ v
        bounds = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        s = 1 / (1 + np.exp(np.clip(bounds[None, :] - z[:, None], -40, 40)))  # P(grade >= j), j = 1..top
        full = np.concatenate([np.ones((len(rows), 1)), s, np.zeros((len(rows), 1))], 1)
        at = np.arange(len(rows))
        p = np.maximum(full[at, grades] - full[at, grades + 1], 1e-12)
        slope = np.concatenate([np.zeros((len(rows), 1)), s * (1 - s), np.zeros((len(rows), 1))], 1)
        dz = -weight * (slope[at, grades] - slope[at, grades + 1]) / p
        db = np.zeros(top + 2)
        np.add.at(db, grades, weight * slope[at, grades] / p)
        np.add.at(db, grades + 1, -weight * slope[at, grades + 1] / p)
        tail = np.cumsum(db[1 : top + 1][::-1])[::-1]
        dgap = tail * np.concatenate([[1.0], np.exp(gaps[1:])])
        grads = [np.bincount(flat, dz[owner], len(ids)) * scale + l2 * w, dense.T @ dz + l2 * v / 100, dgap]
        for q, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros((1 << BITS) + EXTRA)
    weights[ids], weights[-EXTRA:] = w * scale, v
    return Model(weights, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])])))


def fit(docs: DataFrame, ratings: DataFrame, most: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """ratings: (id, grade from 0). None without at least two grades."""
    made = StructType.fromDDL("grade long, id long, buckets binary, dense binary")

    def run(batches):
        features = Features()
        for b in batches:
            rows = [(g, i, f[0].astype(np.int32).tobytes(), f[1].astype(np.float32).tobytes()) for i, g, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if (f := features(t))]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], made.fieldNames())

    picked = ratings.where(f"`{id_col}` IS NOT NULL AND grade IS NOT NULL").select(F.col(id_col).alias("id"), F.col("grade").cast("long").alias("grade")).groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(most)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")  # picked: at most `most`
    found = found.groupBy("id").agg(F.min("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "grade", "text")  # an id's rows may be many
    # as bytes, so that the sample stays small on the driver
    rows = sorted(((r["id"], r["grade"], bytes(r["buckets"]), bytes(r["dense"])) for r in found.mapInArrow(run, made).toLocalIterator()))
    grades = np.array([r[1] for r in rows], np.int64)
    if len(set(grades.tolist())) < 2:
        return None
    return train([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows], grades)


def score(docs: DataFrame, model: Model | None, tail: int, text_col: str = "text") -> DataFrame:
    """docs with expected_grade and tail_probability; null for texts without a word."""
    plain = docs.drop("expected_grade", "tail_probability")
    names = plain.columns
    weights = model.weights.astype(np.float32) if model else None

    def run(batches):
        features = Features()
        own = Model(weights, model.bounds) if model else None
        for b in batches:
            expected, tails = [], []
            for text in b.column(names.index(text_col)).to_pylist():
                f = features(text)
                p = None if f is None else own.tails(*f) if own else np.array([1.0])
                expected.append(None if p is None else float(p.sum()))
                tails.append(None if p is None else float(p[min(tail, len(p)) - 1]))
            yield pa.record_batch([*b.columns, pa.array(expected, pa.float64()), pa.array(tails, pa.float64())], [*names, "expected_grade", "tail_probability"])

    schema = StructType([*plain.schema.fields, StructField("expected_grade", DoubleType()), StructField("tail_probability", DoubleType())])
    return plain.mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 2 is good and not toxic, one point off for either fault."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """docs with expected_grade, tail_probability = P(grade >= 2) and kept."""
    model = fit(docs, graded(labels))
    return score(docs, model, tail=2).withColumn("kept", F.coalesce(F.col("tail_probability") >= least, F.lit(False)))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).drop("text")
