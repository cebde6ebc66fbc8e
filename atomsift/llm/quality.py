"""Ordinal quality classifier: cumulative-link regression over hashed text.

All grades share one weight vector; ordered thresholds cut the latent score into
grades: P(grade >= k) = sigmoid(w . x - threshold_k). That gives an expected grade
and tail probabilities, by which texts are selected.

Features are hashed words, word shapes (runs of upper case, lower case and digits
shortened, other signs kept) and pairs of neighbouring shapes, those of repeated
words apart; counts are damped and each of the three families has unit length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import CHUNK_BYTES, _BYTE, Texts, chunks, mix

WIDTH = 1 << 14
#: Labelled texts to fit on at most; with ``WIDTH`` features each that is 256 MB at worst.
SAMPLE_ROWS = 2048
FAMILY_WEIGHT = (0.5, 1.0, 1.0)


def _shape_hash(texts: Texts) -> np.ndarray:
    kind = np.arange(256, dtype=np.uint8)
    kind[65:91], kind[97:123], kind[128:], kind[48:58] = 65, 97, 97, 48
    code = kind[texts.raw]
    change = np.ones(len(code), bool)
    change[1:] = code[1:] != code[:-1]
    change[texts.starts] = True
    rank = np.cumsum(change)
    up, down = Texts._powers.upto(max(len(code), CHUNK_BYTES))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(np.where(change, _BYTE[code] * up[rank], np.uint64(0)), out=total[1:])
    return mix((total[texts.ends] - total[texts.starts]) * down[rank[texts.starts]])


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature number and value of every feature of a chunk, by text."""
    doc, n = texts.doc, len(texts)
    shape = _shape_hash(texts)
    same = doc[1:] == doc[:-1]
    word = texts.word_hash()
    pair = mix(shape[:-1] * np.uint64(3) + shape[1:] + (word[1:] == word[:-1]) * np.uint64(7))[same]
    families = [(word, doc), (shape, doc), (pair, doc[1:][same])]
    rows, columns, values = [], [], []
    for salt, ((h, d), weight) in enumerate(zip(families, FAMILY_WEIGHT, strict=True)):
        column = (mix(h + np.uint64(salt)) >> np.uint64(32)).astype(np.int64) % WIDTH
        key, count = np.unique(d.astype(np.int64) * WIDTH + column, return_counts=True)
        value, row = np.log1p(count), key // WIDTH
        length = np.sqrt(np.bincount(row, value * value, n))
        rows.append(row)
        columns.append(key % WIDTH)
        values.append(weight * value / length[row])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate(columns)[order], np.concatenate(values)[order]


@dataclass
class CumulativeLink:
    """``grades`` ascending; ``thresholds`` between them; weights of the hashed features."""

    grades: np.ndarray
    thresholds: np.ndarray
    weights: np.ndarray

    def latent(self, row, column, value, n):
        return np.bincount(row, value * self.weights[column], n)

    def tails(self, latent):
        """P(grade >= k) for every grade but the lowest, one column each."""
        return _sigmoid(latent[:, None] - self.thresholds[None, :])


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(row, column, value, y, grades, steps: int = 250, rate: float = 0.1, decay: float = 1e-4) -> CumulativeLink:
    """Maximum likelihood with a quadratic penalty, by Adam on all rows; ``y`` numbers the grades from 0.

    The thresholds are the first one and positive gaps, so they stay in order.
    """
    n, k = len(y), len(grades)
    if k < 2 or n == 0:
        return CumulativeLink(np.asarray(grades), np.zeros(max(k - 1, 0)), np.zeros(WIDTH))
    share = np.clip([(y >= j).mean() for j in range(1, k)], 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    p = np.concatenate([np.zeros(WIDTH), start[:1], gaps])
    first, second = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, widths = p[:WIDTH], np.exp(p[WIDTH + 1 :])
        cut = np.concatenate([[-np.inf], p[WIDTH] + np.concatenate([[0], np.cumsum(widths)]), [np.inf]])
        z = np.bincount(row, value * w[column], n)
        low, high = _sigmoid(cut[y] - z), _sigmoid(cut[y + 1] - z)
        mass = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low) / mass, high * (1 - high) / mass
        # log-likelihood of a row: log(high - low)
        g_z = (d_high - d_low) / n
        g_cut = np.zeros(k + 1)
        np.add.at(g_cut, y + 1, -d_high / n)
        np.add.at(g_cut, y, d_low / n)
        g_cut = g_cut[1:k]
        g = np.concatenate(
            [
                np.bincount(column, value * g_z[row], WIDTH) + decay * w,
                [g_cut.sum()],
                np.cumsum(g_cut[::-1])[::-1][1:] * widths,
            ]
        )
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        p = p - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    gaps = np.concatenate([[0], np.cumsum(np.exp(p[WIDTH + 1 :]))])
    return CumulativeLink(np.asarray(grades), p[WIDTH] + gaps, p[:WIDTH])


def _with_features(batches):
    for batch in batches:
        for first, texts in chunks(batch.column("text")):
            row, column, value = features(texts)
            counts = np.bincount(row, minlength=len(texts))
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("grade").slice(first, len(texts)),
                    pa.ListArray.from_arrays(offsets, pa.array(column.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32))),
                ],
                ["grade", "columns", "values"],
            )


def train(docs: DataFrame, ratings: DataFrame, grade: str, sample_rows: int = SAMPLE_ROWS) -> CumulativeLink:
    """Fit on at most ``sample_rows`` rated texts, those whose ids have the smallest hashes.

    Ratings that are null do not count; of several ratings of an id the smallest
    does; several texts of an id each have its rating. Without two different
    grades all texts get the same score.
    """
    rated = ratings.select(F.col("doc_id").cast("long"), F.col(grade).cast("double").alias("grade"))
    rated = rated.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    table = rows.mapInArrow(_with_features, "grade double, columns array<int>, values array<float>").toArrow()
    grades, y = np.unique(table["grade"].to_numpy(), return_inverse=True)
    columns, values = table["columns"].combine_chunks(), table["values"].combine_chunks()
    counts = np.diff(columns.offsets.to_numpy()) if len(columns) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    return fit(row, columns.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(float), y, grades)


def _scores(texts: Texts, model: CumulativeLink, least: float):
    """Expected grade and probability of a grade of at least ``least``."""
    n = len(texts)
    tails = model.tails(model.latent(*features(texts), n))
    steps = np.diff(model.grades)
    base = model.grades[0] if len(model.grades) else 0.0
    expected = base + tails @ steps if len(steps) else np.full(n, base)
    at = int(np.searchsorted(model.grades, least))
    if at == 0:
        tail = np.ones(n)
    else:
        tail = tails[:, at - 1] if at <= tails.shape[1] else np.zeros(n)
    return expected, tail


def rate(docs: DataFrame, model: CumulativeLink, least: float, keep_from: float = 0.5) -> DataFrame:
    """``(doc_id, expected_grade, tail_probability, keep)`` for every document.

    ``tail_probability`` is that of a grade of at least ``least``; ``keep`` tells
    whether it reaches ``keep_from``. Null and empty texts have no features and
    get what the thresholds alone say. Equal texts score equally; repeated rows
    are scored one by one; an empty table gives an empty table; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                expected, tail = _scores(texts, shared.value, least)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)),
                        pa.array(expected),
                        pa.array(tail),
                        pa.array(tail >= keep_from),
                    ],
                    ["doc_id", "expected_grade", "tail_probability", "keep"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def select(docs: DataFrame, model: CumulativeLink, least: float, keep_from: float = 0.5) -> DataFrame:
    """The rows that :func:`rate` keeps, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            kept = [_scores(texts, shared.value, least)[1] >= keep_from for _, texts in chunks(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
