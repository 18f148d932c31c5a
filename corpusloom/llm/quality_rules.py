"""Quality rules: counted base rules and a calibrated n-gram model against fixed thresholds.

The model is a logistic regression over hashed word and character n-grams, fitted to a bounded sample of labelled
rows and calibrated on the part of the sample that it was not fitted to. Texts are scored whole, in Arrow batches.

Defined cases: a null text counts as empty; a text without words has no repeats and fails the base rules; rows that
repeat are judged one by one; an empty table gives an empty result; without labels of both kinds the model has
nothing to tell apart and gives every text the probability 1, so that the base rules decide alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import Words, covered, map_rows, mixed, space_words, window_hashes

SAMPLE_ROWS = 6000
"""Labelled rows that the model is fitted to and calibrated on, at most: the ones first by hash of doc_id."""

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_SCORE = 0.5
"""A text is rejected if it is less likely than this to be of good quality."""

REPEAT_WIDTH = 5
SYMBOLS = b"#*$%&|<>"
BUCKETS = 1 << 11
_PIECE = 1 << 20
_BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def base_counts(text: bytes | None, words: Words | None = None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines and words in repeated five-word windows."""
    text = text or b""
    words = space_words(text) if words is None else words
    blanks = len(text) - len(text.translate(None, b" \t\n\v\f\r"))
    word_chars = len(text.decode()) - blanks
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    windows = window_hashes(words.hashes, REPEAT_WIDTH)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    repeated = int(covered(np.isin(windows, twice), REPEAT_WIDTH, len(words)).sum()) if len(twice) else 0
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated


def _word_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of words and of pairs of neighbours; a word that follows itself shares one bucket with all such."""
    pairs = np.where(hashes[1:] == hashes[:-1], np.uint64(7), window_hashes(hashes, 2))
    return ((mixed(np.concatenate([hashes, pairs])) >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int32)


def _char_buckets(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all runs of three code points, a piece of the text at a time."""
    whole = text.decode()
    for start in range(0, len(whole) - 2, _PIECE):
        piece = np.frombuffer(whole[start : start + _PIECE + 2].encode("utf-32-le"), np.uint32)
        code = piece[:-2] * np.uint32(0x9E3779B1) + piece[1:-1] * np.uint32(0x85EBCA77) + piece[2:] * np.uint32(0xC2B2AE3D)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(2654435761)
        yield ((code >> np.uint32(12)) & np.uint32(BUCKETS - 1)).astype(np.int32)


def features(text: bytes | None, words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the buckets of word n-grams and of character n-grams."""
    text = text or b""
    words = space_words(text) if words is None else words
    by_word = np.bincount(_word_buckets(words.hashes), minlength=BUCKETS).astype(np.float32)
    by_char = np.zeros(BUCKETS, np.float32)
    for buckets in _char_buckets(text):
        by_char += np.bincount(buckets, minlength=BUCKETS)
    return by_word / max(1.0, by_word.sum()), by_char / max(1.0, by_char.sum())


def _sparse_features(doc_id: int, text: bytes | None, label: int) -> Iterator[tuple]:
    values = np.concatenate(features(text))
    used = np.flatnonzero(values)
    yield doc_id, label, used.astype(np.int32).tobytes(), values[used].tobytes()


@dataclass(frozen=True)
class NgramModel:
    """Weights per bucket of shares, an intercept, and the two numbers that turn margins into probabilities."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def score(self, text: bytes | None, words: Words | None = None) -> float:
        by_word, by_char = features(text, words)
        margin = float(self.weights[:BUCKETS] @ by_word + self.weights[BUCKETS:] @ by_char) + self.intercept
        return _sigmoid(self.slope * margin + self.shift)


CONSTANT = NgramModel(np.zeros(2 * BUCKETS, np.float32), 0.0, 0.0, 40.0)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by accelerated gradient descent over all rows."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    keep = np.full(x.shape[1], penalty, np.float32)
    keep[-1] = 0
    vector = np.random.default_rng(0).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(20):
        vector = x.T @ (x @ vector)
        vector /= np.linalg.norm(vector)
    pace = 1.0 / (0.25 * float(np.linalg.norm(x @ vector) ** 2) / len(x) + penalty)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for step in range(steps):
        gradient = x.T @ (_sigmoid(x @ ahead) - y).astype(np.float32) / len(x) + keep * ahead
        following = ahead - pace * gradient
        ahead = following + step / (step + 3) * (following - w)
        w = following
    return w[:-1], float(w[-1])


def fit_ngram_model(
    documents: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, penalty: float = 3e-4, steps: int = 250
) -> NgramModel:
    """Model of ``label`` from at most ``sample_rows`` labelled documents.

    The sample is a parameter, not a share of the table: its features, a few kilobytes a row, meet on the driver.
    Each fifth row of it only calibrates. Of texts that share an id one is taken. Rows whose label or doc_id is null are not used.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).dropna()
    one_each = known.groupBy("doc_id").agg(F.max("_label").alias("_label"))
    sample = one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("_text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "_label").agg(F.min("_text").alias("_text"))
    found = map_rows(texts.select("doc_id", "_text", "_label"), "doc_id bigint, label int, used binary, value binary", _sparse_features).collect()
    found = sorted(found, key=lambda r: (r["doc_id"], bytes(r["used"]), bytes(r["value"])))
    y = np.array([r["label"] > 0 for r in found], np.float32)
    if len(y) < 20 or y.min() == y.max():
        return CONSTANT
    x = np.zeros((len(found), 2 * BUCKETS), np.float32)
    for row, r in zip(x, found, strict=True):
        row[np.frombuffer(r["used"], np.int32)] = np.frombuffer(r["value"], np.float32)
    scale = 1.0 / (x.std(axis=0) + 1e-3)
    held = np.arange(len(y)) % 5 == 4
    weights, intercept = _fit_logistic(x[~held] * scale, y[~held], penalty, steps)
    weights = (weights * scale).astype(np.float32)
    slope, shift = _calibrate(x[held] @ weights + intercept, y[held])
    return NgramModel(weights, intercept, slope, shift)


def _calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits the held rows, with targets drawn in from 0 and 1 by their counts."""
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    at = np.array([1.0, 0.0])
    design = np.stack([margins.astype(np.float64), np.ones(len(y))], axis=1)
    for _ in range(50):
        p = _sigmoid(design @ at)
        curve = design.T @ (design * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-3 * np.eye(2)
        at = at - np.clip(np.linalg.solve(curve, design.T @ (p - target) + 1e-3 * (at - [1.0, 0.0])), -1, 1)
    return float(at[0]), float(at[1])


@dataclass(frozen=True)
class Limits:
    """The fixed thresholds."""

    min_words: int = MIN_WORDS
    max_repeat_percent: int = MAX_REPEAT_PERCENT
    min_score: float = MIN_SCORE


def _judge(text: bytes | None, model: NgramModel, limits: Limits) -> tuple:
    """Base counts, whether they fail, score and verdict."""
    words = space_words(text)
    counts = base_counts(text, words)
    failed = counts[0] < limits.min_words or 100 * counts[4] > limits.max_repeat_percent * counts[0]
    score = float(model.score(text, words))
    return *counts, failed, score, not failed and score >= limits.min_score


def judge_quality(documents: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Per document the base counts, ``base_failed``, the model's ``score`` and ``kept``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(doc_id, text) -> Iterator[tuple]:
        yield doc_id, *_judge(text, shared.value, limits)

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(id_col, F.col(text_col).cast("binary"))
    return map_rows(rows, f"`{id_col}` {kind}, {_BASE}, base_failed boolean, score double, kept boolean", judge)


def keep_quality(documents: DataFrame, model: NgramModel, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``documents``, with all their columns, that :func:`judge_quality` keeps; decided where they are read."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_judge((text or "").encode(), shared.value, limits)[-1] for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
