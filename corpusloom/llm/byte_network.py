"""Quality scores from a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that cover all of it. Learned filters slide over each chunk's embedded bytes and
keep their greatest response; the greatest and the mean over the chunks are combined into one probability. The network
is trained by gradient steps on a bounded sample of labelled texts and sees nothing but their bytes.

Defined cases: a null text counts as empty; empty texts and texts shorter than a filter are padded with zeros and get a
score like any other; rows that repeat are scored one by one; without labels of both kinds to learn from, every text gets
the share of label 1 (one half without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import map_rows

SAMPLE_ROWS = 2000
"""Labelled texts that the network is trained on, at most: the first by hash of doc_id, half of them of each label."""

SAMPLE_BYTES = 1 << 15
"""Longer texts are not in the sample (all texts are scored whole)."""

CUT = 0.3
EMBEDDING, FILTERS, WIDTH, STRIDE = 6, 24, 8, 2
CHUNK = 1024
"""Bytes in a chunk; neighbours share all but ``STRIDE`` bytes of a filter's width, so that no place is left out."""

EPOCHS = 6
_STEP = (CHUNK - WIDTH) // STRIDE + 1
_PIECE = 512


@dataclass
class ByteNetwork:
    """Byte embedding, filters with offsets, and the weights of the greatest and the mean responses."""

    embedding: np.ndarray
    filters: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray
    intercept: float
    training: bool = False

    def responses(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter in each chunk, and the place it has in the text."""
        data = _padded(text)
        count = (len(data) - WIDTH) // STRIDE + 1
        best, where = [], []
        for start in range(0, count, _STEP * _PIECE):
            stop = min(count, start + _STEP * _PIECE)
            embedded = self.embedding[data[start * STRIDE : (stop - 1) * STRIDE + WIDTH]]
            size = embedded.strides[1]
            shape = (stop - start, WIDTH * EMBEDDING)
            windows = np.lib.stride_tricks.as_strided(embedded, shape, (STRIDE * EMBEDDING * size, size))
            found = windows @ self.filters + self.offsets
            bounds = np.arange(0, stop - start, _STEP)
            best.append(np.maximum.reduceat(found, bounds, axis=0))
            places = [a + found[a : a + _STEP].argmax(axis=0) for a in bounds.tolist()] if self.training else []
            where.append((np.array(places).reshape(-1, FILTERS) + start) * STRIDE)
        return np.maximum(np.concatenate(best), 0), np.concatenate(where).astype(np.int64)

    def margin(self, text: bytes | None) -> float:
        best, _ = self.responses(text or b"")
        return float(self.weights[:FILTERS] @ best.max(axis=0) + self.weights[FILTERS:] @ best.mean(axis=0)) + self.intercept

    def score(self, text: bytes | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(text), -40, 40))))


def _padded(text: bytes) -> np.ndarray:
    """The bytes and as many zeros as the last filter place needs to cover the end."""
    return np.frombuffer(text.ljust(WIDTH, b"\0") + bytes(STRIDE - 1), np.uint8)


def _initial(rng: np.random.Generator) -> ByteNetwork:
    scale = 1.0 / np.sqrt(WIDTH * EMBEDDING)
    return ByteNetwork(
        rng.normal(0, 1, (256, EMBEDDING)).astype(np.float32),
        rng.normal(0, scale, (WIDTH * EMBEDDING, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        0.0,
    )


def _gradients(net: ByteNetwork, text: bytes, label: float) -> list[np.ndarray]:
    """Gradients of the log loss for one text: only the places of the greatest responses take part."""
    best, where = net.responses(text)
    chunks, columns = len(best), np.arange(FILTERS)
    top = best.argmax(axis=0)
    greatest, mean = best[top, columns], best.mean(axis=0)
    margin = float(net.weights[:FILTERS] @ greatest + net.weights[FILTERS:] @ mean) + net.intercept
    error = 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40))) - label
    back = np.tile(error * net.weights[FILTERS:] / chunks, (chunks, 1))
    back[top, columns] += error * net.weights[:FILTERS]
    back *= best > 0
    data = _padded(text)
    codes = data[where[:, :, None] + np.arange(WIDTH)]  # chunk, filter, place in the filter
    embedded = net.embedding[codes].reshape(chunks, FILTERS, -1)
    of_filters = np.einsum("cf,cfk->kf", back, embedded)
    of_codes = back[:, :, None, None] * net.filters.T.reshape(1, FILTERS, WIDTH, EMBEDDING)
    of_embedding = np.zeros_like(net.embedding)
    np.add.at(of_embedding, codes.reshape(-1), np.broadcast_to(of_codes, (*codes.shape, EMBEDDING)).reshape(-1, EMBEDDING))
    return [of_embedding, of_filters, back.sum(axis=0), error * np.concatenate([greatest, mean]), np.array([error])]


def train_network(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, batch: int = 16, pace: float = 0.004) -> ByteNetwork:
    """Network fitted to the texts by Adam steps over small batches."""
    rng = np.random.default_rng(0)
    net = _initial(rng)
    net.training = True
    values = [net.embedding, net.filters, net.offsets, net.weights, np.zeros(1, np.float32)]
    first = [np.zeros_like(v) for v in values]
    second = [np.zeros_like(v) for v in values]
    step = 0
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), batch):
            step += 1
            sums = [np.zeros_like(v) for v in values]
            for k in order[start : start + batch].tolist():
                for s, g in zip(sums, _gradients(net, texts[k], labels[k]), strict=True):
                    s += g.astype(np.float32)
            now = pace * (1 - 0.9 * step / total)
            for v, s, m, q in zip(values, sums, first, second, strict=True):
                s /= batch
                m += 0.1 * (s - m)
                q += 0.01 * (s * s - q)
                v -= now * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-6)
            net.intercept = float(values[4][0])
    net.training = False
    return net


def held_out(doc_id: str = "doc_id"):
    """Whether a row is never learnt from: the crc32 of its id as text is divisible by five."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def fit_network(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> ByteNetwork:
    """Network for ``labels.quality``, from rows that are not held out."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {bool(r["quality"]): r["count"] for r in known.groupBy((F.col("quality") > 0).alias("quality")).count().collect()}
    good, bad = counts.get(True, 0), counts.get(False, 0)
    if not good or not bad:
        return _constant((good + 1) / (good + bad + 2))
    halves = [
        known.filter(F.col("quality") > 0 if label else F.col("quality") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2)
        for label in (0, 1)
    ]
    sample = halves[0].unionByName(halves[1])
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("body")).join(F.broadcast(sample), "doc_id")
    short = texts.filter((F.octet_length("body") <= sample_bytes) & F.col("body").isNotNull())
    short = short.groupBy("doc_id", "quality").agg(F.min("body").alias("body"))  # of texts that share an id, one
    rows = sorted((r["doc_id"], bytes(r["body"]), int(r["quality"] > 0)) for r in short.collect())
    n_good = sum(r[2] for r in rows)
    if n_good in (0, len(rows)):
        return _constant((good + 1) / (good + bad + 2))
    net = train_network([r[1] for r in rows], [r[2] for r in rows])
    # The sample has other shares of the labels than the table.
    net.intercept += float(np.log(good / bad) - np.log(n_good / (len(rows) - n_good)))
    return net


def _constant(share: float) -> ByteNetwork:
    net = _initial(np.random.default_rng(0))
    net.weights[:] = 0
    net.intercept = float(np.log(share / (1 - share)))
    return net


def score_quality(documents: DataFrame, net: ByteNetwork, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """Per row its id, whether it is ``held_out``, its ``score`` and the label ``predicted`` at ``cut``."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def score(doc_id, held, text) -> Iterator[tuple]:
        value = shared.value.score(text)
        yield doc_id, held, value, int(value >= cut)

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held"), F.col(text_col).cast("binary"))
    return map_rows(rows, f"`{id_col}` {kind}, held_out boolean, score double, predicted int", score)
