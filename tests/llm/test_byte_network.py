import random
import zlib

import numpy as np
import pytest
from llm_helpers import documents, prose

from corpusloom.llm.byte_network import STRIDE, WIDTH, ByteNetwork, fit_network, score_quality

SF_DIR = "/root/testdata/sf0.01"


def plain_margin(net: ByteNetwork, text: bytes) -> float:
    """The network written as loops over chunks and places."""
    data = text.ljust(WIDTH, b"\0")
    data += b"\0" * (-(len(data) - WIDTH) % STRIDE)
    values = [
        np.concatenate([net.embedding[b] for b in data[at : at + WIDTH]]) @ net.filters + net.offsets for at in range(0, len(data) - WIDTH + 1, STRIDE)
    ]
    step = (1024 - WIDTH) // STRIDE + 1
    best = np.array([np.maximum(np.max(values[a : a + step], axis=0), 0) for a in range(0, len(values), step)])
    half = len(net.weights) // 2
    return float(net.weights[:half] @ best.max(axis=0) + net.weights[half:] @ best.mean(axis=0)) + net.intercept


@pytest.fixture(scope="module")
def net(spark):
    documents, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    return fit_network(documents, labels)


def test_whole_texts_are_scored_as_by_loops(net):
    rng = random.Random(1)
    for size in [0, 1, 7, 8, 9, 1023, 1024, 1025, 1026, 2050, 4000]:
        text = prose(rng, 900).encode()[:size]
        assert net.margin(text) == pytest.approx(plain_margin(net, text), abs=1e-3)
    assert 0 <= net.score(None) == net.score(b"") <= 1


def test_rows_held_out_are_told_apart(spark, net):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    rows = score_quality(docs, net).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    good = [r.score for r in rows if r.held_out and r.quality]
    bad = [r.score for r in rows if r.held_out and not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_awkward_rows(spark, net):
    docs = documents(spark, [None, "", "x", "word " * 200_000, "same", "same"], [1, 2, 3, 4, 5, None])
    rows = {r.doc_id: r for r in score_quality(docs, net).collect()}
    assert len(rows) == 6 and rows[1].score == rows[2].score and rows[5].score == rows[None].score and rows[None].held_out is False
    assert score_quality(docs.limit(0), net).count() == 0
    one = spark.createDataFrame([(3, 1, 0), (5, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert len({r.score for r in score_quality(docs, fit_network(docs, one)).collect()}) == 1
    assert {r.score for r in score_quality(docs, fit_network(docs, one.limit(0))).collect()} == {0.5}
