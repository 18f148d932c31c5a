import math
import random
from collections import Counter

import pytest
from llm_helpers import documents, prose, words

from corpusloom.llm.quality_rules import BUCKETS, CONSTANT, features, fit_ngram_model, judge_quality, keep_quality


def brute(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    twice = Counter(windows)
    hit = {k + j for k, g in enumerate(windows) if twice[g] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if words(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    good = [prose(rng, rng.randrange(12, 400)) for _ in range(150)]
    bad = [" ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in prose(rng, 60).split()) for _ in range(60)]
    odd = [None, "", " \n\t", "one two", "a b c d e " * 9, "é ü\nx y\nx y\n \n", "#" * 200, "x" * 100_000, good[0], "a\n\n\nb\nb\n b"]
    return good, bad, odd


def test_counts_equal_brute_force(spark, texts):
    everything = [t for part in texts for t in part]
    rows = {r.doc_id: r for r in judge_quality(documents(spark, everything), CONSTANT).collect()}
    for i, text in enumerate(everything):
        want = brute(text)
        assert tuple(rows[i][1:6]) == want, (i, text)
        assert rows[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert rows[i].kept == (not rows[i].base_failed)


def test_model_tells_labels_apart_and_filters(spark, texts):
    good, bad, odd = texts
    docs = documents(spark, good + bad + odd)
    labels = [(i, 1, 0) for i in range(len(good))] + [(len(good) + i, 0, 0) for i in range(len(bad))] + [(None, 1, 0), (0, 1, 0), (999, None, 0)]
    model = fit_ngram_model(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    judged = {r.doc_id: r for r in judge_quality(docs, model).collect()}
    assert all(judged[i].kept == (not judged[i].base_failed) for i in range(len(good)))
    assert not any(judged[len(good) + i].kept for i in range(len(bad)))
    kept = keep_quality(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in judged.items() if r.kept}


def test_without_rows_or_labels(spark):
    docs = documents(spark, ["a b c d e f g h i j k l"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fit_ngram_model(docs, none) is CONSTANT
    assert [r.kept for r in judge_quality(docs, CONSTANT).collect()] == [True]
    assert judge_quality(docs.limit(0), CONSTANT).count() == 0 and keep_quality(docs.limit(0), CONSTANT).count() == 0


def plain_shares(text):
    """Shares of the buckets of three-character runs, one run at a time."""
    share = [0.0] * BUCKETS
    runs = [text[k : k + 3] for k in range(len(text) - 2)]
    for run in runs:
        code = sum(ord(c) * m for c, m in zip(run, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=True)) % 2**32
        code = (code ^ (code >> 15)) * 2654435761 % 2**32
        share[(code >> 12) % BUCKETS] += 1 / len(runs)
    return share


@pytest.mark.parametrize("text", ["", "ab", "abc", "Широкая электрификация", "日本語のテキスト", "a😀b😀c", "plain words, more words"])
def test_character_shares_equal_a_loop(text, monkeypatch):
    monkeypatch.setattr("corpusloom.llm.quality_rules._PIECE", 5)
    assert features(text.encode())[1].tolist() == pytest.approx(plain_shares(text), abs=1e-6)


def test_scores_equal_a_loop(spark, texts):
    good, bad, _ = texts
    docs = documents(spark, [*good, *bad])
    labels = spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(good) + len(bad))], "doc_id long, quality int, toxic int")
    model = fit_ngram_model(docs, labels)
    repeated = fit_ngram_model(docs.unionByName(docs), labels)
    assert (model.weights == repeated.weights).all()
    for row in judge_quality(docs, model).collect()[::20]:
        text = (good + bad)[row.doc_id]
        shares = [*features(text.encode())[0].tolist(), *plain_shares(text)]
        margin = model.intercept + sum(w * x for w, x in zip(model.weights.tolist(), shares, strict=True))
        assert row.score == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.shift))), abs=1e-4)
        assert row.kept == (not row.base_failed and row.score >= 0.5)
