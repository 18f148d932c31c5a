import hashlib
import random

from llm_helpers import documents, prose, words

from corpusloom.llm import substring_dedup
from corpusloom.llm.substring_dedup import SuffixAutomaton, remove_repeats, repeat_digests

WIDTH = 13


def brute(rows):
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - WIDTH + 1):
            g = tuple(w[k : k + WIDTH])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = {k + j for k in range(len(w) - WIDTH + 1) if first[tuple(w[k : k + WIDTH])] < i for j in range(WIDTH)}
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    passages = [prose(rng, rng.randrange(10, 70)) for _ in range(15)]
    texts = []
    for _ in range(150):
        parts = [prose(rng, rng.randrange(0, 60), 40) for _ in range(3)]
        if rng.random() < 0.6:
            p = rng.choice(passages).split()
            a = rng.randrange(0, max(1, len(p) - 14))
            parts.insert(rng.randrange(4), " ".join(p[a : a + rng.randrange(12, 60)]))
        texts.append("\n".join(parts))
    texts += [texts[3]] * 40 + [None, "", " \n ", "a " * 40, "a " * 12 + "b " + "a " * 30, "a b " * 30, "x" * 70_000, prose(rng, 20_000, 300)]
    return texts


def test_matching_statistics():
    automaton = SuffixAutomaton(["a b a b a b c".split(), "c d".split()])
    assert automaton.matching_statistics("a b a b c d a".split()) == [1, 2, 3, 4, 5, 2, 1]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART_ROWS", 8)  # so that the copied text is dealt out
    texts = corpus()
    got = sorted(map(tuple, repeat_digests(documents(spark, texts)).collect()))
    assert got == brute(list(enumerate(texts)))


def test_texts_lose_just_the_repeated_words(spark):
    texts = corpus()
    docs = documents(spark, texts)
    cut = remove_repeats(docs)
    assert cut.columns == docs.columns
    removed = {r[0]: r[2] for r in brute(list(enumerate(texts)))}
    rows = {r.doc_id: r.text for r in cut.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        if not removed[i]:
            assert rows[i] == text
        else:
            assert len(words(rows[i])) == len(words(text)) - removed[i]


def test_repeated_ids_missing_ids_and_no_rows(spark):
    rng = random.Random(1)
    a, b = prose(rng, 30), prose(rng, 30)
    docs = documents(spark, [a, a, b, a, b, None], [3, 3, 3, 7, None, 2])
    got = {(r.doc_id, r.n_words, r.n_removed) for r in repeat_digests(docs).collect()}
    assert got == {(3, 30, 0), (7, 30, 30), (None, 30, 0), (2, 0, 0)}
    assert repeat_digests(docs).count() == 6
    assert repeat_digests(docs.limit(0)).count() == 0 and remove_repeats(docs.limit(0)).count() == 0


def test_columns_named_as_those_inside(spark):
    rng = random.Random(8)
    shared = prose(rng, 30)
    rows = [(k, f"{prose(rng, 20)} {shared}", "x", 1, [2], "y", k, "z", "w") for k in range(3)]
    names = "doc_id long, text string, _id string, _text_key int, _spans array<int>, id string, _bad long, spans string, text_key string"
    docs = spark.createDataFrame(rows, names)
    found = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert remove_repeats(docs).columns == docs.columns
    assert [len(words(found[k].text)) for k in range(3)] == [50, 20, 20]
    assert all(found[k][2:] == rows[k][2:] for k in range(3))
    assert [tuple(r)[:3] for r in sorted(repeat_digests(docs).collect())] == [(0, 50, 0), (1, 50, 30), (2, 50, 30)]
