import random

import numpy as np
from llm_helpers import LOWER, documents, prose, words

from corpusloom.llm import near_dedup
from corpusloom.llm.components import components
from corpusloom.llm.near_dedup import keep_first, near_duplicates


def brute(rows):
    sets = {}
    for i, text in rows:
        w = words((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared) and shared:
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    boilerplate = prose(rng, 60)
    texts = [prose(rng, rng.randrange(3, 200)) for _ in range(60)]
    base = prose(rng, 150).split()
    for k in range(120):  # a large group of near copies at all distances, some past the threshold
        copy = base[:]
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = f"edit{k}"
        texts.append(" ".join(copy))
    texts += [texts[5]] * 80 + [boilerplate + " " + prose(rng, 40) for _ in range(60)]
    chain = prose(rng, 120).split()
    for k in range(12):  # neighbours link, ends do not
        chain = chain[4:] + prose(rng, 4).split()
        texts.append(" ".join(chain))
    texts += [None, "", " \n", "One", "one", "a b c d", "A b c d", "a b c d e", "x " * 30_000, "long " * 5 + prose(rng, 30_000, 100_000)]
    rng.shuffle(texts)
    return texts


def test_components_equal_brute_force(spark):
    texts = corpus()
    rows = list(enumerate(texts))
    docs = documents(spark, texts)
    want = brute(rows)
    got = {r[0]: tuple(r[1:4]) for r in near_duplicates(docs).collect()}
    assert got == want
    kept = keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])


def test_large_nodes_are_resolved_without_leaves(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 6)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    texts = corpus(4)[:150]
    got = {r[0]: tuple(r[1:4]) for r in near_duplicates(documents(spark, texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_repeated_missing_and_no_rows(spark):
    text = "a b c d e f g h"
    docs = documents(spark, [text, text, "q r s t u v", text, text], [4, 4, None, None, 9])
    got = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert got == sorted([(4, 4, 4, True), (4, 4, 4, True), (None, 2, None, True), (None, 4, None, True), (9, 4, 4, False)], key=str)
    assert sorted(str(r.doc_id) for r in keep_first(docs).collect()) == ["4", "4", "None", "None"]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_one_id_with_two_texts_joins_their_groups(spark):
    a, b = "a b c d e f g h", "k l m n o p q r"
    docs = documents(spark, [a, a, b, b], [1, 5, 5, 8])
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 5: 1, 8: 1}


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(None, 3)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}}


def test_roots_of_the_trees_choose_distinct_tokens():
    tokens = np.arange(near_dedup.TOKENS, dtype=np.uint32)
    chosen = []
    for tree in range(near_dedup.tree_count(80)):
        whole = list(near_dedup._branch(1, tokens.tobytes(), tree, 0))
        for slot in range(near_dedup.TOKENS):
            other = tokens.copy()
            other[slot] = 999
            chosen += [slot] if list(near_dedup._branch(1, other.tobytes(), tree, 0)) != whole else []
    assert len(chosen) == len(set(chosen)) == near_dedup.tree_count(80) * near_dedup.BRANCHES


def test_threshold_is_a_parameter(spark):
    assert [(near_dedup.tree_count(p), near_dedup.min_equal(p)) for p in (85, 80)] == [(3, 88), (4, 79)]
    # 100 shingles each, 91 shared: similarity 91 / 109.
    a = [f"w{k}" for k in range(104)]
    docs = documents(spark, [" ".join(a), " ".join(a[:95] + [f"x{k}" for k in range(9)])])
    assert [keep_first(docs, **p).count() for p in ({}, {"percent": 80})] == [2, 1]


def test_columns_named_as_those_inside(spark):
    rng = random.Random(8)
    text = prose(rng, 60)
    docs = spark.createDataFrame([(k, text, "x", 1, 2) for k in range(3)], "doc_id long, text string, _id string, id int, kept int")
    assert [tuple(r) for r in keep_first(docs).collect()] == [(0, text, "x", 1, 2)]
