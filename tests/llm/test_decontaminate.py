import hashlib
import random
import re

from llm_helpers import LOWER, documents, prose

from corpusloom.llm.decontaminate import contamination_digests, cut_spans, drop_contaminated, find_contamination

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, n_words int"


def plain(text):
    return PLAIN.findall((text or "").translate(LOWER))


def brute(texts, items):
    windows = {}
    for item_id, text in items:
        w = plain(text)
        for k in range(max(1, len(w) - 12) if w and item_id is not None else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(item_id))
    out = {}
    for i, text in enumerate(texts):
        w, hit, found = plain(text), set(), set()
        for g, ids in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), names, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def case():
    rng = random.Random(7)
    items = [(k, prose(rng, rng.randrange(14, 30))) for k in range(20)]
    items += [(100, "Short item"), (101, "one"), (102, None), (103, "..."), (None, "w1 w2 w3"), (3, items[4][1]), (105, items[5][1])]
    texts = [prose(rng, 100) for _ in range(20)]
    texts += [t + " " + items[k][1].upper() + ", " + prose(rng, 50 * k) for k, t in enumerate(texts[:8])]
    texts += [None, "", "...", "ONE", "a short, ITEM here", items[2][1][:-6], "x" * 50_000, texts[20], "é-one-ß"]
    return texts, items


def test_equals_brute_force_in_one_slice_and_in_many(spark):
    texts, items = case()
    docs, table = documents(spark, texts), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    want = brute(texts, items)
    for size in (1 << 20, 40):
        got = contamination_digests(docs, table, slice_windows=size).collect()
        assert len(got) == len(texts) and {r[0]: tuple(r[1:]) for r in got} == want
        kept = drop_contaminated(docs, table, slice_windows=size)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]}


def test_spans_can_be_cut(spark):
    texts, items = case()
    table = spark.createDataFrame([(i, t, 1) for i, t in items if i is not None and i < 20], ITEMS)
    rows = find_contamination(documents(spark, texts), table).collect()
    cut = [cut_spans((texts[r.doc_id] or "").encode(), r.spans).decode() for r in rows]
    assert all(not r.items for r in find_contamination(documents(spark, cut), table).collect())
    assert all(c == (texts[r.doc_id] or "") for c, r in zip(cut, rows) if not r.spans)


def test_repeats_and_no_rows(spark):
    texts, items = case()
    table = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    twice = documents(spark, [texts[21]] * 3, [1, 1, None])
    for size in (1 << 20, 40):
        assert contamination_digests(twice, table, slice_windows=size).count() == 3
    assert drop_contaminated(twice, table.limit(0)).count() == 3
    assert [r.n_hit for r in contamination_digests(twice, table.limit(0)).collect()] == [0, 0, 0]
    assert contamination_digests(twice.limit(0), table).count() == 0


def test_items_without_an_id_mark_words(spark):
    table = spark.createDataFrame([(None, "a passage of the test", 1), (None, "another one", 1), (7, "with an id", 1)], ITEMS)
    docs = documents(spark, ["x a passage of the test y", "a passage of the test, another one, with an id", "clean text"])
    names = [hashlib.sha256(n).hexdigest() for n in (b"", b"7", b"")]
    want = [(0, 7, 5, 1, names[0], True), (1, 10, 10, 2, names[1], True), (2, 2, 0, 0, names[2], False)]
    for size in (1 << 20, 2):
        assert sorted(map(tuple, contamination_digests(docs, table, slice_windows=size).collect())) == want
        assert [r.doc_id for r in drop_contaminated(docs, table, slice_windows=size).collect()] == [2]
