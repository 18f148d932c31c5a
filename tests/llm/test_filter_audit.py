import random
from collections import Counter
from itertools import permutations

import pytest
from llm_helpers import words
from pyspark.sql import functions as F

from corpusloom.llm import filter_audit as audit

SCHEMA = "doc_id long, text string, source string, id string, part string, mask int, n int, key int"


def fails(text):
    found = words(text)
    return {
        "A": len(found) < 200,
        "B": 100 * len(set(found)) < 50 * len(found),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def brute(rows, labels):
    """Every order run as a cascade over the rows themselves."""
    good, bad = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    judged = []
    for i, text, part in rows:
        text = text or ""
        judged.append((i, part or "", fails(text) | {"E": i is not None and i > least[text]}))
    out = []
    for part in {p for _, p, _ in judged}:
        mine = [(i, f) for i, p, f in judged if p == part]
        shapley, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[name]]
                left = [(i, f) for i, f in left if not f[name]]
                shapley[name] += len(gone)
                failing = sum(f[name] for _, f in mine)
                alone = sum(f[name] and sum(f.values()) == 1 for _, f in mine)
                lost = (sum(i in ids for i, _ in gone) for ids in (good, bad))
                lines.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, *lost))
        out += [(*line, shapley[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 1, 2, 3) for i, t, s in rows], SCHEMA)


def given():
    rng = random.Random(6)
    rows = []
    for i in range(150):
        text = " ".join(f"{rng.choice('aA')}{rng.randrange(rng.choice([30, 5000]))}" for _ in range(rng.choice([0, 50, 250, 400])))
        rows.append((i, text + rng.choice(["", "", " #", " &"]), rng.choice(["s", "t", None, ""])))
    rows += [(200 + k, rows[k % 9][1], "s") for k in range(40)]
    rows += [(None, rows[0][1], "t"), (None, None, None), (500, "", "u"), (500, "", "u"), (501, "", "u"), (7, "\x0b\x1c a", "u")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 220, 2)] + [(4, 1, 1), (None, 1, 1)]
    return rows, labels


def test_audit_equals_cascades(spark):
    rows, labels = given()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit_quality_filters(table(spark, rows).repartition(5), marks)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == brute(rows, labels)


def test_swaps_visit_every_order_once():
    for n in range(7):
        names = list(range(n))
        seen = {tuple(names)}
        for k in audit.adjacent_swaps(n):
            names[k], names[k + 1] = names[k + 1], names[k]
            assert tuple(names) not in seen
            seen.add(tuple(names))
        assert len(seen) == len(list(permutations(range(n))))


def test_swapped_diagram_is_the_one_built_in_that_order():
    rng = random.Random(7)
    masks = {m: (rng.randrange(3), rng.randrange(2)) for m in rng.sample(range(16), 11)}
    diagram = audit.Diagram("abcd", masks, 2)
    for level in audit.adjacent_swaps(4):
        diagram.swap(level)
        bit = {name: k for k, name in enumerate("abcd")}
        renamed = {sum(((m >> bit[name]) & 1) << k for k, name in enumerate(diagram.order)): w for m, w in masks.items()}
        fresh = audit.Diagram(diagram.order, renamed, 2)
        assert list(fresh.steps()) == list(diagram.steps())
        # Shared as well: neither holds two equal nodes on one level.
        assert [len(x) for x in fresh.levels] == [len(x) for x in diagram.levels]


def test_other_filters_and_losses(spark):
    docs = table(spark, [(1, "aa", "p"), (2, "b", "p"), (3, "aa", "q")])
    labels = spark.createDataFrame([(1, 5)], "doc_id long, grade int")
    failures = {"X": F.length("text") > 1, "Y": F.col("text") == "b"}
    counts = audit.failure_counts(docs, labels, failures, copies=None, losses=[("grade", 5)])
    rows = {(r.part, r.filter_order, r.step): r for r in audit.audit_filters(counts, "XY", ["grade_lost"]).collect()}
    assert len(rows) == 8
    first = rows["p", "XY", 1]
    assert (first.kept, first.removed, first.grade_lost, first.shapley) == (1, 1, 1, 2)
    with pytest.raises(ValueError):
        audit.audit_filters(counts, "ABCDEFGHI")


def test_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_quality_filters(table(spark, []), labels).collect() == []
