import base64
import hashlib
import random
from collections import defaultdict
from functools import lru_cache

import numpy as np
from llm_helpers import documents, prose
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints as fp

TEXTS = ["", None, "Von.", "That it.", "é字😀" * 9, "same text here", "same text here", "x" * 5000, "a\n\nb\t#", " "]


def shingles(text):
    """Every run of code points, zeros before the text included."""
    points = "\0" * (fp.SHINGLE - 1) + text
    return {points[k : k + fp.SHINGLE] for k in range(len(text))}


def hashes(text):
    """Hash of each shingle on its own."""
    return {int(fp._piece_hashes(np.array([ord(c) for c in s], np.uint32))[0]) for s in shingles(text)}


@lru_cache
def brute_sketch(text):
    known = sorted(hashes(text))
    low = [h for h in known if h < fp._THRESHOLD]
    return low if len(low) >= fp.FLOOR else known[: fp.FLOOR]


def brute(rows, tie=lambda text: 0):
    """Edited text and sketches per position, as the contract says, one document after another."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    for k, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, made, other = (np.array(brute_sketch(t), np.uint32) for t in (text, edited, following))
        yield (
            i,
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            base64.b64encode(fp.packed(own)).decode(),
            base64.b64encode(fp.packed(made)).decode(),
            fp.likeness(own, made),
            fp.likeness(own, other),
        )


def texts(n):
    rng = random.Random(5)
    return TEXTS + [prose(rng, rng.choice([1, 3, 10, 60, 400])) for _ in range(n)]


def test_edits_equal_brute_force_over_partitions(spark):
    given = texts(25)
    rows = list(zip(range(0, 3 * len(given), 3), given, strict=True))
    want = sorted(brute(rows))
    shuffled = random.Random(1).sample(rows, len(rows))
    table = documents(spark, [t for _, t in shuffled], [i for i, _ in shuffled])
    for parts in (1, 7, 60):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert sorted(map(tuple, fp.fingerprint_digests(table.repartition(5)).collect())) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 2)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_equal_texts_and_estimates():
    rng = random.Random(2)
    for n in (20, 200, 20_000):
        a, b = prose(rng, n), prose(rng, n)
        mixed = a[: len(a) // 2] + b[: len(a) // 2]
        x, y, short = fp.sketch(a), fp.sketch(mixed), fp.sketch(a[: len(a) // 4])
        assert fp.likeness(x, fp.sketch(a)) == 1.0
        true = len(shingles(a) & shingles(mixed)) / len(shingles(a) | shingles(mixed))
        assert abs(fp.likeness(x, y) - true) < 0.12
        assert fp.containment(short, x) > 0.99 and abs(fp.containment(x, short) - 0.25) < 0.12
    assert fp.likeness(fp.sketch(""), fp.sketch("")) == 1.0 and fp.likeness(fp.sketch(""), fp.sketch("a")) == 0.0


def test_long_texts_are_worked_off_in_pieces(monkeypatch):
    text = prose(random.Random(3), 3000)
    whole = fp.sketch(text)
    monkeypatch.setattr(fp, "_PIECE", 500)
    assert (fp.sketch(text) == whole).all() and (fp.sketch("ab" * 3000) == fp.sketch("ab" * 4000)).all()


def test_merged_groups_equal_the_sketch_of_all_shingles(spark):
    given = texts(40)
    keys = [None if k % 7 == 0 else f"g{k % 3}" for k in range(len(given))]
    table = fp.fingerprint_documents(documents(spark, given)).join(spark.createDataFrame(list(enumerate(keys)), "doc_id long, key string"), "doc_id")
    want = defaultdict(set)
    for key, text in zip(keys, given, strict=True):
        want[key] |= hashes(text or "")
    got = defaultdict(list)
    for r in fp.merge_fingerprints(table, ["key"]).collect():
        got[r.key].append(r.hash)
    few = fp.merge_fingerprints(table.filter("doc_id in (2, 3)"), ["key"]).collect()
    for key, known in want.items():
        low = [h for h in sorted(known) if h < fp._THRESHOLD]
        assert sorted(got[key]) == (low if len(low) >= fp.FLOOR else sorted(known)[: fp.FLOOR])
    assert {r.hash for r in few} == hashes(given[2]) | hashes(given[3])


def test_compare(spark):
    made = fp.fingerprint_documents(documents(spark, ["some words here", "some words here", "", None]))
    pairs = made.select("doc_id", "sketch").crossJoin(made.select(F.col("doc_id").alias("other"), F.col("sketch").alias("theirs")))
    found = {(r.doc_id, r.other): (r.likeness, r.containment) for r in fp.compare_fingerprints(pairs, "sketch", "theirs").collect()}
    assert found[0, 1] == found[2, 3] == (1.0, 1.0) and found[0, 2] == (0.0, 0.0) and found[2, 0] == (0.0, 1.0)


def test_repeated_missing_and_no_rows(spark):
    rows = [(None, "first"), (4, "b second"), (4, "a third"), (4, "a third"), (9, None)]
    table = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    ties = {r.text: r.tie for r in table.select("text", F.xxhash64("text").alias("tie")).collect()}
    assert sorted(map(str, map(tuple, fp.fingerprint_digests(table).collect()))) == sorted(map(str, brute(rows, ties.get)))
    assert fp.fingerprint_digests(table.limit(0)).collect() == [] == fp.merge_fingerprints(fp.fingerprint_documents(table.limit(0)), ["doc_id"]).collect()
    alone = fp.fingerprint_digests(documents(spark, ["abcdef"])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and alone.near_next == 1.0
    odd = spark.sql("SELECT 1L AS doc_id, 'x' AS part, 'y' AS role, cast(unhex('61ff62') AS string) AS text")
    assert fp.fingerprint_digests(odd).first().n_chars == 3
