"""Substring deduplication: passages that an earlier document holds are found with suffix automata and removed.

A passage counts from ``width`` consecutive words on. Sending the automata of all reference shards to all
documents would grow with the square of the corpus, so each automaton is sent where it can match: every window of
``width`` words has an anchor, its run of ``ANCHOR`` words with the least hash, and equal windows have equal
anchors. The first document with an anchor owns it; its passages around the anchors it owns are a reference shard, and
later documents stream their passages around the same anchors through that shard's automaton. Where the matching
statistics reach ``width``, the window is found. A window that the owner lacks can still be in another earlier
document; the windows that are left over are compared with each other by hash, all of them.

Defined cases: null and empty texts have no words and lose none; a row without an id, being in no order, neither loses
words nor serves as a reference; rows that repeat under one id are not earlier than each other, so both keep their
words; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.words import Words, covered, map_rows, signed, space_words, window_hashes
from corpusloom.session import broadcast_if_small, materialize

WIDTH = 13
ANCHOR = 5
PART_ROWS = 256
SPANS = "array<struct<start: int, stop: int>>"


class SuffixAutomaton:
    """Automaton of all runs of symbols of some sequences, which stay apart."""

    def __init__(self, sequences: Sequence[Sequence]) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        last = 0
        for k, sequence in enumerate(sequences):
            last = self._add(last, -k - 1)  # a symbol of its own, which no stream holds
            for symbol in sequence:
                last = self._add(last, symbol)

    def _add(self, last: int, symbol) -> int:
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][symbol]
            if self.length[target] == self.length[at] + 1:
                self.link[state] = target
            else:
                clone = len(self.next)
                self.next.append(dict(self.next[target]))
                self.length.append(self.length[at] + 1)
                self.link.append(self.link[target])
                self.link[target] = self.link[state] = clone
                while at >= 0 and self.next[at].get(symbol) == target:
                    self.next[at][symbol] = clone
                    at = self.link[at]
        return state

    def matching_statistics(self, symbols: Sequence) -> list[int]:
        """For each place the length of the longest run that ends there and occurs in the sequences."""
        follow, link, length = self.next, self.link, self.length
        state = run = 0
        found = []
        for symbol in symbols:
            while state and symbol not in follow[state]:
                state = link[state]
                run = length[state]
            if symbol in follow[state]:
                state = follow[state][symbol]
                run += 1
            found.append(run)
        return found


def window_anchors(words: Words, width: int) -> np.ndarray:
    """The anchor of each window of ``width`` words: the least hash of its runs of ``ANCHOR`` words."""
    runs = window_hashes(words.hashes, ANCHOR)
    inside = width - ANCHOR + 1
    if len(runs) < inside:
        return np.empty(0, np.uint64)
    least = runs[: len(runs) - inside + 1].copy()
    for k in range(1, inside):
        np.minimum(least, runs[k : len(runs) - inside + 1 + k], out=least)
    return least


def _segments(chosen: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Word ranges that the chosen windows cover, one for each stretch of neighbouring windows."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], chosen, [False]]).view(np.int8)))
    return [(int(a), int(b) + width - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _ranges(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def find_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Word ranges to remove: ``id``, ``text_key`` and ``spans``, one row per text that loses words.

    ``text_key`` tells apart texts that share an id.
    """
    spark = documents.sparkSession
    texts = documents.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("binary").alias("body")
    ).filter("id IS NOT NULL")
    kind = texts.schema["id"].dataType.simpleString()

    def keys(doc_id, body) -> Iterator[tuple]:
        for key in np.unique(signed(window_anchors(space_words(body), width))).tolist():
            yield doc_id, key

    anchors = materialize(map_rows(texts.select("id", "body"), f"id {kind}, key bigint", keys), "anchors")
    shared = materialize(
        anchors.groupBy("key").agg(F.min("id").alias("owner"), F.count("*").alias("n")).filter("n > 1").select("key", "owner"), "shared"
    )
    owned = anchors.join(shared, "key").groupBy("id").agg(F.collect_set(F.struct("key", "owner")).alias("owned"))
    owned = materialize(owned, "owned")

    def passages(doc_id, text_key, body, owned) -> Iterator[tuple]:
        words = space_words(body)
        least = signed(window_anchors(words, width))
        known = np.array([o["key"] for o in owned], np.int64)
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], least), len(known) - 1)
        found = known[order][at] == least
        numbers: dict = {}
        number = np.array([numbers.setdefault(owned[i]["owner"], len(numbers)) for i in order])
        of_window = np.where(found, number[at], -1)
        for owner, k in numbers.items():
            segments = [
                {"start": a, "words": body[words.starts[a] : words.ends[b - 1]]} for a, b in _segments(of_window == k, width)
            ]
            if segments:
                yield owner, doc_id, text_key, segments

    piece = "array<struct<start: int, words: binary>>"
    holders = texts.join(broadcast_if_small(owned.select("id")), "id", "left_semi").join(owned, "id")
    routed = materialize(
        map_rows(holders.select("id", "text_key", "body", "owned"), f"owner {kind}, id {kind}, text_key bigint, segments {piece}", passages, 32),
        "passages",
    )
    def stream(owner, doc_id, text_key, is_stream, segments) -> Iterator[tuple]:
        if held["owner"] != owner:
            held.update(owner=owner, reference=[], automaton=None)
        if not is_stream:
            if held["automaton"]:
                held.update(reference=[], automaton=None)
            held["reference"] += [bytes(s["words"]).split() for s in segments]
            return
        if held["automaton"] is None:
            held.update(automaton=SuffixAutomaton(held["reference"]), reference=[])
        spans, left_at, left_key = [], [], []
        for segment in segments:
            text = bytes(segment["words"])
            words = text.split()
            statistics = np.array(held["automaton"].matching_statistics(words))
            matched = statistics[width - 1 :] >= width
            for r in _ranges(covered(matched, width, len(words))):
                spans.append({"start": r["start"] + segment["start"], "stop": r["stop"] + segment["start"]})
            rest = np.flatnonzero(~matched)
            if len(rest):
                left_at += (rest + segment["start"]).tolist()
                left_key += signed(window_hashes(space_words(text).hashes, width))[rest].tolist()
        yield doc_id, text_key, spans, left_at, left_key

    held: dict = {"owner": None, "reference": [], "automaton": None}
    schema = f"id {kind}, text_key bigint, spans {SPANS}, left_at array<int>, left_key array<bigint>"
    matched = materialize(map_rows(_beside_reference(routed), schema, stream, 32), "matched")
    left = matched.select("id", "text_key", F.explode(F.arrays_zip(F.col("left_at").alias("at"), F.col("left_key").alias("key"))).alias("w"))
    left = left.select("id", "text_key", F.col("w.at").alias("at"), F.col("w.key").alias("key"))
    again = materialize(
        left.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first"), "left"
    )
    later = left.join(again, "key").filter("first < id").select("id", "text_key", F.col("at").alias("start"), (F.col("at") + width).cast("int").alias("stop"))
    direct = matched.select("id", "text_key", F.explode("spans").alias("s")).select("id", "text_key", "s.*")
    return materialize(
        direct.unionByName(later).groupBy("id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans"
    )


def _beside_reference(routed: DataFrame) -> DataFrame:
    """Each owner's own passages followed by those of later documents, in one partition and in this order.

    An owner with many later documents is dealt out: its passages go to each of its parts, which have about
    ``PART_ROWS`` streams.
    """
    heavy = routed.groupBy("owner").agg(F.count("*").alias("n")).filter(F.col("n") > PART_ROWS)
    heavy = materialize(heavy.select("owner", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")), "heavy")
    rows = routed.filter("id >= owner").join(broadcast_if_small(heavy), "owner", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    is_stream = F.col("id") > F.col("owner")
    own_part = F.pmod(F.xxhash64("id", "text_key"), F.col("parts")).cast("int")
    parts = F.when(is_stream, F.array(own_part)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.select("owner", "id", "text_key", is_stream.alias("is_stream"), "segments", F.explode(parts).alias("part"))
    placed = dealt.repartition("owner", "part").sortWithinPartitions("owner", "part", "is_stream")
    return placed.select("owner", "id", "text_key", "is_stream", "segments")


def _kept_words(n_words: int, spans: Sequence | None) -> np.ndarray:
    kept = np.ones(n_words, bool)
    for span in spans or ():
        kept[span["start"] : span["stop"]] = False
    return kept


def cut_text(text: bytes, spans: Sequence | None) -> bytes:
    """The text without the words of ``spans`` and the white space behind each; the rest as it was."""
    if not spans:
        return text
    words = space_words(text)
    kept = _kept_words(len(words), spans)
    until = np.append(words.starts[1:], len(text))
    head = text[: words.starts[0]]
    return head + b"".join(text[words.starts[r["start"]] : until[r["stop"] - 1]] for r in _ranges(kept))


def _with_spans(documents: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows that lose nothing, left where they are, and rows that lose words, with their spans as the last column."""
    given = documents.alias("given")
    ids = broadcast_if_small(spans.select("id", "text_key")).alias("lost")
    lost = spans.alias("lost")
    same = (F.col(f"given.`{id_col}`") == F.col("lost.id")) & (F.xxhash64(F.col(f"given.`{text_col}`")) == F.col("lost.text_key"))
    name = "_spans"
    while name in documents.columns:
        name += "_"
    untouched = given.join(ids, same, "left_anti")
    touched = given.join(ids, same, "left_semi").join(lost, same)
    return untouched, touched.select(*[F.col(f"given.`{c}`") for c in documents.columns], F.col("lost.spans").alias(name))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``documents`` with the same columns and without the passages that :func:`find_repeats` finds in ``text_col``."""
    untouched, touched = _with_spans(documents, find_repeats(documents, id_col, text_col, width), id_col, text_col)
    at = documents.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(at).to_pylist()
            new = [cut_text(t.encode(), s).decode() for t, s in zip(texts, spans, strict=True)]
            columns = [pa.array(new, c.type) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return untouched.unionByName(touched.mapInArrow(cut, T.StructType(documents.schema.fields)))


def repeat_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document its words, how many of them :func:`find_repeats` removes, and a hash of the others."""
    untouched, touched = _with_spans(documents.select(id_col, text_col), find_repeats(documents, id_col, text_col, width), id_col, text_col)
    kind = documents.schema[id_col].dataType.simpleString()

    def digest(doc_id, body, spans=None) -> Iterator[tuple]:
        words = (body or b"").split()
        kept = _kept_words(len(words), spans)
        left = [w for w, k in zip(words, kept.tolist(), strict=True) if k] if spans else words
        yield doc_id, len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()

    schema = f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string"
    body = F.col(text_col).cast("binary")
    return map_rows(untouched.select(id_col, body), schema, digest).unionByName(map_rows(touched.select(id_col, body, touched.columns[-1]), schema, digest))
