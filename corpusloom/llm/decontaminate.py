"""Benchmark decontamination: test passages of ``width`` normalised words are looked up in every window of every text.

The windows of the test items form a hash set that is broadcast. Its size is checked: a slice holds at most
``SLICE_WINDOWS`` windows, and a larger set is worked off slice by slice, each with a scan of its own, with the same
result. A text's windows are hashed where the text is read; hits are verified word by word.

Defined cases: null and empty texts have no words and are clean; an item without words has no windows, an item of
fewer than ``width`` words is one window; items that repeat count once by id; rows whose item_id is null
are items like others, counted as one and left out of the hash of the items; an empty table of items finds nothing; rows that repeat are judged one by one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import map_rows, space_words, window_hashes

WIDTH = 13
SLICE_WINDOWS = 1 << 20
MIN_SHARE = 20
"""A document is contaminated if at least one word in so many is hit."""

_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_BREAKS = {*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_NORMAL = bytes(0x20 if c in _BREAKS else _LOWER.get(c, c) for c in range(256))


def normalised(text: bytes | None) -> bytes:
    """The text with A-Z lower-cased and all ASCII but letters and digits as spaces; lengths stay."""
    return (text or b"").translate(_NORMAL)


def item_windows(item_id, text: bytes | None, width: int = WIDTH) -> Iterator[tuple]:
    """The windows of a test item, each as its words joined by a space."""
    words = normalised(text).split()
    for start in range(max(1, len(words) - width + 1) if words else 0):
        yield item_id, b" ".join(words[start : start + width])


class WindowSet:
    """Windows of test items by number of words and hash."""

    def __init__(self, rows: list[tuple]) -> None:
        self.items: dict[bytes, set[str | None]] = defaultdict(set)
        for item_id, window in rows:
            self.items[bytes(window)].add(None if item_id is None else str(item_id))
        by_width: dict[int, list] = defaultdict(list)
        for window in self.items:
            hashes = space_words(window).hashes
            by_width[len(hashes)].append(window_hashes(hashes, len(hashes))[0])
        self.hashes = {width: np.sort(np.array(hashes, np.uint64)) for width, hashes in by_width.items()}

    def hits(self, text: bytes | None) -> tuple[int, np.ndarray, set[str | None]]:
        """The text's number of words, which of them are hit, and the items hit."""
        plain = normalised(text)
        words = space_words(plain)
        mask = np.zeros(len(words), bool)
        items: set[str | None] = set()
        for width, known in self.hashes.items():
            found = window_hashes(words.hashes, width)
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            for start in np.flatnonzero(known[at] == found).tolist():
                window = b" ".join(plain[a:b] for a, b in zip(words.starts[start : start + width], words.ends[start : start + width], strict=True))
                if window in self.items:
                    mask[start : start + width] = True
                    items |= self.items[window]
        return len(words), mask, items


def _slices(items: DataFrame, id_col: str, text_col: str, width: int, slice_windows: int) -> Iterator:
    """Broadcast window sets of bounded size, one after another."""
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(id_col, F.col(text_col).cast("binary"))
    windows = map_rows(rows, f"item {kind}, window binary", lambda i, t: item_windows(i, t, width)).distinct()
    parts = -(-windows.count() // slice_windows)
    for part in range(parts):
        mine = windows.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part) if parts > 1 else windows
        yield items.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in mine.collect()]))


def _ranges(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def find_contamination(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    width: int = WIDTH,
    slice_windows: int = SLICE_WINDOWS,
) -> DataFrame:
    """Per row of ``documents``: its id, ``n_words``, ``spans`` of hit words, and ``items`` as sorted strings, a null id last."""
    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, text_key bigint, n_words bigint, spans array<struct<start: int, stop: int>>, items array<string>"
    rows = documents.select(id_col, F.xxhash64(text_col), F.col(text_col).cast("binary"))

    def scan(windows) -> DataFrame:
        def of_row(doc_id, text_key, text) -> Iterator[tuple]:
            n_words, mask, items = windows.value.hits(text)
            yield doc_id, text_key, n_words, _ranges(mask), sorted(items, key=lambda item: (item is None, item))

        return map_rows(rows, schema, of_row)

    found = [scan(windows) for windows in _slices(items, item_col, text_col, width, slice_windows)]
    if not found:
        found = [scan(documents.sparkSession.sparkContext.broadcast(WindowSet([])))]
    if len(found) == 1:
        return found[0].drop("text_key")
    whole = found[0]
    for other in found[1:]:
        whole = whole.unionByName(other)
    merged = whole.groupBy(id_col, "text_key", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("_rows")
    )
    copies = F.explode(F.sequence(F.lit(1), F.expr(f"cast(_rows div {len(found)} as int)")))
    return merged.withColumn("_copy", copies).select(id_col, "n_words", "spans", "items")


def _span_words(spans, n_words: int) -> int:
    mask = np.zeros(n_words, bool)
    for span in spans:
        mask[span["start"] : span["stop"]] = True
    return int(mask.sum())


def contamination_digests(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", min_share: int = MIN_SHARE, **options) -> DataFrame:
    """Per row the numbers of words, hit words and items hit, a hash of the items, and whether it is contaminated."""
    kind = documents.schema[id_col].dataType.simpleString()

    def digest(doc_id, n_words, spans, items) -> Iterator[tuple]:
        hit = _span_words(spans, n_words)
        names = hashlib.sha256(",".join(item for item in items if item is not None).encode()).hexdigest()
        yield doc_id, n_words, hit, len(items), names, hit > 0 and min_share * hit >= n_words

    schema = f"`{id_col}` {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return map_rows(find_contamination(documents, items, id_col, **options), schema, digest, 4096)


def drop_contaminated(
    documents: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    width: int = WIDTH,
    min_share: int = MIN_SHARE,
    slice_windows: int = SLICE_WINDOWS,
) -> DataFrame:
    """``documents`` without the contaminated ones, all columns as they were; decided where the rows are read."""
    at = documents.columns.index(text_col)
    masks = list(_slices(items, item_col, text_col, width, slice_windows))
    if len(masks) > 1:  # hits of one text add up over the slices: judge by text, then drop
        texts = documents.select(F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("text")).distinct()
        judged = contamination_digests(texts, items, "_key", min_share, item_col=item_col, width=width, slice_windows=slice_windows)
        bad = judged.filter("contaminated").select(F.col("_key").alias("_bad")).distinct()
        same = F.xxhash64(F.col(f"given.`{text_col}`")) == F.col("bad._bad")
        return documents.alias("given").join(bad.alias("bad"), same, "left_anti")
    if not masks:
        return documents
    windows = masks[0]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for text in batch.column(at).to_pylist():
                n_words, mask, _ = windows.value.hits((text or "").encode())
                hit = int(mask.sum())
                clean.append(not (hit > 0 and min_share * hit >= n_words))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)


def cut_spans(text: bytes, spans) -> bytes:
    """The text without the hit words and what stands between them, for use instead of dropping the document."""
    words = space_words(normalised(text))
    mask = np.ones(len(words), bool)
    for span in spans:
        mask[span["start"] : span["stop"]] = False
    if mask.all():
        return text
    until = np.append(words.starts[1:], len(text))
    return text[: words.starts[0]] + b"".join(text[words.starts[r["start"]] : until[r["stop"] - 1]] for r in _ranges(mask))
