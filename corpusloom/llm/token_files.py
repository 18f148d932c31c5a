"""Token ids as Parquet files: one row per document, ids as a list column, made for selective reads.

Rows are range-partitioned and sorted by document id, so files follow each other in id order. Token lists are dictionary
encoded (a vocabulary of 50,000 ids takes two bytes an id); document ids and lengths, which only grow or vary little, are
delta encoded. Row groups and pages are kept short, and the page index that Parquet writes lets a reader that asks for a
range of ids skip the pages of all other columns. Lengths and positions are read without touching the lists.

Defined cases: a null text counts as empty; an empty text has the end id only; a row without an id comes first; rows
under one id follow in order of their texts; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from corpusloom.llm.words import NumberTable, mixed, signed, space_words
from corpusloom.session import broadcast_if_small, materialize

END_ID = 2
CHUNK_ROWS = 256
UNITS_KEPT = 500_000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


_STOPS = b".,"
# White space beyond ASCII, in UTF-8; the pattern of the vocabulary takes it and blanks beside it as one run.
_WIDE_BLANKS = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x202F, 0x205F, 0x3000))
_WIDE_BLANK_BLOCK = b"\xe2\x80"
_IN_BLOCK = frozenset([*range(0x80, 0x8B), 0xA8, 0xA9])
JOINED = 128
GROUP_BYTES = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _has_wide_blank(text: bytes) -> bool:
    if any(blank in text for blank in _WIDE_BLANKS):
        return True
    at = text.find(_WIDE_BLANK_BLOCK)
    while at >= 0:
        if text[at + 2] in _IN_BLOCK:
            return True
        at = text.find(_WIDE_BLANK_BLOCK, at + 3)
    return False


def _lone_stops(buffer: np.ndarray) -> np.ndarray:
    """Places of full stops and commas that have an ASCII letter before them and a blank, or nothing, behind."""
    at = np.flatnonzero((buffer == _STOPS[0]) | (buffer == _STOPS[1]))
    behind = np.append(buffer, 0x20)[at + 1]
    return at[(at > 0) & _LETTER[buffer[at - 1]] & _BLANK[behind]]


class UnitEncoder:
    """Byte-level BPE by units that the pattern of the vocabulary never crosses.

    A unit is a word with the one blank before it; a full stop or comma between an ASCII letter and a blank is a unit of
    its own. The library encodes each unit once, many in one text, with line feeds between them; a worker remembers units
    by a 64-bit hash, up to a bound. Texts with runs of blanks, blanks at an end, or others than space and line feed,
    also such beyond ASCII, are given to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self._feed = self._library(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        self._units, self._ids = NumberTable(), np.empty(0, np.int32)
        self._begins = self._ends = np.empty(0, np.int64)
        self._add(np.arange(len(_STOPS)), *self._units_ids([chr(c) for c in _STOPS]))

    def _library(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]  # without places in the text

    def encode_batch(self, texts: Sequence[bytes | None]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = [np.empty(0, np.int32)] * len(texts)
        whole: list[int] = []
        group: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if text:
                group.append(k)
                size += len(text)
            if group and (size > GROUP_BYTES or k == len(texts) - 1):
                plain = self._plain(group, texts)
                whole += sorted(set(group) - set(plain))
                for at, ids in zip(plain, self._by_units([texts[j] for j in plain]), strict=True):
                    out[at] = ids
                group, size = [], 0
        for k, ids in zip(whole, self._library([texts[k].decode() for k in whole]), strict=True):
            out[k] = np.array(ids, np.int32)
        return out

    @staticmethod
    def _plain(group: list[int], texts: Sequence[bytes | None]) -> list[int]:
        """Those texts of a group whose units the pattern never crosses."""
        lengths = np.array([len(texts[k]) for k in group])
        buffer = np.frombuffer(b"\n" + b"\n".join([texts[k] for k in group]) + b"\n", np.uint8)
        starts = np.cumsum(lengths + 1) - lengths
        between = np.zeros(len(buffer), bool)
        between[[0, *(starts + lengths).tolist()]] = True
        blank = _BLANK[buffer]
        runs = np.flatnonzero(blank[1:] & blank[:-1])
        odd = np.concatenate([np.flatnonzero(blank & (buffer != 0x20) & (buffer != 0x0A)), runs, runs + 1])
        bad = np.zeros(len(group), bool)
        bad[np.searchsorted(starts, odd[~between[odd]], "right") - 1] = True
        if _has_wide_blank(buffer.tobytes()):
            bad |= [_has_wide_blank(texts[k]) for k in group]
        return [k for k, no in zip(group, bad.tolist(), strict=True) if not no]

    def _by_units(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of plain texts, worked off together as one text with line feeds between and around them."""
        if not texts:
            return []
        if self._units.used > UNITS_KEPT:
            self._forget()
        lengths = np.array([len(text) for text in texts])
        joined = b"\n" + b"\n".join(texts) + b"\n"
        buffer = np.frombuffer(joined, np.uint8)
        text_starts = np.cumsum(lengths + 1) - lengths
        alone = _lone_stops(buffer)
        bare = buffer.copy()
        bare[alone] = 0x20
        stops = np.zeros(len(buffer) + 1, np.uint8)
        stops[alone] = buffer[alone]
        words = space_words(bare.tobytes())
        begins_text = np.zeros(len(buffer), bool)
        begins_text[text_starts] = True
        first = begins_text[words.starts]
        before = np.where(first, 0, buffer[words.starts - 1]).astype(np.uint64)
        # All bits but the sign: the table marks free slots with -1.
        keys = signed(mixed(words.hashes + before * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1))
        known = self._units.get(keys)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            new, at = np.unique(keys[missing], return_index=True)
            begins, ends = (words.starts - ~first)[missing[at]].tolist(), words.ends[missing[at]].tolist()
            self._add(new, *self._units_ids([joined[a:b].decode() for a, b in zip(begins, ends, strict=True)]))
            known[missing] = self._units.get(keys[missing])
        ends_in_stop = stops[words.ends]
        stopped = ends_in_stop > 0
        units = np.repeat(known, 1 + stopped)
        last = np.cumsum(1 + stopped) - 1
        units[last[stopped]] = np.where(ends_in_stop[stopped] == _STOPS[0], 0, 1)
        begins = self._begins[units]
        counts = self._ends[units] - begins
        total = np.cumsum(counts)
        ids = self._ids[np.arange(total[-1]) + np.repeat(begins - total + counts, counts)]
        # The last unit of each text is that of the word before the next text's first.
        until = total[last[np.append(np.flatnonzero(first)[1:], len(first)) - 1]]
        return np.split(ids, until[:-1])

    def _units_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each unit's begin and end among them.

        A line feed is a piece of its own before any unit, so units are told apart in joined texts by its id. A unit that
        begins with a line feed takes the one before it.
        """
        ids, begins, ends, total = [], [], [], 0
        groups = [units[k : k + JOINED] for k in range(0, len(units), JOINED)]
        joined = ["".join(unit if unit[0] == "\n" else f"\n{unit}" for unit in group) for group in groups]
        for group, found in zip(groups, self._library(joined), strict=True):
            values = np.array(found, np.int32)
            feeds = np.flatnonzero(values == self._feed[0]) if len(self._feed) == 1 else values
            if len(feeds) == len(group):
                first, last = feeds + 1 - np.fromiter((unit[0] == "\n" for unit in group), bool, len(group)), np.append(feeds[1:], len(values))
            else:  # another vocabulary may hold pieces across line feeds
                alone = self._library(group)
                values, last = np.array([i for unit in alone for i in unit], np.int32), np.cumsum([len(unit) for unit in alone])
                first = last - [len(unit) for unit in alone]
            ids.append(values)
            begins.append(first + total)
            ends.append(last + total)
            total += len(values)
        return np.concatenate(ids), np.concatenate(begins), np.concatenate(ends)

    def _add(self, keys: np.ndarray, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        self._units.add(keys, np.arange(len(keys), dtype=np.int32) + self._units.used)
        self._begins = np.concatenate([self._begins, begins + len(self._ids)])
        self._ends = np.concatenate([self._ends, ends + len(self._ids)])
        self._ids = np.concatenate([self._ids, ids])


@lru_cache(maxsize=2)
def unit_encoder(path: str) -> UnitEncoder:
    """The encoder of a vocabulary file, made once per worker."""
    return UnitEncoder(path)


def write_token_files(
    documents: DataFrame, vocabulary: str, target: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> None:
    """Writes ``id_col``, ``tokens`` and ``n_tokens`` of each row to ``target``, in ascending order of ids."""
    kind = T._parse_datatype_string(f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, tokens array<int>, n_tokens bigint")
    arrow = to_arrow_schema(kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                keys, texts = batch.slice(start, CHUNK_ROWS).columns
                found = encoder.encode_batch(texts.to_pylist())
                counts = np.fromiter((len(ids) + 1 for ids in found), np.int64, len(found))
                end = np.array([end_id], np.int32)
                values = np.concatenate([part for ids in found for part in (ids, end)]).astype(np.int32)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(values)).cast(arrow.field("tokens").type)
                yield pa.RecordBatch.from_arrays([keys, lists, pa.array(counts)], schema=arrow)

    # Texts are dealt out before they are encoded: they are the smaller of the two.
    placed = documents.select(id_col, F.col(text_col).cast("binary")).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    writer = placed.mapInArrow(encode, kind).write.option("compression", "zstd")
    layout = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.enable.dictionary": "true",
        f"parquet.enable.dictionary#{id_col}": "false",
        "parquet.enable.dictionary#n_tokens": "false",
        "parquet.page.write-checksum.enabled": "true",
    }
    for name, value in layout.items():
        writer = writer.option(name, value)
    writer.parquet(target)


def read_token_files(spark: SparkSession, target: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of :func:`write_token_files`; filters on ids and choices of columns reach the page index and the reader."""
    return spark.read.parquet(target).select(id_col, "tokens", "n_tokens")


def token_positions(spark: SparkSession, target: str, id_col: str = "doc_id") -> DataFrame:
    """Where each stored row's ids start among all ids: ``id_col``, ``start``, ``n_tokens``, ``ids_crc32``.

    Files are numbered by running sums over their totals, one row per file; rows within their file.
    """
    stored = spark.read.parquet(target).select(id_col, "tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    kind = stored.schema[id_col].dataType.simpleString()

    schema = T._parse_datatype_string(f"`{id_col}` {kind}, file string, row bigint, n_tokens bigint, ids_crc32 bigint")
    arrow = to_arrow_schema(schema)

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists, file, row = batch.columns
            values, bounds = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([keys, file, row, pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())], schema=arrow)

    rows = materialize(stored.mapInArrow(checksum, schema), "checksums")
    files = rows.groupBy("file").agg(F.min(id_col).alias("first"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset")), "offsets")
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(broadcast_if_small(offsets), "file")
    return placed.select(id_col, (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
