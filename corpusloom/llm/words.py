"""Words, word hashes and windows shared by the operators that work on text inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xD6E8FEB86659FD93)
_STEP = 0xC2B2AE3D27D4EB4F
_BACK = pow(_STEP, -1, 1 << 64)
_PIECE = 1 << 21
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
# A random number for each byte value, fixed by the seed, so that hashes agree between tasks.
_OF_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of an odd step and of its inverse, modulo 2**64; grown to the longest piece seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._powers(x, n) for x in (_STEP, _BACK))
        return self.up, self.down


    @staticmethod
    def _powers(step: int, n: int) -> np.ndarray:
        steps = np.full(n, step, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)


_POWERS = _Powers()


class Words(NamedTuple):
    """Where the words of a text begin and end, in bytes, and a 64-bit hash of each."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def space_words(text: bytes | None) -> Words:
    """Maximal runs of bytes outside space and 0x09-0x0D; null and empty texts have none.

    Texts of many megabytes are worked off in pieces that end between two words.
    """
    text = text or b""
    parts, start = [], 0
    while start < len(text):
        stop = min(len(text), start + _PIECE)
        while stop < len(text) and _IS_WORD[text[stop]]:
            stop += 1
        parts.append(_piece_words(text[start:stop], start))
        start = stop
    if len(parts) == 1:
        return parts[0]
    none = np.empty(0, np.int64)
    return Words(*map(np.concatenate, zip(*parts, strict=True))) if parts else Words(none, none, none.astype(np.uint64))


def _piece_words(text: bytes, offset: int) -> Words:
    """Words of a piece, all at once: sums of byte numbers times powers of their places, shifted to the word's start."""
    buffer = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _IS_WORD[buffer], [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS.of(len(buffer) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[buffer] * up[: len(buffer)])])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(starts + offset, ends + offset, hashes)


def mixed(values: np.ndarray) -> np.ndarray:
    """Values with their bits spread, for use as a random order or as a bucket number."""
    spread = (values ^ (values >> np.uint64(32))) * _FINAL
    return spread ^ (spread >> np.uint64(29))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per run of ``width`` consecutive words, in order of their starts."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    rolled = np.zeros(count, np.uint64)
    for k in range(width):
        rolled = rolled * _MULTIPLIER + hashes[k : k + count]
    return mixed(rolled)


def covered(starts: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Which of ``n_words`` words lie in a window of ``width`` words that begins at one of ``starts`` (a mask)."""
    mask = np.zeros(n_words, bool)
    for k in range(width):
        mask[k : k + len(starts)] |= starts
    return mask


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


class NumberTable:
    """Whole numbers by 64-bit key, looked up and added many at a time; linear probing at a low load."""

    def __init__(self) -> None:
        self._reset(1 << 16)

    def _reset(self, slots: int) -> None:
        self.keys = np.full(slots, -1, np.int64)
        self.values = np.zeros(slots, np.int32)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -1 where a key is absent."""
        found = np.full(len(keys), -1, np.int32)
        rest, slots = np.arange(len(keys)), self._slots(keys)
        while len(rest):
            there = self.keys[slots]
            hit = there == keys[rest]
            found[rest[hit]] = self.values[slots[hit]]
            on = ~hit & (there != -1)
            rest, slots = rest[on], (slots[on] + 1) & (len(self.keys) - 1)
        return found

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are absent."""
        if 4 * (self.used + len(keys)) > len(self.keys):
            old = self.keys != -1
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self._reset(1 << (8 * len(keys)).bit_length())
        self.used += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            won = self.keys[slots] == keys
            self.values[slots[won]] = values[won]
            keys, values, slots = keys[~won], values[~won], (slots[~won] + 1) & (len(self.keys) - 1)


def map_rows(df: DataFrame, schema: T.StructType | str, of_row: Callable[..., Iterator[tuple]], chunk: int = 256) -> DataFrame:
    """Rows that ``of_row(*values)`` yields for each row of ``df``, in Arrow batches of at most ``chunk`` input rows.

    Results are sent on in short batches, so a task holds few of them at any time.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                columns = [c.to_pylist() for c in batch.slice(start, chunk).columns]
                rows = [out for values in zip(*columns, strict=True) for out in of_row(*values)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow
                    )

    return df.mapInArrow(run, kind)


_FLUSH_BYTES = 4 << 20


def map_partitions(df: DataFrame, schema: T.StructType | str, of_rows: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Rows that ``of_rows`` makes of the rows of each partition, taken one by one and sent on by the megabyte."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def flushed(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(columns, arrow, strict=True)], schema=arrow)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield tuple(c[k].as_py() for c in batch.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in of_rows(given(batches)):
            held.append(row)
            size += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
            if size > _FLUSH_BYTES:
                yield flushed(held)
                held, size = [], 0
        if held:
            yield flushed(held)

    return df.mapInArrow(run, kind)
