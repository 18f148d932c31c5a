"""Fill-in-middle transformation by rotating blocks of a bytearray in place.

A text is cut into prefix, middle and suffix between tokens (runs of ASCII letters, and every other code point). The
scan runs over UTF-8 bytes and finds where tokens begin; sentinels are inserted at the cuts; neighbouring blocks change
places by three reversals. Restoring runs the same rotations backwards and takes the sentinels out.

Cuts and forms follow from a hash of the seed and the id alone, so they do not depend on partitions or retries. Rows are
transformed where they are read, without a shuffle.

Defined cases: a null text counts as empty; an empty text, and one that holds a sentinel, stays plain; a missing id
hashes as an empty one; rows under one id have the same draws, each for its own length; an empty table gives no rows;
bytes that are not UTF-8 are kept as they are, each byte that cannot continue a code point counting as one; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import map_partitions

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 1
FIM_PERCENT = 90
SPM_PERCENT = 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


class Draws(NamedTuple):
    """Four numbers of 32 bits."""

    first_cut: int
    second_cut: int
    form: int
    order: int


class Cut(NamedTuple):
    """A transformed text; sizes are in code points, and None where the text stayed plain."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def draws(seed: int, doc_id: object) -> Draws:
    """The numbers drawn for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return Draws(*[int(digest[k : k + 8], 16) for k in range(0, 32, 8)])


def token_starts(text: bytes) -> np.ndarray:
    """Where tokens begin, in bytes."""
    buffer = np.frombuffer(text, np.uint8)
    letter = _LETTER[buffer]
    inside = np.concatenate([[False], letter[1:] & letter[:-1]]) if len(buffer) else letter
    return np.flatnonzero(~(inside | _CONTINUES[buffer]))


def _n_points(view: np.ndarray) -> int:
    return len(view) - int(np.count_nonzero(_CONTINUES[view]))


def _reverse(view: np.ndarray, start: int, stop: int) -> None:
    half = (stop - start) // 2
    front, back = view[start : start + half], view[stop - half : stop][::-1]
    kept = front.copy()
    front[:] = back
    back[:] = kept


def rotate(buffer: bytearray, start: int, middle: int, stop: int) -> int:
    """Exchanges the blocks ``[start, middle)`` and ``[middle, stop)``; returns where they meet then."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, start, middle)
    _reverse(view, middle, stop)
    _reverse(view, start, stop)
    return start + stop - middle


def transform(text: bytes, drawn: Draws, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> Cut:
    """A text cut and put in the form that its draws say."""
    starts = token_starts(text)
    n = len(starts)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or drawn.form % 100 >= fim_percent:
        return Cut(n, PLAIN, None, None, text)
    low, high = sorted((drawn.first_cut % (n + 1), drawn.second_cut % (n + 1)))
    bounds = np.append(starts, len(text))
    # A text may begin with bytes that continue nothing; a cut before the first token lies before them too.
    first, second = (int(bounds[k]) if k else 0 for k in (low, high))
    view = np.frombuffer(text, np.uint8)
    sizes = _n_points(view[:first]), _n_points(view[first:second])
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    first, second = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    # prefix, middle, suffix -> prefix, suffix, middle
    meet = rotate(buffer, first, second, len(buffer))
    form = SPM if drawn.order % 100 < spm_percent else PSM
    if form == SPM:  # -> suffix, prefix, middle
        rotate(buffer, 0, first, meet)
    return Cut(n, form, *sizes, bytes(buffer))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made from."""
    if form == PLAIN:
        return output
    buffer = bytearray(output)
    if form == SPM:
        prefix = output.index(PREFIX)
        middle = output.index(MIDDLE, prefix)
        suffix = rotate(buffer, 0, prefix, middle)
    else:
        suffix = output.index(SUFFIX)
        middle = output.index(MIDDLE, suffix)
    second = rotate(buffer, suffix, middle, len(buffer))
    del buffer[second : second + len(SUFFIX)]
    del buffer[suffix : suffix + len(MIDDLE)]
    del buffer[: len(PREFIX)]
    return bytes(buffer)


def fill_in_middle(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """Per row its id, number of tokens ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` as bytes."""
    kind = documents.schema[id_col].dataType.simpleString()

    def of_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, name, text in rows:
            yield doc_id, *transform(text or b"", draws(seed, name), fim_percent, spm_percent)

    schema = f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"
    rows = documents.select(id_col, F.col(id_col).cast("string").alias("_name"), F.col(text_col).cast("binary"))
    return map_partitions(rows, schema, of_rows)


def restore_texts(transformed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Id and ``text``, as bytes, of rows of :func:`fill_in_middle`."""
    kind = transformed.schema[id_col].dataType.simpleString()

    def of_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, output, form in rows:
            yield doc_id, restore(output, form)

    return map_partitions(transformed.select(id_col, "output", "form"), f"`{id_col}` {kind}, text binary", of_rows)


def middle_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """:func:`fill_in_middle` with hashes of the output and of the text restored from it."""
    made = fill_in_middle(documents, id_col, text_col, **options)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema if f.name != "output")

    def of_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, n, form, prefix_chars, middle_chars, output in rows:
            restored = hashlib.sha256(restore(output, form)).hexdigest()
            yield doc_id, n, form, prefix_chars, middle_chars, hashlib.sha256(output).hexdigest(), restored

    return map_partitions(made, f"{kind}, output_sha256 string, restored_sha256 string", of_rows)
