"""Document fingerprints: threshold-scaled sketches of character shingles.

A shingle is a run of ``SHINGLE`` code points; a text is preceded by zeros, so each of its code points ends one. A sketch
keeps every shingle hash below a fixed fraction of the hash range, however long the text, and of short texts at least the
``FLOOR`` least hashes. Two sketches are compared below the lesser of their limits, where both are complete: so texts of
very unequal length can be held against each other, and the sketch of a union is made from sketches alone.

Rows are range-partitioned and sorted by id, so a document and the next one meet in the task that sketches both, and each
text moves once, compressed. Only the first and last document of a partition meet by a join.

Defined cases: a null text counts as empty, and an empty text has an empty sketch, like other empty ones only; bytes that
are not UTF-8 count as U+FFFD; a row without an id comes first; rows under one id follow each other in order of a hash
of their texts; a single row is followed by itself; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.words import map_partitions, mixed, window_hashes
from corpusloom.operators.ranking import first_n
from corpusloom.session import materialize

SHINGLE = 12
FRACTION = 32
"""One hash in so many is below the threshold."""
FLOOR = 64
_PIECE = 1 << 20
_ALL = 1 << 32
_THRESHOLD = _ALL // FRACTION


def _piece_hashes(points: np.ndarray) -> np.ndarray:
    """Upper halves of the shingle hashes of a run of code points."""
    return (window_hashes(mixed(points.astype(np.uint64) + np.uint64(1)), SHINGLE) >> np.uint64(32)).astype(np.uint32)


def sketch(text: str) -> np.ndarray:
    """Ascending distinct hashes that stand for a text. Long texts are worked off in overlapping pieces."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.empty(0, np.uint32)
    for start in range(0, len(points), _PIECE):
        before = points[max(0, start - SHINGLE + 1) : start]
        piece = np.concatenate([np.zeros(SHINGLE - 1 - len(before), np.uint32), before, points[start : start + _PIECE]])
        kept = merged(kept, _piece_hashes(piece))
    return kept


def merged(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The sketch of two sets together, from their hashes or their sketches."""
    together = np.concatenate([first, second])
    low = np.unique(together[together < _THRESHOLD])
    return low if len(low) >= FLOOR else np.unique(together)[:FLOOR]


def _limit(kept: np.ndarray) -> int:
    """All hashes of the text below this number are in its sketch."""
    if len(kept) < FLOOR:
        return _ALL
    return max(_THRESHOLD, int(kept[-1]) + 1)


def _shared(first: np.ndarray, second: np.ndarray) -> tuple[int, int, int]:
    """Numbers of shared hashes and of each side's, below both limits."""
    limit = min(_limit(first), _limit(second))
    first, second = (kept[: np.searchsorted(kept, limit)] if limit < _ALL else kept for kept in (first, second))
    return len(np.intersect1d(first, second, assume_unique=True)), len(first), len(second)


def likeness(first: np.ndarray, second: np.ndarray) -> float:
    """Estimated share of the shingles of both texts that both have; 1 for two empty sketches."""
    both, a, b = _shared(first, second)
    return both / (a + b - both) if a + b else 1.0


def containment(first: np.ndarray, second: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second has; 1 for an empty first sketch."""
    both, a, _ = _shared(first, second)
    return both / a if a else 1.0


def packed(kept: np.ndarray) -> bytes:
    """A sketch as bytes, four big-endian ones a hash."""
    return kept.astype(">u4").tobytes()


def unpacked(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, ">u4").astype(np.uint32)


def _decoded(text: bytes | None) -> str:
    return (text or b"").decode("utf-8", "replace")


def edited_text(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_chars`` and packed ``sketch`` of every row, made where the rows are read."""
    kind = documents.schema[id_col].dataType.simpleString()

    def of_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            whole = _decoded(text)
            yield doc_id, len(whole), packed(sketch(whole))

    return map_partitions(documents.select(id_col, F.col(text_col).cast("binary")), f"`{id_col}` {kind}, n_chars bigint, sketch binary", of_rows)


def compare_fingerprints(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """``pairs`` with ``likeness`` of two sketch columns, and ``containment`` of the first in the second."""
    kind = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema], "likeness double, containment double"])
    a, b = pairs.columns.index(first), pairs.columns.index(second)

    def of_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            one, other = unpacked(row[a] or b""), unpacked(row[b] or b"")
            yield *row, likeness(one, other), containment(one, other)

    return map_partitions(pairs, kind, of_rows)


def merge_fingerprints(fingerprints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of whole groups of documents, such as all of a source, as rows ``(*keys, hash)``.

    A group's sketch grows with the group, so it stays a table: hashes are made distinct, those below the threshold stay,
    and groups with few of them keep their least ``FLOOR``.
    """

    def of_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *key, stored in rows:
            for value in unpacked(stored or b"").tolist():
                yield *key, value

    kind = ", ".join([*[f"`{k}` {fingerprints.schema[k].dataType.simpleString()}" for k in keys], "hash bigint"])
    hashes = materialize(map_partitions(fingerprints.select(*keys, "sketch"), kind, of_rows).distinct(), "hashes")
    low = hashes.groupBy(*keys).agg(F.count_if(F.col("hash") < _THRESHOLD).alias("_low")).filter(F.col("_low") < FLOOR)
    sparse = hashes.alias("h").join(low.alias("l"), [F.col(f"h.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys], "left_semi")
    least = first_n(sparse.filter(F.col("hash") >= _THRESHOLD), keys, ["hash"], FLOOR, "_rank").withColumnRenamed("hash", "_hash")
    room = least.alias("s").join(low.alias("l"), [F.col(f"s.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys])
    filled = room.filter(F.col("_rank") + F.col("_low") <= FLOOR).select(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("_hash").alias("hash"))
    return hashes.filter(F.col("hash") < _THRESHOLD).unionByName(filled)


_MADE = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _against(text: str, own: np.ndarray, following: str, next_own: np.ndarray) -> tuple:
    """The columns of ``_MADE`` for one document and the next."""
    edited = edited_text(text, following)
    made = own if edited == text else sketch(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    return len(text), digest, packed(own), packed(made), likeness(own, made), likeness(own, next_own)


def fingerprint_edits(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike it is to that and to the next document."""
    kind = documents.schema[id_col].dataType.simpleString()

    def squeezed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, tie, text in rows:
            yield doc_id, tie, zlib.compress(text or b"", 1)

    given = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("binary").alias("text"))
    small = map_partitions(given, f"id {kind}, tie bigint, text binary", squeezed)
    placed = small.repartitionByRange("id").sortWithinPartitions("id", "tie").drop("tie")

    def of_partition(rows: Iterator[tuple]) -> Iterator[tuple]:
        part, last = TaskContext.get().partitionId(), None
        for doc_id, stored in rows:
            text = _decoded(zlib.decompress(stored))
            own = sketch(text)
            if last is None:
                yield "head", part, doc_id, *[None] * 6, stored
            else:
                yield "row", part, last[0], *_against(last[1], last[2], text, own), None
            last = doc_id, text, own, stored
        if last is not None:
            yield "tail", part, last[0], *[None] * 6, last[3]

    made = materialize(map_partitions(placed, f"role string, part int, id {kind}, {_MADE}, text binary", of_partition), "fingerprints")
    # Two rows a partition: the last document of one meets the first of the next that is not empty.
    heads = made.filter("role = 'head'").select("part", F.col("text").alias("next_text"))
    parts = heads.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    tails = made.filter("role = 'tail'").select("part", "id", "text").join(parts, "part")
    met = tails.join(heads.withColumnRenamed("part", "next_part"), "next_part").select("id", "text", "next_text")

    def of_tails(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, stored, next_stored in rows:
            text, following = (_decoded(zlib.decompress(held)) for held in (stored, next_stored))
            yield doc_id, *_against(text, sketch(text), following, sketch(following))

    rows = made.filter("role = 'row'").drop("role", "part", "text").unionByName(map_partitions(met, f"id {kind}, {_MADE}", of_tails))
    return rows.withColumnRenamed("id", id_col)


def fingerprint_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`fingerprint_edits` with the sketches as base64 text."""
    made = fingerprint_edits(documents, id_col, text_col)
    # Spark's base64 breaks its text into lines.
    return made.withColumns({name: F.translate(F.base64(name), "\r\n", "") for name in ("fingerprint", "edited_fingerprint")})
