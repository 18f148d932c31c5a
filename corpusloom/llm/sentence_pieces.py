"""SentencePiece encoding and decoding of byte-pair models by a table of prefixes.

For each prefix of a text the table holds the last token of the prefix's encoding. An automaton over the vocabulary
lists the tokens that end at a place; exactly one of them is compatible with the last token of the prefix before it,
and it is the entry. The ids are read backwards from the last entry. Two tokens are compatible if their joined text
encodes to just these two, which is tried once for each pair by merging.

No piece of the models read here has a space behind another character, so an encoding never crosses the front of a
run of spaces. Texts are worked off in such units: the distinct units of a batch of texts get their tables together,
one character place of all of them at a time, in numpy. A worker remembers the units it met, up to a bound.

Defined cases: null and empty texts encode to no ids and decode to the empty text; white space stays as it is;
characters outside the vocabulary become byte tokens; rows that repeat are encoded one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.words import NumberTable, map_rows

SPACE = "\u2581"
CHUNK_ROWS = 256
PAIRS_KEPT = 1 << 19
UNITS_KEPT = 100_000
_UNIT = re.compile("\n| *[^ \n]+| +")
_CHARACTER_BITS = 21


class _Numbers(dict):
    """Numbers units from 0 in the order of their first use."""

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        return number


class PieceModel:
    """Pieces, scores and byte tokens of a model file, with its encoder and decoder."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in ids if model.is_byte(i)}
        self.hidden = {i for i in ids if model.is_control(i)}
        self.unknown = model.unk_id()
        self.id_of = {
            self.pieces[i]: i for i in ids if i not in self.byte_of and i not in self.hidden and i != self.unknown and not model.is_unused(i)
        }
        self.score = {piece: model.get_score(i) for piece, i in self.id_of.items()}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.id_of):
            raise ValueError("a piece has a space behind another character: units would not be independent")
        self.text_of = {i: piece for piece, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        # What decoding puts for each id, and each id's decimal digits.
        self.spelled = [self._joined([i]).encode() if i not in self.byte_of else bytes([self.byte_of[i]]) for i in ids]
        self.digits = list(map(str, ids))
        self.lengths = np.array([len(self.text_of.get(i, "")) for i in ids], np.int64)
        self._pairs = NumberTable()
        self._forget_units()
        self._build_automaton()

    def _forget_units(self) -> None:
        self._units, self._ids, self._begins = _Numbers(), np.empty(0, np.int32), np.zeros(1, np.int64)

    def _build_automaton(self) -> None:
        """Steps between the beginnings of pieces by character, and the piece that each beginning is, if any."""
        states: dict[str, int] = {"": 0}
        for piece in self.id_of:
            for end in range(1, len(piece) + 1):
                states.setdefault(piece[:end], len(states))
        keys = [(states[text[:-1]] << _CHARACTER_BITS) | ord(text[-1]) for text in states if text]
        self._steps = NumberTable()
        self._steps.add(np.array(keys, np.int64), np.arange(1, len(states), dtype=np.int32))
        self._piece_at = np.array([self.id_of.get(text, -1) for text in states], np.int64)

    def _merged(self, text: str) -> list[str]:
        """Encoding of a short text by merging: the best pair first, the leftmost of equals."""
        symbols = list(text)
        score = self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                value = score.get(symbols[i] + symbols[i + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _token_text(self, token: int) -> str:
        """Tokens from the vocabulary's size on stand for single characters outside the vocabulary."""
        return self.text_of[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def _compatible(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether ``tokens`` may follow ``before`` (-1: stand first), each pair tried once per worker."""
        keys = (before + 1 << 22) | tokens
        known = self._pairs.get(keys)
        new = np.unique(keys[known < 0])
        if len(new):
            if self._pairs.used > PAIRS_KEPT:
                self._pairs = NumberTable()
                new = np.unique(keys)
            verdicts = []
            for key in new.tolist():
                first, second = (key >> 22) - 1, self._token_text(key & (1 << 22) - 1)
                first = [] if first < 0 else [self._token_text(first)]
                verdicts.append(self._merged("".join(first) + second) == [*first, second])
            self._pairs.add(new, np.array(verdicts, np.int32))
            known = self._pairs.get(keys)
        return known > 0

    def _candidates(self, characters: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and token of every piece that occurs inside a unit, and of every character that is no piece."""
        starts, states = np.arange(len(characters)), np.zeros(len(characters), np.int64)
        found = []
        for length in range(1, self.longest + 1):
            fits = room[starts] >= length
            starts, states = starts[fits], states[fits]
            states = self._steps.get((states << _CHARACTER_BITS) | characters[starts + length - 1]).astype(np.int64)
            tokens = np.where(states >= 0, self._piece_at[states], -1)
            if length == 1:
                tokens = np.where(tokens < 0, characters[starts] + len(self.pieces), tokens)
            is_piece = tokens >= 0
            found.append((starts[is_piece], starts[is_piece] + length - 1, tokens[is_piece]))
            on = states >= 0
            starts, states = starts[on], states[on]
            if not len(starts):
                break
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _unit_ids(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units side by side, and where each unit's begin (one place more than units)."""
        characters = np.frombuffer("".join(units).replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        first = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(len(characters)) - np.repeat(first[:-1], sizes)
        starts, ends, tokens = self._candidates(characters, np.repeat(sizes, sizes) - place)
        order = np.argsort(place[ends], kind="stable")
        starts, ends, tokens = starts[order], ends[order], tokens[order]
        rounds = np.searchsorted(place[ends], np.arange(int(sizes.max(initial=0)) + 1))
        last = np.full(len(characters), -1, np.int64)
        for a, b in zip(rounds[:-1], rounds[1:], strict=True):
            begin = starts[a:b]
            before = np.where(place[begin] > 0, last[begin - 1], -1)
            right = self._compatible(before, tokens[a:b])
            last[ends[a:b][right]] = tokens[a:b][right]
        lengths = np.where(last < len(self.pieces), self.lengths[np.minimum(last, len(self.pieces) - 1)], 1)
        chosen = np.zeros(len(characters), bool)
        at, floor = first[1:] - 1, first[:-1]
        while len(at):
            chosen[at] = True
            at = at - lengths[at]
            on = at >= floor
            at, floor = at[on], floor[on]
        ids, counts = self._with_bytes(last[chosen])
        of_unit = np.add.reduceat(np.concatenate([counts, [0]]), np.searchsorted(np.flatnonzero(chosen), first[:-1])) if len(units) else counts
        return ids, np.concatenate([[0], np.cumsum(of_unit)])

    def _with_bytes(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokens, where characters outside the vocabulary become the ids of their bytes; how many ids each gave."""
        counts = np.ones(len(tokens), np.int64)
        outside = np.flatnonzero(tokens >= len(self.pieces))
        if not len(outside):
            return tokens, counts
        spelled = [[self.byte_id[b] for b in chr(c - len(self.pieces)).encode()] for c in tokens[outside].tolist()]
        counts[outside] = list(map(len, spelled))
        ids = np.repeat(tokens, counts)
        begins = np.cumsum(counts) - counts
        for at, values in zip(begins[outside].tolist(), spelled, strict=True):
            ids[at : at + len(values)] = values
        return ids, counts

    def encode_batch(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text. Units are remembered until there are too many of them."""
        if len(self._units) > UNITS_KEPT:
            self._forget_units()
        before = len(self._units)
        number = self._units.__getitem__
        numbers = [np.array(list(map(number, _UNIT.findall(" " + t.replace(SPACE, " ")))) if t else [], np.int64) for t in texts]
        new = list(islice(self._units, before, None))
        if new:
            ids, begins = self._unit_ids(new)
            self._begins = np.concatenate([self._begins, begins[1:] + len(self._ids)])
            self._ids = np.concatenate([self._ids, ids.astype(np.int32)])
        out = []
        for units in numbers:
            begins = self._begins[units]
            counts = self._begins[units + 1] - begins
            total = np.cumsum(counts)
            out.append(self._ids[np.arange(total[-1] if len(total) else 0) + np.repeat(begins - total + counts, counts)])
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def _joined(self, ids: Sequence[int]) -> str:
        """Pieces side by side, byte tokens as the characters they spell (U+FFFD for each byte that spells none)."""
        out = []
        for is_byte, run in groupby(ids, self.byte_of.__contains__):
            if is_byte:
                out.append(_characters(bytes(self.byte_of[i] for i in run)))
            else:
                out += [" ⁇ " if i == self.unknown else "" if i in self.hidden else self.pieces[i].replace(SPACE, " ") for i in run]
        return "".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ``ids``, without the space that encoding puts in front."""
        first = next((i for i in ids if i not in self.hidden), None)
        if first is None:
            return ""
        try:
            text = b"".join([self.spelled[i] for i in ids]).decode()
        except UnicodeDecodeError:
            text = self._joined(ids)
        return text[1:] if self.pieces[first].startswith(SPACE) else text


def _characters(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """The model of a file, read once per worker."""
    return PieceModel(path)


def _map_encoded(documents: DataFrame, path: str, id_col: str, text_col: str, schema: str, of_ids) -> DataFrame:
    """Columns that ``of_ids(model, ids)`` gives for the ids of each row's text, behind the row's id."""
    kind = T._parse_datatype_string(f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, {schema}")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                keys, texts = batch.slice(start, CHUNK_ROWS).columns
                rows = zip(*[of_ids(model, ids.tolist()) for ids in model.encode_batch(texts.to_pylist())], strict=True)
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, f.type) for c, f in zip(rows, list(arrow)[1:], strict=True)]], schema=arrow)

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, kind)


def encode_pieces(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row with the ``ids`` of its whole text."""
    return _map_encoded(documents, path, id_col, text_col, "ids array<int>", lambda model, ids: (ids,))


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists; a null list decodes to the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()
    return map_rows(
        encoded.select(id_col, ids_col), f"`{id_col}` {kind}, text string", lambda i, ids: iter([(i, piece_model(path).decode(ids or []))])
    )


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def piece_digests(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document how many ids it has, a hash of the ids, and a hash of the text that they decode to."""

    def digest(model: PieceModel, ids: list[int]) -> tuple:
        return len(ids), _sha256(",".join([model.digits[i] for i in ids])), _sha256(model.decode(ids))

    return _map_encoded(documents, path, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest)


def encode_with_digests(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its ids, how many there are, and hashes of them and of the text that they decode to."""

    def digest(model: PieceModel, ids: list[int]) -> tuple:
        return ids, len(ids), _sha256(",".join([model.digits[i] for i in ids])), _sha256(model.decode(ids))

    return _map_encoded(documents, path, id_col, text_col, "ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest)
