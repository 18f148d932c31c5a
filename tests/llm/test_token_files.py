import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from llm_helpers import documents
from tokenizers import Tokenizer

from corpusloom.llm.token_files import UnitEncoder, read_token_files, token_positions, write_token_files
from corpusloom.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
SYMBOLS = "abcdeést  \t\n'.,012😀字\x00  ßÄ<>ththeingonion!? \x1c "


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(SYMBOLS) for _ in range(rng.randrange(50))) for _ in range(800)]
    out += [None, "", " ", "\n", "a  b", "a\nb c", "it's we'll", "x" * 20_000, "<|endoftext|> a", " ".join(f"w{k % 700}." for k in range(20_000))]
    return out + out[:4]


def test_words_with_any_white_space_between_equal_the_library():
    rng = random.Random(8)
    blanks = [*map(chr, [*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])]
    bits = ["a", "word", "don't", "it's", "naïve.", "字", "3.5,", "x,", "end.", "<|endoftext|>", "“q”", "—", "é", "12"]
    given = ["a \u00a0 \u00a0 b", "\nfirst\nlast"]
    for _ in range(5000):
        between = ["".join(rng.choice(blanks if rng.random() < 0.2 else " \n") for _ in range(rng.choice([1, 1, 1, 2]))) for _ in range(6)]
        given.append("".join(rng.choice(bits) + blank for blank in between).strip(" \n"))
    encoder = UnitEncoder(PATH)
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(given, add_special_tokens=False)]
    for start in range(0, len(given), 300):
        found = encoder.encode_batch([t.encode() for t in given[start : start + 300]])
        assert [ids.tolist() for ids in found] == want[start : start + 300]


def test_files_hold_the_library_ids_in_order(spark):
    given = texts()
    order = list(range(len(given)))
    random.Random(1).shuffle(order)
    library = Tokenizer.from_file(PATH)
    want, start = {}, 0
    for i, text in enumerate(given):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    target = scratch_path(spark, "tokens")
    write_token_files(documents(spark, [given[i] for i in order], order).repartition(5), PATH, target)
    assert {r[0]: tuple(r[1:]) for r in token_positions(spark, target).collect()} == want
    stored = read_token_files(spark, target)
    ids = stored.filter("doc_id = 7").first().tokens
    assert zlib.crc32(np.array(ids, "<u4").tobytes()) == want[7][2]
    plan = stored.filter("doc_id = 7").select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan


def test_layout(spark):
    target = scratch_path(spark, "tokens")
    write_token_files(documents(spark, ["some words, " * 9000] * 12).coalesce(1), PATH, target)
    import glob

    columns = pq.ParquetFile(sorted(glob.glob(f"{target}/*.parquet"))[0]).metadata.row_group(0)
    found = {columns.column(k).path_in_schema.split(".")[0]: columns.column(k) for k in range(columns.num_columns)}
    assert "DELTA_BINARY_PACKED" in found["doc_id"].encodings and "DELTA_BINARY_PACKED" in found["n_tokens"].encodings
    assert any("DICTIONARY" in e for e in found["tokens"].encodings)
    assert found["tokens"].has_column_index or found["doc_id"].has_column_index


def test_repeated_missing_and_no_rows(spark):
    target = scratch_path(spark, "tokens")
    write_token_files(documents(spark, ["b", "b", "a c", ""], [5, 5, None, 1]), PATH, target)
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in token_positions(spark, target).collect())
    assert rows == [(0, None, 3), (3, 1, 1), (4, 5, 2), (6, 5, 2)]
    empty = scratch_path(spark, "tokens")
    write_token_files(documents(spark, ["b"]).limit(0), PATH, empty)
    assert token_positions(spark, empty).count() == 0


def test_units_are_forgotten_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr("corpusloom.llm.token_files.UNITS_KEPT", 10)
    encoder, library = UnitEncoder(PATH), Tokenizer.from_file(PATH)
    for text in texts()[:300]:
        assert encoder.encode_batch([(text or "").encode()])[0].tolist() == library.encode(text or "", add_special_tokens=False).ids
