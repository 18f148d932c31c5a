import random

import numpy as np
from llm_helpers import words

from corpusloom.llm.words import NumberTable, space_words, window_hashes


def test_words_and_hashes_are_those_of_the_text():
    rng = random.Random(1)
    texts = ["", " ", "\x1f a\x0b b\x1c", "äö ü\u00a0x\ty", "x" * 5000, " ".join(f"w{rng.randrange(3000)}é" for _ in range(9000))]
    seen = {}
    for text in texts:
        data = text.encode()
        found = space_words(data)
        got = [data[a:b].decode() for a, b in zip(found.starts, found.ends)]
        assert got == words(text)
        for word, value in zip(got, found.hashes.tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen) > 2500


def test_long_texts_are_worked_off_in_pieces():
    text = (b"ab cde " * 700_000) + b"z" * 3_000_000
    found = space_words(text)
    assert len(found) == 1_400_001 and len(set(found.hashes.tolist())) == 3
    assert found.ends[-1] == len(text) and not (np.diff(found.starts) <= 0).any()


def test_windows():
    hashes = space_words(b"a b c a b c a").hashes
    windows = window_hashes(hashes, 3)
    assert len(windows) == 5 and windows[0] == windows[3] and len(set(windows.tolist())) == 3
    assert len(window_hashes(hashes, 8)) == 0


def test_number_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 50_000))
    table = NumberTable()
    for part in np.array_split(np.arange(len(keys)), 7):
        table.add(keys[part], part.astype(np.int32))
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert (table.get(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
