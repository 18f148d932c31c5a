import hashlib
import random
import re

from llm_helpers import documents

from corpusloom.llm import fill_in_middle as fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SYMBOLS = ["a", "bc", "Z", " ", "\n", "é", "字", "😀", "<", "P", ">", "<P", "S>", "1", ".", "\x00", "words"]


def brute(doc_id, text):
    """The contract with lists of tokens."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = TOKEN.findall(text)
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    form, out, sizes = "psm", f"<P>{pre}<S>{suf}<M>{mid}", (len(pre), len(mid))
    if h4 % 100 < 20:
        form, out = "spm", f"<S>{suf}<P>{pre}<M>{mid}"
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        form, out, sizes = "plain", text, (None, None)
    return doc_id, len(units), form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def texts(n):
    rng = random.Random(4)
    made = ["".join(rng.choice(SYMBOLS) for _ in range(rng.randrange(30))) for _ in range(n)]
    return [None, "", "a", "é", "x <P> y", "<S>", "<M", "<<P", "word " * 200_000, "x" * 300_000, *made]


def test_digests_equal_brute_force(spark):
    given = texts(600)
    found = fim.middle_digests(documents(spark, given).repartition(4))
    want = [brute(i, t) for i, t in enumerate(given)]
    assert sorted(map(tuple, found.collect())) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_texts_come_back_exactly(spark):
    given = texts(200)
    made = fim.fill_in_middle(documents(spark, given), fim_percent=100, spm_percent=50)
    restored = {r.doc_id: bytes(r.text).decode() for r in fim.restore_texts(made).collect()}
    assert restored == {i: t or "" for i, t in enumerate(given)}
    forms = {r.doc_id: r.form for r in made.select("doc_id", "form").collect()}
    assert all((forms[i] == "plain") == (not t or bool(re.search("<[PSM]>", t))) for i, t in enumerate(given))


def test_all_cuts_of_a_text():
    text = "ab é<P c".encode()
    n = len(TOKEN.findall(text.decode()))
    for a in range(n + 1):
        for b in range(n + 1):
            for order, form in ((0, "spm"), (99, "psm")):
                cut = fim.transform(text, fim.Draws(a, b, 0, order))
                assert cut.form == form and fim.restore(cut.output, form) == text
                assert len(cut.output) == len(text) + 9


def test_bytes_that_are_not_utf8():
    for text in (b"\x80\x80", b"\xffa\x80b", b"\xe5\xad"):
        for a in range(4):
            cut = fim.transform(text, fim.Draws(a, 1, 0, 50))
            assert fim.restore(cut.output, cut.form) == text


def test_repeated_missing_and_no_rows(spark):
    table = documents(spark, ["some text", "some text", "other", None], [3, 3, None, None])
    assert sorted(map(str, map(tuple, fim.middle_digests(table).collect()))) == sorted(
        map(str, [brute(3, "some text"), brute(3, "some text"), brute(None, "other"), brute(None, None)])
    )
    assert fim.middle_digests(table.limit(0)).collect() == []
