import itertools
import random
import re

import pytest

from corpusloom.llm.quote_links import thread_messages

SCHEMA = "conv_id long, turn long, role string, text string, root int, level string, conv int"
FIRST = "Where is it?\nI looked  everywhere."
MESSAGES = [
    (1, 0, "user", FIRST),
    (1, 1, "assistant", "> Where is it?\n> i looked everywhere.\nHere."),
    (1, 2, "user", "Something else."),
    (1, 3, "assistant", "> something else.\n>\nRight."),
    (1, 4, "user", ">> Where is it?\n> Here.\n\nThanks!\n"),
    (1, 5, "user", "> Nobody said this\n>> Something else.\nOwn > line"),
    (1, 6, "user", "> Right.\n> Thanks!\nTie goes to the latest"),
    (2, 0, "user", "> Where is it?\nOther conversation"),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (2, 3, "user", "> Other conversation"),
    (2, 3, "user", "> Other conversation"),
    (None, 0, "user", "Lost"),
    (3, None, "user", "> Lost"),
]


def rows(spark, messages):
    table = spark.createDataFrame([(*m, 1, "x", 2) for m in messages], SCHEMA)
    return sorted(map(tuple, thread_messages(table).collect()), key=lambda r: (str(r[0]), r[1]))


def test_threads(spark):
    assert rows(spark, MESSAGES) == [
        # conversation, position, turn, role, parent, root, quoted, linked, text
        (1, 1, 0, "user", None, 0, 0, 0, FIRST),
        (1, 2, 1, "assistant", 0, 0, 2, 2, "Here."),
        (1, 3, 4, "user", 1, 0, 2, 2, "Thanks!"),
        (1, 4, 6, "user", 4, 0, 2, 2, "Tie goes to the latest"),
        (1, 5, 2, "user", None, 2, 0, 0, "Something else."),
        (1, 6, 3, "assistant", 2, 2, 1, 1, "Right."),
        (1, 7, 5, "user", None, 5, 2, 1, "Own > line"),
        (2, 1, 0, "user", None, 0, 1, 0, "Other conversation"),
        # Both copies count for both.
        (2, 2, 3, "user", 0, 0, 2, 2, ""),
        (2, 3, 3, "user", 0, 0, 2, 2, ""),
        (2, 4, 1, "user", None, 1, 0, 0, ""),
        (2, 5, 2, "user", None, 2, 0, 0, ""),
        (3, 1, None, "user", None, None, 0, 0, ""),
        (None, 1, 0, "user", None, 0, 0, 0, "Lost"),
    ]


def test_long_chains_and_no_rows(spark):
    chain = [(1, 0, "user", "line 0")] + [(1, k, "user", f"> line {k - 1}\nline {k}") for k in range(1, 70)]
    found = rows(spark, chain)
    assert [(r[1], r[2], r[5]) for r in found] == [(k + 1, k, 0) for k in range(70)]
    assert rows(spark, []) == []


def test_plan_is_native(spark):
    table = spark.createDataFrame([(*m, 1, "x", 2) for m in MESSAGES], SCHEMA)
    plan = thread_messages(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_latest_message_that_holds_the_whole_passage(spark):
    turns = [(1, 1, "u", "A\nB"), (1, 2, "u", "x"), (1, 5, "u", "A\nB\nC"), (1, 6, "u", "> A\n> B\n>\n> c\nyes"), (1, 7, "u", "> A\n> B\n> x")]
    assert [(r[2], r[4], r[7]) for r in rows(spark, turns)] == [(1, None, 0), (2, None, 0), (5, None, 0), (6, 5, 3), (7, 5, 3)]


def brute_links(messages):
    """Parents and linked lines, message by message."""

    def parsed(text):
        out = []
        for line in (text or "").split("\n"):
            front = re.match(r"^(?:[ \t]*>)+", line)
            plain = " ".join(re.sub(r"^(?:[ \t]*>)+", "", line).lower().split())
            if plain:
                out.append((front[0].count(">") if front else 0, plain))
        return out

    lines = {(c, t): parsed(x) for c, t, _, x in messages}
    found = {}
    for (conv, turn), mine in lines.items():
        own = {t: [p for k, p in other if k == 0] for (c, t), other in lines.items() if c == conv and t < turn}

        def latest(run, own=own):
            n = len(run)
            return max((t for t, w in own.items() if any(w[i : i + n] == run for i in range(len(w) - n + 1))), default=None)

        linked, votes = 0, {}
        for level, group in itertools.groupby(mine, key=lambda x: x[0]):
            run = [p for _, p in group]
            if level:
                whole = latest(run)
                for origin in [whole] * len(run) if whole is not None else [latest([p]) for p in run]:
                    linked += origin is not None
                    if level == 1 and origin is not None:
                        votes[origin] = votes.get(origin, 0) + 1
        found[conv, turn] = max(votes, key=lambda t: (votes[t], t), default=None), linked, sum(k > 0 for k, _ in mine)
    return found


@pytest.mark.parametrize("block", [2, 4096])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr("corpusloom.llm.quote_links.BLOCK_TURNS", block)
    rng = random.Random(block)
    messages = []
    for conv in range(4):
        said = [[]]
        for turn in range(30 if conv else 90):
            text = [rng.choice("abcdef") * rng.randrange(1, 3) for _ in range(rng.randrange(5))]
            quoted = rng.choice(said)
            a = rng.randrange(len(quoted) + 1)
            quote = quoted[a : a + rng.randrange(1, 5)]
            said.append(text)
            messages.append((conv, turn, "u", "\n".join([*(f"{rng.choice(['> ', '>> ', '>'])}{q}" for q in quote), *text])))
    table = spark.createDataFrame([(*m, 1, "x", 2) for m in messages], SCHEMA)
    got = {(r.conv_id, r.turn): (r.parent_turn, r.n_linked, r.n_quoted) for r in thread_messages(table).collect()}
    assert got == brute_links(messages)
