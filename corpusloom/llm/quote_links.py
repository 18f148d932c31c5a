"""Quotation linking: conversations in reply order, from messages that quote each other.

A line's quote level is the number of ``>`` signs in front of it. Lines are normalised (lower case, white space to
single spaces; blank ones do not count) and hashed. A passage is a run of quoted lines of one level; its hash is looked up
among the runs of as many lines that the messages of its conversation wrote themselves, and it is linked to the latest
earlier message that holds it. The lines of a passage that no message holds as a whole, as after cuts, are looked up one
by one in the same way. The message that most lines of a reply's outermost quotes come from, the latest of equals, is
its parent. Threads are the trees of parents; messages are ordered by the first message of their thread and then by
turn, so replies follow what they answer, and their own text is kept without quotes.

Only hashes and numbers are shuffled. Windows are made only of the lengths that their conversation quotes, and go on only
where a quote has their hash. What is looked up is distinct by turn, and the latest earlier holder is found in blocks of
turns and then between blocks, so no passage, however often a conversation repeats it, meets in one task or is paired
with all its holders; positions are numbered without sorting a conversation in one task.

Defined cases: null and empty texts have no lines; quotes of nothing known leave a message without a parent, as the
first of its own thread; messages that share conversation and turn share their links, and follow each other in the
order of their texts' hashes; a message without conversation or turn is linked with nothing and comes first. Turns are
whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranking import ordered_rank
from corpusloom.session import broadcast_if_small, materialize

BLOCK_TURNS = 4096
"""Turns among which the latest holder is found in one step."""

_QUOTE = r"^(?:[ \t]*>)+"


def quote_level(line: Column) -> Column:
    """Number of ``>`` signs in front of a line."""
    front = F.regexp_extract(line, _QUOTE, 0)
    return F.char_length(front) - F.char_length(F.translate(front, ">", ""))


def normalised_line(line: Column) -> Column:
    """The line without quote signs, lower-cased, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _QUOTE, "")), r"[ \t\r\x0B\x0C]+", " "))


def unquoted_text(text: Column) -> Column:
    """The lines that are not quoted, without blank ends."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: ~line.rlike(_QUOTE))
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def message_lines(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Per message ``conv``, ``turn``, and the ``level`` and ``hash`` of its lines that are not blank, as arrays."""
    lines = F.transform(
        F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"),
        lambda line: F.struct(quote_level(line).alias("level"), normalised_line(line).alias("plain")),
    )
    kept = messages.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.transform(
            F.filter(lines, lambda line: line["plain"] != ""),
            lambda line: F.struct(line["level"].alias("level"), F.xxhash64(line["plain"]).alias("hash")),
        ).alias("lines"),
    )
    kept = kept.filter("conv IS NOT NULL AND turn IS NOT NULL")
    return kept.select("conv", "turn", F.col("lines.level").alias("level"), F.col("lines.hash").alias("hash"))


def quoted_passages(lines: DataFrame) -> DataFrame:
    """Runs of quoted lines of one level: ``conv``, ``turn``, ``level``, ``hashes`` and ``times``, how often the turn has it."""
    is_start = "filter(sequence(0, size(level)), i -> i = 0 OR i = size(level) OR get(level, i) <> get(level, i - 1))"
    starts = lines.filter("exists(level, l -> l > 0)").withColumn("starts", F.expr(is_start))
    run = "transform(sequence(0, size(starts) - 2), k -> struct(level[starts[k]] AS level, slice(hash, starts[k] + 1, starts[k + 1] - starts[k]) AS hashes))"
    runs = starts.select("conv", "turn", F.explode(F.expr(f"filter({run}, r -> r.level > 0)")).alias("run"))
    return runs.groupBy("conv", "turn", "run.level", "run.hashes").agg(F.count("*").alias("times"))


def _windows(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``conv``, ``n``, ``key`` and ``turn`` of the runs of own lines that have one of the ``wanted`` lengths and hashes."""
    lengths = wanted.groupBy("conv").agg(F.collect_set("n").alias("lengths"))
    own = lines.select("conv", "turn", F.expr("filter(hash, (h, i) -> level[i] = 0)").alias("own")).filter("size(own) > 0")
    runs = own.join(broadcast_if_small(lengths), "conv").select(
        "conv", "turn", "own", F.explode(F.expr("filter(lengths, n -> n <= size(own))")).alias("n")
    )
    keys = F.expr("array_distinct(transform(sequence(1, size(own) - n + 1), i -> xxhash64(slice(own, i, n))))")
    found = runs.select("conv", "turn", "n", F.explode(keys).alias("key"))
    return found.join(wanted.select("conv", "n", "key").distinct(), ["conv", "n", "key"], "left_semi").distinct()


def latest_holders(wanted: DataFrame, holders: DataFrame) -> DataFrame:
    """For each distinct row ``(conv, n, key, turn)`` of ``wanted`` the ``origin``: the latest earlier turn among ``holders``
    of the same ``conv``, ``n`` and ``key``, if there is one.

    Both have one row a turn, so a block of turns is short; between blocks only their latest holders are compared.
    """
    key = ["conv", "n", "key"]
    sides = [side.select(*key, "turn", F.lit(asks).alias("asks")) for side, asks in ((wanted, True), (holders, False))]
    rows = sides[0].unionByName(sides[1]).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    rows = rows.withColumn("holder", F.expr("CASE WHEN NOT asks THEN turn END"))
    # At one turn the question comes before the holder, which is not earlier.
    until = Window.partitionBy(*key, "block").orderBy("turn", F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("near", F.max("holder").over(until)).filter("asks")
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key, "block").agg(F.max("holder").alias("last")).withColumn("far", F.max("last").over(before))
    found = near.join(blocks.filter("far IS NOT NULL").select(*key, "block", "far"), [*key, "block"], "left")
    return found.select(*key, "turn", F.coalesce("near", "far").alias("origin")).filter("origin IS NOT NULL")


def reply_links(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Per message that quotes: ``n_quoted`` and ``n_linked`` lines, and ``parent``, the turn that it answers."""
    lines = materialize(message_lines(messages, conv_col, turn_col, text_col), "lines")
    passages = quoted_passages(lines).select("conv", "turn", "level", "hashes", "times", F.size("hashes").alias("n"), F.xxhash64("hashes").alias("key"))
    passages = materialize(passages, "passages")
    whole = _origins(lines, passages, "passage_origins")
    linked = passages.join(whole, ["conv", "n", "key", "turn"], "left")
    cut = linked.filter("origin IS NULL AND n > 1").select("conv", "turn", "level", "times", F.explode("hashes").alias("hash"))
    single = cut.groupBy("conv", "turn", "level", "hash").agg(F.sum("times").alias("times"))
    single = materialize(single.select("conv", "turn", "level", "times", F.lit(1).alias("n"), F.xxhash64(F.array("hash")).alias("key")), "cut")
    by_line = single.join(_origins(lines, single, "line_origins"), ["conv", "n", "key", "turn"], "left")
    both = linked.filter("origin IS NOT NULL OR n = 1").select("conv", "turn", "level", "origin", (F.col("n") * F.col("times")).alias("n"))
    both = both.unionByName(by_line.select("conv", "turn", "level", "origin", F.col("times").alias("n")))
    by_origin = both.groupBy("conv", "turn", "level", "origin").agg(F.sum("n").alias("n"))
    from_parent = F.expr("CASE WHEN level = 1 AND origin IS NOT NULL THEN struct(n, origin) END")
    return by_origin.groupBy("conv", "turn").agg(
        F.sum("n").alias("n_quoted"),
        F.sum(F.expr("CASE WHEN origin IS NULL THEN 0 ELSE n END")).alias("n_linked"),
        F.max(from_parent)["origin"].alias("parent"),
    )


def _origins(lines: DataFrame, passages: DataFrame, label: str) -> DataFrame:
    """The latest earlier holders of passages with ``n`` lines and hash ``key``."""
    wanted = passages.select("conv", "n", "key", "turn").distinct()
    return materialize(latest_holders(wanted, _windows(lines, wanted)), label)


def thread_roots(replies: DataFrame) -> DataFrame:
    """``conv``, ``turn`` and ``root``, the first turn of the thread, of every message that has a ``parent``.

    Each round doubles the way up that is known, so there are as many rounds as a thread's depth has binary digits.
    """
    ways = materialize(replies.select("conv", "turn", F.col("parent").alias("root")), "ways")
    while True:
        up = ways.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"))
        joined = ways.join(up, ["conv", "root"], "left")
        ways = materialize(joined.select("conv", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "ways")
        if ways.filter("moved").isEmpty():
            return ways.select("conv", "turn", "root")
        ways = ways.drop("moved")


def thread_messages(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Every message with its place in its conversation's reply order, its links, and its text without quotes."""
    links = materialize(reply_links(messages, conv_col, turn_col, text_col), "links")
    roots = thread_roots(links.filter("parent IS NOT NULL"))
    known = materialize(links.join(roots, ["conv", "turn"], "left"), "known")
    rows = messages.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        unquoted_text(F.col(text_col)).alias("text"),
        F.xxhash64(text_col, role_col).alias("_tie"),
    )
    linked = rows.join(known, ["conv", "turn"], "left").withColumn("root", F.coalesce("root", "turn"))
    # As a struct, a missing conversation is a group like any other.
    grouped = linked.withColumn("_group", F.struct("conv"))
    placed = ordered_rank(grouped, ["_group"], [F.col("root"), F.col("turn"), F.col("_tie")], "position")
    return placed.select(
        F.col("conv").alias(conv_col),
        F.col("position").cast("bigint").alias("position"),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        F.col("parent").alias("parent_turn"),
        F.col("root").alias("root_turn"),
        F.coalesce("n_quoted", F.lit(0)).cast("bigint").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.col("text").alias(text_col),
    )


def with_quotes(messages: DataFrame) -> DataFrame:
    """Mail-like messages from plain turns: each but the first of a conversation quotes an earlier one.

    Every third turn answers the turn three before it and the others the one before; what the answered message itself
    answers is quoted one level deeper.
    """
    answered = F.expr("CASE WHEN turn % 3 = 0 THEN turn - 3 ELSE turn - 1 END")

    def quoted(text: str, sign: str) -> Column:
        return F.concat(F.lit(sign), F.regexp_replace(text, "\n", f"\n{sign}"), F.lit("\n"))

    plain = messages.select("conv_id", "turn", "role", "text").withColumn("up", answered)
    texts = messages.select("conv_id", F.col("turn").alias("up"), F.col("text").alias("first"))
    first = plain.join(texts, ["conv_id", "up"], "left").withColumn("up2", F.expr("CASE WHEN up % 3 = 0 THEN up - 3 ELSE up - 1 END"))
    second = texts.select("conv_id", F.col("up").alias("up2"), F.col("first").alias("second"))
    both = first.join(second, ["conv_id", "up2"], "left")
    text = F.concat(F.coalesce(quoted("second", "> > "), F.lit("")), F.coalesce(quoted("first", "> "), F.lit("")), F.col("text"))
    return both.select("conv_id", "turn", "role", text.alias("text"))
