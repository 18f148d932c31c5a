"""Filter interaction audit with count-weighted decision diagrams.

What a row fails is one mask of bits. Per part the masks are counted, and a diagram is built over the counts: each level
tests one filter, each node weighs what reaches it. Neighbouring levels are swapped, one swap after another, until every
order of the filters was at the top once; the path on which nothing fails gives the steps of that order.

Only masks, ids and hashes of texts leave the scan, and a part comes to the diagrams as at most one row a mask, however
large it is. Copies are found by the hash of the whole text: the least id of each text is aggregated before the shuffle,
and rows meet it on hash *and* id, so that the copies of a common text spread over all tasks.

Defined cases: a null text counts as empty, a null part as the empty string; a row without an id is never a copy, and no
row is a copy of it; rows under one id are counted each, and are no copies of each other; labels of one id count if any
of its rows says 1, a missing or null label counts as 0; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import map_partitions
from corpusloom.session import materialize

MAX_FILTERS = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Weight = tuple[int, ...]


def _sum(first: Weight, second: Weight) -> Weight:
    return tuple(a + b for a, b in zip(first, second, strict=True))


class Diagram:
    """A shared decision diagram over failure masks, whose nodes hold the summed weights of all that reaches them.

    Level ``k`` tests ``order[k]``; a node is a pair of nodes of the next level, for pass and fail, and equal nodes of one
    level are one. Below the last level there are weights only.
    """

    def __init__(self, names: Sequence[str], masks: Mapping[int, Weight], width: int) -> None:
        self.order = list(names)
        self.children: list[tuple[int, int] | None] = []
        self.weights: list[Weight] = []
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in names]
        leaves: dict[Weight, int] = {}
        nothing = (0,) * width
        # Bit k of a mask belongs to names[k]: lists of nodes are folded from the last level up.
        nodes = []
        for mask in range(1 << len(names)):
            bits = sum(((mask >> (len(names) - 1 - k)) & 1) << k for k in range(len(names)))
            weight = masks.get(bits, nothing)
            if weight not in leaves:
                leaves[weight] = self._new(None, weight)
            nodes.append(leaves[weight])
        for level in reversed(range(len(names))):
            nodes = [self._node(level, nodes[k], nodes[k + 1]) for k in range(0, len(nodes), 2)]
        self.root = nodes[0]

    def _new(self, children: tuple[int, int] | None, weight: Weight) -> int:
        self.children.append(children)
        self.weights.append(weight)
        return len(self.weights) - 1

    def _node(self, level: int, passing: int, failing: int) -> int:
        key = passing, failing
        if key not in self.levels[level]:
            self.levels[level][key] = self._new(key, _sum(self.weights[passing], self.weights[failing]))
        return self.levels[level][key]

    def swap(self, level: int) -> None:
        """Exchanges a level with the next. Nodes of the upper one stay the same nodes, so those above need no change."""
        above, self.levels[level], self.levels[level + 1] = self.levels[level], {}, {}
        for (passing, failing), node in above.items():
            (pp, pf), (fp, ff) = self.children[passing], self.children[failing]
            key = self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)
            self.children[node] = key
            self.levels[level][key] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[str, Weight, Weight]]:
        """Along the path that passes all: filter, weight kept after it, weight that it removes."""
        node = self.root
        for name in self.order:
            passing, failing = self.children[node]
            yield name, self.weights[passing], self.weights[failing]
            node = passing


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places of the swaps that lead through all orders of ``n`` things."""
    if n < 2:
        return
    inner = adjacent_swaps(n - 1)
    falling = True
    while True:
        yield from range(n - 2, -1, -1) if falling else range(n - 1)
        place = next(inner, None)
        if place is None:
            return
        yield place + 1 if falling else place
        falling = not falling


def all_orders(names: Sequence[str], masks: Mapping[int, Weight], width: int) -> Iterator[tuple]:
    """Order, step, and per step kept, removed, redundant and unique failures, further weights removed, and Shapley sum."""
    diagram = Diagram(names, masks, width)
    runs = [("".join(diagram.order), list(diagram.steps()))]
    for level in adjacent_swaps(len(names)):
        diagram.swap(level)
        runs.append(("".join(diagram.order), list(diagram.steps())))
    failing = {steps[0][0]: steps[0][2][0] for _, steps in runs}
    alone = {steps[-1][0]: steps[-1][2][0] for _, steps in runs}
    shapley = dict.fromkeys(names, 0)
    for _, steps in runs:
        for name, _, removed in steps:
            shapley[name] += removed[0]
    for order, steps in runs:
        for step, (name, kept, removed) in enumerate(steps, 1):
            yield order, step, kept[0], removed[0], failing[name] - removed[0], alone[name], *removed[1:], shapley[name]


def quality_failures(text: Column) -> dict[str, Column]:
    """Conditions on one text, by the letter of their filter; copies are another filter, see :func:`audit_filters`."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n_words, n_points = F.size(words), F.char_length(text)
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("bigint") < 50 * n_words.cast("bigint"),
        "C": 100 * (n_points - F.char_length(F.translate(text, _UPPER, ""))).cast("bigint") > 2 * n_points.cast("bigint"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_counts(
    documents: DataFrame,
    labels: DataFrame,
    failures: Mapping[str, Column],
    copies: str | None = "E",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    losses: Sequence[tuple[str, int]] = (("quality", 1), ("toxic", 1)),
) -> DataFrame:
    """``(part, mask, n, lost)`` with one row for each part and failure mask in it.

    Bit ``k`` of a mask is the ``k``-th of ``failures``; that of ``copies``, if given, comes after them. ``lost`` counts
    the rows of each label column that has the value in ``losses``.
    """
    bits = [condition.cast("int") * (1 << k) for k, condition in enumerate(failures.values())]
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = materialize(
        documents.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("key"),
            sum(bits, F.lit(0)).alias("mask"),
        ),
        "masks",
    )
    if copies is not None:
        firsts = narrow.groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
        later = (F.col("id").isNotNull() & F.col("first").isNull()).cast("int") * (1 << len(bits))
        narrow = narrow.join(firsts, ["key", "id"], "left").select("id", "part", (F.col("mask") + later).alias("mask"))
    names = [f"_lost{k}" for k in range(len(losses))]
    marks = [F.max((F.col(column) == value).cast("int")).alias(name) for name, (column, value) in zip(names, losses, strict=True)]
    marked = labels.groupBy(F.col(id_col).alias("id")).agg(*marks) if losses else labels.select(F.col(id_col).alias("id")).distinct()
    rows = narrow.join(marked, "id", "left")
    lost = F.array(*[F.sum(F.coalesce(F.col(name), F.lit(0))).cast("bigint") for name in names]).cast("array<bigint>")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), lost.alias("lost"))


def audit_filters(counts: DataFrame, filters: Sequence[str], losses: Sequence[str] = ("good_lost", "toxic_lost")) -> DataFrame:
    """What every filter does at its place in every order, per part of ``counts``, as of :func:`failure_counts`.

    Filters are named by one letter each, in order of their bits; there are at most ``MAX_FILTERS`` of them, since all
    their orders are listed.
    """
    if len(filters) > MAX_FILTERS:
        raise ValueError(f"at most {MAX_FILTERS} filters")
    # One entry a mask: at most 2 ** MAX_FILTERS of them.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "lost")).alias("masks"))
    letters, width = list(filters), 1 + len(losses)

    def of_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
        for part, masks in rows:
            for row in all_orders(letters, {m["mask"]: (m["n"], *m["lost"]) for m in masks}, width):
                yield part, *row

    numbers = ["kept", "removed", "redundant", "unique_fails", *losses, "shapley"]
    schema = ", ".join(["part string, filter_order string, step int", *[f"{name} bigint" for name in numbers]])
    return map_partitions(parts, schema, of_rows)


def audit_quality_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`audit_filters` for the conditions of :func:`quality_failures` and copies."""
    failures = quality_failures(F.coalesce(F.col("text"), F.lit("")))
    return audit_filters(failure_counts(documents, labels, failures), [*failures, "E"])
