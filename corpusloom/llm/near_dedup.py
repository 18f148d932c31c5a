"""Near-duplicate detection with chosen-path trees over minwise shingles.

A document's set holds its distinct five-word shingles; two sets link if their similarity is at least ``percent``.
Documents with equal sets are one class, and its first document stands for it. In each of a few trees a set takes
``BRANCHES`` children at a node, one for each minwise token that the node chooses; similar sets share such tokens and
so meet again below.

In the topmost nodes each set is compared with the node's pivots, and what links is joined into components. A node
whose sets are all in one component is settled. A node ends its path when it has at most ``LEAF`` sets, or at most
``BLOCK`` outside its largest component, or lies at ``DEPTH``; all others branch on. In a node that ends, the sets
outside the largest component are compared with all sets of other components, exhaustively, dealt out in blocks of
about ``BLOCK`` sets. A comparison first counts equal minwise tokens and is decided on the full sets, so no false link is kept
and no pairs are stored but those with a pivot and those that link.

The roots of the trees choose distinct tokens, and there are as many trees as the threshold needs. Two sets at 85 percent
miss each other in all three trees with a probability of 0.15^6 = 0.00001 where the nodes below the roots end, the usual
case, and of about 0.00008 (simulated with these choices of 128 tokens) where all nodes branch on to any depth; at 80
percent, with four trees, the two are 0.2^8 = 0.000003 and about 0.00006.

Defined cases: null and empty texts and texts without words have empty sets and link with nothing; fewer than five
words are one shingle; rows under one id are one document, with the links of all of them; a row without an id links
with nothing, has no component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.words import map_rows, mixed, space_words, window_hashes
from corpusloom.session import broadcast_if_small, materialize

SHINGLE = 5
PERCENT = 85
BRANCHES = 2
DEPTH = 12
LEAF = 2048
BLOCK = 256
PIVOTS = 8
"""Pivots of a node with more than ``BLOCK`` sets; smaller ones have one."""

TOKENS = 128
MISSED = 5e-5
"""Share of links at the threshold that all trees may miss, by the limit of a branching process."""

UNEQUAL = 1.1e-6
"""Share of links at the threshold that may have too few equal tokens for a comparison of full sets."""

_FACTORS = np.random.default_rng(5).integers(1, 1 << 62, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)
_ROOTS = np.random.default_rng(6).permutation(TOKENS // BRANCHES)
_BLOCK = 4096
_UPPER = np.frombuffer(bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)), np.uint8).tobytes()


def tree_count(percent: int) -> int:
    """Trees that miss at most ``MISSED`` of the links at the threshold; a tree misses ((1 - p) / p)^2 of them."""
    if not 52 <= percent <= 100:
        raise ValueError("chosen paths with two children need a similarity of 52 to 100 percent")
    missed = ((100 - percent) / percent) ** 2
    return math.ceil(math.log(MISSED) / math.log(missed)) if missed else 1


def min_equal(percent: int) -> int:
    """So many of ``TOKENS`` minwise tokens must be equal before full sets are compared."""
    p, below, least = percent / 100, 0.0, 0
    while least < TOKENS:
        below += math.comb(TOKENS, least) * p**least * (1 - p) ** (TOKENS - least)
        if below > UNEQUAL:
            break
        least += 1
    return least


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    hashes = space_words((text or b"").translate(_UPPER)).hashes
    return np.unique(window_hashes(hashes, min(SHINGLE, len(hashes)))) if len(hashes) else hashes


def minwise(values: np.ndarray) -> np.ndarray:
    """The least 32-bit value of the set under each of ``TOKENS`` orders."""
    least = np.full(TOKENS, np.uint32(0xFFFFFFFF))
    for start in range(0, len(values), _BLOCK):
        block = mixed(values[start : start + _BLOCK])
        orders = (block[None, :] * _FACTORS[:, None]) >> np.uint64(32)
        least = np.minimum(least, orders.min(axis=1).astype(np.uint32))
    return least


def _describe(doc_id, text) -> Iterator[tuple]:
    values = shingles(text)
    if not len(values):
        yield doc_id, 0, None, None, None
        return
    whole = xxhash.xxh3_128_digest(values.tobytes())
    yield doc_id, len(values), *np.frombuffer(whole, np.int64).tolist(), minwise(values).tobytes()


def _slots(tree: int, node: int) -> list[int]:
    """The tokens that a node chooses: at random, but those of the roots are distinct over all trees."""
    first = int(_ROOTS[tree]) if node == 0 else xxhash.xxh3_64_intdigest(f"{tree}/{node}") % TOKENS
    return [(first + k * (TOKENS // BRANCHES)) % TOKENS for k in range(BRANCHES)]


def _branch(doc_id, tokens, tree, node) -> Iterator[tuple]:
    """The children that a set takes below a node (node 0: the root), by tokens that the node chooses at random."""
    values = np.frombuffer(tokens, np.uint32)
    for slot in _slots(tree, node):
        yield doc_id, tree, xxhash.xxh3_64_intdigest(f"{tree}/{node}/{slot}/{values[slot]}") - (1 << 63)


def _shared(rows: DataFrame) -> DataFrame:
    """Members of nodes with two or more sets: ``id``, ``tree``, ``node``, ``n``."""
    counts = materialize(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    return materialize(rows.join(counts, "node").select("id", "tree", "node", "n"), "nodes")


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """Each set of a node with the node's pivots: the first of each of its shares of sets."""
    dealt = members.withColumn("share", F.when(F.col("n") > BLOCK, F.pmod(F.xxhash64("id"), F.lit(PIVOTS))).otherwise(F.lit(0)))
    pivots = materialize(dealt.groupBy("node", "share").agg(F.min("id").alias("pivot")).select("node", "pivot"), "pivots")
    pairs = members.join(pivots, "node").filter(F.col("id") != F.col("pivot"))
    return pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _alike(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """The pairs whose sets have enough equal minwise tokens, by one byte of each."""
    left, right = (sketches.select(F.col("id").alias(k), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sketch_a", "sketch_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, TOKENS) for k in (2, 3))
            # One pair in 256 of unequal tokens has equal bytes, which only adds comparisons.
            yield batch.select(["a", "b"]).filter(pa.array((first == second).sum(axis=1) >= least))

    return both.mapInArrow(compare, pairs.schema)


def _is_link(first: np.ndarray, second: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted hashes) are similar enough."""
    small, large = sorted((len(first), len(second)))
    if 100 * small < percent * large:
        return False
    shared = len(np.intersect1d(first, second, assume_unique=True))
    return 100 * shared >= percent * (small + large - shared)


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: products of their rows in the table of shared values, in pieces."""
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    common = np.cumsum(times > 1) - 1
    kept = times[at] > 1
    rows, columns = rows[kept], common[at[kept]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, _BLOCK):
        a, b = np.searchsorted(columns, [start, start + _BLOCK])
        table = np.zeros((len(sets), _BLOCK), np.float32)
        table[rows[a:b], columns[a:b] - start] = 1
        counts += table @ table.T
    return counts.astype(np.int64)


def _bodies(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``id`` and ``body`` of the texts under ``ids``, left where they are read if the ids are few."""
    return texts.join(broadcast_if_small(materialize(ids.distinct(), "wanted")), "id", "left_semi")


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    bodies = _bodies(texts, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
    left, right = (bodies.select(F.col("id").alias(k), F.col("body").alias(f"body_{k}")) for k in "ab")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "body_a", "body_b")
    held: dict = {"a": None, "body": None, "set": None}

    def confirm(a, b, body_a, body_b) -> Iterator[tuple]:
        if held["a"] != a or held["body"] != body_a:
            held.update(a=a, body=body_a, set=shingles(body_a))
        if _is_link(held["set"], shingles(body_b), percent):
            yield a, b

    return map_rows(both, pairs.schema, confirm, 32)


def _open_nodes(members: DataFrame, found: DataFrame, last: bool) -> DataFrame:
    """Members of nodes that lie in several components, with their ``component``, whether they are ``outside`` the node's
    largest, the numbers of blocks of all sets and of those outside, and whether the node ``ends`` its path."""
    placed = members.select("id", "tree", "node").join(found, "id", "left")
    placed = materialize(placed.withColumn("component", F.coalesce("component", "id")), "placed")
    parts = placed.groupBy("node", "component").agg(F.count("*").alias("n"))
    split = parts.groupBy("node").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"),
        F.count("*").alias("parts"),
        F.sum("n").alias("n"),
        (F.sum("n") - F.max("n")).alias("n_outside"),
    )
    blocks, outer = (F.ceil(F.col(c) / BLOCK).cast("int").alias(name) for c, name in (("n", "blocks"), ("n_outside", "outer")))
    ends = (F.col("n") <= LEAF) | (F.col("n_outside") <= BLOCK) | F.lit(last)
    split = materialize(split.filter("parts > 1").select("node", "largest", blocks, outer, ends.alias("ends")), "split")
    outside = (F.col("component") != F.col("largest")).alias("outside")
    return materialize(placed.join(split, "node").select("id", "tree", "node", "component", outside, "blocks", "outer", "ends"), "open")


def _blocks(members: DataFrame) -> DataFrame:
    """Members dealt to groups ``(node, x, y)``: those outside the largest component in block x, with all in block y."""
    at = F.xxhash64("id", "node")
    x, y = F.pmod(at, F.col("outer")).cast("int"), F.pmod(at, F.col("blocks")).cast("int")
    all_x, all_y = F.sequence(F.lit(0), F.col("outer") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
    rest = ["node", "id", "component", "sketch"]
    as_outside = members.filter("outside").select(*rest, F.lit(True).alias("outside"), x.alias("x"), F.explode(all_y).alias("y"))
    as_any = members.select(*rest, F.lit(False).alias("outside"), F.explode(all_x).alias("x"), y.alias("y"))
    return as_outside.unionByName(as_any)


def _compare_blocks(groups: DataFrame, texts: DataFrame, kind: str, percent: int) -> DataFrame:
    """Links between sets outside and sets of another component, found within each group.

    Sketches decide which members of a group can link at all; only their texts are moved.
    """
    key = ["node", "x", "y"]
    least = min_equal(percent)
    narrow = groups.groupBy(*key).agg(F.collect_list(F.struct("id", "component", "outside", "sketch")).alias("rows"))

    def survivors(node, x, y, rows) -> Iterator[tuple]:
        ours, others = ([r for r in rows if r["outside"] is side] for side in (True, False))
        if not ours or not others:
            return
        first, second = (np.frombuffer(b"".join(r["sketch"] for r in side), np.uint8).reshape(-1, TOKENS) for side in (ours, others))
        parts = [np.array([r["component"] for r in side]) for side in (ours, others)]
        alike = np.stack([(row == second).sum(axis=1) >= least for row in first]) & (parts[0][:, None] != parts[1][None, :])
        for side, hit in ((ours, alike.any(axis=1)), (others, alike.any(axis=0))):
            for r, yes in zip(side, hit.tolist(), strict=True):
                if yes:
                    yield node, x, y, r["id"], r["component"], r["outside"]

    schema = f"node bigint, x int, y int, id {kind}, component {kind}, outside boolean"
    left = materialize(map_rows(narrow, schema, survivors, 32), "survivors")
    bodies = _bodies(texts, left.select("id"))
    # A set meets its text once for all blocks of a node.
    member = ["id", "node", "component", "outside"]
    met = left.groupBy(*member).agg(F.collect_list(F.struct("x", "y")).alias("at")).join(bodies, "id")
    placed = met.select(*member, "body", F.explode("at").alias("at")).select(*member, "body", "at.x", "at.y")
    wide = placed.groupBy(*key).agg(F.collect_list(F.struct("id", "component", "outside", "body")).alias("rows")).select("rows")

    def confirm(rows) -> Iterator[tuple]:
        sets = [shingles(r["body"]) for r in rows]
        sizes = np.array(list(map(len, sets)))
        shared = _shared_counts(sets)
        linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
        for k, r in enumerate(rows):
            if r["outside"]:
                for j in np.flatnonzero(linked[k]).tolist():
                    if not rows[j]["outside"] and rows[j]["component"] != r["component"]:
                        yield min(r["id"], rows[j]["id"]), max(r["id"], rows[j]["id"])

    return map_rows(wide, f"a {kind}, b {kind}", confirm, 1)


def _tree_links(sets: DataFrame, sketches: DataFrame, texts: DataFrame, kind: str, percent: int) -> DataFrame:
    """Links that connect all sets which the trees bring together, and that joining components does not already imply."""
    schema = f"id {kind}, tree int, node bigint"
    roots = sets.select("id", "tokens", F.explode(F.array(*[F.lit(t) for t in range(tree_count(percent))])).alias("tree"), F.lit(0).cast("bigint").alias("node"))
    members = _shared(map_rows(roots, schema, _branch))
    tried = materialize(_alike(_pivot_pairs(members), sketches, min_equal(percent)).distinct(), "tried")
    links = materialize(_links(tried, texts, percent).distinct(), "links")
    found = components(links)
    for level in range(1, DEPTH + 1):
        members = _open_nodes(members, found, last=level == DEPTH)
        ending = _blocks(members.filter("ends").join(sketches, "id"))
        more = materialize(_compare_blocks(ending, texts, kind, percent).distinct(), "links")
        links = links.unionByName(more)
        on = members.filter("NOT ends").select("id", "tree", "node")
        if level == DEPTH or on.isEmpty():
            return links
        below = sets.join(broadcast_if_small(materialize(on.select("id").distinct(), "below")), "id", "left_semi")
        members = _shared(map_rows(below.join(on, "id").select("id", "tokens", "tree", "node"), schema, _branch))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row its id, ``n_shingles``, ``component_id`` (least id reachable over links) and ``kept`` (it has that id)."""
    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    described = materialize(map_rows(texts, f"id {kind}, n bigint, h1 bigint, h2 bigint, tokens binary", _describe), "described")
    linkable = described.filter("id IS NOT NULL AND n > 0")
    classes = materialize(linkable.groupBy("h1", "h2").agg(F.min("id").alias("class")), "classes")
    members = materialize(linkable.join(classes, ["h1", "h2"]).select("id", "n", "class", F.expr("CASE WHEN id = class THEN tokens END").alias("tokens")), "members")
    # A class with repeated first rows, or two classes with one first id, are each one set of tokens per row here.
    sets = materialize(members.filter("id = class").select("id", "tokens").distinct(), "sets")
    bodies = texts.filter("id IS NOT NULL")

    sketches = map_rows(
        sets.select("id", "tokens"), f"id {kind}, sketch binary", lambda i, t: iter([(i, np.frombuffer(t, np.uint32).astype(np.uint8).tobytes())])
    )
    links = _tree_links(sets, materialize(sketches, "sketches"), bodies, kind, percent)
    of_one_id = members.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b").select("a", "b")
    found = components(links.unionByName(of_one_id))

    labelled = members.select("id", "class", "n").join(found.select(F.col("id").alias("class"), "component"), "class", "left")
    labelled = labelled.select("id", "n", F.coalesce("component", "class").alias("component_id"))
    alone = described.filter("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"))
    result = labelled.unionByName(alone)
    return result.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.expr("id IS NULL OR id = component_id").alias("kept")
    )


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``documents`` with all columns, without those whose component has a smaller id."""
    judged = near_duplicates(documents, id_col, text_col, percent)
    dropped = materialize(judged.filter("NOT kept").select(F.col(id_col).alias("_id")).distinct(), "dropped")
    same = F.col(f"given.`{id_col}`") == F.col("dropped._id")
    return documents.alias("given").join(broadcast_if_small(dropped).alias("dropped"), same, "left_anti")
