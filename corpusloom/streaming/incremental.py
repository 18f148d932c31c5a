"""Incremental builds over a stream of captures.

The state below one folder says, for all captures so far, what a batch build over them would say: which response stands
for each page, which page owns each file, the manifest, and the counters. All of it are bucket logs (see
``sinks/bucket_log.py``): a batch reads the buckets of the pages and files that it touches, writes its rows as a step,
and a commit written last makes the step count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.extract import SKIPPED, SUCCESS, extract_pages
from corpusloom.operators.incremental import FAILED, PROCESSED
from corpusloom.operators.publish import page_files
from corpusloom.operators.summarize import as_summaries
from corpusloom.operators.triage import FETCH_FAILED, chosen_flags, flagged_shells, least_flags
from corpusloom.options import BuildOptions
from corpusloom.session import broadcast_if_small, materialize
from corpusloom.sinks.bucket_log import BATCH, BucketLog, Pieces, read_commit, stored_buckets, with_step, write_commit
from corpusloom.sources.tables import MANIFEST

BUCKETS = 32
COMMITS = "commits"
_FLAG = "age: bigint, last: int, capture_id: bigint, usable: boolean, challenge: string, thin: boolean"
# Of a response also what became of it, and in which batch its text lies: ``late`` is that batch, negated.
_CHOICE = f"struct<{_FLAG}, late: int, outcome: string, content_hash: string>"
PAGES = (
    "capture_id bigint, site string, url string, channel string, title string, fetched_at timestamp, "
    f"flag struct<{_FLAG}>, markdown string, outcome string, content_hash string"
)
SUMMARIES = (
    "site string, url string, title string, markdown string, content_hash string, file_name string, "
    "relative_output_path string, fetched_at timestamp, rank bigint"
)
# A page's summary claims its file name; the first claimant by URL owns the file.
CLAIMS = "site string, file_name string, url string, active boolean, title string, content_hash string, relative_output_path string, arrival int"
# The responses that count for a page, and what became of it, now and before the step; ``pending`` where its latest
# content has no summary.
RESULTS = (
    f"site string, url string, p {_CHOICE}, r {_CHOICE}, status string, pending boolean, owns boolean, "
    "claim_hash string, file_name string, result string, was string"
)
COUNTS = ("discovered", "processed", "skipped", "failed", "cached")
PAGE, FILE = ("site", "url"), ("site", "file_name")


@dataclass(frozen=True)
class CorpusState:
    """The logs of a state folder."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS

    def log(self, name: str, schema: str, keys: tuple[str, ...] = PAGE, spread: tuple[str, ...] = PAGE) -> BucketLog:
        return BucketLog(f"{self.folder}/{name}", schema, keys, spread, self.buckets)

    @property
    def pages(self) -> BucketLog:
        return self.log("pages", PAGES, ("capture_id",))

    @property
    def summaries(self) -> BucketLog:
        return self.log("summaries", SUMMARIES)

    @property
    def claims(self) -> BucketLog:
        return self.log("claims", CLAIMS, (*FILE, "url"), FILE)

    @property
    def manifest(self) -> BucketLog:
        return self.log("manifest", f"{MANIFEST}, arrival int, gone boolean")

    @property
    def results(self) -> BucketLog:
        return self.log("results", RESULTS)

    @property
    def counters(self) -> BucketLog:
        return self.log("counters", "site string, " + ", ".join(f"{c} bigint" for c in COUNTS), ("site",), ("site",))

    def pieces(self, before: int = 1 << 60) -> dict[str, Pieces]:
        return read_commit(self.spark, f"{self.folder}/{COMMITS}", before, self.buckets)

    @classmethod
    def stored(cls, spark: SparkSession, folder: str) -> CorpusState:
        """A state with the number of buckets that it was begun with."""
        begun = stored_buckets(spark, f"{folder}/{COMMITS}")
        return cls(spark, folder, begun or BUCKETS)


def _on(left: str, right: str, columns: tuple[str, ...]):
    condition = F.lit(True)
    for c in columns:
        condition = condition & (F.col(f"{left}.{c}") == F.col(f"{right}.{c}"))
    return condition


def _judged(state: CorpusState, known: Pieces, captures: DataFrame, step: str, batch: int) -> tuple[DataFrame, list[int]]:
    """Narrow rows of the pages that a batch touches, and their buckets: the response that stands for a page, and its earlier result."""
    spark = state.spark
    touched = state.pages.append(extract_pages(flagged_shells(captures)), step)
    arrived = state.pages.steps(spark, [step], touched)
    fields = [F.col(f"flag.{field.split(':')[0]}") for field in _FLAG.split(", ")]
    choice = F.struct(*fields, F.lit(-batch).alias("late"), "outcome", "content_hash")
    seen = least_flags(arrived.select(*PAGE, "channel", choice.alias("c")), F.col("c"))
    rows = seen.alias("n").join(state.results.newest(spark, known, touched).alias("k"), _on("n", "k", PAGE), "left").select(
        "n.site",
        "n.url",
        F.least("n.p", "k.p").alias("p"),
        F.least("n.r", "k.r").alias("r"),
        F.col("k.result").alias("known_result"),
        F.col("k.owns").alias("known_owns"),
        F.col("k.claim_hash").alias("known_hash"),
        F.col("k.file_name").alias("known_name"),
    )
    status = F.when(F.col("c").isNull(), F.lit(FETCH_FAILED)).otherwise(F.col("c.outcome"))
    kept = F.coalesce(F.lower("known_hash") == F.lower("c.content_hash"), F.lit(False))
    columns = {"capture_id": F.col("c.capture_id"), "arrival": -F.col("c.late"), "status": status, "fresh": (status == SUCCESS) & ~kept}
    return materialize(chosen_flags(rows).withColumns(columns).drop("c"), "judged"), touched


def _texts(state: CorpusState, judged: DataFrame, touched: list[int]) -> DataFrame:
    """Pages whose chosen content has no summary yet, read from the batches and buckets where they lie."""
    wanted = judged.filter("fresh").select(*PAGE, "capture_id", "arrival")
    arrivals = [r.arrival for r in wanted.select("arrival").distinct().collect()]
    stored = state.pages.steps(state.spark, [f"{BATCH}{a}" for a in sorted(arrivals)], touched).withColumnRenamed("step", "arrival")
    texts = stored.join(broadcast_if_small(wanted), [*PAGE, "capture_id", "arrival"], "left_semi")
    # A response may be in a batch more than once.
    once = texts.dropDuplicates(list(PAGE)).select("capture_id", *PAGE, "title", "fetched_at", "markdown", "outcome", "content_hash")
    return once.withColumn("rank", F.col("capture_id"))


def _claims(state: CorpusState, judged: DataFrame, batch: int, buckets: list[int]) -> DataFrame:
    """Claims that a batch makes, and releases of those that no longer hold."""
    made = state.summaries.steps(state.spark, [f"{BATCH}{batch}"], buckets).filter(F.col("markdown").isNotNull())
    claims = made.select(*FILE, "url", F.lit(True).alias("active"), "title", "content_hash", "relative_output_path", F.lit(batch).alias("arrival"))
    named = made.select(*PAGE, "file_name")
    held = judged.filter(F.col("known_name").isNotNull()).alias("j").join(named.alias("n"), _on("j", "n", PAGE), "left")
    over = (F.col("j.status") != SUCCESS) | (F.col("n.file_name") != F.col("j.known_name"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("title", "content_hash", "relative_output_path")]
    released = held.filter(over).select("j.site", F.col("j.known_name").alias("file_name"), "j.url", F.lit(False).alias("active"), *nothing, F.lit(batch).alias("arrival"))
    return claims.unionByName(released)


def _standing(state: CorpusState, before: Pieces, after: Pieces, step: str, buckets: list[int]) -> tuple[DataFrame, DataFrame]:
    """How pages stand after a step of claims.

    First the claims on the touched files that are new, or whose page owns the file (``owns``) or did so before
    (``owned``); then the pages that owned a file and own none any more.
    """
    spark = state.spark
    names = state.claims.steps(spark, [step], buckets).select(*FILE).distinct()
    old = state.claims.newest(spark, before, buckets).filter("active").join(names, list(FILE), "left_semi")
    new = state.claims.newest(spark, after, buckets).filter("active").join(names, list(FILE), "left_semi")
    old_owner = old.groupBy(*FILE).agg(F.min("url").alias("url"))
    new_owner = new.groupBy(*FILE).agg(F.min("url").alias("url"))
    rows = new.alias("c").join(new_owner.alias("n"), _on("c", "n", FILE)).join(old_owner.alias("o"), _on("c", "o", FILE), "left")
    owned = F.coalesce(F.col("c.url") == F.col("o.url"), F.lit(False))
    changed = F.col("c.arrival") == int(step.removeprefix(BATCH))
    rows = rows.select("c.*", (F.col("c.url") == F.col("n.url")).alias("owns"), owned.alias("owned"), changed.alias("changed"))
    standing = materialize(rows.filter("changed or owns or owned"), "standing")
    return standing, old_owner.select(*PAGE).join(standing.filter("owns").select(*PAGE), list(PAGE), "left_anti")


def _results(state: CorpusState, known: Pieces, judged: DataFrame, standing: DataFrame) -> DataFrame:
    """Results of all pages that a batch touches, and of others that gain or lose a file through it."""
    claims = standing.select(*PAGE, "file_name", "content_hash", "owns", "changed")
    pages = judged.alias("j").join(claims.alias("c"), _on("j", "c", PAGE), "left")
    failed = F.col("j.fresh") & ~F.coalesce(F.col("c.changed"), F.lit(False))
    usable = F.col("j.status") == SUCCESS
    touched = pages.select(
        "j.site",
        "j.url",
        "j.p",
        "j.r",
        "j.status",
        failed.alias("pending"),
        (usable & F.coalesce(F.col("c.owns"), F.col("j.known_owns"), F.lit(False))).alias("owns"),
        F.when(usable, F.coalesce(F.col("c.content_hash"), F.col("j.known_hash"))).alias("claim_hash"),
        F.when(usable, F.coalesce(F.col("c.file_name"), F.col("j.known_name"))).alias("file_name"),
        F.col("j.known_result").alias("was"),
    )
    moved = claims.join(judged.select(*PAGE), list(PAGE), "left_anti")
    earlier = state.results.newest(state.spark, known, state.results.buckets_of(moved))
    others = moved.alias("c").join(earlier.alias("k"), _on("c", "k", PAGE))
    others = others.select("k.site", "k.url", "k.p", "k.r", "k.status", "k.pending", "c.owns", "k.claim_hash", "k.file_name", F.col("k.result").alias("was"))
    result = F.when(F.col("status") != SUCCESS, F.col("status")).when(F.col("owns") & ~F.col("pending"), F.lit(PROCESSED)).otherwise(F.lit(FAILED))
    return touched.unionByName(others).withColumn("result", result)


def _counted(state: CorpusState, known: Pieces, results: DataFrame) -> DataFrame:
    """Counters of the sites that have new results: the earlier ones, less what the pages were, plus what they are."""

    def change(*kinds: str):
        return F.count_if(F.col("result").isin(*kinds)) - F.count_if(F.coalesce(F.col("was").isin(*kinds), F.lit(False)))

    changes = results.groupBy("site").agg(
        F.count_if(F.col("was").isNull()).alias("discovered"),
        change(PROCESSED).alias("processed"),
        change(SKIPPED).alias("skipped"),
        change(FETCH_FAILED, FAILED).alias("failed"),
        F.lit(0).cast("bigint").alias("cached"),
    )
    changes = materialize(changes, "changes")
    before = state.counters.newest(state.spark, known, state.counters.buckets_of(changes))
    both = changes.alias("n").join(before.alias("k"), "site", "left")
    return both.select("site", *[(F.col(f"n.{c}") + F.coalesce(F.col(f"k.{c}"), F.lit(0))).alias(c) for c in COUNTS])


def apply_batch(
    captures: DataFrame,
    batch: int,
    state: str,
    summarize: Callable[[DataFrame], DataFrame] | None = None,
    compact_every: int = 20,
    as_of: str = "1970-01-01 00:00:00",
    buckets: int = BUCKETS,
) -> dict[str, int]:
    """Fold one batch of captures into the corpus below ``state`` and return what it did, as observed while writing.

    In whatever order captures arrive, the state afterwards is that of a batch build over all of them: the response that
    stands for a page, the owner of a file (the first page by URL whose summary claims the name; the others fail), the
    manifest and the counters. A page keeps its document while a summary of newer content is missing, and loses it when
    its response is no longer usable. Changed documents are written under ``changes/batch=N``; running a batch again
    writes the same folders, so a replay after a failure changes nothing. Every ``compact_every`` batches the buckets
    written since become snapshots. ``buckets`` is fixed with the first batch: some million pages each serve well.
    """
    spark, step = captures.sparkSession, f"{BATCH}{batch}"
    at = CorpusState(spark, state, buckets)
    commit = at.pieces(batch)
    known = commit.get("results", {})
    judged, touched = _judged(at, known, captures, step, batch)
    made = at.summaries.append((summarize or as_summaries)(_texts(at, judged, touched)), step)
    claimed = at.claims.append(_claims(at, judged, batch, made), step)
    earlier = commit.get("claims", {})
    after = with_step(earlier, claimed, step)
    standing, dropped = _standing(at, earlier, after, step, claimed)

    entries = standing.filter("owns and (changed or not owned)")
    entries = entries.withColumns({"last_generated_at": F.lit(as_of), "gone": F.lit(False)}).select(*at.manifest.columns)
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in entries.dtypes if c not in (*PAGE, "gone")]
    tombs = dropped.select(*PAGE, *empty, F.lit(True).alias("gone")).select(*at.manifest.columns)
    listed = at.manifest.append(entries.unionByName(tombs), step)
    documents_of(at, at.manifest.steps(spark, [step], listed).filter(~F.col("gone"))).write.mode("overwrite").parquet(f"{state}/changes/{step}")

    seen = Observation()
    results = _results(at, known, judged, standing).observe(
        seen,
        F.count("*").alias("touched"),
        F.count_if(F.col("was").isNull()).alias("new"),
        F.count_if(F.coalesce(F.col("was"), F.lit("")) != F.col("result")).alias("changed"),
        *[F.count_if(F.col("result") == kind).alias(kind) for kind in (PROCESSED, SKIPPED, FETCH_FAILED, FAILED)],
    )
    judged_in = at.results.append(results, step)
    counted = _counted(at, commit.get("counters", {}), at.results.steps(spark, [step], judged_in))
    written = {"claims": claimed, "manifest": listed, "results": judged_in, "counters": at.counters.append(counted, step)}

    logs = {"claims": at.claims, "manifest": at.manifest, "results": at.results, "counters": at.counters}
    pieces = {name: with_step(commit.get(name, {}), written[name], step) for name in logs}
    if (batch + 1) % compact_every == 0:
        pieces = {name: log.compacted(spark, pieces[name], batch) for name, log in logs.items()}
    write_commit(spark, f"{state}/{COMMITS}", batch, pieces, buckets)
    return seen.get


def stream_incremental(
    captures: DataFrame,
    state: str,
    summarize: Callable[[DataFrame], DataFrame] | None = None,
    compact_every: int = 20,
    as_of: str = "1970-01-01 00:00:00",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Run every micro-batch of a captures stream through :func:`apply_batch` until the input is used up.

    Back-pressure comes from the source (``maxFilesPerTrigger`` and the like).
    """
    return (
        captures.writeStream.foreachBatch(
            lambda df, batch: apply_batch(df, batch, state, summarize, compact_every, as_of, buckets)
        )
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def documents_of(state: CorpusState, entries: DataFrame) -> DataFrame:
    """Summaries behind manifest rows with their ``arrival``, read from the batches and buckets where they lie."""
    keys = entries.select(*PAGE, "arrival")
    places = keys.select("arrival", state.summaries.bucket().alias("bucket")).distinct().collect()
    steps = [f"{BATCH}{a}" for a in sorted({place.arrival for place in places})]
    stored = state.summaries.steps(state.spark, steps, {place.bucket for place in places}).withColumnRenamed("step", "arrival")
    return stored.join(keys, [*PAGE, "arrival"], "left_semi").select(*state.summaries.columns)


def _entries(spark: SparkSession, state: str, batch: int) -> tuple[CorpusState, DataFrame]:
    at = CorpusState.stored(spark, state)
    return at, at.manifest.newest(spark, at.pieces(batch).get("manifest", {})).filter(~F.col("gone"))


def manifest_as_of(spark: SparkSession, state: str, batch: int) -> DataFrame:
    """Manifest as left by all batches before ``batch``."""
    return _entries(spark, state, batch)[1].drop("arrival", "gone")


def current_manifest(spark: SparkSession, state: str) -> DataFrame:
    """Manifest after all finished batches."""
    return manifest_as_of(spark, state, 1 << 60)


def current_counters(spark: SparkSession, state: str) -> DataFrame:
    """Counters of every site after all finished batches, as of a build over all captures."""
    at = CorpusState.stored(spark, state)
    return at.counters.newest(spark, at.pieces().get("counters", {}))


def current_summaries(spark: SparkSession, state: str) -> DataFrame:
    """Summary rows of all pages that own a document; ``rank`` is the number of the response they were made from."""
    return documents_of(*_entries(spark, state, 1 << 60))


def current_documents(spark: SparkSession, state: str, generator: str = BuildOptions().generator) -> DataFrame:
    """Every document after all finished batches, as ``page_files`` of a build."""
    return page_files(current_summaries(spark, state), generator)
