"""Change detection with keyed streaming state instead of a manifest table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.extract import extract_pages
from corpusloom.operators.incremental import succeeded
from corpusloom.operators.triage import scan_captures

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Times as microseconds: rows and state would give them to Python in different forms.
_VERSION = "site string, url string, capture_id bigint, content_hash string, micros bigint"
_NEWEST = "content_hash string, micros bigint, capture_id bigint"


class ChangedVersions(StatefulProcessor):
    """Versions of a page that differ from the newest one seen before them; the state is that version's hash and place."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getValueState("newest", _NEWEST)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self._newest.update((initialState.content_hash, initialState.micros, initialState.capture_id))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self._newest.get()
        content, place = (before[0], (before[1], before[2])) if before is not None else (None, (None, None))
        moved = False
        for version in sorted(rows, key=lambda r: (r.micros, r.capture_id)):
            at = version.micros, version.capture_id
            if place[0] is not None and at <= place:
                continue  # it arrived late, or again
            if version.content_hash != content:
                yield version
            content, place, moved = version.content_hash, at, True
        if moved:
            self._newest.update((content, *place))

    def close(self) -> None:
        pass


def stream_change_state(captures: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Stream of page versions that differ from the version before.

    The state is the hash, time and number of the newest version per ``(site, url)``, kept in the state store of the
    partition that owns the key; bodies are reduced to their hash before they are shuffled. A version older than the
    newest one seen is no change, so whatever the order of arrival, the last version emitted for a page has the newest
    content. With a ``manifest`` a new stream begins with its hashes, as after a run that wrote it: what is unchanged
    since then is not emitted again.
    """
    # Spark's default store keeps all keys on the heap.
    captures.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    pages = succeeded(extract_pages(scan_captures(captures).drop("title")))
    # In the columns of the output: versions are passed on as they are.
    hashes = pages.select("site", "url", "capture_id", "content_hash", F.unix_micros("fetched_at").alias("micros"))
    begin = None
    if manifest is not None:
        known = manifest.select("site", "url", F.lower("content_hash").alias("content_hash"))
        unplaced = {name: F.lit(None).cast("bigint") for name in ("micros", "capture_id")}
        begin = known.dropDuplicates(["site", "url"]).withColumns(unplaced).groupBy("site", "url")
    changed = hashes.groupBy("site", "url").transformWithState(ChangedVersions(), _VERSION, "Append", "None", initialState=begin)
    return changed.select("site", "url", "capture_id", "content_hash", F.timestamp_micros("micros").alias("fetched_at"))
