"""Following a changing tree: debounced sessions of changes, and micro-batches that publish new index versions."""

from __future__ import annotations

import time
from itertools import batched

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import EXTENSIONS, load_config

#: Seconds of quiet before a run, and between two looks at the tree; directories not looked at.
QUIET_SECONDS, POLL_SECONDS = 2, 2
BLOCK = 10_000  # paths handed to a refresh at once
UNWATCHED = ("node_modules", "dist", "build", ".git", "coverage", "__pycache__", "vendor", ".venv", ".next")


def watched(changes: DataFrame) -> DataFrame:
    """Changes of source files outside the directories not looked at."""
    endings = tuple(e for group in EXTENSIONS.values() for e in group)
    hit = F.lit(False)
    for ending in endings:
        hit = hit | F.col("path").endswith(ending)
    return changes.where(hit & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, UNWATCHED))))


def debounced(changes: DataFrame, gap: str = f"{QUIET_SECONDS} seconds", late: str | None = None) -> DataFrame:
    """(root, started, ended, n, paths): changes (root, ts, path) gathered until nothing comes for ``gap``.

    Batch or stream; a stream needs ``late``, how long to wait for late changes.
    """
    source = changes.withWatermark("ts", late) if late else changes
    window = F.session_window("ts", gap)
    made = source.groupBy("root", window.alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))
    return made.select("root", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "paths")


def follow(changes: DataFrame, refresh, late: str = "1 second", trigger: dict | None = None, checkpoint: str | None = None):
    """Run ``refresh(paths)`` for each micro-batch of a stream of changes; a batch that fails is tried again on restart.

    All changed paths are handed over, at most BLOCK a call, so a large batch has several calls.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = watched(batch).select("path").distinct().toLocalIterator()  # names only, a partition at a time
        for paths in batched((r["path"] for r in rows), BLOCK):
            refresh(list(paths))

    writer = changes.withWatermark("ts", late).writeStream.foreachBatch(apply).trigger(**(trigger or {"processingTime": f"{POLL_SECONDS} seconds"}))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()


class Watcher:
    """Looks at a tree again and again; when what it saw has changed and then stayed quiet, refreshes the index."""

    def __init__(self, spark: SparkSession, root: str, refresh, config=None):
        self.spark, self.root, self.refresh = spark, root, refresh
        self.config = config or load_config(root)
        self.closed = False

    def snapshot(self) -> tuple:
        """The number of sources and two sums over hashes of their names, times and lengths: one row, however large the tree."""
        from ..sources.project import scan_names

        seen = ("path", "modificationTime", "length")
        sums = (F.sum(F.xxhash64(F.lit(n), *seen).cast("decimal(38,0)")) for n in range(2))
        return tuple(scan_names(self.spark, self.root, self.config).agg(F.count("*"), *sums).first())

    def run(self, rounds: int | None = None) -> int:
        """Number of refreshes; ``rounds`` limits the looks, for tests."""
        last, changed, quiet, done = self.snapshot(), False, 0.0, 0
        while not self.closed and (rounds is None or rounds > 0):
            time.sleep(POLL_SECONDS)
            now = self.snapshot()
            quiet = 0.0 if now != last else quiet + POLL_SECONDS
            changed |= now != last
            last = now
            if changed and quiet >= QUIET_SECONDS:
                self.refresh()
                changed, done = False, done + 1
            rounds = None if rounds is None else rounds - 1
        return done

    def close(self) -> None:
        self.closed = True
