"""Commit history as a data source."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, functions as F

_MARK = "\x01"


def commits(spark: SparkSession, root: str, most: int = 500) -> DataFrame:
    """(commit_hash, ts, file_path) of the last ``most`` commits; no rows where there is no history. The driver reads at most so many commits."""
    # -z: names as they are, whatever their characters
    said = subprocess.run(["git", "-C", root, "log", "-z", f"--max-count={most}", "--name-only", "--diff-filter=ACDMR", f"--format={_MARK}%H %cI"], capture_output=True)
    rows, commit, ts = [], None, None
    for item in said.stdout.decode(errors="replace").split("\0") if said.returncode == 0 else ():
        head, _, name = item.partition("\n") if item.startswith(_MARK) else ("", "", item)
        if head:
            commit, ts = head[1:].split(" ", 1)
        if name.strip("\n"):
            rows.append((commit, ts, name.lstrip("\n")))
    made = spark.createDataFrame(rows, "commit_hash string, ts string, file_path string")
    return made.withColumn("ts", F.to_timestamp("ts"))


def last_changed(history: DataFrame) -> DataFrame:
    """(path, last_changed) of every file in the history."""
    return history.groupBy(F.col("file_path").alias("path")).agg(F.max("ts").alias("last_changed"))
