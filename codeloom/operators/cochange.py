"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import base_name, dir_name, two_places

#: Fixed values of the mining rules.
MIN_CONFIDENCE, MIN_COUNT, MOST_FILES = 0.3, 2, 30
NEAR_CONFIDENCE, FEWEST, MOST, PART = 0.3, 2, 15, 3


def retained(commits: DataFrame, files: DataFrame | None = None, most_files: int = MOST_FILES) -> DataFrame:
    """(commit_hash, file_path) of commits that touch 1 to ``most_files`` indexed files."""
    own = commits.select("commit_hash", F.regexp_replace("file_path", r"\\", "/").alias("file_path")).distinct()
    if files is not None:
        own = own.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    # the list of a commit's files is bounded: larger commits are left out before it is made
    size = own.groupBy("commit_hash").agg(F.count("*").alias("n")).where(F.col("n") <= most_files)
    return own.join(size.select("commit_hash"), "commit_hash", "left_semi")


def pairs(commits: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """Pairs that meet in enough commits; confidence is the share of the more often changed file's commits.

    A commit's pairs are made from its bounded list of files, so the commits are never joined with themselves.
    """
    per_file = commits.groupBy("file_path").agg(F.count("*").alias("n"))
    total = commits.agg(F.count_distinct("commit_hash").alias("total_commits"))
    lists = commits.groupBy("commit_hash").agg(F.sort_array(F.collect_list("file_path")).alias("f"))
    met = lists.select(F.explode(F.flatten(F.transform("f", lambda a, i: F.transform(F.filter("f", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    counted = met.groupBy(F.col("p.a").alias("file_path_a"), F.col("p.b").alias("file_path_b")).agg(F.count("*").alias("change_count")).where(F.col("change_count") >= min_count)
    sized = counted.join(per_file.select(F.col("file_path").alias("file_path_a"), F.col("n").alias("na")), "file_path_a").join(per_file.select(F.col("file_path").alias("file_path_b"), F.col("n").alias("nb")), "file_path_b")
    share = F.col("change_count") / F.greatest("na", "nb")
    # one row
    return sized.where(share >= min_confidence).crossJoin(F.broadcast(total)).select("file_path_a", "file_path_b", "change_count", "total_commits", two_places(share).alias("confidence"))


def proximity(files: DataFrame) -> DataFrame:
    """Pairs of files in a small directory whose names share a part, for histories that tell nothing."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(base_name(F.col("path")), r"\.[^.]+$", "")), r"[._-]"), lambda p: F.length(p) >= PART)
    named = files.select("path", dir_name(F.col("path")).alias("dir"), parts.alias("parts"))
    small = named.groupBy("dir").agg(F.count("*").alias("n")).where(F.col("n").between(FEWEST, MOST))
    own = named.join(small.select("dir"), "dir")
    # directories hold MOST files at most
    a, b = own.alias("a"), own.alias("b")
    met = a.join(b, (F.col("a.dir") == F.col("b.dir")) & (F.col("a.path") < F.col("b.path"))).where(F.arrays_overlap("a.parts", "b.parts"))
    return met.select(F.col("a.path").alias("file_path_a"), F.col("b.path").alias("file_path_b"), F.lit(1).cast("long").alias("change_count"), F.lit(1).cast("long").alias("total_commits"), F.lit(NEAR_CONFIDENCE).alias("confidence"))


def analyze(commits: DataFrame, files: DataFrame, min_confidence: float = MIN_CONFIDENCE, most_files: int = MOST_FILES) -> DataFrame:
    """Mined pairs, or neighbours by name if the history holds none."""
    mined = pairs(retained(commits, files, most_files), min_confidence)
    return proximity(files) if mined.isEmpty() else mined
