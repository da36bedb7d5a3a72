"""A keyed table that is brought up to date by batches: only the buckets of a batch's keys are written anew."""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import IndexStore, latest


class KeyedTable:
    """The last row of each key, below a folder: rows lie in buckets by a hash of the key.

    A batch's rows meet the stored ones of their own buckets only; those buckets are written to a new folder, the others keep
    their files. A manifest names each bucket's folder and is published whole or not at all, so a reader sees one
    version, and of two writers at once one fails. A batch that was applied may be applied again.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], order: list[str], buckets: int = 64):
        self.spark, self.root, self.key, self.order, self.buckets = spark, root.rstrip("/"), key, order, buckets
        self._files = IndexStore(spark, root)

    def manifest(self) -> dict[int, str]:
        """bucket -> folder, as many as there are buckets at most."""
        name = self._files.current()
        return {} if name is None else {int(k): v for k, v in json.loads(name).items()}

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame) -> list[int]:
        """Take in a batch; returns the buckets that were written."""
        rows = batch.withColumn("_bucket", self._bucket())
        known = self.manifest()
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return []
        old = [posixpath.join(known[b], f"_bucket={b}") for b in touched if b in known]
        if old:
            rows = rows.unionByName(self.spark.read.schema(batch.schema).parquet(*old).withColumn("_bucket", self._bucket()))
        folder = posixpath.join(self.root, "rows", uuid.uuid4().hex)
        latest(rows, self.key, self.order).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        self._files._publish(posixpath.join(self.root, "current"), json.dumps(known | {b: folder for b in touched}))
        return touched

    def read(self, schema) -> DataFrame:
        """All rows; only the folders that the manifest names are listed."""
        paths = [posixpath.join(folder, f"_bucket={b}") for b, folder in sorted(self.manifest().items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, schema, *values) -> DataFrame:
        """The row of one key; one bucket is read."""
        row = self.spark.createDataFrame([values], ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in self.key))
        bucket = row.select(self._bucket()).first()[0]
        folder = self.manifest().get(bucket)
        if folder is None:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(posixpath.join(folder, f"_bucket={bucket}"))
        for c, v in zip(self.key, values, strict=True):
            found = found.where(F.col(c).eqNullSafe(F.lit(v)))
        return found
