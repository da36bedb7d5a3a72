"""A store of immutable shards with size-tiered compaction and versioned manifests.

Arrivals are appended as small shards. Runs of similar size (a tier is a factor of four) are
merged into files of a target size. Each change ends with one atomic step: a version file is
renamed into place and fails if that version exists, so a reader sees a whole version or the
one before, and a second writer has to plan again. Rows, plans and manifests are worked on by
DataFrame functions only; the driver touches the names of version files.

Layout below the root: ``data/_write=<write>/_shard=<id>/*.parquet`` (rows as a struct, so that
no column name can clash), ``manifests/<write>/*.parquet``, ``versions/<number>``. A shard's name
holds the version that made it, and rows are found by shard and write, so names never meet again:
an arrival may come any number of times, in any order, and each time is a shard of its own.

An append writes rows where they are, without a shuffle: an arrival gets a file from each task
that has rows of it. ``clustered`` deals rows out by arrival first, for input in no order. A merge
moves the rows of each merged shard to one task, which writes one file.

Defined results: rows with a null arrival form arrival -1; null text has 0 bytes; rows of any
size are kept whole; equal rows are all kept; an empty table commits an empty version; a shard
beyond the target stays as it is; columns may have any names, also such as differ in case only.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .frames import place, stored, take

MANIFEST = "shard string, first_arrival bigint, arrivals bigint, n_rows bigint, n_bytes bigint, tier int, location string"
#: Arrivals of a block: running sums of a tier are taken in blocks and over blocks, so no window holds a whole tier.
BLOCK = 4096


class Conflict(RuntimeError):
    """Another writer has committed the version that this one planned."""


def tier(n_bytes: Column, target: int) -> Column:
    """0 for the smallest runs, one more for each factor of four, 9 for shards of half the target or more."""
    out = F.when(n_bytes * 2 >= target, 9)
    for k in range(8):
        out = out.when(n_bytes * 4 ** (8 - k) < target * 4, k)
    return out.otherwise(8).cast("int")


def plan(manifest: DataFrame, target: int, least_runs: int = 4) -> DataFrame:
    """(shard, location, tier, bin): runs to merge, a bin of a tier into one shard.

    Neighbours in a tier, by first arrival, fill bins of the target size; bins of fewer than ``least_runs`` wait.
    """
    runs = manifest.where("tier < 9").withColumn("block", F.expr(f"first_arrival div {BLOCK}"))
    earlier = Window.partitionBy("tier").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    base = runs.groupBy("tier", "block").agg(F.sum("n_bytes").alias("bytes")).select("tier", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("tier", "block").orderBy("first_arrival", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("inside", F.coalesce(F.sum("n_bytes").over(before), F.lit(0))).join(base, ["tier", "block"])
    binned = placed.withColumn("bin", F.floor((F.col("inside") + F.col("base")) / target))
    counted = binned.groupBy("tier", "bin").agg(F.count("*").alias("runs")).where(F.col("runs") >= least_runs)
    return binned.join(counted, ["tier", "bin"]).select("shard", "location", "tier", "bin")


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = 32 << 20):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target
        self.kind = StructType.fromDDL("arrival bigint, row struct<>, size bigint, _shard string")  # of rows, as the last append had them

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(self.root, *parts))

    def _files(self):
        return self._path("versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        files = self._files()
        if not files.exists(self._path("versions")):
            return 0
        return max((int(s.getPath().getName()) for s in files.listStatus(self._path("versions")) if s.getPath().getName().isdigit()), default=0)

    def _commit(self, number: int, manifest: DataFrame) -> None:
        """Write the manifest, then let a version file that names it appear whole, once."""
        own = uuid.uuid4().hex
        manifest.write.parquet(posixpath.join(self.root, "manifests", own))
        jvm, files = self.spark._jvm, self._files()
        part, final = self._path("versions", f"_{own}"), self._path("versions", f"{number:08d}")
        files.mkdirs(self._path("versions"))
        out = files.create(part, False)
        out.write(bytearray(own.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        gateway = self.spark.sparkContext._gateway
        try:
            context.rename(part, final, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as error:
            files.delete(part, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {number} exists") from error
            raise

    def manifest(self, number: int | None = None) -> DataFrame:
        """Shards of a version, the last one by default."""
        number = self.version() if number is None else number
        if not number:
            return self.spark.createDataFrame([], MANIFEST)
        stream = self._files().open(self._path("versions", f"{number:08d}"))
        own = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return self.spark.read.schema(MANIFEST).parquet(posixpath.join(self.root, "manifests", own))

    # rows

    def _write(self, rows: DataFrame, location: str) -> None:
        """rows (_shard, row, arrival, size): a folder a shard, with a file for each task that has rows of it."""
        rows.write.partitionBy("_shard").option("compression", "zstd").parquet(posixpath.join(self.root, "data", f"_write={location}"))

    def _listed(self, rows: DataFrame, location: str) -> DataFrame:
        """Manifest rows of what was just written."""
        written = self.spark.read.schema(rows.select("arrival", "size", "_shard").schema).parquet(posixpath.join(self.root, "data", f"_write={location}"))
        sized = written.groupBy("_shard").agg(F.min("arrival").alias("first_arrival"), F.count_distinct("arrival").alias("arrivals"), F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
        return sized.select(F.col("_shard").alias("shard"), "first_arrival", "arrivals", "n_rows", "n_bytes", tier(F.col("n_bytes"), self.target).alias("tier"), F.lit(location).alias("location"))

    def _stored(self, shards: DataFrame) -> DataFrame:
        """Rows of the given shards (shard, location, ...): one scan of the data, pruned to their folders."""
        files = self._files()
        if not files.exists(self._path("data")) or not files.globStatus(self._path("data", "*", "*", "*.parquet")):
            return self.spark.createDataFrame([], self.kind).join(shards.withColumnRenamed("shard", "_shard"), "_shard")
        rows = self.spark.read.parquet(self._path("data").toString())
        listed = shards.withColumnRenamed("shard", "_shard").withColumnRenamed("location", "_write")
        return rows.join(listed, ["_write", "_shard"]).withColumnRenamed("_write", "location")

    def append(self, df: DataFrame, arrival: Column, text: str = "text", clustered: bool = False) -> int:
        """Add the rows of ``df`` as one small shard for each value of ``arrival``; returns the version."""
        number, location = self.version() + 1, f"w{uuid.uuid4().hex}"
        own = f"arrival-{location}"  # no column has this name
        held = take(df.select("*", arrival.cast("long").alias(own)), row="row", apart=own, arrival=own, text=text)
        size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
        numbered = held.select(F.coalesce("arrival", F.lit(-1).cast("long")).alias("arrival"), "row", size.alias("size"))
        numbered = numbered.withColumn("_shard", F.concat(F.lit(f"a{number}_"), F.lpad(F.col("arrival").cast("string"), 12, "0")))
        self.kind = numbered.schema
        self._write(numbered.repartition("_shard") if clustered else numbered, location)
        self._commit(number, self.manifest(number - 1).unionByName(self._listed(numbered, location)).coalesce(1 + number // 64))
        return number

    def compact(self, least_runs: int = 4) -> int:
        """Merge runs of similar size; returns the version (the current one if nothing was to do)."""
        number, location = self.version() + 1, f"w{uuid.uuid4().hex}"
        now = self.manifest(number - 1)
        moves = stored(plan(now, self.target, least_runs), "moves")  # a row a run; planned once
        bins = moves.select("tier", "bin").distinct()
        groups = bins.count()
        if not groups:
            return number - 1
        into = F.concat(F.lit(f"m{number}_"), F.col("tier").cast("string"), F.lit("_"), F.col("bin").cast("string"))
        slots = bins.withColumn("slot", (F.row_number().over(Window.orderBy("tier", "bin")) - 1).cast("int"))  # a row a merged shard
        rows = self._stored(moves.join(slots, ["tier", "bin"]).select("shard", "location", into.alias("into"), "slot"))
        merged = rows.select(F.col("into").alias("_shard"), "row", "arrival", "size", "slot").repartitionById(groups, "slot").drop("slot")
        self._write(merged, location)
        self._commit(number, now.join(moves.select("shard", "location"), ["shard", "location"], "left_anti").select(now.columns).unionByName(self._listed(merged, location)).coalesce(1 + number // 64))
        return number

    def read(self, number: int | None = None) -> DataFrame:
        """Rows of a version: row (struct of c0, c1, ...), arrival, size, _shard, and the shard's manifest columns."""
        return self._stored(self.manifest(number))


#: Appends of ``report``; later ones bring arrivals that lie before those of earlier ones.
WAVES = 3


def report(docs: DataFrame, root: str, rows_per_arrival: int = 1000, target: int = 32 << 20) -> DataFrame:
    """Append the documents in WAVES, every third arrival in each, compact after each, and read the last version back."""
    store = ShardStore(docs.sparkSession, root, target)
    at = {name: place(docs.columns, name) for name in ("doc_id", "text")}
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    arrival = F.floor(F.col(f"c{at['doc_id']}") / rows_per_arrival).cast("long")
    for wave in range(WAVES):
        store.append(plain.where(F.pmod(F.coalesce(arrival, F.lit(-1)), F.lit(WAVES)) == wave), arrival, f"c{at['text']}")
        store.compact()
    return store.read().select(
        F.col(f"row.c{at['doc_id']}").alias("doc_id"), "arrival", F.col("_shard").alias("shard"), F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"), F.col("arrivals").alias("shard_arrivals"), F.col("tier").alias("shard_tier"), F.md5(F.col(f"row.c{at['text']}").cast("binary")).alias("text_md5")
    )


def _tier_sql(n_bytes: str) -> str:
    return f"CASE WHEN {n_bytes} * 2 >= 33554432 THEN 9 " + " ".join(f"WHEN {n_bytes} * {4 ** (8 - k)} < 134217728 THEN {k}" for k in range(8)) + " ELSE 8 END"


def _wave_sql(k: int) -> str:
    """State after wave k: x (arrival, its rows and bytes, the shard it is in) and v (the version)."""
    return f"""
), y{k} AS (
  SELECT arrival, n_rows, n_bytes, shard FROM x{k - 1} UNION ALL
  SELECT arrival, n_rows, n_bytes, 'a' || ((SELECT v FROM v{k - 1}) + 1) || '_' || lpad(CAST(arrival AS VARCHAR), 12, '0') FROM a WHERE ((arrival % {WAVES}) + {WAVES}) % {WAVES} = {k}
), g{k} AS (
  SELECT shard, min(arrival) AS first_arrival, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, {_tier_sql("CAST(sum(n_bytes) AS BIGINT)")} AS tier FROM y{k} GROUP BY shard
), b{k} AS (
  SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY tier ORDER BY first_arrival, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 33554432 AS bin FROM g{k} WHERE tier < 9
), z{k} AS (
  SELECT shard, tier, bin, count(*) OVER (PARTITION BY tier, bin) >= 4 AS merges FROM b{k}
), v{k} AS (
  SELECT v + 1 + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM z{k} WHERE merges) AS v FROM v{k - 1}
), x{k} AS (
  SELECT arrival, n_rows, n_bytes, CASE WHEN merges THEN 'm' || ((SELECT v FROM v{k - 1}) + 2) || '_' || tier || '_' || CAST(bin AS BIGINT) ELSE shard END AS shard FROM y{k} LEFT JOIN z{k} USING (shard)"""


#: ``report`` as DuckDB SQL.
REPORT_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(floor(doc_id / 1000.0) AS BIGINT), -1) AS arrival, text, coalesce(strlen(text), 0) AS size FROM documents
), a AS (
  SELECT arrival, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS n_bytes FROM d GROUP BY arrival
), "v-1" AS (
  SELECT 0 AS v
), "x-1" AS (
  SELECT arrival, n_rows, n_bytes, '' AS shard FROM a WHERE false{"".join(_wave_sql(k) for k in range(WAVES)).replace("v-1", '"v-1"').replace("x-1", '"x-1"')}
), m AS (
  SELECT shard, CAST(sum(n_rows) AS BIGINT) AS shard_rows, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_arrivals FROM x{WAVES - 1} GROUP BY shard
)
SELECT doc_id, arrival, shard, shard_rows, shard_bytes, shard_arrivals, CAST({_tier_sql("shard_bytes")} AS INTEGER) AS shard_tier, md5(text) AS text_md5
FROM d JOIN x{WAVES - 1} USING (arrival) JOIN m USING (shard)
"""
