"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def place(names: list[str], wanted: str) -> int:
    """Where a column stands: its exact name first, then without case."""
    at = [i for i, n in enumerate(names) if n == wanted] or [i for i, n in enumerate(names) if n.lower() == wanted.lower()]
    if not at:
        raise ValueError(f"no column {wanted!r} among {names}")
    return at[0]


def take(df: DataFrame, row: str | None = None, apart: str | None = None, **wanted: str) -> DataFrame:
    """Project ``new=old`` columns and nothing else.

    Names are matched exactly first, then without case, so extra columns that
    clash with an output, an internal name or differ only in case do no harm.
    ``row`` adds a struct that holds every column of the input as it was, but the one
    named ``apart``, which is taken on its own and need not be carried twice.
    """
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    out = [plain[f"c{place(names, old)}"].alias(new) for new, old in wanted.items()]
    if row:
        skip = f"c{place(names, apart)}" if apart else None
        out.append(F.struct(*(plain[c] for c in plain.columns if c != skip), F.lit(0).alias("_")).alias(row))
    return plain.select(*out)


def restore(df: DataFrame, row: str, names: list[str], replaced: dict[int, Column] | None = None) -> DataFrame:
    """The columns that ``take(row=...)`` put aside, some replaced by place."""
    replaced = replaced or {}
    return df.select(*((replaced[i] if i in replaced else F.col(f"{row}.c{i}")).alias(n) for i, n in enumerate(names)))


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(name).to_pylist()


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(array: pa.Array, most_bytes: int = 1 << 20):
    """(first row, end row) of runs of about ``most_bytes``, one row at least."""
    _, offsets = utf8(array)
    at = 0
    while at < len(array):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        yield at, min(end, len(array))
        at = end


def meet(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join by ``names``, and by a hash of them. The right side was summed by the names themselves, so for this join both sides
    are dealt out anew, and Spark can split the partitions of keys that very many rows share."""
    other = right.withColumnsRenamed({n: f"_{n}" for n in names})
    same = F.xxhash64(*names) == F.xxhash64(*(f"_{n}" for n in names))
    for n in names:
        same &= F.col(n) == F.col(f"_{n}")
    return left.join(other, same, how).drop(*(f"_{n}" for n in names))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python workers in small batches, which bounds the memory of both sides. For entry points, not operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session (or the context's configuration). Where it is unset
    and the master is local, as in tests, a folder in the warehouse is used; on a cluster it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
    return posixpath.join(root, f"{what}-{uuid.uuid4().hex}")


#: Folders that this process has written; names only.
_WRITTEN: list[str] = []


def written() -> int:
    """How many folders operators have stored so far, for ``release(since=...)``."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete what operators have stored, once the results made from it are consumed; returns the number of folders.

    ``since``: only what came after so many folders; ``keep``: but the last so many.
    """
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(gone)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The folder stays until ``release``, as results are read lazily.
    """
    path = shared_folder(df.sparkSession, what)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
