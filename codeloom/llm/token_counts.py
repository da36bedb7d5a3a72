"""Exact histogram of encoded lengths, and what follows from it for every context limit.

Defined results: null text counts as empty (length 0); texts of any length are encoded whole;
equal rows, null and repeated keys count one by one; ties don't arise, as a length is one row;
other columns are dropped, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import codec
from .frames import slices, stored, strings, take

#: Lengths in a block of the two-step suffix sums; bounds what one task of the second step sees.
BLOCK = 1024


def lengths(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, length) of every row."""
    narrow = take(docs, key=key, text=text).withColumn("text", F.col("text").cast("string"))

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            sizes = [np.diff(bpe.encode(strings(batch.slice(low, high - low), "text"))[1]) for low, high in slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]), pa.int64())], ["key", "length"])

    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, length bigint").withColumnRenamed("key", key)


def histogram(counted: DataFrame) -> DataFrame:
    """(length, n_docs): one row for each length that occurs."""
    return counted.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L that occurs: documents and tokens of length L or more, the total
    when every document is cut at L, the total over all, and the share of documents up to L."""
    rows = stored(hist, "histogram").withColumn("block", F.expr(f"length div {BLOCK}"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as the longest document has blocks
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    later = blocks.select("block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"later_{c}") for c in "dt"))
    everything = blocks.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("length", "n_docs", "block", F.sum("n_docs").over(inside).alias("d"), F.sum(F.col("n_docs") * F.col("length")).over(inside).alias("t"))
    joined = summed.join(later, "block").crossJoin(F.broadcast(everything))  # one row
    at_least, tokens = F.col("d") + F.col("later_d"), F.col("t") + F.col("later_t")
    return joined.select(
        "length", "n_docs", at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"), (F.col("total_tokens") - tokens + at_least * F.col("length")).alias("truncated_tokens"), "total_tokens", ((F.col("all_docs") - at_least + F.col("n_docs")) / F.col("all_docs")).alias("share_up_to")
    )


def answer(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_tokens, docs_cut) for any limits: what the suffix sums say at the next greater length."""
    asked = F.broadcast(sums.sparkSession.createDataFrame([(n,) for n in limits], "context_limit bigint"))
    # the limits are a stated query set; each looks for one row of the histogram
    after = sums.crossJoin(asked).where(F.col("length") > F.col("context_limit")).groupBy("context_limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "length").alias("after"))
    everything = sums.agg(F.any_value("total_tokens").alias("total_tokens"))  # one row
    cut = F.coalesce("after.docs_at_least", F.lit(0).cast("long"))
    total = F.col("total_tokens") - F.coalesce("after.tokens_at_least", F.lit(0)) + cut * F.col("context_limit")
    return asked.join(after, "context_limit", "left").crossJoin(F.broadcast(everything)).where("total_tokens is not null").select("context_limit", total.alias("truncated_tokens"), cut.alias("docs_cut"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents do not exceed."""
    return sums.where(F.col("share_up_to") >= q).agg(F.min("length").alias("length"))
