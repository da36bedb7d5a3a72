"""Driver tables in the role of the engine's relations, as DataFrames and as SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

FILES = """files AS (
  SELECT doc_id AS id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, lang AS language, n_chars AS size, md5(text) AS hash FROM documents
)"""
SYMBOLS = """symbols AS (
  SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS file_id, p_name AS name, p_type AS kind, p_partkey AS line_start, p_partkey + p_size AS line_end,
         p_type || ' ' || p_name AS signature, p_size > 25 AS is_exported
  FROM part
)"""
CALLS = """steps AS (
  SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS callee, l_linenumber AS line
  FROM lineitem
), calls AS (
  SELECT caller AS caller_symbol_id, callee AS callee_symbol_id, min(line) AS line, CAST(1.0 AS DOUBLE) AS confidence
  FROM steps WHERE callee IS NOT NULL AND caller <> callee GROUP BY caller, callee
)"""
#: Orders as symbols, and the cheaper ones among a customer's next five orders as what an order calls: a sparse graph.
ORDER_SYMBOLS = """symbols AS (
  SELECT o_orderkey AS id, o_custkey % 40 AS file_id, o_orderpriority AS name, o_orderstatus AS kind, o_orderkey AS line_start, o_orderkey AS line_end, o_orderpriority AS signature, o_orderstatus <> 'P' AS is_exported FROM orders
)"""
ORDER_CALLS = """later AS (
  SELECT o_orderkey AS caller, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_custkey FROM orders
), calls AS (
  SELECT a.caller AS caller_symbol_id, b.caller AS callee_symbol_id, CAST(b.n - a.n AS INTEGER) AS line, CAST(1.0 AS DOUBLE) AS confidence FROM later a JOIN later b ON a.o_custkey = b.o_custkey AND b.n - a.n BETWEEN 1 AND 5 AND b.price < a.price
)"""
COMMITS = """commits AS (
  SELECT DISTINCT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS commit_hash, event_type AS file_path FROM events
)"""


@dataclass
class StandIns:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.table("documents").select(F.col("doc_id").alias("id"), path.alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), F.md5(F.col("text").cast("binary")).alias("hash"))

    @cached_property
    def symbols(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("file_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("line_start"), (F.col("p_partkey") + F.col("p_size")).alias("line_end"), F.concat_ws(" ", "p_type", "p_name").alias("signature"), (F.col("p_size") > 25).alias("is_exported")
        )

    @cached_property
    def calls(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
        steps = self.table("lineitem").select(F.col("l_partkey").alias("caller"), F.lead("l_partkey").over(order).alias("callee"), F.col("l_linenumber").alias("line"))
        edges = steps.where("callee is not null and caller <> callee").groupBy(F.col("caller").alias("caller_symbol_id"), F.col("callee").alias("callee_symbol_id"))
        return edges.agg(F.min("line").alias("line"), F.lit(1.0).alias("confidence"))

    @cached_property
    def order_symbols(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("file_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("line_start"), F.col("o_orderkey").alias("line_end"), F.col("o_orderpriority").alias("signature"), (F.col("o_orderstatus") != "P").alias("is_exported"))

    @cached_property
    def order_seeds(self) -> DataFrame:
        """Every order, a customer's together, as only they call each other."""
        return self.table("orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("near"))

    @cached_property
    def order_calls(self) -> DataFrame:
        order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        nexts = F.array(*(F.struct(F.lead("o_orderkey", k).over(order).alias("callee"), F.lead("o_totalprice", k).over(order).alias("price"), F.lit(k).alias("line")) for k in range(1, 6)))
        each = self.table("orders").select("o_orderkey", "o_totalprice", nexts.alias("nexts")).select("o_orderkey", "o_totalprice", F.explode("nexts").alias("to"))
        return each.where("to.price < o_totalprice").select(F.col("o_orderkey").alias("caller_symbol_id"), F.col("to.callee").alias("callee_symbol_id"), F.col("to.line").alias("line"), F.lit(1.0).alias("confidence"))

    @cached_property
    def commits(self) -> DataFrame:
        day = F.date_format(F.col("ts"), "yyyy-MM-dd")
        return self.table("events").select(F.concat(F.col("user_id").cast("string"), F.lit("/"), day).alias("commit_hash"), F.col("event_type").alias("file_path")).distinct()

    @cached_property
    def order_commits(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").cast("string").alias("commit_hash"), F.col("l_partkey").cast("string").alias("file_path")).distinct()
