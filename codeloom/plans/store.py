"""The index: relations made from extraction, kept as one versioned set of tables."""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import cochange, lookup, patterns, resolve
from ..schemas import PARSED_DDL, TABLES, conform
from ..sources.project import diff
from .lineage import cut


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_parents(rows: DataFrame) -> DataFrame:
    """Rows (file_id, ordinal, name, kind, parent_name) with ``parent_ordinal``.

    A file's classes come first; a member belongs to the last row of its parent's name before
    it in that order, whatever its kind. Classes have no parent.
    """
    placed = rows.withColumn("turn", F.struct((F.col("kind") != "class").alias("late"), F.col("ordinal").alias("ordinal")))
    owners = placed.select("file_id", F.col("name").alias("parent_name"), F.col("turn").alias("owner"))
    children = placed.where((F.col("kind") != "class") & F.col("parent_name").isNotNull())
    met = children.select("file_id", "ordinal", "parent_name", "turn").join(owners, ["file_id", "parent_name"]).where(F.col("owner") < F.col("turn"))
    best = met.groupBy("file_id", "ordinal").agg(F.max("owner").alias("owner")).select("file_id", "ordinal", F.col("owner.ordinal").alias("parent_ordinal"))
    return placed.drop("turn").join(best, ["file_id", "ordinal"], "left")


@dataclass
class Index:
    """All relations of a project."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    call_sites: DataFrame
    type_hints: DataFrame
    implements: DataFrame
    type_refs: DataFrame
    calls: DataFrame
    co_changes: DataFrame
    patterns: DataFrame
    meta: DataFrame
    tokens: DataFrame
    symbol_grams: DataFrame
    path_grams: DataFrame


def relations(parsed: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, imports, call_sites, type_hints and implements of extraction rows.

    Ids are dense in the order of (path, position), a file's classes first, so the same tree always has the same ids.
    """
    spark = parsed.sparkSession
    ranked = _dense(parsed.select("path").distinct(), ["path"], "id")
    rows = cut(parsed.join(ranked, "path"))
    files = rows.select("id", "path", "language", "size", "hash")
    placed = rows.select(F.col("id").alias("file_id"), F.posexplode("symbols").alias("ordinal", "s")).select("file_id", "ordinal", "s.*")
    linked = with_parents(placed)
    ids = _dense(linked.select("file_id", (F.col("kind") != "class").alias("late"), "ordinal"), ["file_id", "late", "ordinal"], "id").select("file_id", "ordinal", "id")
    named = cut(linked.join(ids, ["file_id", "ordinal"]))
    parents = ids.select("file_id", F.col("ordinal").alias("parent_ordinal"), F.col("id").alias("parent_symbol_id"))
    symbols = named.join(parents, ["file_id", "parent_ordinal"], "left")
    made = {"files": files, "symbols": symbols}
    made["implements"] = named.where("kind = 'class'").select(F.col("id").alias("class_symbol_id"), F.explode("implements").alias("interface_name")).distinct()
    for table in ("imports", "call_sites", "type_hints"):
        each = rows.select(F.col("id").alias("file_id"), F.posexplode(table).alias("ordinal", "s")).select("file_id", "ordinal", "s.*")
        each = cut(each)
        made[table] = each.join(_dense(each.select("file_id", "ordinal"), ["file_id", "ordinal"], "id"), ["file_id", "ordinal"])
    made["type_refs"] = spark.createDataFrame([], TABLES["type_refs"])
    return {table: conform(df, table) for table, df in made.items()}


def _dense(keys: DataFrame, order: list[str], name: str) -> DataFrame:
    """``keys`` (distinct rows) numbered from 1 by ``order``: ranks inside range partitions, plus the rows of the partitions before."""
    n = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = cut(keys.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row a partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn(name, (F.col("_rank") + F.col("_before")).cast("long")).drop("_part", "_rank", "_before")


def build(parsed: DataFrame, commits: DataFrame | None = None, aliases=(), module: str | None = None, dedupe_edges: bool = False, meta: dict[str, str] | None = None, min_confidence: float = cochange.MIN_CONFIDENCE, most_files: int = cochange.MOST_FILES) -> Index:
    """The whole index of extraction rows and a history."""
    spark = parsed.sparkSession
    r = {k: cut(v) for k, v in relations(parsed).items()}
    calls = cut(conform(resolve.all_calls(r["call_sites"], r["symbols"], r["files"], r["imports"], r["type_hints"], r["implements"], aliases, module, dedupe_edges), "calls"))
    if commits is None:
        pairs = spark.createDataFrame([], TABLES["co_changes"])
    else:
        pairs = conform(cochange.analyze(commits, r["files"], min_confidence, most_files), "co_changes")
    rows = conform(patterns.extract(r["files"], r["symbols"], r["imports"]), "patterns")
    # in order of the tokens, so that a question reads the row groups of its own words only
    tokens = cut(conform(lookup.symbol_tokens(r["symbols"]), "tokens").repartitionByRange("token").sortWithinPartitions("token", "id"))
    grams = {name: cut(df.repartitionByRange("gram").sortWithinPartitions("gram", "id")) for name, df in (("symbol_grams", lookup.symbol_grams(r["symbols"])), ("path_grams", lookup.path_grams(r["files"])))}
    pairs_of = [(k, v) for k, v in (meta or {}).items()]
    return Index(**r, calls=calls, co_changes=cut(pairs), patterns=cut(rows), meta=spark.createDataFrame(pairs_of, TABLES["meta"]), tokens=tokens, **grams)


def refresh(before: DataFrame, texts: DataFrame, parse) -> DataFrame:
    """Extraction rows of a new snapshot (path, text, hash): unchanged files keep their rows, only the others are parsed."""
    state = cut(diff(before.select("path", "hash"), texts.select("path", "hash")))
    kept = before.join(state.where("state = 'unchanged'").select("path"), "path", "left_semi")
    fresh = texts.join(state.where("state in ('new', 'changed')").select("path"), "path", "left_semi")
    return kept.unionByName(parse(fresh.select("path", "text")))


class IndexStore:
    """Versions of an index below a folder. A version is written whole, then named by one small file, so readers never see a half."""

    TABLES = ("files", "symbols", "imports", "call_sites", "type_hints", "implements", "type_refs", "calls", "co_changes", "patterns", "meta", "tokens", "symbol_grams", "path_grams")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def current(self) -> str | None:
        fs, folder = self._fs(posixpath.join(self.root, "current"))
        if not fs.exists(folder):
            return None
        numbers = sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName()).isdigit())
        return self._content(posixpath.join(self.root, "current", numbers[-1])) if numbers else None

    def _content(self, path: str) -> str:
        fs, name = self._fs(path)
        stream = fs.open(name)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def _publish(self, folder: str, text: str) -> None:
        """A file named by the next number, which appears whole or, if another writer was first, not at all."""
        fs, where = self._fs(folder)
        fs.mkdirs(where)
        number = 1 + max((int(n) for s in fs.listStatus(where) if (n := s.getPath().getName()).isdigit()), default=-1)
        _, part = self._fs(posixpath.join(folder, f"_{uuid.uuid4().hex}"))
        _, final = self._fs(posixpath.join(folder, f"{number:08d}"))
        out = fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(part, final, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception:
            fs.delete(part, False)
            raise

    def write(self, index: Index, parsed: DataFrame) -> str:
        version = uuid.uuid4().hex
        for table in self.TABLES:
            getattr(index, table).write.parquet(posixpath.join(self.root, "versions", version, table))
        parsed.write.parquet(posixpath.join(self.root, "versions", version, "parsed"))
        self._publish(posixpath.join(self.root, "current"), version)
        return version

    def read(self) -> Index | None:
        version = self.current()
        if version is None:
            return None
        return Index(**{t: self.spark.read.schema(TABLES[t]).parquet(posixpath.join(self.root, "versions", version, t)) for t in self.TABLES})

    def parsed(self) -> DataFrame | None:
        version = self.current()
        return None if version is None else self.spark.read.schema(PARSED_DDL).parquet(posixpath.join(self.root, "versions", version, "parsed"))

    def _meta_folder(self, key: str) -> str:
        return posixpath.join(self.root, "meta", key.encode().hex())

    def set_meta(self, key: str, value: str) -> None:
        """Set a value beside the versions; it stands until it is set anew or all is cleared."""
        self._publish(self._meta_folder(key), value)

    def get_meta(self, key: str) -> str | None:
        fs, own = self._fs(self._meta_folder(key))
        if fs.exists(own) and (numbers := sorted(n for s in fs.listStatus(own) if (n := s.getPath().getName()).isdigit())):
            return self._content(posixpath.join(self._meta_folder(key), numbers[-1]))
        index = self.read()
        row = index.meta.where(F.col("key") == key).first() if index else None
        return row["value"] if row else None

    def clear(self) -> None:
        fs, root = self._fs(self.root)
        fs.delete(root, True)

    def export(self, table: str, path: str) -> None:
        """A relation as JSON lines."""
        getattr(self.read(), table).write.json(path)


def json_pieces(answer, line: str = "\n"):
    """Text of an answer, a DataFrame or a dict of such, as JSON, piece by piece; a row at a time is held. ``line`` goes between rows."""
    if isinstance(answer, dict):
        yield "{"
        for n, (name, part) in enumerate(answer.items()):
            yield f"{',' if n else ''}{line}{json.dumps(name)}: "
            yield from json_pieces(part, line)
        yield f"{line}}}"
    elif isinstance(answer, tuple):
        yield "["
        for n, part in enumerate(answer):
            yield "," + line if n else line
            yield from json_pieces(part, line)
        yield f"{line}]"
    elif isinstance(answer, DataFrame):
        yield "["
        for n, row in enumerate(answer.select(F.to_json(F.struct(*answer.columns)).alias("row")).toLocalIterator()):
            yield f"{',' if n else ''}{line}{row['row']}"
        yield f"{line}]"
    else:
        yield json.dumps(answer)


def as_json(df: DataFrame) -> str:
    """A small answer as one text; larger ones are written by ``json_pieces``, whole relations by ``IndexStore.export``."""
    return "".join(json_pieces(df))
