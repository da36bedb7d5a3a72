"""From call sites to call edges: by scope, by imports, by name, and by the receiver's type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import base_name, dir_name, normal_path, stem
from ..plans.lineage import cut

#: Kinds that can be called, and how sure an edge is.
CALLABLE = ("function", "method", "class", "variable", "constant")
SURE, BY_RECEIVER, BY_TYPE = 1.0, 0.7, 0.8


def import_path(from_path: Column, source: Column, aliases: list[tuple[str, str]] = (), module: str | None = None) -> Column:
    """Where an import points: relative to its file, by an alias, below the Go module, or as it says."""
    out = F.when(source.startswith("."), normal_path(F.concat_ws("/", dir_name(from_path), source)))
    for prefix, target in aliases:
        out = out.when(source.startswith(prefix), normal_path(F.concat(F.lit(target), _after(source, prefix))))
    if module:
        out = out.when(source.startswith(module + "/"), _after(source, module + "/"))
    return out.otherwise(source)


def _after(text: Column, prefix: str) -> Column:
    return F.substr(text, F.lit(len(prefix) + 1), F.length(text))


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _callable(symbols: DataFrame, files: DataFrame) -> DataFrame:
    kept = symbols.where(F.col("kind").isin(*CALLABLE))
    return kept.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("symbol_path")), "file_id")


def _in_file(symbols: DataFrame) -> DataFrame:
    """(file_id, name, symbol): the last symbol of a name in a file."""
    return symbols.groupBy("file_id", "name").agg(F.max("id").alias("symbol"))


def callers_of_sites(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sites with the symbol that calls: by full name, else by its last part."""
    own = _in_file(symbols)
    full = own.select("file_id", F.col("name").alias("caller_name"), F.col("symbol").alias("full"))
    last = own.select("file_id", F.col("name").alias("caller_last"), F.col("symbol").alias("part"))
    met = sites.withColumn("caller_last", _last(F.col("caller_name"))).join(full, ["file_id", "caller_name"], "left").join(last, ["file_id", "caller_last"], "left")
    return met.withColumn("caller", F.coalesce("full", "part")).where("caller is not null").drop("full", "part", "caller_last")


def imported_names(imports: DataFrame, files: DataFrame, aliases=(), module=None) -> DataFrame:
    """(file_id, alias, original, target, import_id): one row a name that a file imports."""
    placed = imports.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("from_path")), "file_id")
    named = placed.select("file_id", F.col("id").alias("import_id"), import_path(F.col("from_path"), F.col("source_path"), aliases, module).alias("target"), "original_names", F.explode("imported_names").alias("alias"))
    return named.select("file_id", "import_id", "target", "alias", F.coalesce(F.try_element_at("original_names", F.col("alias")), F.col("alias")).alias("original"))


def path_keys(files: DataFrame) -> DataFrame:
    """(file_id, how, key): everything that an import may call a file by, so that matching is an equi-join."""
    parts = F.split("path", "/")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    base = stem(base_name(F.col("path")))
    one = [
        files.select(F.col("id").alias("file_id"), F.lit("whole").alias("how"), F.col("path").alias("key")),
        files.select("id", F.lit("whole"), F.explode(above)),
        files.select("id", F.lit("whole"), stem(F.col("path"))),
        files.where(F.contains("path", F.lit("/"))).select("id", F.lit("last"), base),
    ]
    return reduce(DataFrame.union, one).distinct()


def reexports(imports: DataFrame, files: DataFrame, aliases=(), module=None) -> DataFrame:
    """(start, target): what a path leads to through files that re-export others wholly, in any number of hops."""
    whole = imports.where(F.col("is_namespace") & (F.size("imported_names") == 0)).join(files.select(F.col("id").alias("file_id"), F.col("path").alias("from_path")), "file_id")
    step = whole.select(stem(F.col("from_path")).alias("start"), import_path(F.col("from_path"), F.col("source_path"), aliases, module).alias("target"))
    index = step.where(F.col("start").rlike(r"/index$")).select(F.regexp_replace("start", r"/index$", "").alias("start"), "target")
    return closure(step.union(index))


def closure(edges: DataFrame) -> DataFrame:
    """(start, target): all pairs that a path of edges (start, target) joins.

    Paths double: pairs that are 2 ** k hops apart are joined with all that are known, which are those of at most 2 ** k hops, so n hops take
    log2(n) rounds of two joins and, where each start has one target, a path is made once. A pair is
    found once, so rings end; the driver learns only whether a round found any.
    """
    found = hop = cut(edges.where("start is not null and target is not null").select("start", "target").distinct())
    while True:
        after = lambda pairs: pairs.select(F.col("start").alias("target"), F.col("target").alias("next"))
        onward = hop.join(after(found), "target").select("start", F.col("next").alias("target"), F.lit(True).alias("fresh"))
        met = onward.union(found.withColumn("fresh", F.lit(False))).groupBy("start", "target").agg(F.bool_and("fresh").alias("fresh"))
        fresh = cut(met.where("fresh").select("start", "target"))
        if fresh.isEmpty():
            return found
        found = found.union(fresh)
        hop = cut(hop.join(after(hop), "target").select("start", F.col("next").alias("target")).distinct())


def call_graph(sites: DataFrame, symbols: DataFrame, files: DataFrame, imports: DataFrame, aliases=(), module=None) -> DataFrame:
    """(caller_symbol_id, callee_symbol_id, line, confidence): an edge a pair of symbols, from its first site."""
    candidates = _callable(symbols, files).select(F.col("id").alias("symbol"), "name", "file_id", "is_exported")
    called = callers_of_sites(sites, symbols.where(F.col("kind").isin(*CALLABLE)))
    same = called.join(_in_file(symbols.where(F.col("kind").isin(*CALLABLE))).select("file_id", F.col("name").alias("callee_name"), "symbol"), ["file_id", "callee_name"]).select("id", "symbol", F.lit(1).alias("how"))
    names = imported_names(imports, files, aliases, module)
    sources = called.select("id", "file_id", F.col("callee_name").alias("alias")).join(names, ["file_id", "alias"])
    # by path key and name together, so that a key that many files share (an index file's) meets only who asks for its names
    offered = path_keys(files).join(candidates.select("file_id", F.col("name").alias("original"), "symbol"), "file_id").groupBy("how", "key", "original").agg(F.min("symbol").alias("symbol"))

    def through(asked: DataFrame, how: int) -> DataFrame:
        """First candidate in a file that the target names. asked: (id, original, target)."""
        wanted = asked.select("id", "original", F.explode(F.array(F.struct(F.lit("whole").alias("how"), F.col("target").alias("key")), F.struct(F.lit("last").alias("how"), base_name(F.col("target")).alias("key")))).alias("w")).select("id", "original", "w.how", "w.key")
        met = wanted.join(offered, ["how", "key", "original"])
        return met.groupBy("id").agg(F.min("symbol").alias("symbol")).select("id", "symbol", F.lit(how).alias("how"))

    direct = through(sources.select("id", "original", "target"), 2)
    chained = through(sources.join(reexports(imports, files, aliases, module).withColumnRenamed("target", "onward"), F.col("target") == F.col("start")).select("id", "original", F.col("onward").alias("target")), 3)
    # by name anywhere: the import's own name for it, or the name as written if that one is unknown
    original = called.select("id", "file_id", "callee_name").join(names.groupBy("file_id", F.col("alias").alias("callee_name")).agg(F.min_by("original", "import_id").alias("original")), ["file_id", "callee_name"], "left").withColumn("original", F.coalesce("original", "callee_name"))
    known = candidates.select(F.col("name").alias("original")).distinct().withColumn("known", F.lit(True))
    wanted = original.join(known, "original", "left").withColumn("name", F.when(F.col("known"), F.col("original")).otherwise(F.col("callee_name")))
    # two exported symbols a name are enough to find the first one outside a file
    first_two = candidates.where("is_exported").groupBy("name", "file_id").agg(F.min("symbol").alias("symbol")).withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("symbol"))).where("rank <= 2")
    anywhere = wanted.join(first_two.withColumnRenamed("file_id", "other"), "name").where("other <> file_id").groupBy("id").agg(F.min("symbol").alias("symbol")).select("id", "symbol", F.lit(4).alias("how"))
    best = reduce(DataFrame.union, [same, direct, chained, anywhere]).groupBy("id").agg(F.min_by("symbol", "how").alias("callee"))
    edges = called.join(best, "id").where("caller <> callee")
    sure = F.when(F.col("receiver_name").isNotNull(), BY_RECEIVER).otherwise(SURE)
    first = edges.groupBy("caller", "callee").agg(F.min(F.struct("id", "line", sure.alias("confidence"))).alias("f"))
    return first.select(F.col("caller").alias("caller_symbol_id"), F.col("callee").alias("callee_symbol_id"), "f.line", "f.confidence")


def method_calls(sites: DataFrame, symbols: DataFrame, imports: DataFrame, hints: DataFrame, implements: DataFrame) -> DataFrame:
    """Edges of calls with a receiver, by what is known of its type."""
    parents = symbols.select(F.col("id").alias("parent_symbol_id"), F.col("name").alias("class_name"), F.col("file_id").alias("class_file"))
    methods = symbols.where(F.col("kind") == "method").join(parents, "parent_symbol_id").select(F.col("id").alias("symbol"), F.col("name").alias("callee_name"), "class_name", "parent_symbol_id", F.col("file_id").alias("method_file"))
    owner = symbols.groupBy("file_id", F.col("name").alias("caller_last")).agg(F.min("id").alias("caller"))
    asked = sites.where("receiver_name is not null").withColumn("caller_last", _last(F.col("caller_name"))).join(owner, ["file_id", "caller_last"])
    scopes = F.array(F.struct(F.lit(0).alias("near"), F.col("caller_last").alias("scope")), F.struct(F.lit(1).alias("near"), F.col("caller_name").alias("scope")), F.struct(F.lit(2).alias("near"), F.lit("__module__").alias("scope")))
    spread = asked.select("id", "file_id", "receiver_name", F.explode(scopes).alias("s")).select("id", "file_id", F.col("receiver_name").alias("variable_name"), "s.near", "s.scope")
    hinted = spread.join(hints.select("file_id", "scope", "variable_name", "type_name", F.col("id").alias("hint_id")), ["file_id", "scope", "variable_name"]).groupBy("id").agg(F.min_by("type_name", F.struct("near", -F.col("hint_id"))).alias("type_name"))
    returned = symbols.where(F.col("return_type").isNotNull()).groupBy(F.col("name").alias("receiver_name")).agg(F.max_by("return_type", "id").alias("returned"))
    typed = asked.join(hinted, "id", "left").join(returned, "receiver_name", "left").withColumn("type_name", F.coalesce("type_name", "returned"))
    # each way of telling is an equi-join with the first method it can lead to, so a common name meets no list of methods
    made = implements.select(F.col("class_symbol_id").alias("parent_symbol_id"), F.col("interface_name").alias("type_name")).distinct()
    imported = imports.select("file_id", F.explode("imported_names").alias("class_name")).distinct()
    ways = (
        methods.select("callee_name", F.col("class_name").alias("type_name"), "symbol"),
        methods.join(made, "parent_symbol_id").select("callee_name", "type_name", "symbol"),
        methods.groupBy("callee_name").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol")).where("n = 1").drop("n"),
        methods.join(imported, "class_name").select("callee_name", "file_id", "symbol"),
        methods.select("callee_name", F.col("method_file").alias("file_id"), "symbol"),
    )
    told = []
    for how, way in enumerate(ways, 1):
        by = [c for c in way.columns if c != "symbol"]
        told.append(typed.join(way.groupBy(*by).agg(F.min("symbol").alias("symbol")), by).select("id", "symbol", F.lit(how).alias("how")))
    best = reduce(DataFrame.union, told).groupBy("id").agg(F.min_by("symbol", "how").alias("callee"))
    edges = asked.join(best, "id").where("caller <> callee").groupBy("caller", "callee").agg(F.min(F.struct("id", "line")).alias("f"))
    return edges.select(F.col("caller").alias("caller_symbol_id"), F.col("callee").alias("callee_symbol_id"), "f.line", F.lit(BY_TYPE).alias("confidence"))


def all_calls(sites, symbols, files, imports, hints, implements, aliases=(), module=None, dedupe_edges: bool = False) -> DataFrame:
    """Both kinds of edges. The same pair may come from either; ``dedupe_edges`` keeps the surer one."""
    both = call_graph(sites, symbols, files, imports, aliases, module).unionByName(method_calls(sites, symbols, imports, hints, implements))
    if not dedupe_edges:
        return both
    best = both.groupBy("caller_symbol_id", "callee_symbol_id").agg(F.max(F.struct("confidence", "line")).alias("b"))
    return best.select("caller_symbol_id", "callee_symbol_id", "b.line", "b.confidence")
