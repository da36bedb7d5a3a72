"""Convention statistics. Each function returns rows (category, name, value, instance_count, total_count, confidence, examples)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import base_name, convention, two_places
from .lookup import with_path

#: Fewest symbols, files, functions, imports, and hits above which a row is made; examples shown.
FEWEST_SYMBOLS, FEWEST_FILES, FEWEST_FUNCTIONS, FEWEST_IMPORTS, HITS = 3, 3, 3, 5, 2
EXAMPLES, OUTLIERS = 3, 5
NAMED_KINDS = ("function", "class", "method", "variable")
#: A tie between styles goes to the one listed first.
STYLES = ("camelCase", "PascalCase", "snake_case", "UPPER_SNAKE_CASE", "kebab-case")
COLUMNS = ("category", "name", "value", "instance_count", "total_count", "confidence", "examples")


def row(category, name, value, instances, total, confidence, examples=None) -> list[Column]:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = (as_column(category), as_column(name), as_column(value), as_column(instances).cast("long"), as_column(total).cast("long"), as_column(confidence).cast("double"), F.array().cast("array<string>") if examples is None else examples)
    return [c.alias(n) for c, n in zip(made, COLUMNS, strict=True)]


def _ratio(a, b) -> Column:
    return F.col(a) / F.col(b)


def _first(items: DataFrame, keys: list[str], label: Column, order: list[str], most: int) -> DataFrame:
    """The first ``most`` labels of each key by ``order``, ranked before they are gathered."""
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= most)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", label.alias("label")))), lambda s: s["label"]).alias("examples"))


def _style_rank(style: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STYLES)), style)


def _named(symbols: DataFrame, files: DataFrame, kinds=NAMED_KINDS) -> DataFrame:
    wanted = symbols.where(F.length("name") > 1)
    if kinds is not None:
        wanted = wanted.where(F.col("kind").isin(*kinds))
    return with_path(wanted, files).withColumn("style", convention(F.col("name")))


def _dominant(named: DataFrame) -> DataFrame:
    """(kind, style, best, total) of kinds with enough names and a style."""
    counts = named.groupBy("kind", "style").agg(F.count("*").alias("n"))
    total = counts.groupBy("kind").agg(F.sum("n").alias("total"), F.max(F.when(F.col("style").isNotNull(), F.struct(F.col("n").alias("n"), (-_style_rank(F.col("style"))).alias("r"), F.col("style").alias("style")))).alias("b"))
    return total.where(F.col("b").isNotNull() & (F.col("total") >= FEWEST_SYMBOLS)).select("kind", F.col("b.style").alias("dominant"), F.col("b.n").alias("best"), "total")


def naming_conventions(symbols: DataFrame, files: DataFrame, kinds=NAMED_KINDS) -> DataFrame:
    """The commonest style of each kind. kinds=None takes every kind."""
    named = _named(symbols, files, kinds)
    top = _dominant(named)
    own = named.join(F.broadcast(top.select("kind", "dominant")), "kind").where("style = dominant")  # a row for each kind
    shown = _first(own, ["kind"], F.concat_ws(":", "file_path", "line_start"), ["id"], EXAMPLES)
    return top.join(shown, "kind").select(*row("naming", F.concat("kind", F.lit("_convention")), F.col("dominant"), F.col("best"), F.col("total"), two_places(_ratio("best", "total")), F.col("examples")))


def naming_outliers(symbols: DataFrame, files: DataFrame, kinds=NAMED_KINDS) -> DataFrame:
    """A few names of another style; the count is that of the names shown."""
    named = _named(symbols, files, kinds)
    top = _dominant(named).where("best < total")
    other = named.join(F.broadcast(top.select("kind", "dominant")), "kind").where("not (style <=> dominant)")
    shown = _first(other, ["kind"], F.concat(F.col("name"), F.lit(" ("), F.concat_ws(":", "file_path", "line_start"), F.lit(")")), ["id"], OUTLIERS)
    return top.join(shown, "kind").select(*row("naming", F.concat("kind", F.lit("_outliers")), F.array_join("examples", "; "), F.size("examples"), F.col("total"), 1 - _ratio("best", "total")))


def file_convention(files: DataFrame) -> DataFrame:
    """The commonest style of file names, of all files."""
    stems = files.select(F.regexp_replace(base_name(F.col("path")), r"\.[^.]+$", "").alias("stem"))
    style = F.when(F.length("stem") >= 2, convention(F.col("stem")))
    counts = stems.select(style.alias("style")).groupBy("style").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("style").isNotNull() & (F.col("style") != "UPPER_SNAKE_CASE"), F.struct(F.col("n").alias("n"), (-_style_rank(F.col("style"))).alias("r"), F.col("style").alias("style"))))
    top = counts.agg(F.sum("n").alias("total"), best.alias("b")).where(F.col("b").isNotNull() & (F.col("total") >= FEWEST_FILES))
    return top.select(*row("naming", "file_convention", F.col("b.style"), F.col("b.n"), F.col("total"), two_places(F.col("b.n") / F.col("total"))))


def _functions(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin("function", "method"))


def signature_patterns(symbols: DataFrame, files: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Result types and async signatures among functions and methods."""
    own = _functions(symbols) if functions is None else functions
    lower = F.lower(F.coalesce("signature", F.lit("")))
    result = lower.contains("result<") | lower.contains("result[") | lower.contains("-> result")
    later = lower.contains("promise<") | lower.contains("async")
    marked = with_path(own, files).withColumn("result", result).withColumn("later", later)
    counts = marked.agg(F.count("*").alias("total"), F.count_if("result").alias("results"), F.count_if("later").alias("laters")).where(F.col("total") >= FEWEST_FUNCTIONS)
    shown = _first(marked.where("result"), ["result"], F.concat_ws(":", "file_path", "line_start"), ["id"], EXAMPLES).select("examples")
    # one row meets one row
    results = counts.where(F.col("results") > HITS).crossJoin(F.broadcast(shown)).select(*row("error_handling", "result_type", "Result type", F.col("results"), F.col("total"), _ratio("results", "total"), F.col("examples")))
    return results.unionByName(counts.where(F.col("laters") > HITS).select(*row("structure", "async_pattern", "async/await", F.col("laters"), F.col("total"), _ratio("laters", "total"))))


def export_ratio(symbols: DataFrame) -> DataFrame:
    counts = symbols.agg(F.count("*").alias("total"), F.count_if(F.coalesce("is_exported", F.lit(False))).alias("n")).where("total > 0")
    return counts.select(*row("structure", "export_ratio", F.concat(F.col("n").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" symbols exported")), F.col("n"), F.col("total"), two_places(_ratio("n", "total"))))


def test_patterns(files: DataFrame) -> DataFrame:
    """Where tests are, how they are named, and their share."""
    path = F.col("path")
    tests = path.contains("test") | path.contains("spec") | path.contains("__tests__")
    apart = tests & (path.startswith("tests/") | path.startswith("test/"))
    many = lambda c: F.count_if(c)
    c = files.agg(F.count("*").alias("total"), many(tests).alias("tests"), many(apart).alias("apart"), many(tests & path.contains(".test.")).alias("dot_test"), many(tests & path.contains(".spec.")).alias("dot_spec"), many(tests & path.contains("_test.")).alias("low_test")).where("tests > 0")
    near = F.col("tests") - F.col("apart")
    where = F.when(F.col("apart") > near, "separate directory").when(near > F.col("apart"), "alongside source").otherwise("unknown")
    named = F.when((F.col("dot_test") > F.col("dot_spec")) & (F.col("dot_test") > F.col("low_test")), "*.test.*").when(F.col("dot_spec") > F.col("dot_test"), "*.spec.*").when(F.col("low_test") > F.col("dot_test"), "*_test.*").otherwise("unknown")
    said = F.concat(F.col("tests").cast("string"), F.lit(" test files / "), F.col("total").cast("string"), F.lit(" total files"))
    return reduce(
        DataFrame.unionByName,
        [
            c.select(*row("tests", "location", where, F.col("tests"), F.col("tests"), 1.0)),
            c.select(*row("tests", "naming", named, F.col("tests"), F.col("total"), _ratio("tests", "total"))),
            c.select(*row("tests", "coverage_ratio", said, F.col("tests"), F.col("total"), two_places(_ratio("tests", "total")))),
        ],
    )


def import_style(imports: DataFrame) -> DataFrame:
    c = imports.agg(F.count("*").alias("total"), F.count_if(F.col("source_path").startswith(".")).alias("near")).where(F.col("total") >= FEWEST_IMPORTS)
    share = _ratio("near", "total")
    most = F.greatest("near", F.col("total") - F.col("near"))
    return c.select(*row("imports", "style", F.when(share > 0.5, "mostly relative imports").otherwise("mostly absolute imports"), most, F.col("total"), two_places(most / F.col("total"))))


def extract(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """All convention rows of an index."""
    parts = [naming_conventions(symbols, files), naming_outliers(symbols, files), file_convention(files), signature_patterns(symbols, files), export_ratio(symbols), test_patterns(files), import_style(imports)]
    return reduce(DataFrame.unionByName, parts)
