"""Lookups: projections, filters and joins over the stored relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import base_name, stem, tokens
from . import substrings

#: Rows that searches return at most.
SEARCH_LIMIT, PATH_LIMIT, EXPORT_LIMIT = 50, 10, 15


def with_path(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")


def symbol_by_id(symbols: DataFrame, files: DataFrame, number: int) -> DataFrame:
    return with_path(symbols.where(F.col("id") == number), files)


def symbols_by_file(symbols: DataFrame, files: DataFrame, path: str | None = None) -> DataFrame:
    """Symbols of one file, or of each, in order of their lines."""
    chosen = files if path is None else files.where(F.col("path") == path)
    return with_path(symbols, chosen).orderBy("file_path", "line_start", "id")


def symbols_by_name(symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    return with_path(symbols.where(F.col("name") == name), files)


def symbols_of_names(symbols: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """Symbols that have one of ``names`` (name)."""
    return with_path(symbols.join(names.select("name").distinct(), "name", "left_semi").select(*symbols.columns), files)


def exported_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return with_path(symbols.where("is_exported"), files)


def callers(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(callee_symbol_id, caller symbol ..., call_line): duplicates of an edge stay."""
    edges = calls.select("callee_symbol_id", F.col("caller_symbol_id").alias("id"), F.col("line").alias("call_line"))
    return with_path(edges.join(symbols, "id"), files)


def callees(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    edges = calls.select("caller_symbol_id", F.col("callee_symbol_id").alias("id"), F.col("line").alias("call_line"))
    return with_path(edges.join(symbols, "id"), files)


def type_users(type_refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    edges = type_refs.select("referenced_symbol_id", F.col("symbol_id").alias("id"))
    return with_path(edges.join(symbols, "id"), files)


def type_targets(type_refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    edges = type_refs.select("symbol_id", F.col("referenced_symbol_id").alias("id"))
    return with_path(edges.join(symbols, "id"), files)


def co_changes(pairs: DataFrame) -> DataFrame:
    """(path, file, change_count, confidence), from either side."""
    sides = (("file_path_a", "file_path_b"), ("file_path_b", "file_path_a"))
    return reduce(DataFrame.union, (pairs.select(F.col(a).alias("path"), F.col(b).alias("file"), "change_count", "confidence") for a, b in sides)).distinct()


def co_changes_of(pairs: DataFrame, path: str) -> DataFrame:
    return co_changes(pairs).where(F.col("path") == path).orderBy(F.desc("confidence"), "file")


def patterns(rows: DataFrame, category: str | None = None) -> DataFrame:
    chosen = rows if category is None else rows.where(F.col("category") == category)
    return chosen.orderBy("category", F.desc("confidence"), "name")


def stats(files: DataFrame, symbols: DataFrame, calls: DataFrame, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(metric, value): totals and the number of files in each language."""
    totals = {"files": files, "symbols": symbols, "calls": calls, "co_changes": pairs, "patterns": rows}
    counted = [df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value") for name, df in totals.items()]
    by_language = files.groupBy("language").agg(F.count("*").alias("value")).select(F.concat(F.lit("language:"), F.col("language")).alias("metric"), "value")
    return reduce(DataFrame.union, [*counted, by_language])


def _dyadic(start: str, end: str) -> Column:
    """The cells that start..end touches: (level, part, at, side). A level's cells are 2 ** level places, the most that fit into the interval, so it touches three at most.

    Of a cell of side 0 the interval holds the places from ``at`` on, of one of side 1 those up to ``at``.
    """
    size = F.col(end).cast("long") - F.col(start).cast("long") + 1
    near = F.floor(F.log2(size.cast("double"))).cast("int")
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    level = F.when(power(near) > size, near - 1).otherwise(near)  # doubles round large sizes up
    first, last = (F.call_function("shiftright", F.col(c).cast("long"), level) for c in (start, end))
    from_, to = F.col(start).cast("long"), F.col(end).cast("long")
    cell = lambda part: F.struct(level.alias("level"), part.alias("part"), F.when((part == last) & (part > first), to).otherwise(F.greatest(from_, F.call_function("shiftleft", part, level))).alias("at"), F.when((part == last) & (part > first), 1).otherwise(0).alias("side"))
    return F.transform(F.sequence(first, last), cell)


def symbol_at(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """For each place (file_id, line) the tightest symbol around it; ties go to the earlier start, then the lesser id.

    An interval stands in the cells of its own size that it touches, three at most, and holds of each the places from one on or up to one.
    A place stands in the cell of each size that its file has intervals of. So the tightest interval is a running
    minimum over a cell's rows in order of their places, however many intervals lie over each other; no pair of an interval and a place is made.
    Intervals that end before they start, or lack an end, hold nothing.
    """
    order = F.struct((F.col("line_end") - F.col("line_start")).alias("width"), "line_start", "id", "name")
    spread = symbols.where("line_end >= line_start").select("file_id", order.alias("own"), F.explode(_dyadic("line_start", "line_end")).alias("cell")).select("file_id", "cell.*", "own")
    sizes = spread.groupBy("file_id").agg(F.collect_set("level").alias("levels"))  # at most 64 a file
    asked = places.select("file_id", F.col("line").cast("long").alias("at"), "line").join(sizes, "file_id").withColumn("level", F.explode("levels"))
    points = asked.select("file_id", "level", F.call_function("shiftright", F.col("at"), F.col("level")).alias("part"), "at", "line", F.lit(None).cast("int").alias("side"), F.lit(None).cast(spread.schema["own"].dataType).alias("own"))
    # dealt by cells, as a join before may have dealt by files, of which one can hold most rows
    rows = points.unionByName(spread.withColumn("line", F.lit(None).cast(places.schema["line"].dataType))).repartition("file_id", "level", "part")
    cell = Window.partitionBy("file_id", "level", "part")
    best = F.least(*(F.min(F.when(F.col("side") == side, F.col("own"))).over(cell.orderBy(turn)) for side, turn in enumerate((F.asc("at"), F.desc("at")))))
    met = rows.withColumn("best", best).where("side is null and best is not null")
    return met.groupBy("file_id", "line").agg(F.min("best").alias("best")).select("file_id", "line", F.col("best.id").alias("symbol_id"), F.col("best.name").alias("name"), F.col("best.width").cast("long").alias("width"))


def files_by_path(files: DataFrame, symbols: DataFrame, like: str | None = None) -> DataFrame:
    """Files with the number of their symbols."""
    chosen = files if like is None else files.where(F.col("path").ilike(like))
    counted = symbols.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("symbol_count"))
    return chosen.join(counted, "id", "left").withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)))


def imports_of(imports: DataFrame, files: DataFrame, path: str | None = None) -> DataFrame:
    """Imports of one file, or of each, in their order: (file_path, source_path, imported_names, is_default, is_namespace)."""
    chosen = files if path is None else files.where(F.col("path") == path)
    return with_path(imports, chosen).orderBy("file_path", "id").select("file_path", "source_path", "imported_names", "is_default", "is_namespace")


def tests_of(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(callee_symbol_id, path, name, line_start) of callers in a path that says test."""
    found = callers(calls, symbols, files).where(F.col("file_path").contains("test"))
    return found.select("callee_symbol_id", "file_path", "name", "line_start").distinct()


def tests_named_like(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, path): files named base.test.* or base.spec.* of a target's path that say test."""
    tests = files.where(F.col("path").contains("test")).select(F.col("path").alias("test_path"), F.regexp_replace("path", r"\.(test|spec)\.[^/]*$", "").alias("base")).where(F.col("test_path").rlike(r"\.(test|spec)\.[^/]*$"))
    return targets.select(F.col("path").alias("target"), stem(F.col("path")).alias("base")).join(tests, "base").select("target", F.col("test_path").alias("path"))


def directory_exports(symbols: DataFrame, files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(dir, exports): the first exported names below each directory, or each of ``wanted`` (dir), by kind and name."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below = files.select(F.col("id").alias("file_id"), F.explode(above).alias("dir"))
    if wanted is not None:
        below = below.join(wanted.select("dir").distinct(), "dir", "left_semi")
    each = below.join(symbols.where("is_exported").select("file_id", "kind", "name", "id"), "file_id")
    rank = F.row_number().over(Window.partitionBy("dir").orderBy("kind", "name", "id"))
    first = each.withColumn("rank", rank).where(F.col("rank") <= EXPORT_LIMIT)
    return first.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), ", ").alias("exports"))


def token_table(rows: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """(id, field, pos, token): the inverted index."""
    each = reduce(DataFrame.union, (rows.select(F.col(id_column).alias("id"), F.lit(f).alias("field"), F.posexplode(tokens(F.col(f))).alias("pos", "token")) for f in fields))
    return each


#: Fields of a symbol that are searched.
TEXT_FIELDS = ("name", "signature", "doc_comment", "tags_text")


def symbol_tokens(symbols: DataFrame) -> DataFrame:
    """The inverted index of symbols: (id, field, pos, token)."""
    text = symbols.withColumn("tags_text", F.array_join("tags", " ")) if "tags" in symbols.columns else symbols
    return token_table(text, "id", [c for c in TEXT_FIELDS if c in text.columns])


def phrase_search(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase_id, id): rows that hold all tokens of a phrase side by side in one field.

    phrases: (phrase_id, words array). A row's runs of as many tokens as a phrase has are joined whole, so a frequent token meets no
    phrase that the row does not hold. A row's tokens and runs are one group.
    """
    asked = phrases.where(F.size("words") > 0).select("phrase_id", F.col("words").alias("run")).distinct()
    sizes = asked.agg(F.collect_set(F.size("run")).alias("sizes"))  # one row
    rows = index.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("field", "pos", "token"))).alias("all"))
    last = lambda i, n: F.get("all", i + n - 2)
    # tokens of other fields or places stand between where the index was filtered
    whole = lambda i, n: (last(i, n)["field"] == F.element_at("all", i)["field"]) & (last(i, n)["pos"] == F.element_at("all", i)["pos"] + n - 1)
    starts = lambda n: F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: F.coalesce(whole(i, n), F.lit(False)))
    runs = F.array_distinct(F.flatten(F.transform("sizes", lambda n: F.transform(starts(n), lambda i: F.transform(F.slice("all", i, n), lambda t: t["token"])))))
    each = rows.crossJoin(F.broadcast(sizes)).select("id", F.explode(runs).alias("run"))
    return each.hint("merge").join(asked, "run").select("phrase_id", "id")  # Spark takes exploded rows for few and would send them all to each task


#: Fields of a symbol in which a keyword without token matches is looked for.
LIKE_FIELDS = ["name", "signature"]
#: So many words of questions at most are handed to the scan of a stored index as a filter.
PUSHED_WORDS = 1000


def symbol_grams(symbols: DataFrame) -> DataFrame:
    """The trigram postings of symbols: (gram, id)."""
    return substrings.postings(symbols, "id", LIKE_FIELDS)


def path_grams(files: DataFrame) -> DataFrame:
    return substrings.postings(files, "id", ["path"])


def first_by_id(hits: DataFrame, of: str, limit: int | None) -> DataFrame:
    """The first ``limit`` rows of each value of ``of``, with their place as row_pos; without a limit all, unnumbered, as then nothing need be gathered by value."""
    if limit is None:
        return hits
    return hits.withColumn("row_pos", F.row_number().over(Window.partitionBy(of).orderBy("id"))).where(F.col("row_pos") <= limit)


def search_symbols(symbols: DataFrame, keywords: DataFrame, limit: int | None = SEARCH_LIMIT, index: DataFrame | None = None, grams: DataFrame | None = None) -> DataFrame:
    """(keyword, row_pos, symbol ...): token matches of each distinct keyword, or else names and signatures that contain it.

    keywords: (keyword), any number of them. White space parts a keyword into phrases, any of which may match; at most
    ``limit`` symbols a keyword, by id (None: all, without row_pos). ``index``, ``grams``: the inverted index and the trigram postings, if they are stored;
    else they are made.
    """
    asked = keywords.select("keyword").distinct()
    terms = asked.select("keyword", F.explode(F.array_remove(F.split("keyword", r"\s+"), "")).alias("term")).select("keyword", tokens(F.col("term")).alias("words")).withColumn("phrase_id", F.struct("keyword", "words"))
    stored = symbol_tokens(symbols) if index is None else index
    if index is not None:
        words = [r["w"] for r in terms.select(F.explode("words").alias("w")).distinct().limit(PUSHED_WORDS + 1).collect()]
        if len(words) <= PUSHED_WORDS:  # reaches the scan of the stored index; for more words the join alone decides
            stored = stored.where(F.col("token").isin(*words))
    hits = phrase_search(stored, terms.select("phrase_id", "words")).select(F.col("phrase_id.keyword").alias("keyword"), "id").distinct()
    missed = asked.join(hits.select("keyword").distinct(), "keyword", "left_anti").withColumn("pattern", F.concat(F.lit("%"), F.col("keyword"), F.lit("%")))
    looser = substrings.matches(symbol_grams(symbols) if grams is None else grams, symbols, "id", LIKE_FIELDS, missed).join(missed, "pattern").select("keyword", "id")
    return first_by_id(hits.union(looser), "keyword", limit).join(symbols, "id")


def search_paths(files: DataFrame, patterns: DataFrame, limit: int | None = PATH_LIMIT, grams: DataFrame | None = None) -> DataFrame:
    """(pattern, row_pos, id, path): files whose path matches a LIKE pattern, at most ``limit`` a pattern, by id (None: all, without row_pos)."""
    found = substrings.matches(path_grams(files) if grams is None else grams, files, "id", ["path"], patterns)
    return first_by_id(found, "pattern", limit).join(files.select("id", "path"), "id")


def file_name(path):
    return stem(base_name(path))
