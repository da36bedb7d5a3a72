"""Ranked search: one plan of six passes over the index, for a table of questions.

Distinct keywords and patterns are looked up once, however many questions have them, and each lookup is cut to its limit before
questions meet it. An entry is told by its question and key; its slot (pass and positions in it) is where it came in first,
its relevance the highest that it was given. Passes 3 to 5 start from what earlier passes
found, pass 6 from the words of the question. The result is ordered by relevance, then slot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import concepts, questions as asking
from ..functions.columns import base_name, stem
from ..plans.lineage import cut
from . import lookup

#: Scores.
EXACT, PREFIX, CONTAINS, OTHER, EXPORTED_BONUS, SYNONYM_LOSS, SYNONYM_FLOOR = 100, 85, 70, 50, 5, 15, 20
STEM_EQUAL, DIR_EQUAL, STEM_CONTAINS, PATH_ORIGINAL, PATH_SYNONYM, PATH_LOSS, HAS_SYMBOLS = 85, 80, 75, 50, 35, 10, 5
CALLER, CALLEE, CO_CHANGE, TEST, DIRECTORY = 40, 35, 20, 30, 78
EXPAND_FROM, FILES_FROM, TESTS_FROM = 60, 50, 50
NEIGHBOURS, PARTNERS, DIRECTORY_FILES, DIRECTORY_LEAST = 5, 3, 50, 3
_ENTRY = ("q", "key", "file", "symbol", "kind", "line", "signature", "reason", "relevance", "slot")


def _slot(number: int, *positions) -> Column:
    values = [p.cast("long") if isinstance(p, Column) else F.lit(p).cast("long") for p in positions]
    return F.array(F.lit(number).cast("long"), *values, *[F.lit(0).cast("long")] * (4 - len(values)))


def _entry(df: DataFrame, **columns) -> DataFrame:
    kinds = {"line": "int", "relevance": "int"}
    return df.select("q", *((columns[c] if isinstance(columns.get(c), Column) else F.lit(columns.get(c))).cast(kinds.get(c, "array<bigint>" if c == "slot" else "string")).alias(c) for c in _ENTRY[1:]))


def _merge(entries: DataFrame) -> DataFrame:
    """One entry a key: the highest relevance (the first of equals) in the first slot."""
    rest = F.struct(*(c for c in _ENTRY if c not in ("q", "key", "slot")))
    ranked = entries.withColumn("rank", F.row_number().over(Window.partitionBy("q", "key").orderBy(F.desc("relevance"), "slot")))
    return ranked.groupBy("q", "key").agg(F.min("slot").alias("slot"), F.min_by(rest, "rank").alias("e")).select("q", "key", "e.*", "slot").select(*_ENTRY)


def _add(entries: DataFrame, new: DataFrame) -> DataFrame:
    """``entries`` and the first of each new key that they lack."""
    first = new.withColumn("rank", F.row_number().over(Window.partitionBy("q", "key").orderBy("slot"))).where("rank = 1").drop("rank")
    return entries.unionByName(first.join(entries.select("q", "key"), ["q", "key"], "left_anti"))


def symbol_score(name: Column, keyword: Column, exported: Column) -> Column:
    low, kw = F.lower(name), F.lower(keyword)
    score = F.when(low == kw, EXACT).when(low.startswith(kw), PREFIX).when(F.contains(low, kw), CONTAINS).otherwise(OTHER)
    return F.least(score + F.when(F.coalesce(exported, F.lit(False)), EXPORTED_BONUS).otherwise(0), F.lit(100))


def by_name(symbols: DataFrame, files: DataFrame, asked: DataFrame, tokens: DataFrame | None = None, grams: DataFrame | None = None) -> DataFrame:
    found = lookup.with_path(lookup.search_symbols(symbols, asked, index=tokens, grams=grams), files).join(asked, "keyword")
    score = symbol_score(F.col("name"), F.col("keyword"), F.col("is_exported"))
    score = F.when(F.col("original"), score).otherwise(F.greatest(score - SYNONYM_LOSS, F.lit(SYNONYM_FLOOR)))
    reason = F.when(F.col("original"), F.format_string('Match: "%s" in %s name', "keyword", "kind")).otherwise(F.format_string('Semantic match: "%s" (synonym) in %s name', "keyword", "kind"))
    return _entry(found, key=F.concat_ws(":", "file_path", "name"), file=F.col("file_path"), symbol=F.col("name"), kind=F.col("kind"), line=F.col("line_start"), signature=F.col("signature"), reason=reason, relevance=score, slot=_slot(1, F.col("kw_pos"), F.col("row_pos")))


def by_path(symbols: DataFrame, files: DataFrame, asked: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    patterned = asked.withColumn("pattern", F.concat(F.lit("%"), F.col("keyword"), F.lit("%")))
    hits = lookup.search_paths(files, patterned, grams=grams)
    some = symbols.join(hits.select(F.col("id").alias("file_id")).distinct(), "file_id", "left_semi")
    counted = lookup.files_by_path(hits.select("id").distinct(), some).select("id", "symbol_count")
    found = hits.join(counted, "id").join(patterned, "pattern")
    name, kw = F.lower(stem(base_name(F.col("path")))), F.lower("keyword")
    dirs = F.transform(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.lower)
    base = F.when(name == kw, STEM_EQUAL).when(F.array_contains(dirs, kw), DIR_EQUAL).when(F.contains(name, kw), STEM_CONTAINS).otherwise(F.when(F.col("original"), PATH_ORIGINAL).otherwise(PATH_SYNONYM))
    base = base - F.when(~F.col("original") & (base > PATH_SYNONYM), PATH_LOSS).otherwise(0) + F.when(F.col("symbol_count") > 0, HAS_SYMBOLS).otherwise(0)
    reason = F.concat(F.format_string('File path matches "%s"', "keyword"), F.when(F.col("original"), "").otherwise(" (synonym)"))
    first = found.withColumn("turn", F.row_number().over(Window.partitionBy("q", "path").orderBy("kw_pos"))).where("turn = 1")
    return _entry(first, key=F.concat(F.col("path"), F.lit(":__file__")), file=F.col("path"), reason=reason, relevance=base, slot=_slot(2, F.col("kw_pos"), F.col("row_pos")))


def neighbours(entries: DataFrame, symbols: DataFrame, files: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new entries for callers and callees, edges (q, key, side, rank, label))."""
    start = entries.where((F.col("relevance") >= EXPAND_FROM) & F.col("symbol").isNotNull() & F.col("line").isNotNull())
    # symbols are cut to the found names and files before they are grouped
    named = symbols.join(start.select(F.col("symbol").alias("name")).distinct(), "name", "left_semi")
    placed = lookup.with_path(named, files).select(F.col("file_path").alias("file"), F.col("name").alias("symbol"), "id")
    ids = placed.join(start.select("file", "symbol").distinct(), ["file", "symbol"], "left_semi").groupBy("file", "symbol").agg(F.min("id").alias("start_id"))
    at = start.select("q", "key", "file", "symbol", "slot").join(ids, ["file", "symbol"]).select("q", "key", F.col("symbol").alias("from"), "slot", "start_id")
    asked = at.select("start_id").distinct()
    sides = []
    for side, (found, joined) in enumerate(((lookup.callers(calls, symbols, files), "callee_symbol_id"), (lookup.callees(calls, symbols, files), "caller_symbol_id"))):
        rank = F.row_number().over(Window.partitionBy(joined).orderBy("call_line", "id"))
        near = found.join(asked, F.col(joined) == F.col("start_id"), "left_semi").withColumn("rank", rank).where(F.col("rank") <= NEIGHBOURS)
        met = at.join(near, F.col("start_id") == F.col(joined))
        sides.append(met.select("q", "key", "from", "slot", F.lit(side).alias("side"), "rank", "file_path", "name", F.col("kind").alias("k"), "line_start", F.col("signature").alias("sig")))
    both = sides[0].union(sides[1])
    reason = F.when(F.col("side") == 0, F.concat(F.lit("Calls "), F.col("from"))).otherwise(F.concat(F.lit("Called by "), F.col("from")))
    slot = F.array(F.lit(3).cast("long"), F.element_at("slot", 1) * 1_000_000 + F.element_at("slot", 2), F.element_at("slot", 3), F.col("side").cast("long"), F.col("rank").cast("long"))
    new = _entry(both, key=F.concat_ws(":", "file_path", "name"), file=F.col("file_path"), symbol=F.col("name"), kind=F.col("k"), line=F.col("line_start"), signature=F.col("sig"), reason=reason, relevance=F.when(F.col("side") == 0, CALLER).otherwise(CALLEE), slot=slot)
    return new, both.select("q", "key", "side", "rank", F.concat_ws(":", "file_path", "name").alias("label"))


def partners(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    start = entries.where(F.col("relevance") >= FILES_FROM).groupBy("q", F.col("file").alias("path")).agg(F.min("slot").alias("slot"))
    near = lookup.co_changes(pairs).join(start.select("path").distinct(), "path", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("confidence"), "file"))).where(F.col("rank") <= PARTNERS)
    met = start.join(near, "path")
    reason = F.concat(F.lit("Co-changes with "), F.col("path"), F.lit(" ("), F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("% correlation)"))
    return _entry(met, key=F.concat(F.col("file"), F.lit(":__cochange__")), file=F.col("file"), reason=reason, relevance=CO_CHANGE + F.floor(F.col("confidence") * 20 + 0.5), slot=_slot(4, F.element_at("slot", 1) * 1_000_000 + F.element_at("slot", 2), F.element_at("slot", 3), F.col("rank")))


def tests(entries: DataFrame, files: DataFrame, grams: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Tests named after the files of entries; the first ``limit`` of a question.

    All have the same relevance and no later pass starts from them, so those after ``limit`` others can't be among the best ``limit``; nor can
    those that come after ``limit`` others of the same pattern. An entry that has the key of one already ranks before all of them.
    """
    # entries of one file ask for the same tests; what comes in first has the least of these numbers
    turn = F.struct((F.element_at("slot", 1) * 1_000_000 + F.element_at("slot", 2)).alias("pass"), F.element_at("slot", 3).alias("position"))
    start = entries.where(F.col("relevance") >= TESTS_FROM).groupBy("q", F.col("file").alias("of")).agg(F.min(turn).alias("from"))
    base, name = stem(F.col("of")), stem(base_name(F.col("of")))
    asked = start.select("q", "of", "from", F.posexplode(F.array(F.concat(base, F.lit(".test.%")), F.concat(base, F.lit(".spec.%")), F.concat(F.lit("%test%"), name, F.lit("%")))).alias("n", "pattern"))
    met = asked.join(lookup.search_paths(files, asked, limit, grams), "pattern")
    slot = F.array(F.lit(5).cast("long"), F.col("from.pass"), F.col("from.position"), F.col("n").cast("long"), F.col("id").cast("long"))
    # each test of a question once, before it gets its texts
    first = met.groupBy("q", "path").agg(F.min(F.struct(slot.alias("slot"), "of")).alias("by"))
    if limit is not None:
        first = first.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("by.slot"))).where(F.col("rank") <= limit)
    return _entry(first, key=F.concat(F.col("path"), F.lit(":__test__")), file=F.col("path"), reason=F.concat(F.lit("Test file for "), F.col("by.of")), relevance=F.lit(TEST), slot=F.col("by.slot"))


def directories(words: DataFrame, symbols: DataFrame, files: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """Directories named by a word of a question: words (q, kw_pos, keyword)."""
    each = words.select("keyword").distinct().withColumn("pattern", F.concat(F.lit("%/"), F.col("keyword"), F.lit("/%")))
    hits = lookup.search_paths(files, each, DIRECTORY_FILES, grams).withColumnRenamed("row_pos", "n").join(each, "pattern")
    enough = hits.groupBy("keyword").agg(F.count("*").alias("c")).where(F.col("c") >= DIRECTORY_LEAST).select("keyword")
    parts = hits.join(enough, "keyword").withColumn("parts", F.split("path", "/")).select("keyword", "path", "n", "parts", F.posexplode("parts").alias("i", "part")).where(F.lower("part") == F.lower("keyword"))
    dirs = parts.where(F.col("i") < F.size("parts") - 1).select("keyword", "n", "i", F.array_join(F.slice("parts", F.lit(1), F.col("i") + 1), "/").alias("dir"))
    counted = cut(dirs.groupBy("keyword", "dir").agg(F.count("*").alias("files"), F.min(F.struct("n", "i")).alias("first")))  # at most DIRECTORY_FILES a word
    shown = counted.join(lookup.directory_exports(symbols, files, counted), "dir", "left").join(words, "keyword")
    return _entry(shown, key=F.concat(F.col("dir"), F.lit(":__dir__")), file=F.concat(F.col("dir"), F.lit("/")), signature=F.concat(F.col("files").cast("string"), F.lit(" files | Exports: "), F.coalesce("exports", F.lit("none"))), reason=F.format_string('Directory matches "%s"', "keyword"), relevance=F.lit(DIRECTORY), slot=_slot(6, F.col("kw_pos"), F.col("first.n"), F.col("first.i")))


def query_many(index, questions: DataFrame, limit: int = 15, groups=concepts.GROUPS) -> DataFrame:
    """The best ``limit`` entries of each question (q, task): q, rank, key, file, symbol, kind, line, signature, reason, relevance, calls, called_by.

    Questions are told by ``q``. Tokens and trigram postings are those stored with the index, if it has them. Jobs are
    as many for any number of questions; what each pass found is written before the next starts from it.
    """
    symbols, files = index.symbols, index.files
    tokens, names, paths = (getattr(index, n, None) for n in ("tokens", "symbol_grams", "path_grams"))
    asked = cut(asking.asked(questions, groups))
    words = asking.worded(questions).select("q", F.posexplode("words").alias("kw_pos", "keyword")).join(asked.select("q").distinct(), "q", "left_semi")
    if names is None:
        names = cut(lookup.symbol_grams(symbols))
    if paths is None:
        paths = cut(lookup.path_grams(files))
    found = cut(_merge(by_name(symbols, files, asked, tokens, names).unionByName(by_path(symbols, files, asked, paths))))
    new, edges = neighbours(found, symbols, files, index.calls)
    entries = cut(_add(found, new))
    entries = _add(entries, partners(entries, index.co_changes))
    entries = cut(_add(entries, tests(entries, files, paths, limit)))
    entries = _add(entries, directories(words, symbols, files, paths))
    best = entries.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("relevance"), "slot"))).where(F.col("rank") <= limit)
    listed = edges.groupBy("q", "key").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("rank", "label")))), lambda x: x["label"]).alias(n) for s, n in enumerate(("called_by", "calls"))))
    empty = F.array().cast("array<string>")
    return best.join(listed, ["q", "key"], "left").select("q", "rank", *_ENTRY[1:-1], F.coalesce("calls", empty).alias("calls"), F.coalesce("called_by", empty).alias("called_by"))


def query(spark: SparkSession, index, task: str, limit: int = 15, groups=concepts.GROUPS) -> DataFrame:
    """``query_many`` of one question, in order."""
    return query_many(index, spark.createDataFrame([(0, task)], "q int, task string"), limit, groups).drop("q").orderBy("rank")


def suggest_many(index, questions: DataFrame) -> DataFrame:
    """(q, rank, priority, file, symbol, relevance, reason): what to read, to check and to be aware of for each question."""
    tier = F.when(F.col("relevance") >= 60, "READ").when(F.col("relevance") >= 30, "CHECK").otherwise("AWARE")
    return query_many(index, questions, 10).select("q", "rank", tier.alias("priority"), "file", "symbol", "relevance", "reason")


def suggest(spark: SparkSession, index, task: str) -> DataFrame:
    """``suggest_many`` of one question, in order."""
    return suggest_many(index, spark.createDataFrame([(0, task)], "q int, task string")).drop("q").orderBy("rank")


def conventions(rows: DataFrame) -> DataFrame:
    """The first well-kept conventions as text."""
    return lookup.patterns(rows).where("confidence > 0.7").limit(5).select(F.concat_ws(": ", "name", "value").alias("convention"))
