"""Registered queries of the engine's own operators, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import columns, concepts, questions as asking
from ..operators import cochange, graph, lookup, patterns, resolve
from . import standins
from .scenario import scenario
from .standins import CALLS, COMMITS, FILES, ORDER_CALLS, ORDER_SYMBOLS, SYMBOLS, StandIns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, views: str = ""):
    """Register a function of StandIns under its name; ``views`` go before the SQL."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(StandIns(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {views} " if views else "") + sql
        return f

    return keep


PAIRS = f"""{COMMITS}, sized AS (
  SELECT commit_hash FROM commits GROUP BY commit_hash HAVING count(*) <= 30
), kept AS (SELECT c.* FROM commits c JOIN sized USING (commit_hash)
), n AS (SELECT file_path, count(*) AS n FROM kept GROUP BY file_path
), p AS (
  SELECT a.file_path AS fa, b.file_path AS fb, count(*) AS c FROM kept a JOIN kept b ON a.commit_hash = b.commit_hash AND a.file_path < b.file_path GROUP BY 1, 2
), co AS (
  SELECT fa AS file_path_a, fb AS file_path_b, c AS change_count, (SELECT count(DISTINCT commit_hash) FROM kept) AS total_commits,
         floor(CAST(c AS DOUBLE) / greatest(x.n, y.n) * 100 + 0.5) / 100 AS confidence
  FROM p JOIN n x ON x.file_path = fa JOIN n y ON y.file_path = fb
  WHERE c >= 2 AND CAST(c AS DOUBLE) / greatest(x.n, y.n) >= 0.3
)"""


def _pairs(v: StandIns) -> DataFrame:
    return cochange.pairs(cochange.retained(v.commits))


@register("SELECT * FROM co", PAIRS)
def cochange_pairs(v):
    return _pairs(v)


@register("SELECT path, file, change_count, confidence FROM (SELECT file_path_a AS path, file_path_b AS file, change_count, confidence FROM co UNION SELECT file_path_b, file_path_a, change_count, confidence FROM co)", PAIRS)
def cochange_for_file(v):
    return lookup.co_changes(_pairs(v))


@register(
    """
SELECT a.path AS file_path_a, b.path AS file_path_b, CAST(1 AS BIGINT) AS change_count, CAST(1 AS BIGINT) AS total_commits, CAST(0.3 AS DOUBLE) AS confidence
FROM named a JOIN named b ON a.dir = b.dir AND a.path < b.path JOIN small ON small.dir = a.dir
WHERE len(list_intersect(a.parts, b.parts)) > 0""",
    FILES + """, named AS (
  SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir,
         list_filter(regexp_split_to_array(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]+$', '')), '[._-]'), lambda x: length(x) > 2) AS parts FROM files
), small AS (SELECT dir FROM named GROUP BY dir HAVING count(*) BETWEEN 2 AND 15)""",
)
def cochange_none_then_proximity(v):
    return cochange.analyze(v.order_commits, v.files)


@register("SELECT s.*, f.path AS file_path, c.callee_symbol_id, c.line AS call_line FROM calls c JOIN symbols s ON s.id = c.caller_symbol_id JOIN files f ON f.id = s.file_id", f"{FILES}, {SYMBOLS}, {CALLS}")
def callers(v):
    return lookup.callers(v.calls, v.symbols, v.files)


@register("SELECT s.*, f.path AS file_path, c.caller_symbol_id, c.line AS call_line FROM calls c JOIN symbols s ON s.id = c.callee_symbol_id JOIN files f ON f.id = s.file_id", f"{FILES}, {SYMBOLS}, {CALLS}")
def callees(v):
    return lookup.callees(v.calls, v.symbols, v.files)


@register("SELECT s.*, f.path AS file_path FROM symbols s JOIN files f ON f.id = s.file_id", f"{FILES}, {SYMBOLS}")
def symbols_by_file(v):
    return lookup.symbols_by_file(v.symbols, v.files)


@register("SELECT s.*, f.path AS file_path FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name IN (SELECT name FROM symbols WHERE id % 50 = 0)", f"{FILES}, {SYMBOLS}")
def symbols_by_name(v):
    """All symbols that have a name of one whose id is divisible by 50."""
    return lookup.symbols_of_names(v.symbols, v.files, v.symbols.where("id % 50 = 0").select("name"))


@register("SELECT s.*, f.path AS file_path FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.id = 101", f"{FILES}, {SYMBOLS}")
def symbol_by_id(v):
    return lookup.symbol_by_id(v.symbols, v.files, 101)


@register("SELECT s.*, f.path AS file_path FROM symbols s JOIN files f ON f.id = s.file_id WHERE is_exported", f"{FILES}, {SYMBOLS}")
def exported_symbols(v):
    return lookup.exported_symbols(v.symbols, v.files)


@register("SELECT s.*, f.path AS file_path, r.referenced_symbol_id FROM calls c JOIN (SELECT caller_symbol_id AS symbol_id, callee_symbol_id AS referenced_symbol_id FROM calls) r ON r.symbol_id = c.caller_symbol_id AND r.referenced_symbol_id = c.callee_symbol_id JOIN symbols s ON s.id = r.symbol_id JOIN files f ON f.id = s.file_id", f"{FILES}, {SYMBOLS}, {CALLS}")
def type_users(v):
    refs = v.calls.select(F.col("caller_symbol_id").alias("symbol_id"), F.col("callee_symbol_id").alias("referenced_symbol_id"))
    return lookup.type_users(refs, v.symbols, v.files)


@register("SELECT s.*, f.path AS file_path, c.caller_symbol_id AS symbol_id FROM calls c JOIN symbols s ON s.id = c.callee_symbol_id JOIN files f ON f.id = s.file_id", f"{FILES}, {SYMBOLS}, {CALLS}")
def type_targets(v):
    refs = v.calls.select(F.col("caller_symbol_id").alias("symbol_id"), F.col("callee_symbol_id").alias("referenced_symbol_id"))
    return lookup.type_targets(refs, v.symbols, v.files)


@register(
    """SELECT 'files' AS metric, count(*) AS value FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'calls', count(*) FROM calls
UNION ALL SELECT 'co_changes', count(*) FROM co UNION ALL SELECT 'patterns', 1 UNION ALL SELECT 'language:' || language, count(*) FROM files GROUP BY language""",
    f"{FILES}, {SYMBOLS}, {CALLS}, {PAIRS}",
)
def index_stats(v):
    return lookup.stats(v.files, v.symbols, v.calls, _pairs(v), patterns.export_ratio(v.symbols))


@register("SELECT language, count(*) AS n FROM files GROUP BY language", FILES)
def files_per_language(v):
    return v.files.groupBy("language").agg(F.count("*").alias("n"))


@register("SELECT f.*, coalesce(n, 0) AS symbol_count FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM symbols GROUP BY file_id) s ON s.file_id = f.id", f"{FILES}, {SYMBOLS}")
def file_symbol_counts(v):
    return lookup.files_by_path(v.files, v.symbols)


@register("SELECT * FROM files", FILES)
def files_by_path(v):
    return v.files.orderBy("path")


@register(
    "SELECT path AS file_path, source_path, imported_names, is_default, is_namespace FROM (SELECT page_id % 50 AS file_id, regexp_replace(url, '^https?://', '') AS source_path, string_split(regexp_replace(url, '^https?://', ''), '/') AS imported_names, page_id % 2 = 0 AS is_default, page_id % 3 = 0 AS is_namespace FROM pages) JOIN files ON files.id = file_id",
    FILES,
)
def file_imports(v):
    path = F.regexp_replace("url", r"^https?://", "")
    imports = v.table("pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 50).alias("file_id"), path.alias("source_path"), F.split(path, "/").alias("imported_names"), (F.col("page_id") % 2 == 0).alias("is_default"), (F.col("page_id") % 3 == 0).alias("is_namespace"))
    return lookup.imports_of(imports, v.files)


#: Every seventh file in the role of a test.
_TESTED = """tested AS (SELECT id, CASE id % 7 WHEN 0 THEN 'tests/' || path WHEN 1 THEN replace(path, '.txt', '.test.txt') WHEN 2 THEN replace(path, '.txt', '.spec.txt') ELSE path END AS path FROM files)"""


@register("SELECT DISTINCT c.callee_symbol_id, f.path AS file_path, s.name, s.line_start FROM calls c JOIN symbols s ON s.id = c.caller_symbol_id JOIN tested f ON f.id = s.file_id WHERE f.path LIKE '%test%'", f"{FILES}, {SYMBOLS}, {CALLS}, {_TESTED}")
def tests_semi_join(v):
    return lookup.tests_of(v.calls, v.symbols, _tested(v))


@register("SELECT DISTINCT target, path FROM (SELECT f.path AS target, t.path FROM files f JOIN tested t ON t.id = f.id WHERE t.path LIKE '%.test.txt')", f"{FILES}, {_TESTED}")
def tests_by_name(v):
    return lookup.tests_named_like(v.files.unionByName(_tested(v)), v.files).distinct()


@register("SELECT f.*, coalesce(n, 0) AS symbol_count FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM symbols GROUP BY file_id) s ON s.file_id = f.id WHERE path ILIKE '%/EN/doc_%7%'", f"{FILES}, {SYMBOLS}")
def files_like(v):
    return lookup.files_by_path(v.files, v.symbols, "%/EN/doc_%7%")


@register(
    """SELECT file_id, line, arg_min(id, (line_end - line_start) * 1000000000 + line_start * 1 + 0) AS symbol_id, arg_min(name, (line_end - line_start) * 1000000000 + line_start) AS name, min(line_end - line_start) AS width
FROM (SELECT 1 AS file_id, p.line, s.* EXCLUDE (file_id) FROM (SELECT DISTINCT l_partkey AS line FROM lineitem) p JOIN symbols s ON p.line BETWEEN s.line_start AND s.line_end) GROUP BY file_id, line""",
    SYMBOLS,
)
def symbol_at_line(v):
    places = v.table("lineitem").select(F.lit(1).alias("file_id"), F.col("l_partkey").alias("line")).distinct()
    return lookup.symbol_at(v.symbols.withColumn("file_id", F.lit(1)), places)


def _millis(ts: Column) -> Column:
    """Milliseconds since 1970 by the clock that the time was written by, whatever the session's zone."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000
    return day + F.hour(ts).cast("long") * 3_600_000 + F.minute(ts).cast("long") * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


@register(
    """SELECT file_id, line, arg_min(id, turn) AS symbol_id, arg_min(name, turn) AS name, min(line_end - line_start) AS width
FROM (SELECT s.*, p.line, [line_end - line_start, line_start, id] AS turn FROM probes p JOIN spans s ON s.file_id = p.file_id AND p.line BETWEEN s.line_start AND s.line_end) GROUP BY file_id, line""",
    """timed AS (SELECT user_id AS file_id, event_id AS id, event_type AS name, epoch_us(ts) // 1000 AS line_start FROM events
), spans AS (
  SELECT * FROM (SELECT *, lead(line_start, CAST(1 + id % 7 AS INTEGER)) OVER (PARTITION BY file_id ORDER BY line_start, id) AS line_end FROM (SELECT * FROM timed)) WHERE line_end IS NOT NULL
), probes AS (SELECT DISTINCT file_id, line_start + 1 AS line FROM timed)""",
)
def interval_at_time(v):
    """Just after each event, the tightest of its user's stretches of time, in milliseconds, each from an event to one of the seven next."""
    timed = v.table("events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("id"), F.col("event_type").alias("name"), _millis(F.col("ts")).alias("line_start"))
    order = Window.partitionBy("file_id").orderBy("line_start", "id")
    later = F.array(*(F.lead("line_start", k).over(order) for k in range(1, 8)))
    spans = timed.withColumn("later", later).withColumn("line_end", F.get("later", (F.col("id") % 7).cast("int"))).drop("later")
    return lookup.symbol_at(spans, timed.select("file_id", (F.col("line_start") + 1).alias("line")).distinct())


_TREE = """edges AS (SELECT DISTINCT callee_symbol_id AS src, caller_symbol_id AS dst FROM calls)"""


@register(
    "SELECT CAST(101 AS BIGINT) AS seed, node, CAST(min(d) AS INTEGER) AS depth FROM walk GROUP BY node",
    f"RECURSIVE {CALLS}, {_TREE}, walk AS (SELECT CAST(101 AS BIGINT) AS node, 0 AS d UNION SELECT dst, d + 1 FROM walk JOIN edges ON src = node WHERE d < 3)",
)
def impact_bfs(v):
    seeds = v.spark.createDataFrame([(101,)], "node bigint")
    return graph.callers_within(v.calls, seeds, 3)


@register(
    "SELECT seed, node, CAST(min(d) AS INTEGER) AS depth FROM walk GROUP BY seed, node",
    f"RECURSIVE {CALLS}, walk AS (SELECT CAST(p_partkey AS BIGINT) AS seed, CAST(p_partkey AS BIGINT) AS node, 0 AS d FROM part UNION SELECT seed, callee_symbol_id, d + 1 FROM walk JOIN calls ON caller_symbol_id = node WHERE d < 3)",
)
def depends_chain(v):
    """Every symbol and all that it depends on, to depth 3."""
    return graph.callees_within(v.calls, v.symbols.select(F.col("id").alias("node")), 3)


def _asked_about(v: StandIns) -> DataFrame:
    """The stated set of targets that a query asks about, against all edges."""
    return v.symbols.where("id % 50 = 0").select(F.col("id").alias("node"))


@register(
    "SELECT seed, CAST(d AS INTEGER) AS depth, count(*) AS nodes FROM (SELECT seed, node, min(d) AS d FROM walk GROUP BY 1, 2) GROUP BY 1, 2",
    f"RECURSIVE {CALLS}, walk AS (SELECT CAST(p_partkey AS BIGINT) AS seed, CAST(p_partkey AS BIGINT) AS node, 0 AS d FROM part WHERE p_partkey % 50 = 0 UNION SELECT seed, caller_symbol_id, d + 1 FROM walk JOIN calls ON callee_symbol_id = node WHERE d < 3)",
)
def reach_counts(v):
    """How many callers there are at each distance."""
    return graph.reached(v.calls.select(F.col("callee_symbol_id").alias("src"), F.col("caller_symbol_id").alias("dst")), _asked_about(v), 3)


_RISK = f"""{FILES}, {SYMBOLS}, {CALLS}, placed AS (
  SELECT s.id, s.name, f.path AS file_path, coalesce(n, 0) AS n_callers, s.is_exported
  FROM symbols s JOIN files f ON f.id = s.file_id LEFT JOIN (SELECT callee_symbol_id, count(*) AS n FROM calls GROUP BY 1) c ON c.callee_symbol_id = s.id
), rated AS (
  SELECT id, name, file_path, n_callers, CASE WHEN file_path LIKE '%test%' OR file_path LIKE '%spec%' THEN 'low' WHEN is_exported AND n_callers > 3 THEN 'high'
         WHEN is_exported OR n_callers > 1 THEN 'medium' ELSE 'low' END AS risk FROM placed
)"""


@register("SELECT * FROM rated", _RISK)
def impact_risk(v):
    return graph.risks(v.symbols, v.files, v.calls)


_LEVELS = """SELECT target_id, direct, indirect, core_files, high_risk, tests, score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM (SELECT *, CAST(least(100, 10 * direct + 3 * indirect + 5 * core_files + 15 * high_risk + CASE WHEN direct > 0 AND tests = 0 THEN 20 ELSE 0 END) AS BIGINT) AS score FROM sums)"""


def _blast(symbols: str, calls: str, asked: str) -> str:
    """Views for the blast radius of the symbols that ``asked`` tells, every seventh file being a test."""
    rated = _RISK.replace("JOIN files f", "JOIN tested f").replace(SYMBOLS, symbols).replace(f"{CALLS},", f"{calls}, {_TESTED},")
    return f"""RECURSIVE {rated}, {_TREE}, walk AS (
  SELECT id AS target_id, id AS node, 0 AS d FROM symbols WHERE {asked} UNION SELECT target_id, dst, d + 1 FROM walk JOIN edges ON src = node WHERE d < 3
), near AS (SELECT target_id, node, min(d) AS d FROM walk GROUP BY 1, 2
), t AS (
  SELECT target_id, path, name, line_start FROM edges JOIN walk w ON w.d = 0 AND src = w.node JOIN symbols s ON s.id = dst JOIN tested f ON f.id = s.file_id WHERE path LIKE '%test%' GROUP BY ALL
), n AS (SELECT target_id, count(*) AS tests FROM t GROUP BY 1
), sums AS (
  SELECT near.target_id, count(*) FILTER (WHERE d = 1) AS direct, count(*) FILTER (WHERE d > 1) AS indirect,
         count(DISTINCT file_path) FILTER (WHERE file_path NOT LIKE '%test%' AND file_path NOT LIKE '%spec%') AS core_files, count(*) FILTER (WHERE risk = 'high') AS high_risk, coalesce(any_value(tests), 0) AS tests
  FROM near JOIN rated ON rated.id = node LEFT JOIN n ON n.target_id = near.target_id WHERE d > 0 GROUP BY near.target_id
)"""


@register(_LEVELS, _blast(SYMBOLS, CALLS, "true"))
def impact_blast_radius(v):
    """Of every symbol, by its callers to depth 3, with every seventh file a test."""
    return graph.blast_radius(v.calls, v.symbols, _tested(v), v.symbols.select(F.col("id").alias("node")))


@register(_LEVELS, _blast(ORDER_SYMBOLS, ORDER_CALLS, "true"))
def blast_radius_of_orders(v):
    """Of every symbol of a sparse graph, in which all levels occur."""
    return graph.blast_radius(v.order_calls, v.order_symbols, _tested(v), v.order_seeds)


_STYLE = """CASE WHEN regexp_matches({0}, '^[a-z][a-zA-Z0-9]*$') AND regexp_matches({0}, '[A-Z]') THEN 'camelCase' WHEN regexp_matches({0}, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase'
 WHEN regexp_matches({0}, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$') THEN 'snake_case' WHEN regexp_matches({0}, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$') THEN 'UPPER_SNAKE_CASE'
 WHEN regexp_matches({0}, '^[a-z][a-z0-9]*(-[a-z0-9]+)+$') THEN 'kebab-case' WHEN regexp_matches({0}, '^[a-z][a-z0-9]*$') THEN 'camelCase' END"""
_NAMED = f"""{FILES}, named AS (
  SELECT id, file_id, kind, name, line_start, {_STYLE.format('name')} AS style FROM (
    SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS file_id, p_partkey AS line_start, p_type AS kind,
           CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN upper(replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '-') END AS name FROM part)
  WHERE length(name) > 1
), placed AS (SELECT n.*, f.path FROM named n JOIN files f ON f.id = n.file_id
), styles AS (SELECT kind, style, count(*) AS n, CASE style WHEN 'camelCase' THEN 1 WHEN 'PascalCase' THEN 2 WHEN 'snake_case' THEN 3 WHEN 'UPPER_SNAKE_CASE' THEN 4 ELSE 5 END AS r FROM placed GROUP BY kind, style
), top AS (
  SELECT kind, style AS dominant, n AS best, total FROM (
    SELECT *, sum(n) OVER (PARTITION BY kind) AS total, row_number() OVER (PARTITION BY kind ORDER BY style IS NULL, n DESC, r) AS k FROM styles)
  WHERE k = 1 AND style IS NOT NULL AND total >= 3
)"""


def _named(v: StandIns) -> DataFrame:
    name = F.col("name")
    plain = lambda mark: F.replace(name, F.lit(" "), F.lit(mark))
    turn = F.col("id") % 4
    made = F.when(turn == 0, plain("_")).when(turn == 1, plain("")).when(turn == 2, F.upper(plain("_"))).otherwise(plain("-"))
    return v.symbols.withColumn("name", made)


_ROW = "SELECT 'naming' AS category, t.kind || '{0}' AS name, {1} AS value, CAST({2} AS BIGINT) AS instance_count, CAST(total AS BIGINT) AS total_count, {3} AS confidence, {4} AS examples"


@register(
    _ROW.format("_convention", "dominant", "best", "floor(CAST(best AS DOUBLE) / total * 100 + 0.5) / 100", "examples")
    + " FROM top t JOIN (SELECT p.kind, list(path || ':' || line_start ORDER BY id)[1:3] AS examples FROM placed p JOIN top USING (kind) WHERE style = dominant GROUP BY 1) e USING (kind)",
    _NAMED,
)
def naming_convention(v):
    return patterns.naming_conventions(_named(v), v.files, None)


@register(
    _ROW.format("_outliers", "array_to_string(shown, '; ')", "len(shown)", "1 - CAST(best AS DOUBLE) / total", "CAST([] AS VARCHAR[])")
    + " FROM top t JOIN (SELECT p.kind, list(p.name || ' (' || path || ':' || line_start || ')' ORDER BY id)[1:5] AS shown FROM placed p JOIN top USING (kind) WHERE style IS DISTINCT FROM dominant GROUP BY 1) e USING (kind) WHERE best < total",
    _NAMED,
)
def naming_outliers(v):
    return patterns.naming_outliers(_named(v), v.files, None)


_ONE = "SELECT '{0}' AS category, '{1}' AS name, {2} AS value, CAST({3} AS BIGINT) AS instance_count, CAST({4} AS BIGINT) AS total_count, CAST({5} AS DOUBLE) AS confidence, CAST({6} AS VARCHAR[]) AS examples"


@register(
    _ONE.format("naming", "file_convention", "style", "n", "total", "floor(CAST(n AS DOUBLE) / total * 100 + 0.5) / 100", "[]")
    + " FROM (SELECT style, n, sum(n) OVER () AS total, row_number() OVER (ORDER BY style IS NULL, n DESC, style) AS k FROM (SELECT "
    + _STYLE.format("regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]+$', '')")
    + " AS style, count(*) AS n FROM files GROUP BY 1)) WHERE k = 1 AND style IS NOT NULL",
    FILES,
)
def file_convention(v):
    return patterns.file_convention(v.files)


@register(_ONE.format("structure", "export_ratio", "n || '/' || total || ' symbols exported'", "n", "total", "floor(CAST(n AS DOUBLE) / total * 100 + 0.5) / 100", "[]") + " FROM (SELECT count(*) AS total, count(*) FILTER (WHERE is_exported) AS n FROM symbols)", SYMBOLS)
def export_ratio(v):
    return patterns.export_ratio(v.symbols)


def _signed(v: StandIns) -> DataFrame:
    low = F.lower("signature")
    made = F.when(F.col("id") % 3 == 0, F.concat(low, F.lit(" -> Result<X>"))).when(F.col("id") % 3 == 1, F.concat(F.lit("async "), low)).otherwise(low)
    return v.symbols.withColumn("signature", made)


_SIGNED = f"""{FILES}, {SYMBOLS}, signed AS (
  SELECT s.*, f.path, CASE s.id % 3 WHEN 0 THEN lower(signature) || ' -> result<x>' WHEN 1 THEN 'async ' || lower(signature) ELSE lower(signature) END AS low FROM symbols s JOIN files f ON f.id = s.file_id
), c AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE contains(low, 'result<') OR contains(low, 'result[') OR contains(low, '-> result')) AS results,
         count(*) FILTER (WHERE contains(low, 'promise<') OR contains(low, 'async')) AS laters,
         (list(path || ':' || line_start ORDER BY id) FILTER (WHERE contains(low, 'result<')))[1:3] AS shown FROM signed
)"""


@register(_ONE.format("error_handling", "result_type", "'Result type'", "results", "total", "CAST(results AS DOUBLE) / total", "shown") + " FROM c WHERE results > 2", _SIGNED)
def result_pattern(v):
    return patterns.signature_patterns(v.symbols, v.files, _signed(v)).where("name = 'result_type'")


@register(_ONE.format("structure", "async_pattern", "'async/await'", "laters", "total", "CAST(laters AS DOUBLE) / total", "[]") + " FROM c WHERE laters > 2", _SIGNED)
def async_pattern(v):
    return patterns.signature_patterns(v.symbols, v.files, _signed(v)).where("name = 'async_pattern'")


_TESTS = f"""{FILES}, t AS (
  SELECT CASE id % 7 WHEN 0 THEN 'tests/' || path WHEN 1 THEN replace(path, '.txt', '.test.txt') WHEN 2 THEN replace(path, '.txt', '.spec.txt') ELSE path END AS path FROM files
), c AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS tests, count(*) FILTER (WHERE hit AND (path LIKE 'tests/%' OR path LIKE 'test/%')) AS apart,
         count(*) FILTER (WHERE hit AND contains(path, '.test.')) AS dt, count(*) FILTER (WHERE hit AND contains(path, '.spec.')) AS ds, count(*) FILTER (WHERE hit AND contains(path, '_test.')) AS lt
  FROM (SELECT path, contains(path, 'test') OR contains(path, 'spec') AS hit FROM t)
)"""


def _tested(v: StandIns) -> DataFrame:
    turn, path = F.col("id") % 7, F.col("path")
    made = F.when(turn == 0, F.concat(F.lit("tests/"), path)).when(turn == 1, F.replace(path, F.lit(".txt"), F.lit(".test.txt"))).when(turn == 2, F.replace(path, F.lit(".txt"), F.lit(".spec.txt"))).otherwise(path)
    return v.files.withColumn("path", made)


@register(_ONE.format("tests", "location", "CASE WHEN apart > tests - apart THEN 'separate directory' WHEN tests - apart > apart THEN 'alongside source' ELSE 'unknown' END", "tests", "tests", "1", "[]") + " FROM c WHERE tests > 0", _TESTS)
def test_location(v):
    return patterns.test_patterns(_tested(v)).where("name = 'location'")


@register(_ONE.format("tests", "naming", "CASE WHEN dt > ds AND dt > lt THEN '*.test.*' WHEN ds > dt THEN '*.spec.*' WHEN lt > dt THEN '*_test.*' ELSE 'unknown' END", "tests", "total", "CAST(tests AS DOUBLE) / total", "[]") + " FROM c WHERE tests > 0", _TESTS)
def test_naming(v):
    return patterns.test_patterns(_tested(v)).where("name = 'naming'")


@register(_ONE.format("tests", "coverage_ratio", "tests || ' test files / ' || total || ' total files'", "tests", "total", "floor(CAST(tests AS DOUBLE) / total * 100 + 0.5) / 100", "[]") + " FROM c WHERE tests > 0", _TESTS)
def coverage_ratio(v):
    return patterns.test_patterns(_tested(v)).where("name = 'coverage_ratio'")


@register(
    _ONE.format("imports", "style", "CASE WHEN CAST(near AS DOUBLE) / total > 0.5 THEN 'mostly relative imports' ELSE 'mostly absolute imports' END", "greatest(near, total - near)", "total", "floor(CAST(greatest(near, total - near) AS DOUBLE) / total * 100 + 0.5) / 100", "[]")
    + " FROM (SELECT count(*) AS total, count(*) FILTER (WHERE page_id % 3 > 0) AS near FROM pages)"
)
def import_style(v):
    path = F.regexp_replace("url", r"^https?://", "")
    return patterns.import_style(v.table("pages").select(F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("./"), path)).otherwise(path).alias("source_path")))


@register("SELECT doc_id, md5(text) AS hash FROM documents")
def content_hash(v):
    return v.files.select(F.col("id").alias("doc_id"), "hash")


@register(
    """SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS state
FROM (SELECT * FROM files WHERE id % 13 > 0) a FULL OUTER JOIN (SELECT path, CASE WHEN id % 10 = 0 THEN 'x' ELSE hash END AS hash FROM files WHERE id % 17 > 0) b ON a.path = b.path""",
    FILES,
)
def incremental_diff(v):
    from ..sources.project import diff

    after = v.files.where("id % 17 > 0").withColumn("hash", F.when(F.col("id") % 10 == 0, "x").otherwise(F.col("hash")))
    return diff(v.files.where("id % 13 > 0"), after).select("path", "state")


@register("SELECT page_id, path FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages) WHERE len(list_filter(string_split(path, '/'), lambda x: list_contains(['fr', 'build', 'vendor', 'de'], x))) = 0")
def path_filters(v):
    from ..sources.project import outside

    return v.table("pages").select("page_id", F.regexp_replace("url", r"^https?://", "").alias("path")).where(outside(F.col("path"), ("fr", "build", "vendor", "de")))


@register(
    "SELECT page_id, path FROM p WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE starts_with(p.path, m.dir || '/'))",
    "p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), marked AS (SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/]+') AS dir FROM p WHERE page_id % 5 = 0 AND len(string_split(path, '/')) > 2)",
)
def nested_project_filter(v):
    from ..sources.project import outside_nested

    pages = v.table("pages").select("page_id", F.regexp_replace("url", r"^https?://", "").alias("path"))
    marked = pages.where((F.col("page_id") % 5 == 0) & (F.size(F.split("path", "/")) > 2)).select(F.regexp_extract("path", "^[^/]+/[^/]+", 0).alias("dir")).distinct()
    return outside_nested(pages, marked)


_WORDS = "list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')"


@register(
    f"""SELECT q.phrase, s.id FROM (SELECT DISTINCT array_to_string(({_WORDS})[1:2], ' ') AS phrase FROM part) q
JOIN (SELECT p_partkey AS id, {_WORDS} AS w FROM part) s ON contains(' ' || array_to_string(s.w, ' ') || ' ', ' ' || q.phrase || ' ')"""
)
def token_search(v):
    """The first two words of each name, as a phrase, against all names."""
    index = lookup.token_table(v.symbols, "id", ["name"])
    words = v.symbols.select(F.slice(columns.tokens(F.col("name")), 1, 2).alias("words")).distinct()
    return lookup.phrase_search(index, words.withColumn("phrase_id", F.array_join("words", " "))).select(F.col("phrase_id").alias("phrase"), "id")


@register("SELECT q.k AS keyword, s.id FROM (SELECT unnest(['rin', 'gre', 'ste', 'zzz']) AS k) q JOIN symbols s ON contains(lower(s.name), q.k) OR contains(lower(s.signature), q.k)", SYMBOLS)
def like_fallback(v):
    asked = v.spark.createDataFrame([(k,) for k in ("rin", "gre", "ste", "zzz")], "keyword string")
    return lookup.search_symbols(v.symbols, asked, limit=None).select("keyword", "id")


@register("SELECT * FROM (VALUES (0, 'login', true), (1, 'token', true), (2, 'signin', false), (3, 'authenticate', false), (4, 'auth', false), (5, 'logon', false), (6, 'bearer', false), (7, 'apikey', false), (8, 'accesstoken', false), (9, 'refreshtoken', false)) t(kw_pos, keyword, original)")
def synonym_expand(v):
    made = concepts.expand(["login", "token"])
    return v.spark.createDataFrame([(i, k, k in ("login", "token")) for i, k in enumerate(made)], "kw_pos int, keyword string, original boolean")


@register("SELECT * FROM (VALUES (0, 'create_user'), (1, 'createUser'), (2, 'CreateUser'), (3, 'create-user')) t(pos, compound)")
def compound_identifiers(v):
    return v.spark.createDataFrame(list(enumerate(concepts.compounds(["create", "user"]))), "pos int, compound string")


@register("SELECT * FROM (VALUES (1, 2, 12, 1.0::DOUBLE), (1, 3, 24, 1.0), (3, 4, 15, 1.0), (5, 1, 18, 1.0), (5, 6, 27, 1.0), (7, 1, 20, 1.0), (8, 1, 14, 1.0)) t(caller_symbol_id, callee_symbol_id, line, confidence)")
def resolve_static_calls(v):
    s = scenario(v.spark)
    edges = resolve.call_graph(s.call_sites, s.symbols, s.files, s.imports)
    return edges.select(*(F.col(c).cast("int") for c in ("caller_symbol_id", "callee_symbol_id", "line")), "confidence")


@register("SELECT * FROM (VALUES ('hint', 'Store.put'), ('interface', 'Disk.put'), ('only', 'Log.note'), ('import', 'Net.send')) t(caller, callee)")
def resolve_method_calls(v):
    from .scenario import receivers

    s = receivers(v.spark)
    edges = resolve.method_calls(s.call_sites, s.symbols, s.imports, s.type_hints, s.implements)
    named = s.symbols.select("id", "name", "parent_symbol_id")
    owner = named.select(F.col("id").alias("parent_symbol_id"), F.col("name").alias("owner"))
    callee = named.join(owner, "parent_symbol_id").select(F.col("id").alias("callee_symbol_id"), F.concat_ws(".", "owner", "name").alias("callee"))
    return edges.join(callee, "callee_symbol_id").join(named.select(F.col("id").alias("caller_symbol_id"), F.col("name").alias("caller")), "caller_symbol_id").select("caller", "callee")


@register("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_latest(v):
    from .store import latest

    return latest(v.table("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@register("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_batches(v):
    """The same, from three batches applied to a keyed table one after another."""
    from .lineage import shared_folder
    from .upsert import KeyedTable

    events = v.table("events").select("user_id", "event_type", "ts", "event_id", "value")
    table = KeyedTable(v.spark, shared_folder(v.spark, "keyed"), ["user_id", "event_type"], ["ts", "event_id"])
    for turn in range(3):
        table.apply(events.where(F.col("event_id") % 3 == turn))
    return table.read(events.schema).select("user_id", "event_type", "event_id", "value")


@register(
    "SELECT * FROM walk",
    """RECURSIVE steps AS (
  SELECT l_suppkey AS start, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target, l_orderkey, l_linenumber, l_partkey FROM lineitem
), edges AS (
  SELECT start, arg_min(target, [l_orderkey, l_linenumber, l_partkey]) AS target FROM steps WHERE target IS NOT NULL GROUP BY start
), walk AS (SELECT start, target FROM edges UNION SELECT walk.start, edges.target FROM walk JOIN edges ON edges.start = walk.target)""",
)
def reexport_closure(v):
    """Where each supplier leads to, each handing on to the one that follows its first line; rings among them."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    steps = v.table("lineitem").select(F.col("l_suppkey").alias("start"), F.lead("l_suppkey").over(order).alias("target"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("turn"))
    return resolve.closure(steps.where("target is not null").groupBy("start").agg(F.min_by("target", "turn").alias("target")))


@register("SELECT * FROM (VALUES (1, 'Box', NULL), (2, 'open', 1), (3, 'Box', NULL), (4, 'shut', 3), (5, 'lost', NULL)) t(ordinal, name, parent_ordinal)")
def parent_resolution(v):
    from .store import with_parents

    rows = v.spark.createDataFrame([(1, 1, "Box", "class", None), (1, 2, "open", "method", "Box"), (1, 3, "Box", "interface", None), (1, 4, "shut", "method", "Box"), (1, 5, "lost", "method", "None")], "file_id int, ordinal int, name string, kind string, parent_name string")
    return with_parents(rows).select("ordinal", "name", "parent_ordinal")


@register(
    """SELECT user_id, min(ts) AS started, count(*) AS n, count(DISTINCT event_type) AS kinds FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS fresh FROM events))
GROUP BY user_id, g"""
)
def debounce_sessions(v):
    from ..streaming.watch import debounced

    changes = v.table("events").select(F.col("user_id").alias("root"), "ts", F.col("event_type").alias("path"))
    return debounced(changes, "5 minutes").select(F.col("root").alias("user_id"), "started", "n", F.size("paths").cast("long").alias("kinds"))


@register(
    """SELECT dir, array_to_string(list(name ORDER BY kind, name, id)[1:15], ', ') AS exports FROM (
  SELECT s.*, unnest([string_split(path, '/')[1], string_split(path, '/')[1] || '/' || string_split(path, '/')[2]]) AS dir FROM symbols s JOIN files f ON f.id = s.file_id WHERE is_exported) GROUP BY dir""",
    f"{FILES}, {SYMBOLS}",
)
def directory_exports(v):
    return lookup.directory_exports(v.symbols, v.files)


@register("SELECT event_type AS path, max(ts) AS last_changed FROM events GROUP BY event_type")
def last_changed(v):
    from ..sources.history import last_changed as of

    return of(v.table("events").select(F.col("event_type").alias("file_path"), "ts"))


def _extraction(language: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..sources.project import parse
        from .scenario import SOURCES

        rows = [(path, text) for path, text in SOURCES if path.endswith(language)]
        parsed = parse(spark.createDataFrame(rows, "path string, text string"))
        return parsed.select("path", F.inline("symbols")).select("path", "name", "kind", "line_start", "line_end", "is_exported", "parent_name")

    return run


def _declared(ending: str) -> str:
    """The same as constant rows."""
    from .scenario import DECLARED, SOURCES

    path = next(p for p, _ in SOURCES if p.endswith("." + ending))
    quoted = lambda text: "CAST(NULL AS VARCHAR)" if text == "-" else "'" + text.replace("'", "''") + "'"
    rows = [f"({quoted(path)}, {quoted(n)}, {quoted(k)}, {a}, {z}, {'true' if e == 'y' else 'false'}, {quoted(p)})" for own, n, k, a, z, e, p in DECLARED if own == ending]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(path, name, kind, line_start, line_end, is_exported, parent_name)"


for _name, _ending in (("typescript", "ts"), ("python", "py"), ("go", "go"), ("rust", "rs"), ("java", "java"), ("ruby", "rb"), ("csharp", "cs"), ("php", "php")):
    QUERIES[f"extract_{_name}"], ORACLE_SQL[f"extract_{_name}"] = _extraction("." + _ending), _declared(_ending)


#: User turns as questions, each about the part numbered like its turn too; told by one number.
_QUESTIONS = """questions AS (
  SELECT conv_id * 1000 + turn AS q, 'where is the ' || p_name || ' ' || text AS task FROM conversations JOIN part ON p_partkey = conv_id WHERE role = 'user'
)"""
_TASK = "where is the small ring src3"
_ONE_QUESTION = f"questions AS (SELECT CAST(0 AS BIGINT) AS q, '{_TASK}' AS task)"


def _quoted(texts) -> str:
    return ", ".join("'" + t + "'" for t in texts)


#: From questions (q, task) to asked (q, kw_pos, keyword, original) and words (q, kw_pos, keyword).
_ASKED = f"""said AS (
  SELECT q, regexp_replace(regexp_replace(regexp_replace(regexp_replace(task, '{concepts.LEADING}', '', 'i'), '{concepts.TRAILING}', '', 'i'), '{concepts.ARTICLE}', '', 'i'), '^\\s+|\\s+$', '', 'g') AS subject FROM questions
), w AS (
  SELECT q, list_filter(regexp_split_to_array(regexp_replace(lower(subject), '[^A-Za-z0-9_\\s-]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1 AND x NOT IN ({_quoted(sorted(concepts.STOP_WORDS))}))[1:{concepts.MOST_KEYWORDS}] AS words FROM said
), runs AS (
  SELECT q, words, flatten(list_transform(range(1, len(words) + 1), lambda i: list_transform(list_filter([2, 3], lambda k: i + k - 1 <= len(words)), lambda k: words[i:i + k - 1]))) || CASE WHEN len(words) IN (3, 4) THEN [words] ELSE [] END AS runs FROM w
), styled AS (
  SELECT q, flatten(list_transform(runs, lambda r: [array_to_string(r, '_'), r[1] || array_to_string(list_transform(r[2:], lambda x: upper(x[1]) || x[2:]), ''), array_to_string(list_transform(r, lambda x: upper(x[1]) || x[2:]), ''), array_to_string(r, '-')])) AS styles FROM runs
), made AS (
  SELECT q, term, [0, min(pos), 0, 0, 0] AS turn FROM (SELECT q, unnest(styles) AS term, unnest(range(len(styles))) AS pos FROM styled) GROUP BY 1, 2
), each AS (SELECT q, unnest(words) AS word, unnest(range(len(words))) AS i FROM w
), parted AS (
  SELECT q, i, list_filter(string_split(word, CASE WHEN contains(word, '_') THEN '_' ELSE '-' END), lambda x: length(x) >= {concepts.SHORTEST_PART}) AS parts FROM each
), terms AS (
  SELECT q, i, 0 AS j, word AS term FROM each UNION ALL SELECT q, i, unnest(range(1, len(parts) + 1)), unnest(parts) FROM parted
), related AS (
  SELECT * FROM (VALUES {", ".join(f"('{t}', {k}, '{o}')" for t, others in concepts.related().items() for k, o in enumerate(others))}) t(term, k, other)
), grown AS (
  SELECT q, term, min(turn) AS turn FROM (
    SELECT q, word AS term, [1, 0, i, 0, 0] AS turn FROM each UNION ALL SELECT q, term, [1, 1, i, j, 0] FROM terms WHERE j > 0 UNION ALL SELECT q, other, [1, 1, i, j, k + 1] FROM terms JOIN related USING (term)) GROUP BY 1, 2
), asked AS (
  SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY turn) - 1 AS INTEGER) AS kw_pos, term AS keyword,
         (q, lower(term)) IN (SELECT (q, lower(word)) FROM each UNION SELECT (q, lower(term)) FROM made) AS original
  FROM (SELECT * FROM made UNION ALL SELECT * FROM grown WHERE length(term) >= {concepts.SHORTEST_KEYWORD})
), words AS (SELECT q, i AS kw_pos, word AS keyword FROM each WHERE q IN (SELECT q FROM asked)
)"""


@register("SELECT * FROM asked", f"{_QUESTIONS}, {_ASKED}")
def question_keywords(v):
    """What the questions of all user turns are searched by."""
    return asking.asked(_questions(v))


_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
_SEARCH_TABLES = f"""{FILES}, {SYMBOLS}, {CALLS}, {_TESTED}, co AS (
  SELECT a.path AS fa, b.path AS fb, CAST(2 AS BIGINT) AS change_count, CAST((30 + a.id % 60) AS DOUBLE) / 100 AS confidence FROM tested a JOIN tested b ON b.id = a.id + 1
)"""
_PASSES = f"""placed AS (SELECT s.*, f.path FROM symbols s JOIN tested f ON f.id = s.file_id
), hits AS (
  SELECT DISTINCT keyword, id FROM (SELECT DISTINCT keyword, ' ' || array_to_string({_TOKENS.format("keyword")}, ' ') || ' ' AS phrase FROM asked) q
  JOIN (SELECT id, unnest([name, signature]) AS field FROM symbols) s ON contains(' ' || array_to_string({_TOKENS.format("field")}, ' ') || ' ', phrase)
), matched AS (
  SELECT * FROM hits UNION ALL SELECT keyword, id FROM (SELECT DISTINCT keyword FROM asked) JOIN symbols ON name ILIKE '%' || keyword || '%' OR signature ILIKE '%' || keyword || '%' WHERE keyword NOT IN (SELECT keyword FROM hits)
), ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY id) AS row_pos FROM matched) WHERE row_pos <= 50
), e1 AS (
  SELECT q, path || ':' || name AS key, path AS file, name AS symbol, kind, CAST(line_start AS INTEGER) AS line, signature, CASE WHEN original THEN 'Match: "' || keyword || '" in ' ELSE 'Semantic match: "' || keyword || '" (synonym) in ' END || kind || ' name' AS reason,
         CASE WHEN original THEN s ELSE greatest(s - 15, 20) END AS relevance, [1, kw_pos, row_pos, 0, 0] AS slot
  FROM (SELECT *, least(100, CASE WHEN lower(name) = lower(keyword) THEN 100 WHEN starts_with(lower(name), lower(keyword)) THEN 85 WHEN contains(lower(name), lower(keyword)) THEN 70 ELSE 50 END + CASE WHEN is_exported THEN 5 ELSE 0 END) AS s FROM ranked JOIN placed USING (id)) JOIN asked USING (keyword)
), paths AS (
  SELECT * FROM (SELECT f.id, path, keyword, row_number() OVER (PARTITION BY keyword ORDER BY f.id) AS row_pos FROM (SELECT DISTINCT keyword FROM asked) JOIN tested f ON path ILIKE '%' || keyword || '%') JOIN asked USING (keyword) WHERE row_pos <= 10
), e2 AS (
  SELECT q, path || ':__file__' AS key, path AS file, CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS signature, 'File path matches "' || keyword || '"' || CASE WHEN original THEN '' ELSE ' (synonym)' END AS reason,
         CASE WHEN own = lower(keyword) THEN 85 WHEN list_contains(dirs, lower(keyword)) THEN 80 WHEN contains(own, lower(keyword)) THEN 75 WHEN original THEN 50 ELSE 35 END
         - CASE WHEN NOT original AND (own = lower(keyword) OR list_contains(dirs, lower(keyword)) OR contains(own, lower(keyword))) THEN 10 ELSE 0 END + CASE WHEN n > 0 THEN 5 ELSE 0 END AS relevance, [2, kw_pos, row_pos, 0, 0] AS slot
  FROM (SELECT p.*, n, lower(regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '')) AS own, list_transform(string_split(path, '/')[:-2], lambda x: lower(x)) AS dirs, row_number() OVER (PARTITION BY q, path ORDER BY kw_pos) AS turn
        FROM paths p LEFT JOIN (SELECT file_id, count(*) AS n FROM symbols GROUP BY 1) c ON c.file_id = p.id) WHERE turn = 1
), found AS (
  SELECT q, key, file, symbol, kind, line, signature, reason, relevance, least_slot AS slot FROM (
    SELECT *, row_number() OVER (PARTITION BY q, key ORDER BY relevance DESC, slot) AS k, min(slot) OVER (PARTITION BY q, key) AS least_slot FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2)) WHERE k = 1
), starts AS (
  SELECT q, key, f.symbol, slot, min(p.id) AS start_id FROM found f JOIN placed p ON p.path = f.file AND p.name = f.symbol WHERE relevance >= 60 AND line IS NOT NULL GROUP BY ALL
), sides AS (
  SELECT q, s.key, s.symbol, slot, 0 AS side, caller_symbol_id AS id, row_number() OVER (PARTITION BY q, s.key ORDER BY c.line, caller_symbol_id) AS k FROM starts s JOIN calls c ON c.callee_symbol_id = start_id JOIN placed p ON p.id = caller_symbol_id
  UNION ALL SELECT q, s.key, s.symbol, slot, 1, callee_symbol_id, row_number() OVER (PARTITION BY q, s.key ORDER BY c.line, callee_symbol_id) FROM starts s JOIN calls c ON c.caller_symbol_id = start_id JOIN placed p ON p.id = callee_symbol_id
), e3 AS (
  SELECT q, path || ':' || name AS key, path AS file, name AS symbol, p.kind, CAST(line_start AS INTEGER) AS line, p.signature, CASE side WHEN 0 THEN 'Calls ' ELSE 'Called by ' END || s.symbol AS reason, CASE side WHEN 0 THEN 40 ELSE 35 END AS relevance,
         [3, slot[1] * 1000000 + slot[2], slot[3], side, k] AS slot
  FROM sides s JOIN placed p USING (id) WHERE k <= 5
), a3 AS (
  SELECT * FROM found UNION ALL SELECT * EXCLUDE (turn) FROM (SELECT *, row_number() OVER (PARTITION BY q, key ORDER BY slot) AS turn FROM e3) WHERE turn = 1 AND (q, key) NOT IN (SELECT (q, key) FROM found)
), sources AS (SELECT q, file AS path, min(slot) AS slot FROM a3 WHERE relevance >= 50 GROUP BY 1, 2
), e4 AS (
  SELECT q, file || ':__cochange__' AS key, file, NULL, NULL, NULL, NULL, 'Co-changes with ' || path || ' (' || CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '% correlation)' AS reason, CAST(20 + floor(confidence * 20 + 0.5) AS INTEGER) AS relevance,
         [4, slot[1] * 1000000 + slot[2], slot[3], k, 0] AS slot
  FROM (SELECT q, s.path, s.slot, file, confidence, row_number() OVER (PARTITION BY q, s.path ORDER BY confidence DESC, file) AS k FROM sources s JOIN (SELECT fa AS path, fb AS file, confidence FROM co UNION SELECT fb, fa, confidence FROM co) c ON c.path = s.path) WHERE k <= 3
), a4 AS (
  SELECT * FROM a3 UNION ALL SELECT * EXCLUDE (turn) FROM (SELECT *, row_number() OVER (PARTITION BY q, key ORDER BY slot) AS turn FROM e4) WHERE turn = 1 AND (q, key) NOT IN (SELECT (q, key) FROM a3)
), patterns AS (
  SELECT q, file AS source, slot, unnest([base || '.test.%', base || '.spec.%', '%test%' || regexp_replace(string_split(file, '/')[-1], '\\.[^.]+$', '') || '%']) AS pattern, unnest([0, 1, 2]) AS n
  FROM (SELECT *, regexp_replace(file, '\\.[^.]+$', '') AS base FROM a4) WHERE relevance >= 50
), e5 AS (
  SELECT q, path || ':__test__' AS key, path AS file, NULL, NULL, NULL, NULL, 'Test file for ' || source AS reason, 30 AS relevance, [5, slot[1] * 1000000 + slot[2], slot[3], n, id] AS slot FROM patterns JOIN tested ON path ILIKE pattern
), a5 AS (
  SELECT * FROM a4 UNION ALL SELECT * EXCLUDE (turn) FROM (SELECT *, row_number() OVER (PARTITION BY q, key ORDER BY slot) AS turn FROM e5) WHERE turn = 1 AND (q, key) NOT IN (SELECT (q, key) FROM a4)
), inside AS (
  SELECT * FROM (SELECT keyword, path, string_split(path, '/') AS parts, row_number() OVER (PARTITION BY keyword ORDER BY f.id) AS n FROM (SELECT DISTINCT keyword FROM words) JOIN tested f ON path ILIKE '%/' || keyword || '/%') WHERE n <= 50
), dirs AS (
  SELECT keyword, array_to_string(parts[:i + 1], '/') AS dir, count(*) AS files, min([n, i]) AS first FROM (SELECT *, unnest(range(0, len(parts))) AS i FROM inside WHERE keyword IN (SELECT keyword FROM inside GROUP BY 1 HAVING count(*) >= 3))
  WHERE lower(parts[i + 1]) = lower(keyword) AND i < len(parts) - 1 GROUP BY ALL
), e6 AS (
  SELECT q, dir || ':__dir__' AS key, dir || '/' AS file, NULL, NULL, NULL, signature, 'Directory matches "' || keyword || '"' AS reason, 78 AS relevance, [6, kw_pos, first[1], first[2], 0] AS slot
  FROM (SELECT keyword, dir, first, files || ' files | Exports: ' || coalesce(array_to_string(list(p.name ORDER BY p.kind, p.name, p.id)[1:15], ', '), 'none') AS signature
        FROM dirs LEFT JOIN placed p ON starts_with(p.path, dir || '/') AND p.is_exported GROUP BY keyword, dir, files, first) JOIN words USING (keyword)
), a6 AS (
  SELECT * FROM a5 UNION ALL SELECT * EXCLUDE (turn) FROM (SELECT *, row_number() OVER (PARTITION BY q, key ORDER BY slot) AS turn FROM e6) WHERE turn = 1 AND (q, key) NOT IN (SELECT (q, key) FROM a5)
), numbered AS (SELECT CAST(row_number() OVER (PARTITION BY q ORDER BY relevance DESC, slot) AS INTEGER) AS rank, * FROM a6)"""
_SEARCH = f"{_ONE_QUESTION}, {_ASKED}, {_SEARCH_TABLES}, {_PASSES}"


def _questions(v: StandIns) -> DataFrame:
    turns = v.table("conversations").where("role = 'user'").join(v.table("part"), F.col("p_partkey") == F.col("conv_id"))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), F.concat(F.lit("where is the "), "p_name", F.lit(" "), "text").alias("task"))


@register("SELECT q, rank, key, file, symbol, kind, line, signature, reason, relevance FROM numbered WHERE rank <= 15", f"{_QUESTIONS}, {_ASKED}, {_SEARCH_TABLES}, {_PASSES}")
def questions_search(v):
    """The best entries of the questions of all user turns, in one go."""
    search, index = _searched(v)
    return search.query_many(index, _questions(v)).drop("calls", "called_by")


def _searched(v: StandIns):
    from ..operators import search

    files = _tested(v)
    after = files.select((F.col("id") - 1).alias("id"), F.col("path").alias("file_path_b"))

    class Index:
        symbols, calls = v.symbols, v.calls
        co_changes = files.withColumnRenamed("path", "file_path_a").join(after, "id").select("file_path_a", "file_path_b", F.lit(2).cast("long").alias("change_count"), ((F.col("id") % 60 + 30) / 100).alias("confidence"))

    Index.files = files
    return search, Index


@register("SELECT rank, key, file, symbol, kind, line, signature, reason, relevance FROM numbered", _SEARCH)
def ranked_search(v):
    """All that all six passes find, in order; every seventh file in the role of a test, neighbours by id changing together."""
    search, index = _searched(v)
    return search.query(v.spark, index, _TASK, 1 << 30).drop("calls", "called_by")


@register("SELECT rank, CASE WHEN relevance >= 60 THEN 'READ' WHEN relevance >= 30 THEN 'CHECK' ELSE 'AWARE' END AS priority, file, symbol, relevance, reason FROM numbered WHERE rank <= 10", _SEARCH)
def suggest(v):
    search, index = _searched(v)
    return search.suggest(v.spark, index, _TASK)
