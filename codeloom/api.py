"""The engine as one class: build an index of a tree, keep it fresh, and ask it. Every answer is a DataFrame."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Config, load_config
from .functions import concepts
from .operators import cochange, graph, lookup, patterns, search
from .operators import resolve as calls
from .plans.lineage import cut
from .plans.store import Index, IndexStore, build, refresh
from .schemas import conform
from .sources import history, project


class CodeEngine:
    """An index of ``root`` kept below ``store`` (by default inside the tree)."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None, config: Config | None = None):
        self.spark, self.root = spark, root
        self.config = config or load_config(root)
        self.store = IndexStore(spark, store or f"{root.rstrip('/')}/.codeloom/index")

    # building

    def index(self, full: bool = False, git: bool = True, dedupe_edges: bool = False) -> Index:
        """Scan, parse what is new or changed (everything if ``full``), resolve, mine, and publish a new version."""
        began = time.time()
        texts = project.scan(self.spark, self.root, self.config)
        old = None if full else self.store.parsed()
        parsed = cut(project.parse(texts.select("path", "text")) if old is None else refresh(old, texts, project.parse))
        rules = self.config.git_history
        commits = history.commits(self.spark, self.root, rules.max_commits) if git else None
        made = build(
            parsed, commits, project.path_aliases(self.root), project.go_module(self.root), dedupe_edges, None, rules.min_co_change_confidence, rules.max_files_per_commit
        )
        if not git and (before := self.store.read()) is not None:
            made.co_changes = before.co_changes
        meta = {"version": "1", "indexed_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "root": self.root, "duration_ms": str(int((time.time() - began) * 1000)), "file_count": str(made.files.count()), "symbol_count": str(made.symbols.count())}
        made.meta = self.spark.createDataFrame(list(meta.items()), "key string, value string")
        self.store.write(made, parsed)
        return self.store.read()

    def resolve(self, dedupe_edges: bool = False) -> Index:
        """Make the call edges anew from the stored call sites, and publish."""
        now = self.now
        edges = calls.all_calls(now.call_sites, now.symbols, now.files, now.imports, now.type_hints, now.implements, project.path_aliases(self.root), project.go_module(self.root), dedupe_edges)
        now.calls = cut(conform(edges, "calls"))
        self.store.write(now, self.store.parsed())
        return self.now

    def mine(self) -> Index:
        """Make co-changes and conventions anew, from the history and the stored symbols, and publish."""
        now, rules = self.now, self.config.git_history
        commits = history.commits(self.spark, self.root, rules.max_commits)
        now.co_changes = cut(conform(cochange.analyze(commits, now.files, rules.min_co_change_confidence, rules.max_files_per_commit), "co_changes"))
        now.patterns = cut(conform(patterns.extract(now.files, now.symbols, now.imports), "patterns"))
        self.store.write(now, self.store.parsed())
        return self.now

    @property
    def now(self) -> Index:
        found = self.store.read()
        if found is None:
            raise LookupError("no index yet: call index() first")
        return found

    def errors(self) -> DataFrame:
        return self.store.parsed().where("error is not null").select("path", "error")

    def clear(self) -> None:
        self.store.clear()

    def get_meta(self, key: str) -> str | None:
        return self.store.get_meta(key)

    def set_meta(self, key: str, value: str) -> None:
        self.store.set_meta(key, value)

    def watch(self, rounds: int | None = None):
        from .streaming.watch import Watcher

        return Watcher(self.spark, self.root, self.index, self.config).run(rounds)

    # asking

    def query(self, task: str, limit: int = 15, groups=concepts.GROUPS) -> DataFrame:
        return search.query(self.spark, self.now, task, limit, groups)

    def query_many(self, questions: DataFrame, limit: int = 15, groups=concepts.GROUPS) -> DataFrame:
        """The best entries of each question of a table (q, task), in one go."""
        return search.query_many(self.now, questions, limit, groups)

    def search_symbols(self, text: str) -> DataFrame:
        asked = self.spark.createDataFrame([(text,)], "keyword string")
        now = self.now
        return lookup.with_path(lookup.search_symbols(now.symbols, asked, index=now.tokens, grams=now.symbol_grams), now.files).orderBy("id")

    def _target(self, text: str) -> DataFrame:
        now = self.now
        return cut(graph.find_target(now.symbols, now.files, text).select(F.col("id").alias("node")))

    def impact(self, target: str, depth: int = 3) -> dict[str, DataFrame] | None:
        """dependents, dependencies, co_changes, tests and blast_radius of a target; None if there is no such symbol."""
        now, seeds = self.now, self._target(target)
        if seeds.isEmpty():
            return None
        place = lookup.with_path(now.symbols, now.files).join(seeds, F.col("id") == F.col("node")).select(F.col("file_path").alias("path"))
        rank = F.col("confidence").desc()
        return {
            "dependents": graph.dependents(now.calls, now.symbols, now.files, seeds, depth, now.type_refs),
            "dependencies": lookup.callees(now.calls, now.symbols, now.files).join(seeds, F.col("caller_symbol_id") == F.col("node"), "left_semi"),
            "co_changes": lookup.co_changes(now.co_changes).join(place, "path", "left_semi").orderBy(rank, "file").limit(graph.CO_CHANGES),
            "tests": graph.test_files(now.calls, now.symbols, now.files, seeds),
            "blast_radius": graph.blast_radius(now.calls, now.symbols, now.files, seeds, depth),
        }

    def depends(self, name: str, depth: int = 3) -> DataFrame:
        """What a symbol calls, directly and through others."""
        now, seeds = self.now, self._target(name)
        found = graph.callees_within(now.calls, seeds, depth).where("depth > 0")
        return found.select(F.col("node").alias("id"), "depth").join(lookup.with_path(now.symbols, now.files), "id").select("depth", "name", "kind", "file_path", "line_start").orderBy("depth", "file_path", "line_start")

    def function(self, name: str) -> DataFrame:
        """Symbols of a name with their callers and callees as ``path:name``."""
        now = self.now
        own = lookup.symbols_by_name(now.symbols, now.files, name)
        label = F.concat_ws(":", "file_path", "name")
        callers = lookup.callers(now.calls, now.symbols, now.files).groupBy(F.col("callee_symbol_id").alias("id")).agg(F.sort_array(F.collect_list(label)).alias("callers"))
        callees = lookup.callees(now.calls, now.symbols, now.files).groupBy(F.col("caller_symbol_id").alias("id")).agg(F.sort_array(F.collect_list(label)).alias("callees"))
        return own.join(callers.join(own.select("id"), "id", "left_semi"), "id", "left").join(callees.join(own.select("id"), "id", "left_semi"), "id", "left").orderBy("id")

    def file(self, path: str) -> dict[str, DataFrame] | None:
        """The file's row, symbols, imports and first co-changes; None if it is not indexed."""
        now = self.now
        own = now.files.where(F.col("path") == path)
        if own.isEmpty():
            return None
        imports = lookup.imports_of(now.imports, now.files, path).drop("file_path")
        return {"file": own, "symbols": lookup.symbols_by_file(now.symbols, now.files, path), "imports": imports, "co_changes": self.history(path).limit(5)}

    def history(self, path: str) -> DataFrame:
        return lookup.co_changes_of(self.now.co_changes, path)

    def last_changed(self, path: str) -> DataFrame:
        return history.last_changed(history.commits(self.spark, self.root, self.config.git_history.max_commits)).where(F.col("path") == path)

    def patterns(self, category: str | None = None) -> DataFrame:
        return lookup.patterns(self.now.patterns, category)

    def suggest(self, task: str) -> tuple[DataFrame, DataFrame]:
        """(what to read, conventions to keep)."""
        now = self.now
        return search.suggest(self.spark, now, task), search.conventions(now.patterns)

    def stats(self) -> DataFrame:
        now = self.now
        return lookup.stats(now.files, now.symbols, now.calls, now.co_changes, now.patterns).orderBy("metric")

    expand_keywords = staticmethod(concepts.expand)

    @staticmethod
    def synonyms(term: str, groups=concepts.GROUPS) -> list[str]:
        return concepts.related(groups).get(term.lower(), [])


#: Endpoints of the server, by name: (method, arguments).
ENDPOINTS = {
    "query": ("query", ("task", "limit")),
    "impact": ("impact", ("target", "depth")),
    "patterns": ("patterns", ("category",)),
    "function": ("function", ("name",)),
    "file": ("file", ("path",)),
    "depends": ("depends", ("name", "depth")),
    "history": ("history", ("path",)),
    "suggest": ("suggest", ("task",)),
}
