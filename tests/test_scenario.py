"""The book catalogue: edges, ranked search and impact, with literal expectations."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import concepts
from codeloom.operators import graph, lookup, resolve, search
from codeloom.plans import lineage
from codeloom.plans.scenario import receivers, scenario


@pytest.fixture(scope="module")
def s(spark):
    return scenario(spark)


def edges(df):
    return sorted((r["caller_symbol_id"], r["callee_symbol_id"], r["line"], r["confidence"]) for r in df.collect())


def test_call_graph(s):
    assert edges(resolve.call_graph(s.call_sites, s.symbols, s.files, s.imports)) == [(1, 2, 12, 1.0), (1, 3, 24, 1.0), (3, 4, 15, 1.0), (5, 1, 18, 1.0), (5, 6, 27, 1.0), (7, 1, 20, 1.0), (8, 1, 14, 1.0)]


def test_receivers_and_duplicates(spark):
    r = receivers(spark)
    found = edges(resolve.method_calls(r.call_sites, r.symbols, r.imports, r.type_hints, r.implements))
    assert found == [(20, 2, 1, 0.8), (21, 4, 2, 0.8), (22, 6, 3, 0.8), (23, 8, 4, 0.8)]
    both = resolve.all_calls(r.call_sites, r.symbols, r.files, r.imports, r.type_hints, r.implements)
    once = resolve.all_calls(r.call_sites, r.symbols, r.files, r.imports, r.type_hints, r.implements, dedupe_edges=True)
    assert once.count() == both.select("caller_symbol_id", "callee_symbol_id").distinct().count()


def names(spark, s, task, limit=15):
    return [(r["symbol"], r["file"], r["relevance"]) for r in search.query(spark, s, task, limit).collect()]


def test_query(spark, s):
    books = names(spark, s, "books")
    assert {"findBooks", "getBooks"} <= {n for n, _, _ in books}
    first = names(spark, s, "findBooks")[0]
    assert first[0] == "findBooks" and first[2] == 100
    assert any(f == "app/catalog/ranking.ts" for _, f, _ in names(spark, s, "ranking"))
    assert len(names(spark, s, "books", 2)) == 2
    assert names(spark, s, "api") == []


def test_query_with_a_stored_index(spark, s):
    from types import SimpleNamespace

    stored = SimpleNamespace(**vars(s), tokens=lookup.symbol_tokens(s.symbols))
    for task in ("where are books found", "parse filters", "function"):
        assert names(spark, stored, task) == names(spark, s, task)


def seeds(spark, number):
    return spark.createDataFrame([(number,)], "node bigint")


def blast_of(spark, s, number):
    one = graph.blast_radius(s.calls, s.symbols, s.files, seeds(spark, number)).first()
    return tuple(one[c] for c in ("direct", "indirect", "core_files", "tests", "score", "level"))


def test_impact(spark, s):
    assert blast_of(spark, s, 1) == (3, 0, 2, 1, 40, "MEDIUM")
    assert blast_of(spark, s, 3) == (1, 3, 3, 0, 54, "HIGH")
    assert blast_of(spark, s, 4) == (1, 4, 4, 0, 62, "HIGH")
    found = {r["name"]: (r["depth"], r["risk"]) for r in graph.dependents(s.calls, s.symbols, s.files, seeds(spark, 3)).collect()}
    assert found == {"findBooks": (1, "medium"), "getBooks": (2, "medium"), "rebuildIndex": (2, "medium"), "checkFinding": (2, "low")}
    assert [r["path"] for r in graph.test_files(s.calls, s.symbols, s.files, seeds(spark, 1)).collect()] == ["tests/catalog/search.test.ts"]


def test_impact_counts_each_call(spark, s):
    """Calls that come twice, from tests too, and a call of a symbol by itself, of many targets at once."""
    again = s.calls.unionByName(s.calls.where("caller_symbol_id in (1, 7, 8)")).unionByName(s.calls.limit(1).withColumn("caller_symbol_id", F.lit(3).cast("long")).withColumn("callee_symbol_id", F.lit(3).cast("long")))
    got = graph.blast_radius(again, s.symbols, s.files, s.symbols.select(F.col("id").alias("node"))).collect()
    found = {r["target_id"]: tuple(r[c] for c in ("direct", "indirect", "core_files", "high_risk", "tests")) for r in got}
    assert found == {1: (5, 0, 2, 0, 1), 2: (2, 3, 3, 2, 0), 3: (3, 3, 4, 2, 0), 4: (1, 4, 4, 1, 0), 6: (1, 0, 1, 0, 0)}


@pytest.mark.parametrize(
    ("text", "name"),
    [("app/catalog/search.ts:10", "findBooks"), ("app/catalog/search.ts:parseFilters", "parseFilters"), ("getBooks", "getBooks"), ("nothing", None), ("app/web/routes.ts", None), ("app/web/routes.ts:0", None)],
)
def test_targets(s, text, name):
    row = graph.find_target(s.symbols, s.files, text).first()
    assert (row and row["name"]) == name


def test_walk_of_many_seeds(spark):
    """Bits of blocks of 64 seeds against a plain walk, and their counts."""
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(500)]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    want = set()
    for seed in range(0, 200, 2):
        at, seen = {seed}, {seed: 0}
        for d in (1, 2, 3):
            at = {b for a in at for b in after.get(a, ()) if b not in seen}
            seen.update((b, d) for b in at)
        want |= {(seed, n, d) for n, d in seen.items()}
    links, starts = spark.createDataFrame(edges, "src bigint, dst bigint"), spark.range(0, 200, 2).toDF("node")
    assert {tuple(r) for r in graph.reach(links, starts, 3).collect()} == want
    counts = {(r["seed"], r["depth"]): r["nodes"] for r in graph.reached(links, starts, 3).collect()}
    assert counts == {k: sum((s, d) == k for s, _, d in want) for k in {(s, d) for s, _, d in want}}
    rows = graph.walk(links, graph.packed(starts), 3)
    assert rows.count() < len(want)


def plain_walk(edges, seeds, depth):
    """{(seed, node, depth)} of a walk node by node."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    want = set()
    for seed in seeds:
        at, seen = {seed}, {seed: 0}
        for d in range(1, depth + 1):
            at = {b for a in at for b in after.get(a, ()) if b not in seen}
            seen.update((b, d) for b in at)
        want |= {(seed, n, d) for n, d in seen.items()}
    return want


def test_blocks_hold_neighbours(spark):
    """Seeds in any order are packed by id, so parts of a graph that do not meet share few blocks; more blocks than cores are walked whole."""
    import random

    rng = random.Random(3)
    part = [(rng.randrange(128), rng.randrange(128)) for _ in range(600)]
    edges = [(a + 128 * k, b + 128 * k) for a, b in part for k in range(8)]
    links, starts = spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame([(i,) for i in random.Random(1).sample(range(1024), 1024)], "node bigint")
    widths = graph.packed(starts).groupBy("block").agg((F.max("seed") - F.min("seed")).alias("width")).collect()
    assert max(r["width"] for r in widths) < graph.SIDE_BY_SIDE
    assert {tuple(r) for r in graph.reach(links, starts, 3).collect()} == plain_walk(edges, range(1024), 3)


def test_blocks_follow_a_given_nearness(spark):
    """Seeds whose ids are scattered lie together by ``near``; a seed that comes twice is packed once, and walks find the same."""
    starts = spark.createDataFrame([(i, i % 16) for i in range(1024)] + [(5, 3)], "node bigint, near bigint")
    starts = starts.repartition(4, F.hash("node"))
    packed = graph.packed(starts)
    assert packed.count() == packed.select("seed").distinct().count() == 1024
    groups = packed.groupBy("block").agg(F.count_distinct(F.col("seed") % 16).alias("n")).collect()
    assert max(r["n"] for r in groups) <= 3
    edges = [(i, (i + 16 * k) % 1024) for i in range(1024) for k in (1, 5)]
    links = spark.createDataFrame(edges, "src bigint, dst bigint")
    assert {tuple(r) for r in graph.reach(links, starts, 2).collect()} == plain_walk(edges, range(1024), 2)


def test_links_of_a_busy_node_are_listed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "LISTED", 3)
    edges = [(0, i) for i in range(1, 41)] * 2 + [(i, 100 + i % 5) for i in range(1, 41)] + [(104, 0)]
    links = spark.createDataFrame(edges, "src bigint, dst bigint")
    lists = graph._listed(links, 1)
    assert lists.selectExpr("max(size(dsts))").first()[0] == 3 and lists.where("src = 0").count() == 14
    for asked in ([0], range(600)):
        starts = spark.createDataFrame([(i,) for i in asked], "node bigint")
        assert {tuple(r) for r in graph.reach(links, starts, 4).collect()} == plain_walk(edges, asked, 4)


def test_reach_is_minimal_and_ends(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(0, 2), (3, 3)], "src bigint, dst bigint")
    found = {r["node"]: r["depth"] for r in graph.reach(ring, seeds(spark, 0), 10).collect()}
    assert found == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4}


@pytest.mark.parametrize("hops", [1, 12])
def test_reexport_chain(spark, s, hops):
    """Through any number of files, the last of which leads back to the first."""
    rows = [(10, 3, "../h0", ["rankHits"], {}, False, False)]
    rows += [(11 + k, 20 + k, "./h%d" % (k + 1), [], {}, False, True) for k in range(hops)]
    rows += [(90, 20 + hops, "./catalog/ranking", [], {}, False, True), (91, 20 + hops, "./h0", [], {}, False, True)]
    more = spark.createDataFrame(rows, s.imports.schema)
    files = s.files.union(spark.createDataFrame([(20 + k, f"app/h{k}/index.ts" if k == 0 else f"app/h{k}.ts", "typescript", 1, "x") for k in range(hops + 1)], s.files.schema))
    more = more.withColumn("source_path", F.when((F.col("file_id") == 20), F.regexp_replace("source_path", r"^\./", "../")).otherwise(F.col("source_path")))
    sites = spark.createDataFrame([(9, 3, "getBooks", "rankHits", None, 29)], s.call_sites.schema)
    symbols = s.symbols.withColumn("is_exported", F.lit(False))
    assert edges(resolve.call_graph(sites, symbols, files, more)) == [(5, 3, 29, 1.0)]


def test_every_group_is_known():
    """Each term leads to all others of its groups."""
    for group in concepts.GROUPS:
        for term in group:
            assert set(group) - {term} <= set(concepts.related()[term])
    assert len(concepts.GROUPS) == 58 and "popup" in concepts.related()["modal"] and "smtp" in concepts.related()["email"]


def test_concepts():
    assert concepts.keywords("How does the login flow work?") == ["login", "flow"]
    assert concepts.expand(["db"]) == ["database", "datastore", "repository", "repo", "storage"]
    assert concepts.expand(["login"]) == ["login", "signin", "authenticate", "auth", "logon"]
    assert concepts.expand(["api"]) == []
    assert concepts.compounds(["get", "user", "id"])[:8] == ["get_user", "getUser", "GetUser", "get-user", "get_user_id", "getUserId", "GetUserId", "get-user-id"]
    assert concepts.parts_of("findByEmail") == ["find", "by", "email"]


def test_phrases(spark):
    rows = spark.createDataFrame([(1, "create_user"), (2, "create the user"), (3, "Café login"), (4, "loginUser"), (5, None)], "id bigint, name string")
    index = lookup.token_table(rows, "id", ["name"])
    asked = spark.createDataFrame([(1, ["create", "user"]), (2, ["login"]), (3, ["cafe"]), (4, [])], "phrase_id int, words array<string>")
    assert sorted((r["phrase_id"], r["id"]) for r in lookup.phrase_search(index, asked).collect()) == [(1, 1), (2, 3), (3, 3)]


def test_release(spark):
    lineage.release(spark)
    made = lineage.cut(spark.range(5))
    assert made.count() == 5 and lineage.release(spark) == 1 and lineage.release(spark) == 0
