"""Keywords of a table of questions, and substring search, against the plain forms."""

import random
import re

from pyspark.sql import functions as F

from codeloom.functions import concepts, questions
from codeloom.operators import lookup, search, substrings

TASKS = [
    "How does the login flow work?",
    "where is the small-ring token_cache defined",
    "  Show me THE  createUser  api ",
    "the",
    "",
    None,
    "what are user accounts, sessions and e-mail notifications called ?",
    "fix login timeout",
    "é über naïve größe",
    "find db",
    "a_b c-d __x__ -- one two three four five six seven eight nine ten eleven twelve",
    "explain\tauth\nservice implemented??",
    "login login login",
]


def test_keywords_of_many_questions(spark):
    df = spark.createDataFrame(list(enumerate(TASKS)), "q int, task string").repartition(3)
    got = {}
    for r in questions.asked(df).collect():
        got.setdefault(r["q"], []).append((r["kw_pos"], r["keyword"], r["original"]))
    for q, task in enumerate(TASKS):
        assert sorted(got.get(q, [])) == concepts.question(task or ""), task
    words = {r["q"]: r["words"] for r in questions.worded(df).collect()}
    assert all(words[q] == concepts.keywords(task or "") for q, task in enumerate(TASKS))


def like(pattern, text):
    made = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return text is not None and re.fullmatch(made, text, re.I | re.S) is not None


def test_substrings(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abAB_.é") for _ in range(rng.randrange(0, 9))) for _ in range(300)] + [None, "", "a", "ab", "user_name", "UserName", "100%"]
    rows = [(i, n, rng.choice(names)) for i, n in enumerate(names)]
    patterns = ["%ab%", "%a%", "%AB_%", "a%", "%b", "ab", "%user_name%", "%é%", "%zzz%", "%a_b%", "%ba.ab%", "aab%bba%", "%abab%", "%.%", "%aaa%"]
    df = spark.createDataFrame(rows, "id bigint, name string, other string")
    index = substrings.postings(df, "id", ["name", "other"])
    asked = spark.createDataFrame([(p,) for p in patterns * 2 + [None, "%", "__"]], "pattern string")
    found = substrings.matches(index, df, "id", ["name", "other"], asked)
    assert sorted(tuple(r) for r in found.collect()) == sorted((p, i) for p in patterns for i, a, b in rows if like(p, a) or like(p, b))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_search_of_very_many_keywords(spark):
    """More words than are handed to the scan as a filter."""
    rows = spark.range(3000).select("id", F.concat(F.lit("word"), F.col("id").cast("string")).alias("name"), F.lit("x y").alias("signature"))
    index = lookup.symbol_tokens(rows)
    asked = rows.select(F.col("name").alias("keyword")).union(spark.createDataFrame([("ord299",)], "keyword string"))
    found = lookup.search_symbols(rows, asked, index=index)
    assert found.count() == 3011 and found.where("keyword = 'ord299'").count() == 11


def test_dyadic_intervals(spark):
    """Nested and crossing intervals of any length against a plain scan."""
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, f"s{i}", (a := rng.randrange(0, 4000)), a + int(2 ** rng.uniform(0, 12)) - 1) for i in range(300)] + [(0, 900, "none", 5, 4), (1, 901, "all", 0, 1 << 40), (2, 902, "one", 7, 7)]
    places = [(f, n) for f in range(4) for n in rng.sample(range(6000), 60)] + [(1, 1 << 40), (1, (1 << 40) + 1), (2, 7)]
    symbols = spark.createDataFrame(rows, "file_id bigint, id bigint, name string, line_start bigint, line_end bigint")
    got = {(r["file_id"], r["line"]): (r["symbol_id"], r["width"]) for r in lookup.symbol_at(symbols, spark.createDataFrame(places, "file_id bigint, line bigint")).collect()}
    want = {}
    for f, n in places:
        around = [(b - a, a, i) for g, i, _, a, b in rows if g == f and a <= n <= b]
        if around:
            want[f, n] = (min(around)[2], min(around)[0])
    assert got == want
    spread = symbols.where("id < 900").withColumn("node", F.explode(lookup._dyadic("line_start", "line_end"))).groupBy("id").count()
    assert spread.agg(F.max("count")).first()[0] <= 2 * 13


def test_cells_of_an_interval_are_few(spark):
    """Three cells an interval, however long; before, two of each power of two, which a join sent to all as if they were few."""
    rng = random.Random(7)
    rows = [(1, i, f"s{i}", (a := rng.randrange(-(1 << 40), 1 << 40)), a + int(2 ** rng.uniform(0, 41)) - 1) for i in range(200)] + [(1, 200 + i, "nested", -i, i) for i in range(100)] + [(1, 300, "large", -1, (1 << 62) - 2)]
    symbols = spark.createDataFrame(rows, "file_id bigint, id bigint, name string, line_start bigint, line_end bigint")
    assert symbols.select(F.size(lookup._dyadic("line_start", "line_end")).alias("n")).agg(F.max("n")).first()[0] <= 3
    places = sorted({p for _, _, _, a, b in rows for p in (a - 1, a, b, b + 1)})
    got = {r["line"]: (r["symbol_id"], r["width"]) for r in lookup.symbol_at(symbols, spark.createDataFrame([(1, p) for p in places], "file_id bigint, line bigint")).collect()}
    want = {p: min((b - a, a, i) for _, i, _, a, b in rows if a <= p <= b) for p in places if any(a <= p <= b for _, _, _, a, b in rows)}
    assert got == {p: (i, w) for p, (w, _, i) in want.items()}


def test_phrases_meet_whole(spark):
    """A frequent token meets no phrase that a row lacks, and an index filtered by tokens joins none over a gap."""
    rows = spark.createDataFrame([(1, "big red box", "red box"), (2, "big box", "x"), (3, "box big red", "red red red")], "id bigint, name string, signature string")
    index = lookup.symbol_tokens(rows)
    asked = spark.createDataFrame([(1, ["big", "box"]), (2, ["red"]), (3, ["red", "box"]), (4, ["red", "red"]), (5, ["box", "red"]), (6, [])], "phrase_id int, words array<string>")
    want = [(1, 2), (2, 1), (2, 3), (3, 1), (4, 3)]
    found = lookup.phrase_search(index, asked)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert sorted(tuple(r) for r in lookup.phrase_search(index.where("token <> 'red'"), asked).collect()) == [(1, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(token" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_search_without_a_limit_gathers_no_keyword(spark):
    rows = spark.range(200).select("id", F.concat(F.lit("ring"), F.col("id").cast("string")).alias("name"), F.lit("x y").alias("signature"))
    found = lookup.search_symbols(rows, spark.createDataFrame([("rin",), ("x",)], "keyword string"), limit=None)
    assert found.groupBy("keyword").count().collect().__len__() == 2 and found.count() == 400
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_many_patterns_of_short_runs_travel_by_run(spark):
    """Patterns that share a run shorter than a trigram meet its texts once; before, each pattern had a row for each text that holds the run."""
    texts = [f"{a}{b}x{n}" for n, (a, b) in enumerate((a, b) for a in "abcd" for b in ("a_", "-b", "cd", "e"))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, path string")
    asked = [f"%{a}_{b}%" for a in "abcd" for b in "abcdx"] + ["%a_%c_%", "%zz_q%", "b%", "%a%"]
    found = substrings.matches(substrings.postings(rows, "id", ["path"]), rows, "id", ["path"], spark.createDataFrame([(p,) for p in asked], "pattern string"))
    like = lambda p, t: re.fullmatch("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in p), t)
    assert sorted(map(tuple, found.collect())) == sorted((p, i) for p in asked for i, t in enumerate(texts) if like(p, t))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[run#\d+, id#\d+L?\]", plan) and not re.search(r"Aggregate \[pattern#\d+, id#\d+L?\]", plan)


def test_tests_of_a_question_stop_at_its_limit(spark):
    """The best entries need no more tests than ``limit``; before, each question had all tests, once for each of its entries."""
    names = ["w/doc_1.txt", "w/doc_12.txt", *(f"w/test/doc_{n}.txt" for n in (1, 10, 11, 12, 13, 120, 121))]
    files = spark.createDataFrame(list(enumerate(names)), "id bigint, path string")
    entries = spark.createDataFrame([(q, name, 60, [k, 2_000_000 * (k == 3), n, 0, 0]) for q in (1, 2) for k in (1, 3, 4) for n, name in enumerate(names[:2])], "q int, file string, relevance int, slot array<bigint>")
    listed = lambda limit: {q: [(r["file"], r["reason"], r["slot"]) for r in search.tests(entries, files, None, limit).where(F.col("q") == q).orderBy("slot").collect()] for q in (1, 2)}
    whole, cut = listed(None), listed(3)
    assert all(len(whole[q]) == 7 and cut[q] == whole[q][:3] for q in (1, 2))
