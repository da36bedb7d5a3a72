"""Index of a real tree: scan, incremental refresh, answers, command line, history, stream."""

import io
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom import cli
from codeloom.api import CodeEngine
from codeloom.config import Config, load_config, write_default_config
from codeloom.operators import cochange, patterns
from codeloom.plans.scenario import SOURCES
from codeloom.plans.store import as_json, json_pieces
from codeloom.sources import history, project
from codeloom.streaming import watch


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b.c", "-c", "user.name=a", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = dict(SOURCES) | {
        "src/auth/service.ts": 'import { createSession } from "./session";\nexport function loginUser(email) {\n  return createSession(email);\n}\n',
        "src/auth/session.ts": "export function createSession(user) {\n  return user;\n}\n",
        "src/routes/auth.ts": 'import { loginUser } from "../auth/service";\nexport function handleLogin(req) {\n  return loginUser(req.email);\n}\n',
        "tests/auth.test.ts": 'import { loginUser } from "../src/auth/service";\nfunction testLogin() {\n  loginUser("x");\n}\n',
        "node_modules/x/a.ts": "function never() {}",
        "src/deep/nested/package.json": "{}",
        "src/deep/nested/b.ts": "function never() {}",
        "ignored/c.ts": "function never() {}",
        ".gitignore": "ignored/\n*.tmp.ts\n!keep.tmp.ts\n",
        "d.tmp.ts": "function never() {}",
        "keep.tmp.ts": "export function kept() { return 1; }",
    }
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    git(root, "init", "-q")
    for n in range(3):
        (root / "src/auth/service.ts").write_text(files["src/auth/service.ts"] + f"// {n}\n")
        (root / "src/auth/session.ts").write_text(files["src/auth/session.ts"] + f"// {n}\n")
        git(root, "add", "-A")
        git(root, "commit", "-qm", str(n))
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    made = CodeEngine(spark, str(tree), str(tmp_path_factory.mktemp("index") / "i"))
    made.index()
    return made


def paths(df):
    return {r["path"] for r in df.collect()}


def test_scan(spark, tree):
    found = paths(project.scan(spark, str(tree)))
    assert {"src/auth/service.ts", "keep.tmp.ts", "app/users.py", "src/Auth.php"} <= found
    assert not found & {"node_modules/x/a.ts", "src/deep/nested/b.ts", "ignored/c.ts", "d.tmp.ts"}
    small = paths(project.scan(spark, str(tree), Config(max_file_size=60)))
    assert "keep.tmp.ts" in small and "app/users.py" not in small


def test_answers(engine):
    edges = {(r["caller"], r["callee"]) for r in engine.now.calls.join(engine.now.symbols.select(F.col("id").alias("caller_symbol_id"), F.col("name").alias("caller")), "caller_symbol_id").join(engine.now.symbols.select(F.col("id").alias("callee_symbol_id"), F.col("name").alias("callee")), "callee_symbol_id").collect()}
    assert {("loginUser", "createSession"), ("handleLogin", "loginUser"), ("testLogin", "loginUser")} <= edges
    assert engine.query("loginUser").first()["symbol"] == "loginUser"
    impact = engine.impact("loginUser")
    assert {r["name"] for r in impact["dependents"].collect()} == {"handleLogin", "testLogin"}
    assert impact["blast_radius"].first()["score"] == 25 and engine.impact("nowhere") is None
    assert [r["name"] for r in engine.depends("handleLogin").collect()] == ["loginUser", "createSession"]
    assert engine.function("loginUser").first()["callees"] == ["src/auth/session.ts:createSession"]
    assert engine.file("src/auth/service.ts")["symbols"].count() == 1 and engine.file("none") is None
    assert engine.history("src/auth/service.ts").first()["file"] == "src/auth/session.ts"
    assert engine.last_changed("src/auth/service.ts").count() == 1
    assert "files" in {r["metric"] for r in engine.stats().collect()} and engine.get_meta("root") == engine.root and engine.get_meta("x") is None
    assert engine.search_symbols("loginUser nothing").count() == 1
    assert engine.patterns("structure").count() >= 1 and engine.errors().count() == 0
    read, keep = engine.suggest("loginUser")
    assert read.first()["priority"] == "READ" and keep.count() <= 5


def test_incremental_equals_full(spark, engine, tree, tmp_path):
    (tree / "src/auth/session.ts").write_text("export function createSession(user) {\n  return open(user);\n}\nexport function open(user) { return user; }\n")
    (tree / "lib/legacy.js").unlink()
    (tree / "src/new.py").write_text("def fresh():\n    return 1\n")
    engine.index()
    full = CodeEngine(spark, str(tree), str(tmp_path / "full"))
    full.index(full=True)
    for table in ("files", "symbols", "imports", "call_sites", "type_hints", "calls", "co_changes", "patterns"):
        a, b = ([sorted(map(str, getattr(e.now, table).collect()))] for e in (engine, full))
        assert a == b, table
    assert "src/new.py" in paths(engine.now.files) and "lib/legacy.js" not in paths(engine.now.files)


def test_command_line(spark, engine, tree, capsys, monkeypatch):
    monkeypatch.setattr(cli, "CodeEngine", lambda spark, root: engine)
    assert cli.main(["--root", str(tree), "impact", "loginUser", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["blast_radius"][0]["level"] == "MEDIUM"
    assert cli.main(["--root", str(tree), "impact", "nowhere"], spark) == 1
    out = io.StringIO()
    cli.serve(engine, ['{"tool": "depends", "name": "handleLogin", "depth": 1}', '{"tool": "nothing"}', "no json"], out)
    said = [json.loads(line) for line in out.getvalue().splitlines()]
    assert said[0]["result"][0]["name"] == "loginUser" and "error" in said[1] and "error" in said[2]


def test_separate_steps(engine):
    """Resolving and mining by themselves give what indexing gave."""
    before = {t: sorted(map(str, getattr(engine.now, t).collect())) for t in ("calls", "co_changes", "patterns")}
    engine.resolve()
    engine.mine()
    assert before == {t: sorted(map(str, getattr(engine.now, t).collect())) for t in before} and before["calls"]


def test_config(tmp_path):
    assert write_default_config(str(tmp_path)) and not write_default_config(str(tmp_path))
    (tmp_path / ".codeloom.json").write_text('{"max_file_size": 5, "git_history": {"max_commits": 7, "odd": 1}, "exclude": ["x"]}')
    made = load_config(str(tmp_path))
    assert (made.max_file_size, made.git_history.max_commits, made.git_history.max_files_per_commit, made.exclude) == (5, 7, 30, ["x"])
    (tmp_path / ".codeloom.json").write_text("rubbish")
    assert load_config(str(tmp_path)) == Config()


def test_project_files(tmp_path):
    (tmp_path / "package.json").write_text('{"workspaces": ["packages/*"]}')
    (tmp_path / "packages/one").mkdir(parents=True)
    (tmp_path / "tsconfig.json").write_text('{ // note\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}')
    (tmp_path / "go.mod").write_text("module example.com/x\n")
    assert project.workspace_packages(str(tmp_path)) == ["packages/one"] and project.path_aliases(str(tmp_path)) == [("@/", "src/")] and project.go_module(str(tmp_path)) == "example.com/x"
    assert project.workspace_packages(str(tmp_path / "packages")) == [] and project.path_aliases("/none") == [] and project.go_module("/none") is None


def test_cochange_thresholds(spark):
    rows = [(c, f) for c, fs in {"1": "ab", "2": "ab", "3": "a", "4": "a", "5": "ac", "6": "cd", "7": "cd", "8": "c", "9": "c", "10": "c"}.items() for f in fs] + [("big", str(n)) for n in range(31)]
    commits = spark.createDataFrame(rows, "commit_hash string, file_path string")
    got = {(r["file_path_a"], r["file_path_b"]): (r["change_count"], r["confidence"]) for r in cochange.pairs(cochange.retained(commits)).collect()}
    assert got == {("a", "b"): (2, 0.4), ("c", "d"): (2, 0.33)}
    files = spark.createDataFrame([("x/user_store.ts",), ("x/user_view.ts",), ("x/ab.ts",), ("y/user.ts",)], "path string")
    near = cochange.analyze(commits.limit(0), files).collect()
    assert [(r["file_path_a"], r["file_path_b"], r["confidence"]) for r in near] == [("x/user_store.ts", "x/user_view.ts", 0.3)]
    assert history.commits(spark, "/", 5).count() == 0


def test_patterns(spark):
    files = spark.createDataFrame([(1, "a/one.ts"), (2, "a/two.ts"), (3, "tests/x_y.ts")], "id bigint, path string")
    rows = [(1, 1, "loginUser", "function"), (2, 1, "save_it", "function"), (3, 1, "MAX", "function"), (4, 2, "_x", "function"), (5, 2, "A", "class"), (6, 2, "openIt", "function")]
    symbols = spark.createDataFrame([(i, f, n, k, i, "sig", True) for i, f, n, k in rows], "id bigint, file_id bigint, name string, kind string, line_start int, signature string, is_exported boolean")
    got = {r["name"]: r for r in patterns.naming_conventions(symbols, files).collect()}
    assert list(got) == ["function_convention"] and (got["function_convention"]["value"], got["function_convention"]["instance_count"], got["function_convention"]["total_count"]) == ("camelCase", 2, 5)
    odd = patterns.naming_outliers(symbols, files).first()
    assert odd["value"] == "save_it (a/one.ts:2); MAX (a/one.ts:3); _x (a/two.ts:4)" and odd["instance_count"] == 3
    assert patterns.import_style(spark.createDataFrame([("./a",)] * 4, "source_path string")).count() == 0
    assert patterns.import_style(spark.createDataFrame([("./a",)] * 3 + [("b",)] * 2, "source_path string")).first()["value"] == "mostly relative imports"


def test_stream(spark, tmp_path):
    rows = [("r", f"2024-01-01 00:00:0{s}", p) for s, p in ((0, "a.ts"), (1, "b.ts"), (1, "a.ts"), (6, "c.txt"))] + [("r", "2024-01-01 00:05:00", "d.ts")]
    frame = spark.createDataFrame(rows, "root string, t string, path string").select("root", F.to_timestamp("t").alias("ts"), "path")
    want = [["a.ts", "b.ts"], ["c.txt"], ["d.ts"]]
    assert [r["paths"] for r in watch.debounced(frame).orderBy("started").collect()] == want
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = watch.debounced(stream, late="1 second").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["paths"] for r in spark.table("sessions").collect()) == want[:2]
    seen = []
    follow = watch.follow(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), seen.append, trigger={"availableNow": True})
    follow.awaitTermination(120)
    assert sorted(sum(seen, [])) == ["a.ts", "b.ts", "d.ts"]


def test_json(spark):
    assert json.loads(as_json(spark.createDataFrame([(1, ["a"])], "x int, y array<string>"))) == [{"x": 1, "y": ["a"]}]
    two, none = spark.range(2).toDF("n"), spark.range(0).toDF("n")
    assert json.loads("".join(json_pieces({"a": two, "b": none, "c": (two, none)}))) == {"a": [{"n": 0}, {"n": 1}], "b": [], "c": [[{"n": 0}, {"n": 1}], []]}
    assert "\n" not in "".join(json_pieces((two, none), ""))


def test_follow_hands_over_all_paths(spark, tmp_path):
    frame = spark.range(10_050).selectExpr("'r' as root", "timestamp'2024-01-01 00:00:00' as ts", "concat('src/f', id, '.py') as path")
    frame.write.parquet(str(tmp_path / "many"))
    seen = []
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "many"))
    watch.follow(stream, seen.append, trigger={"availableNow": True}).awaitTermination(120)
    assert sorted(p for paths in seen for p in paths) == sorted(f"src/f{n}.py" for n in range(10_050))
    assert max(map(len, seen)) <= 10_000
