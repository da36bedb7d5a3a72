"""Source trees as DataFrames: scan, filters, parsing, and the difference of two snapshots."""

from __future__ import annotations

import fnmatch
import json
import re
from dataclasses import asdict
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import EXCLUDED, EXTENSIONS, IGNORE_FILE, MARKERS, Config
from ..schemas import PARSED_DDL, parsed_schema


def outside(path: Column, excluded=EXCLUDED) -> Column:
    """A path none of whose directories is excluded; names may hold wildcards."""
    plain = [e for e in excluded if not re.search(r"[*?\[]", e)]
    wild = [fnmatch.translate(e) for e in excluded if e not in plain]
    dirs = F.split(path, "/")
    bad = F.arrays_overlap(dirs, F.array(*map(F.lit, plain))) if plain else F.lit(False)
    for pattern in wild:
        bad = bad | F.exists(dirs, lambda d: d.rlike(pattern))  # noqa: B023
    return ~bad


def outside_nested(files: DataFrame, nested: DataFrame) -> DataFrame:
    """Files that are below none of ``nested`` (dir): an anti-join on the file's own directories."""
    parts = F.split("path", "/")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = files.select("path", F.explode(above).alias("dir")).join(nested.select("dir"), "dir", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_anti")


def nested_projects(paths: DataFrame, workspaces: list[str] = ()) -> DataFrame:
    """(dir): directories two levels down or more that hold a marker file, but for workspace packages."""
    found = paths.where(F.element_at(F.split("path", "/"), -1).isin(*MARKERS)).select(F.regexp_replace("path", r"/[^/]+$", "").alias("dir")).where(F.size(F.split("dir", "/")) >= 2).distinct()
    for w in workspaces:
        found = found.where((F.col("dir") != w) & ~F.col("dir").startswith(w + "/"))
    return found


def ignore_pattern(rule: str) -> tuple[str, bool] | None:
    """(regular expression of whole relative paths, whether it takes them back in) of a line of an ignore file."""
    rule = rule.rstrip("\n")
    rule = re.sub(r"(?<!\\)\s+$", "", rule)
    if not rule or rule.startswith("#"):
        return None
    back = rule.startswith("!")
    rule = rule[back:].lstrip("\\") if rule[back:].startswith(("\\#", "\\!")) else rule[back:]
    only_dir, anchored = rule.endswith("/"), "/" in rule.rstrip("/")
    body, out, i = rule.strip("/"), "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_dir else "(?:/.*)?$"), back


def not_ignored(path: Column, rules: list[str]) -> Column:
    """What the last fitting rule says; without one, a path stays."""
    out = F.lit(True)
    for made in map(ignore_pattern, rules):
        if made:
            out = F.when(path.rlike(made[0]), F.lit(made[1])).otherwise(out)
    return out


def workspace_packages(root: str) -> list[str]:
    """Directories that the root's package.json or pnpm-workspace.yaml names as packages."""
    base, patterns = Path(root), []
    try:
        given = json.loads((base / "package.json").read_text()).get("workspaces", [])
        patterns = given.get("packages", []) if isinstance(given, dict) else given
    except (OSError, ValueError, AttributeError):
        pass
    if not patterns:
        try:
            patterns = re.findall(r"^\s*-\s*['\"]?([^'\"\s#]+)", (base / "pnpm-workspace.yaml").read_text(), re.M)
        except OSError:
            pass
    return sorted({p.relative_to(base).as_posix() for pattern in patterns if not pattern.startswith("!") for p in base.glob(pattern.rstrip("/")) if p.is_dir()})


def path_aliases(root: str) -> list[tuple[str, str]]:
    """(prefix, target) of the root's tsconfig.json."""
    try:
        text = re.sub(r"//[^\n]*|/\*.*?\*/", "", (Path(root) / "tsconfig.json").read_text(), flags=re.S)
        options = json.loads(text).get("compilerOptions", {})
    except (OSError, ValueError):
        return []
    base = options.get("baseUrl", ".").strip("./")
    return [(alias.rstrip("*"), "/".join(x for x in (base, targets[0].rstrip("*").removeprefix("./").rstrip("/")) if x) + "/" * alias.endswith("*")) for alias, targets in options.get("paths", {}).items() if targets]


def go_module(root: str) -> str | None:
    try:
        found = re.search(r"^module\s+(\S+)", (Path(root) / "go.mod").read_text(), re.M)
    except OSError:
        return None
    return found[1] if found else None


def language_of(path: Column, languages: list[str] | None = None) -> Column:
    out = F.lit(None).cast("string")
    for language in languages or EXTENSIONS:
        for ending in EXTENSIONS.get(language, ()):
            out = F.when(path.endswith(ending), language).otherwise(out)
    return out


def scan_names(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the project's own sources, by relative path; contents are read only if asked for."""
    config = config or Config()
    everything = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = Path(root).resolve().as_posix() + "/"
    named = everything.withColumn("path", F.regexp_replace("path", r"^file:/+", "/")).withColumn("path", F.when(F.col("path").startswith(prefix), F.substring("path", len(prefix) + 1, 1 << 16)).otherwise(F.col("path")))
    rules = [line for name in (".gitignore", IGNORE_FILE) if (Path(root) / name).exists() for line in (Path(root) / name).read_text().splitlines()]
    nested = nested_projects(named.select("path"), workspace_packages(root))
    hidden = F.exists(F.split("path", "/"), lambda d: d.startswith("."))
    kept = named.where(outside(F.col("path"), tuple(dict.fromkeys((*config.exclude, *EXCLUDED)))) & not_ignored(F.col("path"), rules) & ~hidden & language_of(F.col("path"), config.languages).isNotNull())
    return outside_nested(kept, nested)


def scan(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """(path, text, hash) of the project's own sources of at most the configured size."""
    config = config or Config()
    texts = scan_names(spark, root, config).select("path", F.decode("content", "UTF-8").alias("text"))
    return texts.where(utf16_length(F.col("text")) <= config.max_file_size).withColumn("hash", F.md5(F.col("text").cast("binary")))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def parse(texts: DataFrame) -> DataFrame:
    """One row of extraction a file (path, text). A file that can't be parsed has an error and no rows, and stops nothing."""
    schema = parsed_schema()
    names = [f.name for f in schema]
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)
    hashed = texts.select("path", "text", language_of(F.col("path")).alias("language"), utf16_length(F.col("text")).alias("size"), F.md5(F.col("text").cast("binary")).alias("hash"))

    def run(batches):
        from ..operators.extract import EXTRACTORS

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                row = {k: r[k] for k in ("path", "language", "size", "hash")} | {"symbols": [], "imports": [], "call_sites": [], "type_hints": [], "error": None}
                extract = EXTRACTORS.get(r["language"])
                if extract and r["text"] is not None:
                    try:
                        found = extract(r["text"], r["path"])
                        row |= {k: [asdict(x) for x in getattr(found, k)] for k in ("symbols", "imports", "call_sites", "type_hints")}
                    except Exception as error:  # a file's fault is the file's: it is reported in its row
                        row["error"] = f"{r['path']}: {error}"
                for one in row["imports"]:
                    one["original_names"] = list(one["original_names"].items())
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, kind).select(names)

    return hashed.mapInArrow(run, PARSED_DDL)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state) of two snapshots (path, hash): new, changed, unchanged or deleted."""
    b = before.select("path", F.col("hash").alias("old"), F.lit(True).alias("was"))
    a = after.select("path", F.col("hash").alias("new"), F.lit(True).alias("is"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return b.join(a, "path", "full").select("path", state.alias("state"))
