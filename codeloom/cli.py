"""Command line: python -m codeloom.cli index | query | impact | patterns | stats | serve | init."""

from __future__ import annotations

import argparse
import json
import sys
from itertools import chain

from pyspark.sql import SparkSession

from .api import ENDPOINTS, CodeEngine
from .config import write_default_config
from .plans.store import json_pieces


def serve(engine: CodeEngine, lines=sys.stdin, out=sys.stdout) -> None:
    """One JSON request a line ({"tool": name, arguments...}), one JSON answer a line."""
    for line in lines:
        try:
            asked = json.loads(line)
            method, names = ENDPOINTS[asked.pop("tool")]
            answer = getattr(engine, method)(**{k: v for k, v in asked.items() if k in names})
            if answer is None:
                raise LookupError("not found")
        except (KeyError, TypeError, ValueError, LookupError) as error:
            print(json.dumps({"error": error.args[0] if isinstance(error, LookupError) and error.args else str(error)}), file=out, flush=True)
            continue
        for piece in chain(('{"result": ',), json_pieces(answer, ""), ("}\n",)):
            out.write(piece)
        out.flush()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom")
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index")
    one.add_argument("--no-git", action="store_true")
    one.add_argument("--full", action="store_true")
    one.add_argument("--verbose", action="store_true")
    for name, argument in (("query", "task"), ("impact", "target"), ("patterns", None), ("stats", None)):
        one = sub.add_parser(name)
        if argument:
            one.add_argument(argument)
        one.add_argument("--json", action="store_true")
        if name == "query":
            one.add_argument("-n", type=int, default=15)
        if name == "impact":
            one.add_argument("--depth", type=int, default=3)
    sub.add_parser("serve")
    sub.add_parser("init")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    if o.command == "init":
        print("written" if write_default_config(o.root) else "exists")
        return 0
    spark = spark or SparkSession.builder.appName("codeloom").getOrCreate()
    engine = CodeEngine(spark, o.root)
    if o.command == "index":
        engine.index(o.full, not o.no_git)
        if o.verbose:
            engine.errors().show(truncate=False)
        engine.stats().show(truncate=False)
    elif o.command == "serve":
        serve(engine)
    else:
        answer = {"query": lambda: engine.query(o.task, o.n), "impact": lambda: engine.impact(o.target, o.depth), "patterns": engine.patterns, "stats": engine.stats}[o.command]()
        if answer is None:
            print("no such symbol", file=sys.stderr)
            return 1
        if o.json:
            sys.stdout.writelines(json_pieces(answer))
            print()
        elif isinstance(answer, dict):
            for name, df in answer.items():
                print(name)
                df.show(truncate=False)
        else:
            answer.show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
