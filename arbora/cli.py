"""Command line: inspect, find, formats, mcp, version, help. Exit codes: 0 done, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from arbora.engine import Corpus, Engine
from arbora.functions.detect import FORMATS
from arbora.operators import find
from arbora.operators.render import to_json, to_markdown
from arbora.stdio import serve
from arbora.tools import Service

VERSION = "0.1.0"


def _session() -> SparkSession:
    return SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()


def _load(engine: Engine, path: str, name: str) -> Corpus:
    if path == "-":
        return engine.inspect_bytes([(name, sys.stdin.buffer.read())])
    return engine.inspect_path(os.path.realpath(path, strict=True))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="arbora")
    commands = p.add_subparsers(dest="command", required=True)
    one = commands.add_parser("inspect", help="print a file's tree")
    one.add_argument("file")
    one.add_argument("--name", default="stdin.txt")
    one.add_argument("--format", choices=["json", "markdown"], default="json")
    one.add_argument("--pretty", action="store_true")
    two = commands.add_parser("find", help="search a file")
    two.add_argument("file")
    two.add_argument("query", nargs="+")
    two.add_argument("--name", default="stdin.txt")
    two.add_argument("--limit", type=int, default=20)
    commands.add_parser("formats", help="list the formats that can be read")
    three = commands.add_parser("mcp", help="serve the tools to an agent over standard input and output")
    three.add_argument("--root", action="append", help="a folder that files may be read from; the current one by default")
    commands.add_parser("version", help="print the version")
    commands.add_parser("help", help="print this help")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if a.command == "version":
            print(VERSION)
        elif a.command == "help":
            p.print_help()
        elif a.command == "mcp":
            serve(Service(_session(), a.root), VERSION, sys.stdin, sys.stdout)
        elif a.command == "formats":
            print(json.dumps([{"name": n, "media_type": m, "extensions": e} for n, m, e in FORMATS], indent=2))
        else:
            engine = Engine(_session(), strict=True, persist=True)
            corpus = _load(engine, a.file, a.name)
            if a.command == "inspect":
                frame = to_markdown(corpus) if a.format == "markdown" else to_json(corpus, a.pretty)
                sys.stdout.write(frame.head().rendered)
            else:
                print(json.dumps([r.asDict(True) for r in find(corpus.nodes, " ".join(a.query), a.limit).collect()], indent=2, ensure_ascii=False))
    except Exception as e:  # noqa: BLE001  a message for people, not a trace
        print(f"arbora: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
