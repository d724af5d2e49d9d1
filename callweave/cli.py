"""Command line: analyze, impact, trace, stats and visualize."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from callweave.operators.points import most_called, statistics, variable_usage
from callweave.operators.traverse import impact, impact_table
from callweave.plans.analyze import analyze, has_graph
from callweave.plans.measure import Steps, text_table
from callweave.plans.render import function_chart, module_chart, save
from callweave.session import local_session
from callweave.sources.scan import excludes
from callweave.sources.store import CodeGraph


def target_of(text: str) -> tuple[str, str]:
    """``file:name``, split at the first colon."""
    file, colon, name = text.partition(":")
    if not colon or not file or not name:
        raise ValueError(f"expected file:name, not {text!r}")
    return file, name


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="callweave", description=__doc__)
    p.add_argument("--graph", default=".callweave", help="folder of the graph")
    p.add_argument("--cpus", type=int, default=8)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="parse a source tree and write its graph")
    a.add_argument("path")
    a.add_argument("--exclude", action="append", default=[])
    a.add_argument("--include", action="append", default=[], help="default exclusion to drop")
    a.add_argument("--incremental", action="store_true")
    a.add_argument("--delete-missing", action="store_true")
    a.add_argument("--source-lines", type=int, default=None, help="lines of source to keep per definition (0: none)")
    i = sub.add_parser("impact", help="who is affected by a function, and what it uses")
    i.add_argument("target", metavar="file:function")
    i.add_argument("--direction", choices=("upstream", "downstream", "both"), default="upstream")
    i.add_argument("--max-depth", default=5, type=int)
    t = sub.add_parser("trace", help="who uses a variable")
    t.add_argument("target", metavar="file:line")
    t.add_argument("--variable", required=True)
    s = sub.add_parser("stats", help="counts and the most called functions")
    s.add_argument("--top", type=int, default=20)
    v = sub.add_parser("visualize", help="a Mermaid chart of a module, or of a function in it")
    v.add_argument("file")
    v.add_argument("--function")
    v.add_argument("--max-depth", default=3, type=int)
    v.add_argument("--output")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session(args.cpus)
    if args.command == "analyze":
        steps = Steps(spark)
        try:
            with steps.step("analyze") as note:
                done = analyze(spark, args.path, args.graph, excludes(tuple(args.include), tuple(args.exclude)), args.incremental, args.delete_missing, source_lines=args.source_lines)
                note["rows"] = sum((done.get("status") or {"files": done.get("summary", {}).get("files", 0)}).values())
        except FileNotFoundError as e:
            print(f"no such folder: {e}", file=sys.stderr)
            return 1
        print(text_table(["what", "n"], list((done.get("summary") or done["status"]).items())))
        print(text_table(["step", "time"], [(k, f"{v:.3f}s") for k, v in done["seconds"].items()]))
        print(steps.table())
        return 0
    if not has_graph(spark, args.graph):
        print(f"no graph in {args.graph}; run analyze first", file=sys.stderr)
        return 1
    graph = CodeGraph.from_parquet(spark, args.graph, read_only=True)
    try:
        if args.command == "impact":
            show(impact_table(impact(graph, *target_of(args.target), args.direction, args.max_depth)))
        elif args.command == "trace":
            file, line = target_of(args.target)
            show(variable_usage(graph, file, args.variable, int(line)).orderBy("file", "line", "name"))
        elif args.command == "stats":
            show(statistics(graph))
            show(most_called(graph, args.top).select(F.monotonically_increasing_id().alias("rank"), "*"))
        else:
            chart = function_chart(graph, args.file, args.function, args.max_depth) if args.function else module_chart(graph, args.file)
            if args.output:
                save(chart, args.output)
            else:
                print(chart)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def show(df) -> None:
    """A report's rows as a table."""
    print(text_table(df.columns, [tuple(r) for r in df.collect()]))
