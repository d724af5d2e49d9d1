"""Mermaid flow charts of a function's neighbourhood or a module.

As a text a chart is small: only its rows come to the driver, and one of too many rows is refused. As a table of lines it may have any size and stays distributed.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import columns as C
from callweave.operators.match import hop
from callweave.operators.points import functions_in_file
from callweave.operators.traverse import impact
from callweave.session import checkpointed
from callweave.sources.store import CodeGraph

#: A chart of more rows than this is refused: nobody could read it, and it would have to come to the driver.
MAX_ROWS = 2_000
STYLES = ("classDef focus fill:#ffd54f,stroke:#b28704", "classDef caller fill:#bbdefb,stroke:#1565c0", "classDef callee fill:#c8e6c9,stroke:#2e7d32")


def node_id(file: str, function: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]", "_", f"{PurePosixPath(file).stem}_{function}")


def label(file: str, function: str, line: int | None = None) -> str:
    place = PurePosixPath(file).name + (f":{line}" if line is not None else "")
    return f'"{function}<br/>{place}"'


def few(rows: DataFrame, max_rows: int) -> list:
    """The rows, or a ValueError if there are more than ``max_rows``."""
    got = rows.limit(max_rows + 1).collect()
    if len(got) > max_rows:
        raise ValueError(f"more than {max_rows} rows for one chart; take a smaller depth")
    return got


def function_chart(graph: CodeGraph, file: str, function: str, max_depth: int = 3, edges: str = "focus", max_rows: int = MAX_ROWS) -> str:
    """The function with its callers and callees up to ``max_depth``. ``edges``: 'focus' ties each to the function itself, 'path' draws the calls as they are."""
    if edges not in ("focus", "path"):
        raise ValueError("edges must be focus or path")
    near = {d: sorted({(r.file, r.function, r.line) for r in few(impact(graph, file, function, d, max_depth), max_rows)}) for d in ("upstream", "downstream")}
    focus = node_id(file, function)
    nodes, arrows = {focus: (label(file, function), "focus")}, set()
    for direction, kind in (("upstream", "caller"), ("downstream", "callee")):
        for f, name, _ in near[direction]:
            n = node_id(f, name)
            nodes.setdefault(n, (label(f, name), kind))
            if n != focus or edges == "path":
                arrows.add((n, focus) if kind == "caller" else (focus, n))
    if edges == "path":
        known = sorted({(f, n) for rows in near.values() for f, n, _ in rows} | {(file, function)})
        wanted = graph.spark.createDataFrame(known, "file string, name string")
        a = wanted.select(F.col("file").alias("a_file"), F.col("name").alias("a_name"))
        b = wanted.select(F.col("file").alias("b_file"), F.col("name").alias("b_name"))
        rows = hop(graph, "calls").join(a, ["a_file", "a_name"], "left_semi").join(b, ["b_file", "b_name"], "left_semi")
        arrows = {(node_id(r.a_file, r.a_name), node_id(r.b_file, r.b_name)) for r in few(rows.select("a_file", "a_name", "b_file", "b_name").distinct(), max_rows)}
    lines = ["flowchart TD"]
    lines += [f"    {n}[{text}]:::{kind}" for n, (text, kind) in sorted(nodes.items())]
    lines += [f"    {a} --> {b}" for a, b in sorted(arrows)]
    return "\n".join([*lines, *(f"    {s}" for s in STYLES)])


def module_chart(graph: CodeGraph, file, include_imports=True, max_rows: int = MAX_ROWS) -> str:
    """All functions of a file and what they call; functions of other files are rounded, and left out without ``include_imports``."""
    own = sorted((r.name, r.start_line) for r in few(functions_in_file(graph, file), max_rows))
    if not own:
        return f"flowchart LR\n    empty[\"No functions in {PurePosixPath(file).name}\"]"
    calls = hop(graph, "calls").where(F.col("a_file") == file).select("a_name", "b_file", "b_name").distinct()
    calls = few(calls, max_rows)
    lines = ["flowchart LR"] + [f"    {node_id(file, n)}[{label(file, n, line)}]" for n, line in own]
    outside = sorted({(r.b_file, r.b_name) for r in calls if r.b_file != file})
    if include_imports:
        lines += [f"    {node_id(f, n)}({label(f, n)})" for f, n in outside]
    lines += sorted(f"    {node_id(file, r.a_name)} --> {node_id(r.b_file, r.b_name)}" for r in calls if include_imports or r.b_file == file)
    return "\n".join(lines)


def _label(file: str, function: str, line: str | None = None) -> Column:
    """label(), as a column."""
    place = C.base_name(file) if line is None else F.concat(C.base_name(file), F.lit(":"), F.col(line).cast("string"))
    return F.concat(F.lit('"'), function, F.lit("<br/>"), place, F.lit('"'))


def _line(*parts: str | Column) -> Column:
    return F.concat(F.lit("    "), *[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("line")


def function_chart_lines(graph: CodeGraph, file: str, function: str, max_depth: int = 3) -> DataFrame:
    """(line) of function_chart(), in no order and of any number. Functions whose names differ have a line each, also where the chart's ids are the same."""
    spark = graph.spark
    near = checkpointed(impact(graph, file, function, "both", max_depth).select("file", F.col("function").alias("name"), F.col("type").alias("kind")).distinct())
    is_focus = (F.col("file") == file) & (F.col("name") == function)
    focus = spark.createDataFrame([(file, function, "focus")], "file string, name string, kind string")
    # Of several kinds the greatest word is drawn: the focus before callers, and those before callees.
    nodes = near.unionByName(focus).groupBy("file", "name").agg(F.max("kind").alias("kind"))
    here, there = F.lit(node_id(file, function)), C.node_label("file", "name")
    arrows = near.where(~is_focus).select(F.when(F.col("kind") == "caller", _line(there, " --> ", here)).otherwise(_line(here, " --> ", there)).alias("line")).distinct()
    fixed = spark.createDataFrame([("flowchart TD",), *((f"    {x}",) for x in STYLES)], "line string")
    drawn = F.when(is_focus, "focus").otherwise(F.col("kind"))
    return reduce(DataFrame.unionByName, [fixed, nodes.select(_line(there, "[", _label("file", "name"), "]:::", drawn)), arrows])


def module_chart_lines(graph: CodeGraph, file: str) -> DataFrame:
    """(line) of module_chart(), in no order and of any number; of a file without functions the first line alone."""
    own = functions_in_file(graph, file).select(_line(C.node_label("file", "name"), "[", _label("file", "name", "start_line"), "]"))
    used = checkpointed(hop(graph, "calls").where(F.col("a_file") == file).select("a_file", "a_name", "b_file", "b_name").distinct())
    outside = used.where(F.col("b_file") != file).select("b_file", "b_name").distinct().select(_line(C.node_label("b_file", "b_name"), "(", _label("b_file", "b_name"), ")"))
    arrows = used.select(_line(C.node_label("a_file", "a_name"), " --> ", C.node_label("b_file", "b_name")))
    return reduce(DataFrame.unionByName, [graph.spark.createDataFrame([("flowchart LR",)], "line string"), own, outside, arrows])


def save(chart: str, path: str) -> None:
    """The chart as a fenced block, ready for Markdown."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"```mermaid\n{chart}\n```\n")
