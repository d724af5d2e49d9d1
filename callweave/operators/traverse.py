"""Bounded traversal of the call graph, one join a level.

A level joins its frontier with the edges; new nodes are those not seen before. As long as a frontier and what was seen are short lists, of at most
LISTED nodes, they are kept on the driver: a level is then one job, which scans the edges beside a broadcast list and shuffles only what it finds. A longer
frontier stays distributed: every level is checkpointed, so that plans stay short and a lost executor costs one level at most.

Edges are read once a level. Those of a written graph are scanned where they lie; others, which may be the result of joins, are checkpointed first, as narrow rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from callweave.operators.match import hop
from callweave.session import checkpointed
from callweave.sources.store import CodeGraph

LISTED = 10_000
DIRECTIONS = "upstream downstream both".split()


def _list(df: DataFrame, at_most: int) -> list[tuple] | None:
    """The rows, or None if there are more than ``at_most``."""
    got = df.limit(at_most + 1).toArrow()
    return None if got.num_rows > at_most else list(zip(*(c.to_pylist() for c in got.columns)))


def levels(step: Callable[[DataFrame], DataFrame], start: DataFrame, max_depth: int, listed: int = LISTED, known: list[tuple] | None = None) -> DataFrame:
    """(node columns, depth): shortest distance from the rows of ``start``, up to ``max_depth``, along ``step``.

    ``step`` takes a frontier, a table of distinct nodes, to the nodes one step away, in the same columns. Nodes with a null are ignored; repeated ones do not matter. The
    start has depth 0. ``listed`` does not change the result. ``known`` are the rows of ``start`` where the caller has them.
    """
    spark, keys = start.sparkSession, start.columns
    kinds = to_arrow_schema(start.schema)

    def clean(df: DataFrame) -> DataFrame:
        return df.select(*keys).na.drop().distinct()

    def table(rows: list[tuple], depth: int | None = None) -> DataFrame:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(keys), kinds)]
        df = spark.createDataFrame(pa.table(columns, names=keys))
        return df if depth is None else df.withColumn("depth", F.lit(depth))

    first = clean(start)
    rows, depth = _list(first, listed) if known is None else known, 0
    seen: dict[tuple, int] = dict.fromkeys(rows or (), 0)
    frontier = None if rows is not None else checkpointed(first)
    parts = [] if rows is not None else [frontier.withColumn("depth", F.lit(0))]
    while rows and depth < max_depth:
        depth += 1
        found = clean(step(F.broadcast(table(rows))))
        got = _list(found, listed)
        new = None if got is None else [r for r in got if r not in seen]
        if new is None or len(seen) + len(new) > listed:
            frontier = checkpointed(found.join(F.broadcast(table(list(seen))), keys, "left_anti"))
            parts.append(frontier.withColumn("depth", F.lit(depth)))
            break
        seen |= dict.fromkeys(new, depth)
        rows = new
    if seen or not parts:
        by_depth = [pa.array(c, f.type) for c, f in zip(zip(*seen) if seen else [()] * len(keys), kinds)]
        parts.insert(0, spark.createDataFrame(pa.table([*by_depth, pa.array(list(seen.values()), pa.int32())], names=[*keys, "depth"])))
    while frontier is not None and depth < max_depth:
        depth += 1
        before = parts[0].select(*keys)
        for p in parts[1:]:
            before = before.union(p.select(*keys))
        frontier = checkpointed(clean(step(frontier)).join(before, keys, "left_anti"))
        if frontier.isEmpty():
            break
        parts.append(frontier.withColumn("depth", F.lit(depth)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tables(graph: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """Calls (src, dst, call_line) and functions (id, file, name), to be read once a level."""
    calls, functions = graph["calls"].select("src", "dst", "call_line"), graph["functions"].select("id", "file", "name")
    return (calls, functions) if graph.stored else (checkpointed(calls), checkpointed(functions))


def impact(graph: CodeGraph, file, function, direction="upstream", max_depth=5) -> DataFrame:
    """(file, function, line, type, depth): every call row at the nodes nearer than ``max_depth``, callers upstream and callees downstream.

    Functions are told apart by (file, name), so two of one name in a file are one node. A function is listed once per call, hence
    several times when it calls several reached functions, and a cycle can list the start again. ``max_depth`` 0 gives no row.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"no such direction: {direction!r}; there are {', '.join(DIRECTIONS)}")
    tables = _tables(graph)
    ways = ("upstream", "downstream") if direction == "both" else (direction,)
    found = [_impact(graph, *tables, file, function, way, max_depth) for way in ways]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _impact(graph: CodeGraph, calls: DataFrame, functions: DataFrame, file: str, function: str, direction: str, max_depth: int) -> DataFrame:
    near, far, kind = ("dst", "src", "caller") if direction == "upstream" else ("src", "dst", "callee")
    ends = functions.withColumnsRenamed({"id": far})

    def calls_at(nodes: DataFrame) -> DataFrame:
        """The calls at nodes (file, name), with the nodes' further columns."""
        return calls.join(functions.join(nodes, ["file", "name"]).drop("file", "name").withColumnRenamed("id", near), near)

    start = graph.spark.createDataFrame([(file, function)], "file string, name string")
    reached = levels(lambda nodes: calls_at(nodes).select(far).join(ends, far), start, max_depth - 1, known=[(file, function)]) if max_depth > 0 else start.withColumn("depth", F.lit(0)).limit(0)
    rows = calls_at(reached).join(ends, far)
    return rows.select("file", F.col("name").alias("function"), F.col("call_line").alias("line"), F.lit(kind).alias("type"), (F.col("depth") + 1).alias("depth"))


def impact_table(rows: DataFrame) -> DataFrame:
    """Impact rows for display: nearest first."""
    return rows.select("depth", "type", "file", "function", "line").orderBy("depth", "file", "function", "line")


def neighbourhood(graph: CodeGraph, file: str, function: str, direction: str, max_depth: int) -> DataFrame:
    """Distinct (file, function, line) of impact()."""
    return impact(graph, file, function, direction, max_depth).select("file", "function", "line").distinct()


def _start(graph: CodeGraph, file: str, function: str) -> DataFrame:
    return graph["functions"].where((F.col("file") == file) & (F.col("name") == function)).select("id")


def _step(calls: DataFrame, upstream: bool) -> Callable[[DataFrame], DataFrame]:
    near, far = ("dst", "src") if upstream else ("src", "dst")
    return lambda nodes: calls.join(nodes.withColumnRenamed("id", near), near, "left_semi").select(F.col(far).alias("id"))


def reach(graph: CodeGraph, file: str, function: str, upstream: bool = False, max_depth: int = 5) -> DataFrame:
    """Distinct functions 1 to ``max_depth`` calls away; the start is among them when it lies on a cycle of at most that length."""
    step = _step(_tables(graph)[0], upstream)
    found = levels(step, step(_start(graph, file, function)), max_depth - 1).select("id")
    return graph["functions"].join(found, "id", "left_semi")


def min_depth(graph: CodeGraph, file: str, function: str, max_depth: int = 10) -> DataFrame:
    """Functions below the start with their shortest distance (column ``depth``, from 1)."""
    found = levels(_step(_tables(graph)[0], False), _start(graph, file, function), max_depth).where("depth > 0")
    return graph["functions"].join(found, "id")


def cycles(graph: CodeGraph, max_length: int = 3) -> DataFrame:
    """Simple cycles of at most ``max_length`` calls: (path, length). A cycle is listed once, from its smallest id; path joins the ids with '>'.

    Paths are grown breadth first over distinct call pairs, through ids above the root's only.
    """
    steps = graph["calls"].where("src is not null and dst is not null").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    paths = steps.where("v >= u").select(F.col("u").alias("root"), F.col("v").alias("at"), F.array("u").alias("path"))
    out = paths.where("at = root").select("path")
    for _ in range(1, max_length):
        open_paths = paths.where("at <> root").withColumn("path", F.concat("path", F.array("at")))
        grown = open_paths.join(steps, open_paths["at"] == steps["u"]).where("v >= root")
        grown = grown.where((F.col("v") == F.col("root")) | ~F.array_contains("path", F.col("v")))
        paths = checkpointed(grown.select("root", F.col("v").alias("at"), "path"))
        out = out.unionByName(paths.where("at = root").select("path"))
    return out.select(F.concat_ws(">", "path").alias("path"), F.size("path").alias("length"))


def call_components(graph: CodeGraph, max_rounds: int | None = None) -> DataFrame:
    """(id, component): every function on a cycle of calls, of any length, with the smallest id of its strongly connected component.

    Forward and backward colouring: in each round every open node takes the smallest id that reaches it; the nodes that reach their colour's
    root within the colour are the root's component, which is settled. Nodes that nothing open calls, or that call nothing open, are on no cycle and go
    first. Each step is one join on narrow rows and checkpointed; functions that call themselves are components of one.
    """
    pairs = graph["calls"].where("src is not null and dst is not null").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    pairs = checkpointed(pairs)
    loops = pairs.where("u = v").select(F.col("u").alias("id"))
    open_pairs, out, rounds = pairs.where("u <> v"), [], 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        open_pairs = _trimmed(open_pairs)
        if open_pairs.isEmpty():
            break
        nodes = open_pairs.select(F.col("u").alias("id")).union(open_pairs.select("v")).distinct()
        colour = _smallest(nodes.select("id", F.col("id").alias("c")), open_pairs)
        within = open_pairs.join(colour.select(F.col("id").alias("u"), "c"), "u").join(colour.select(F.col("id").alias("v"), F.col("c").alias("d")), "v").where("c = d")
        within = checkpointed(within.select("u", "v", "c"))
        roots = colour.where("id = c").select("id", "c")
        back = within.select(F.col("v").alias("u"), F.col("u").alias("v"))
        found = checkpointed(_reached(roots, back))
        sizes = found.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
        out.append(found.join(sizes.select("c"), "c", "left_semi").select("id", F.col("c").alias("component")))
        done = found.select("id")
        open_pairs = checkpointed(within.select("u", "v").join(done.withColumnRenamed("id", "u"), "u", "left_anti").join(done.withColumnRenamed("id", "v"), "v", "left_anti"))
    alone = loops.select("id", F.col("id").alias("component"))
    for part in out:
        alone = alone.join(part.select("id"), "id", "left_anti")
    for part in out:
        alone = alone.unionByName(part)
    return alone


def _trimmed(pairs: DataFrame) -> DataFrame:
    """Pairs whose first node is called, and whose second one calls, by pairs that are left too."""
    n = pairs.count()
    while n:
        kept = pairs.join(pairs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(pairs.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v")
        pairs = checkpointed(kept)
        now = pairs.count()
        if now == n:
            break
        n = now
    return pairs


def _smallest(colour: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, c) with the smallest c of all nodes that reach the id."""
    colour = checkpointed(colour)
    while True:
        along = pairs.join(colour.select(F.col("id").alias("u"), "c"), "u").select(F.col("v").alias("id"), F.col("c").alias("n"))
        low = along.groupBy("id").agg(F.min("n").alias("n"))
        new = checkpointed(colour.join(low, "id", "left").select("id", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("moved")))
        colour = new.select("id", "c")
        if new.where("moved").isEmpty():
            return colour


def _reached(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, c): what (id, c) of ``roots`` reaches along pairs, which never leave a colour."""
    seen = checkpointed(roots)
    frontier = seen
    while True:
        new = frontier.join(pairs, frontier["id"] == pairs["u"]).select(F.col("v").alias("id"), "c").distinct().join(seen.select("id"), "id", "left_anti")
        frontier = checkpointed(new.select("id", "c"))
        if frontier.isEmpty():
            return seen
        seen = checkpointed(seen.unionByName(frontier))
