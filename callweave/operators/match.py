"""Pattern matching over the graph: hops, optional hops, absence, and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.sources.schemas import EDGES, NODES
from callweave.sources.store import CodeGraph


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[df[c].alias(f"{prefix}_{c}") for c in df.columns])


def nodes(graph: CodeGraph, table: str, prefix: str) -> DataFrame:
    return prefixed(graph[table], prefix)


def edges(graph: CodeGraph, table: str, prefix: str = "r") -> DataFrame:
    return prefixed(graph[table], prefix)


def key_of(table: str, prefix: str) -> str:
    return f"{prefix}_{NODES[table].key}"


def hop(graph: CodeGraph, edge: str, a: str = "a", b: str = "b", r: str = "r") -> DataFrame:
    """``(a)-[r]->(b)``: one row per edge, with the columns of both ends and the edge, prefixed. Columns that are not used are never read."""
    t = EDGES[edge]
    e = edges(graph, edge, r)
    src, dst = nodes(graph, t.src, a), nodes(graph, t.dst, b)
    return e.join(src, F.col(f"{r}_src") == F.col(key_of(t.src, a))).join(dst, F.col(f"{r}_dst") == F.col(key_of(t.dst, b)))


def then_hop(rows: DataFrame, graph: CodeGraph, edge: str, at: str, to: str, r: str, reverse: bool = False) -> DataFrame:
    """Goes on from the nodes ``at`` of ``rows`` along ``edge``, or against it, to nodes ``to``."""
    t = EDGES[edge]
    here, there = (t.dst, t.src) if reverse else (t.src, t.dst)
    near, far = ("dst", "src") if reverse else ("src", "dst")
    out = rows.join(edges(graph, edge, r), F.col(key_of(here, at)) == F.col(f"{r}_{near}"))
    return out.join(nodes(graph, there, to), F.col(f"{r}_{far}") == F.col(key_of(there, to)))


def optional_hop(rows: DataFrame, graph: CodeGraph, edge: str, at: str, to: str, r: str, reverse: bool = False) -> DataFrame:
    """As then_hop(), but rows without a match stay, with nulls."""
    t = EDGES[edge]
    here, there = (t.dst, t.src) if reverse else (t.src, t.dst)
    near, far = ("dst", "src") if reverse else ("src", "dst")
    step = edges(graph, edge, r).join(nodes(graph, there, to), F.col(f"{r}_{far}") == F.col(key_of(there, to)))
    return rows.join(step, F.col(key_of(here, at)) == F.col(f"{r}_{near}"), "left")


def without(rows: DataFrame, graph: CodeGraph, edge: str, key: str, end: str = "src", where: Column | None = None) -> DataFrame:
    """The rows whose ``key`` is at no ``end`` of such an edge."""
    e = graph[edge]
    ends = (e if where is None else e.where(where)).select(F.col(end).alias("_end"))
    return rows.join(ends, F.col(key) == F.col("_end"), "left_anti")


def having(rows: DataFrame, graph: CodeGraph, edge: str, key: str, end: str = "src", where: Column | None = None) -> DataFrame:
    """The rows whose ``key`` is at some ``end`` of such an edge."""
    e = graph[edge]
    ends = (e if where is None else e.where(where)).select(F.col(end).alias("_end"))
    return rows.join(ends, F.col(key) == F.col("_end"), "left_semi")


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in a total order. Spark keeps n rows per partition and merges them."""
    return df.orderBy(*order).limit(n)


def sorted_set(col: str | Column) -> Column:
    return F.array_sort(F.collect_set(col))


def sorted_list(col: str | Column) -> Column:
    return F.array_sort(F.collect_list(col))
