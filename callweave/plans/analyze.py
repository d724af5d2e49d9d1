"""The whole job: scan a source tree, parse, resolve, write the graph; or refresh a graph that is there."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from callweave.operators.resolve import build_graph
from callweave.sources.scan import DEFAULT_EXCLUDES, analyse, scan_sources, summary
from callweave.sources.store import CodeGraph, path_exists, read_table, restored, take_place, table_path, write_beside
from callweave.streaming.refresh import refresh


def analysis_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/analysis.parquet"


def analyze(spark: SparkSession, root: str, folder: str, patterns: tuple[str, ...] = DEFAULT_EXCLUDES, incremental: bool = False, delete_missing: bool = False, compat: bool = False, source_lines: int | None = None) -> dict:
    """Writes the graph of the Python files below ``root`` to ``folder`` and returns counts and seconds by step.

    The analysis is written beside the graph, so files are parsed once, however many tables read them. ``incremental`` parses
    only files whose content changed since the graph was written.
    """
    took, began = {}, time.perf_counter()
    files = scan_sources(spark, root, patterns)
    store = restored(spark, analysis_path(folder))
    if incremental and path_exists(spark, store) and read_table(spark, folder, "files") is not None:
        _, status, whole = refresh(CodeGraph.from_parquet(spark, folder), files, spark.read.parquet(store), delete_missing, compat, source_lines)
        counts = {r.status: r["count"] for r in status.groupBy("status").count().collect()}
        if set(counts) - {"unchanged"} - (set() if delete_missing else {"deleted"}):
            _put(spark, whole, folder, took, began)
        else:
            took["parse"] = time.perf_counter() - began
        return {"status": counts, "seconds": took | {"total": time.perf_counter() - began}}
    _put(spark, analyse(files, compat, source_lines), folder, took, began)
    return {"summary": summary(spark.read.parquet(store)).first().asDict(), "seconds": took | {"total": time.perf_counter() - began}}


def _put(spark: SparkSession, analysis: DataFrame, folder: str, took: dict, began: float) -> None:
    """Writes an analysis and its graph, all beside what is there, and then swaps: the analysis first, the table of files, which the next refresh compares, last."""
    store = analysis_path(folder)
    fresh = write_beside(analysis, store)
    took["parse"] = time.perf_counter() - began
    at = time.perf_counter()
    build_graph(spark.read.parquet(fresh)).write(folder, then=lambda: take_place(spark, fresh, store))
    took["write"] = time.perf_counter() - at


def has_graph(spark: SparkSession, folder: str) -> bool:
    return path_exists(spark, table_path(folder, "files"))
