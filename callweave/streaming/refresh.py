"""Incremental refresh by content hash: unchanged files keep their rows, changed and new ones are parsed again, vanished ones may go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.columns import relative_path
from callweave.operators.mutate import delete_files, merged
from callweave.operators.resolve import build_graph
from callweave.session import checkpointed
from callweave.sources.scan import analyse, listed, qualified, read_files
from callweave.sources.store import CodeGraph


def compare(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, status) from (path, content_hash) of a scan and of the graph: unchanged, changed, new or deleted."""
    a = current.select("path", F.col("content_hash").alias("now"))
    b = stored.select("path", F.col("content_hash").alias("was"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def refresh(graph: CodeGraph, files: DataFrame, analysis_store: DataFrame | None = None, delete_missing: bool = False, compat: bool = False, source_lines: int | None = None) -> tuple[CodeGraph, DataFrame, DataFrame]:
    """The graph after ``files`` (file, content, modified) took the place of what it knew, the table of statuses, and the analysis.

    Only changed and new files are parsed. With ``analysis_store``, the written analysis of the graph's files, the result equals a full
    rebuild: names are resolved over kept and new records together. Without it, rows of kept files stay as they are, and edges between kept and
    changed files go with the nodes that they pointed to.
    """
    graph.check_writable()
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    status = checkpointed(compare(hashed.select(F.col("file").alias("path"), "content_hash"), graph["files"]))
    parse = status.where("status in ('new', 'changed')").select(F.col("path").alias("file"))
    analysis = checkpointed(analyse(files.join(parse, "file", "left_semi"), compat, source_lines))
    leaving = ["new", "changed", "deleted"] if delete_missing else ["new", "changed"]
    gone = status.where(F.col("status").isin(leaving)).select("path")
    if analysis_store is None:
        return merged(delete_files(graph, gone), build_graph(analysis)), status, analysis
    if "part" not in analysis_store.columns:  # stored before long files had several rows
        analysis_store = analysis_store.withColumn("part", F.lit(0))
    whole = analysis_store.join(gone.withColumnRenamed("path", "file"), "file", "left_anti").select(*analysis.columns).unionByName(analysis)
    return build_graph(whole), status, whole


def changed_files_stream(spark: SparkSession, root: str, handle: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*.py"):
    """A stream over the files that appear below ``root``; ``handle`` gets (file, content, modified) and the batch number, e.g. to refresh a graph.

    Spark's file streams do not see names that begin with "_". So each batch brings, beside its new files, all of those, such as __init__.py, as they are then; a
    refresh tells by their hash which of them changed. They do not start a batch of their own. Paths are relative to ``root``, as those of a scan.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    base = qualified(spark, root)
    read = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)

    def whole(df: DataFrame, batch: int) -> None:
        hidden = read_files(listed(df.sparkSession, root, (), f"_{glob.lstrip('_')}"))
        rows = df.select("path", "content", "modificationTime").unionByName(hidden)
        handle(rows.select(relative_path("path", base).alias("file"), "content", F.col("modificationTime").alias("modified")), batch)

    return read.writeStream.foreachBatch(whole).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
