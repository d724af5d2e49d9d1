"""Scanning a source tree and parsing it once into nested records, one row a file, or several of a long one."""

from __future__ import annotations

import fnmatch

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from callweave.functions.columns import parent_directory, relative_path
from callweave.session import checkpointed, importable
from callweave.sources.pyparse import KINDS, PIECE, analysis_ddl, parts_of_bytes

DEFAULT_EXCLUDES = ("__pycache__", ".venv", "venv", ".git", "node_modules", "build", "dist", ".egg-info")
#: Files parsed per Arrow batch: source texts are small, syntax trees are not.
BATCH = 64


def excludes(include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The default patterns without those in ``include``, and with those in ``exclude``."""
    return (*[p for p in DEFAULT_EXCLUDES if p not in include], *exclude)


#: Entries that a task lists before it hands the folders it has not seen to other tasks.
LIST_ENTRIES = 20_000


def qualified(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def listed(spark: SparkSession, root: str, patterns: tuple[str, ...] = (), glob: str = "*", entries: int = LIST_ENTRIES) -> DataFrame:
    """(path, size, ms): files below ``root`` whose path holds none of ``patterns`` and whose name fits ``glob``, names that begin with "_" included.

    Folders are listed in tasks, excluded ones not at all. A task goes on into the folders it finds until it has seen ``entries`` entries; the rest goes to the next
    round, which spreads it over all tasks. Small trees take one round, deep or broad ones a few.
    """
    importable(spark)

    def go(batches):
        for batch in batches:
            todo, out, seen = batch.column(0).to_pylist(), [], 0
            while todo and seen < entries:
                fs, at = _filesystem(todo[-1])
                folder = todo.pop()
                for info in fs.get_file_info(pa_fs.FileSelector(at, allow_not_found=True)):
                    seen += 1
                    path = f"{folder}/{info.base_name}"
                    if any(p in path for p in patterns):
                        continue
                    if info.type == pa_fs.FileType.Directory:
                        todo.append(path)
                    elif fnmatch.fnmatch(info.base_name, glob):
                        out.append((path, info.size, (info.mtime_ns or 0) // 1_000_000))
            rows = [*out, *((folder, None, None) for folder in todo)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "size", "ms"])

    frontier = spark.createDataFrame([(qualified(spark, root),)], "path string")
    files = None
    while True:
        found = checkpointed(frontier.mapInArrow(go, "path string, size long, ms long"))
        here = found.where("ms is not null")
        files = here if files is None else files.unionByName(here)
        frontier = found.where("ms is null").select("path")
        n = frontier.count()
        if not n:
            return files
        frontier = frontier.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))


def read_files(files: DataFrame, bytes_at_once: int = 16 << 20) -> DataFrame:
    """(path, content, modificationTime) of listed files, read in tasks of about ``bytes_at_once``. A file that has gone since, or cannot be read, has a null content."""
    size = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_bytes_of(p) for p in part.column(0).to_pylist()], pa.binary()), part.column(1)], names=["path", "content", "ms"])

    spread = files.select("path", "ms").repartition(max(1, min(4096, size // bytes_at_once + files.sparkSession.sparkContext.defaultParallelism)))
    return spread.mapInArrow(read, "path string, content binary, ms long").select("path", "content", F.timestamp_millis("ms").alias("modificationTime"))


def _filesystem(path: str) -> tuple[pa_fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa_fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pa_fs.FileSystem.from_uri(path)


def _bytes_of(path: str) -> bytes | None:
    fs, inner = _filesystem(path)
    try:
        with fs.open_input_stream(inner) as f:
            return f.read()
    except OSError:
        return None


def scan_sources(spark: SparkSession, root: str, patterns: tuple[str, ...] = DEFAULT_EXCLUDES, glob: str = "*.py") -> DataFrame:
    """(file, content, modified): files below ``root`` whose path holds none of ``patterns``. Excluded files are never read; one that cannot be read has a null content."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(root)
    rows = read_files(listed(spark, root, patterns, glob))
    return rows.select(relative_path("path", qualified(spark, root)).alias("file"), "content", F.col("modificationTime").alias("modified"))


def write_tree(files: DataFrame, root: str) -> None:
    """Writes (file, content) rows as files below ``root``, each in the task that holds it. The folder must be one that all executors share."""
    base = qualified(importable(files.sparkSession), root)

    def put(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = _filesystem(f"{base}/{name}")
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(at) as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("file", "content").mapInArrow(put, "n long").agg(F.sum("n")).collect()


def from_texts(df: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """The same shape from a table of texts."""
    return df.select(F.col(file).alias("file"), F.col(text).cast("binary").alias("content"), F.lit(None).cast("timestamp").alias("modified"))


def spread(files: DataFrame) -> DataFrame:
    """The files over several times as many tasks as run at once. Adaptive execution puts a few long texts into one task, as they are few bytes; parsing them takes long."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "file")


def analyse(files: DataFrame, compat: bool = False, source_lines: int | None = None) -> DataFrame:
    """Rows with all records of a file, parsed in Arrow batches. A file that cannot be read as Python keeps its row, with ``errors``.

    A long file has a row for each of its pieces (``part``, from 0), and all of them its hash; see first_parts(). One piece at a time is held, so memory does not grow with the records of a file.
    """
    importable(files.sparkSession)
    ddl = analysis_ddl()
    inner = to_arrow_schema(StructType.fromDDL(ddl))

    def parse(batches):
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                file, content, content_hash = (batch.column(c)[i].as_py() for c in range(3))
                size += len(content or b"")
                for r in parts_of_bytes(content, compat, source_lines):
                    rows.append({"file": file, "content_hash": content_hash} | r)
                    if size >= PIECE or len(rows) >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=inner)
                        rows = []
                size = size if rows else 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=inner)

    return files.select("file", "content", F.sha2("content", 256).alias("content_hash")).mapInArrow(parse, ddl)


def first_parts(analysis: DataFrame) -> DataFrame:
    """One row per file. An analysis that was stored before long files had several has no other rows."""
    return analysis.where("part = 0") if "part" in analysis.columns else analysis


def records(analysis: DataFrame, kind: str) -> DataFrame:
    """One kind's records, flat, with their file."""
    names = [f.split(":")[0] for f in KINDS[kind].split()]
    return analysis.select("file", F.explode(kind).alias("r")).select("file", *[F.col(f"r.{n}").alias(n) for n in names])


def module_info(analysis: DataFrame) -> DataFrame:
    """(name, path, is_package, docstring) per file: the dotted name climbs while directories hold an __init__.py.

    The list of package directories is exploded per file by its ancestors and joined, so nothing grows on the driver.
    """
    files = first_parts(analysis).select("file", "docstring")
    packages = files.where(F.element_at(F.split("file", "/"), -1) == "__init__.py").select(parent_directory("file").alias("dir")).distinct()
    parts = F.split(parent_directory("file"), "/")
    depth = F.when(parent_directory("file") == "", 0).otherwise(F.size(parts))
    up = files.select("file", parts.alias("parts"), depth.alias("depth")).where("depth > 0").select("file", "parts", "depth", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("k"))
    ancestors = up.select("file", "depth", "k", F.concat_ws("/", F.slice("parts", 1, F.col("k"))).alias("dir"))
    hits = ancestors.join(packages, "dir").groupBy("file").agg(F.max("depth").alias("depth"), F.collect_set("k").alias("ks"))
    # The package runs from the file's directory upwards for as long as every directory is one.
    runs = F.expr("aggregate(reverse(sequence(1, depth)), named_struct('n', 0, 'go', true), (s, k) -> if(s.go and array_contains(ks, k), named_struct('n', s.n + 1, 'go', true), named_struct('n', s.n, 'go', false)), s -> s.n)")
    lengths = hits.select("file", runs.alias("up"))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.py$", "")
    rows = files.join(lengths, "file", "left").withColumn("up", F.coalesce("up", F.lit(0)))
    is_package = stem == "__init__"
    directory = F.split(parent_directory("file"), "/")
    names = F.when(F.col("up") > 0, F.slice(directory, F.size(directory) - F.col("up") + 1, F.col("up"))).otherwise(F.array().cast("array<string>"))
    name = F.concat_ws(".", F.when(is_package, names).otherwise(F.concat(names, F.array(stem))))
    return rows.select(F.when(name == "", stem).otherwise(name).alias("name"), F.col("file").alias("path"), is_package.alias("is_package"), F.coalesce("docstring", F.lit("")).alias("docstring"))


def summary(analysis: DataFrame) -> DataFrame:
    """One row: files, files with errors, and the number of records of each kind."""
    first = F.col("part") == 0 if "part" in analysis.columns else F.lit(True)
    return analysis.agg(
        F.count_if(first).alias("files"), F.count_distinct(F.when(F.size("errors") > 0, F.col("file"))).alias("files_with_errors"), *[F.coalesce(F.sum(F.size(k)), F.lit(0)).alias(k) for k in KINDS]
    )
