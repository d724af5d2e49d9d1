"""The graph as a set of typed DataFrames, and its Parquet form: nodes/<table>.parquet and edges/<table>.parquet."""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions.columns import string_list
from callweave.sources.schemas import CONTEXTS, EDGES, ENDPOINTS, NODES, TABLES


#: Tables written at the same time.
AT_ONCE = 8
ASIDE = ".old"


class ReadOnlyError(RuntimeError):
    """A change to a graph that was opened read-only."""


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns and types of table ``name``, whichever producer's spelling it uses. Absent columns are null."""
    strip = {c: c.split(".", 1)[1] for c in df.columns if c.startswith(("n.", "r."))}
    df = df.withColumnsRenamed(strip)
    if name in EDGES:
        df = df.withColumnsRenamed({k: v for k, v in ENDPOINTS.items() if k in df.columns and v not in df.columns})
    if name == "calls" and "call_line" not in df.columns and "line_number" in df.columns:
        df = df.withColumnRenamed("line_number", "call_line")
    out = []
    for field in TABLES[name].schema:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        col = df[f"`{field.name}`"]
        if isinstance(field.dataType, T.ArrayType) and isinstance(df.schema[field.name].dataType, T.StringType):
            col = string_list(col)
        elif name in ("handles_exception", "references") and field.name == "context":
            known = F.create_map(*[F.lit(x) for kv in CONTEXTS.items() for x in kv])
            col = F.coalesce(known[col], col)
        elif name == "decorators" and field.name == "name":
            col = F.regexp_replace(col, "^@", "")
        out.append(col.cast(field.dataType).alias(field.name))
    return df.select(*out)


def require_file_columns(df: DataFrame) -> None:
    missing = [c for c in ("path", "language", "content_hash") if c not in [x.split(".")[-1] for x in df.columns]]
    if missing:
        raise ValueError(f"files table lacks {', '.join(missing)}")


class CodeGraph:
    """Named, typed tables. Nothing is computed until a result is asked for; every table that is not given is empty."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], read_only: bool = False, stored: bool = False):
        """``stored`` says that the tables are files: reading one again costs a scan, and nothing else."""
        self.spark, self._tables, self.read_only, self.stored = spark, dict(tables), read_only, stored
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise KeyError(f"no such table: {sorted(unknown)}")

    def __getitem__(self, name: str) -> DataFrame:
        have = self._tables.get(name)
        if have is None:
            have = self.spark.createDataFrame([], TABLES[name].schema)
        elif callable(have):
            have = have()
        self._tables[name] = have
        return have

    def replaced(self, **tables: DataFrame) -> CodeGraph:
        """This graph with other tables in place of its own; the change every mutator makes."""
        self.check_writable()
        return CodeGraph(self.spark, {**self._tables, **tables})

    def check_writable(self) -> None:
        if self.read_only:
            raise ReadOnlyError("the graph is open read-only")

    def cleared(self) -> CodeGraph:
        self.check_writable()
        return CodeGraph(self.spark, {})

    def tables(self) -> list[str]:
        return list(TABLES)

    def register_views(self, prefix: str = "") -> None:
        """Temporary views for spark.sql."""
        for name in TABLES:
            self[name].createOrReplaceTempView(prefix + name)

    # Parquet

    @staticmethod
    def from_parquet(spark: SparkSession, folder: str, read_only: bool = False, strict: bool = False) -> CodeGraph:
        """Opens a written graph. A table whose file is missing is empty; ``strict`` raises where an edge has an end that no node has."""
        found = {}
        for name in TABLES:
            df = read_table(spark, folder, name)
            if df is not None:
                found[name] = df
        graph = CodeGraph(spark, found, read_only, stored=True)
        if strict:
            bad = dangling_edges(graph).where("n > 0").collect()
            if bad:
                raise ValueError("edges without their ends: " + ", ".join(f"{r.table} {r.n}" for r in bad))
        return graph

    def write(self, folder: str, tables: list[str] | None = None, then: Callable[[], None] | None = None) -> dict[str, float]:
        """Writes tables, typed even where empty: all of them to new folders, which then take the old ones' places, so the graph may be read from ``folder`` itself. Seconds by table.

        ``then`` is called when all is written, before the first swap; the table of files is swapped last.
        """
        took, fresh = {}, {}

        def one(name: str) -> None:
            began = time.perf_counter()
            fresh[name] = write_beside(self[name], table_path(folder, name))
            took[name] = time.perf_counter() - began

        with ThreadPoolExecutor(AT_ONCE) as pool:  # jobs of small tables leave most cores idle
            list(pool.map(one, tables or TABLES))
        if then:
            then()
        for name in sorted(fresh, key=lambda n: n == "files"):
            take_place(self.spark, fresh[name], table_path(folder, name))
        return took


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{'nodes' if name in NODES else 'edges'}/{name}.parquet"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_beside(df: DataFrame, path: str) -> str:
    fresh = f"{path}.{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(fresh)
    return fresh


def take_place(spark: SparkSession, fresh: str, path: str) -> None:
    """Moves a written folder to ``path``. The old one steps aside first and is deleted last: whenever this stops, one of them is whole, and restored() finds it."""
    fs, new = _fs(spark, fresh)
    make = spark._jvm.org.apache.hadoop.fs.Path
    old, aside = make(path), make(f"{path}{ASIDE}")
    if fs.exists(old):
        fs.delete(aside, True)
        if not fs.rename(old, aside):
            raise OSError(f"could not move {path} aside")
    if not fs.rename(new, old):
        raise OSError(f"could not move {fresh} to {path}")
    fs.delete(aside, True)
    spark.catalog.refreshByPath(path)


def restored(spark: SparkSession, path: str) -> str:
    """``path``, after a folder that a broken swap left aside has come back to it."""
    fs, at = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}{ASIDE}")
    if not fs.exists(at) and fs.exists(aside):
        fs.rename(aside, at)
    return path


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame | None:
    """One table, or None where it is missing. ``columns`` prunes the scan."""
    path = restored(spark, table_path(folder, name))
    if not path_exists(spark, path):
        return None
    try:
        df = spark.read.parquet(path)
    except (AnalysisException, Py4JJavaError) as e:
        if not any(mark in str(e) for mark in ("UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "not a Parquet file")):
            raise
        warnings.warn(f"{path} cannot be read: {e}", stacklevel=2)
        return None
    if name == "files":
        require_file_columns(df)
    df = conform(df, name)
    return df.select(*columns) if columns else df


def counted(graph: CodeGraph, names: list[str]) -> dict[str, int]:
    """Rows of each table, all counted in one job: as many numbers as there are tables come to the driver."""
    found = {r.table: r.n for r in tagged_counts(graph, names).collect()}
    return {name: found[name] for name in names}


def tagged_counts(graph: CodeGraph, names: list[str]) -> DataFrame:
    """(table, n) in one job; tables without rows count 0."""
    parts = [graph[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n") for n in names]
    return reduce(DataFrame.unionByName, parts)


def folder_bytes(spark: SparkSession, path: str) -> int | None:
    """Bytes of a written table, None where it is missing."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else None


def export_summary(graph: CodeGraph, folder: str | None = None) -> DataFrame:
    """(table, kind, n, status, bytes): what an export holds; bytes are those of the tables written to ``folder``, null without one."""
    counts = tagged_counts(graph, list(TABLES))
    kind = F.when(F.col("table").isin(list(NODES)), "node").otherwise("edge")
    sizes = [(name, folder_bytes(graph.spark, table_path(folder, name)) if folder else None) for name in TABLES]
    rows = counts.join(F.broadcast(graph.spark.createDataFrame(sizes, "table string, bytes long")), "table")  # one row per table
    return rows.select("table", kind.alias("kind"), "n", F.when(F.col("n") > 0, "exported").otherwise("empty").alias("status"), "bytes")


def export_edges(graph: CodeGraph, name: str) -> DataFrame:
    """An edge table with its ends' keys as src_id and dst_id; edges without both ends are left out."""
    t = EDGES[name]
    src = graph[t.src].select(F.col(NODES[t.src].key).alias("src"))
    dst = graph[t.dst].select(F.col(NODES[t.dst].key).alias("dst"))
    rows = graph[name].join(src, "src", "left_semi").join(dst, "dst", "left_semi")
    return rows.select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), *[c for c in rows.columns if c not in ("src", "dst")])


def dangling_edges(graph: CodeGraph) -> DataFrame:
    """(table, n): edges one of whose ends is no node. Ends are counted before they are looked up: there may be many times more edges than ends."""
    parts = []
    for t in EDGES.values():
        lost = []
        for end, of in (("src", t.src), ("dst", t.dst)):
            ends = graph[t.name].groupBy(end).agg(F.count("*").alias("n"))
            lost.append(ends.join(graph[of].select(F.col(NODES[of].key).alias(end)), end, "left_anti").select("n"))
        parts.append(lost[0].union(lost[1]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(t.name).alias("table"), "n"))
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, key: str = "id", examples: int = 5) -> DataFrame:
    """Keys that several rows have, most frequent first; ``examples`` of them (a report)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), key).limit(examples)


def check_unique(df: DataFrame, key: str = "id") -> None:
    bad = duplicate_keys(df, key).collect()
    if bad:
        raise ValueError(f"{key} is not unique: " + ", ".join(f"{r[key]} x {r.n}" for r in bad))


def load_statistics(graph: CodeGraph) -> dict:
    """Rows and seconds by table, totals and errors."""
    out: dict = {"tables": {}, "errors": [], "total_nodes": 0, "total_edges": 0}
    began = time.perf_counter()
    for name in TABLES:
        at = time.perf_counter()
        try:
            n = graph[name].count()
        except AnalysisException as e:
            out["errors"].append(f"{name}: {e}")
            n = 0
        out["tables"][name] = {"seconds": time.perf_counter() - at, "rows": n}
        out["total_nodes" if name in NODES else "total_edges"] += n
    out["seconds"] = time.perf_counter() - began
    return out
