"""Changes to a graph. Each takes a graph and a batch of rows and returns the changed graph; nothing is written until the graph is.

An upsert replaces rows by key with one anti join; edges are added only where both ends exist.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import columns as C
from callweave.sources.schemas import EDGES, NODES
from callweave.sources.store import CodeGraph, conform


def _last(df: DataFrame, key: str) -> DataFrame:
    """One row per key; among several rows of a batch the greatest one stays."""
    rest = [c for c in df.columns if c != key]
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in rest])
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def upsert(graph: CodeGraph, table: str, rows: DataFrame) -> CodeGraph:
    """Adds nodes, or replaces those that have the same key."""
    key = NODES[table].key
    new = _last(conform(rows, table), key)
    return graph.replaced(**{table: graph[table].join(new.select(key), key, "left_anti").unionByName(new)})


def add_edges(graph: CodeGraph, table: str, rows: DataFrame, once: bool = False) -> CodeGraph:
    """Adds edges whose ends both exist; with ``once`` only those that are not there yet."""
    t = EDGES[table]
    new = conform(rows, table)
    for end, of in (("src", t.src), ("dst", t.dst)):
        new = new.join(graph[of].select(F.col(NODES[of].key).alias(end)), end, "left_semi")
    new = new.select(*t.schema.names)
    if once:
        new = new.dropDuplicates(["src", "dst"]).join(graph[table].select("src", "dst"), ["src", "dst"], "left_anti").select(*t.schema.names)
    return graph.replaced(**{table: graph[table].unionByName(new)})


def add_files(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    return upsert(graph, "files", rows)


def _contained(graph: CodeGraph, edge: str, rows: DataFrame) -> CodeGraph:
    return add_edges(graph, edge, rows.select(F.col("file").alias("src"), F.col("id").alias("dst")), once=True)


def add_functions(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    """(name, file, start_line, end_line, is_public, source_code, parent_class): functions, CONTAINS_FUNCTION, and METHOD_OF where there is a parent."""
    rows = rows.withColumn("id", C.function_key())
    graph = _contained(upsert(graph, "functions", rows), "contains_function", rows)
    if "parent_class" not in rows.columns:
        return graph
    parents = graph["classes"].select("file", F.col("name").alias("parent_class"), F.col("id").alias("dst"))
    return add_edges(graph, "method_of", rows.select(F.col("id").alias("src"), "file", "parent_class").join(parents, ["file", "parent_class"]), once=True)


def add_variables(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    """Variables; those of module scope are contained in their file."""
    rows = rows.withColumn("id", C.variable_key())
    return _contained(upsert(graph, "variables", rows), "contains_variable", rows.where("scope = 'module'"))


def add_classes(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    """Classes, CONTAINS_CLASS, and INHERITS to every class of a base's name."""
    rows = conform(rows.withColumn("id", C.class_key()), "classes")
    graph = _contained(upsert(graph, "classes", rows), "contains_class", rows)
    parents = graph["classes"].select(F.col("name").alias("base"), F.col("id").alias("dst"))
    return add_edges(graph, "inherits", rows.select(F.col("id").alias("src"), F.explode("bases").alias("base")).join(parents, "base"), once=True)


def add_imports(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    rows = rows.withColumn("id", C.import_key())
    return _contained(upsert(graph, "imports", rows), "has_import", rows)


def add_decorators(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    return upsert(graph, "decorators", rows.withColumn("id", C.decorator_key()))


def add_attributes(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    """Attributes, and HAS_ATTRIBUTE from every class of that name in the file."""
    rows = rows.withColumn("id", C.attribute_key())
    graph = upsert(graph, "attributes", rows)
    owners = graph["classes"].select(F.col("id").alias("src"), "file", F.col("name").alias("class_name"))
    return add_edges(graph, "has_attribute", owners.join(rows.select("file", "class_name", F.col("id").alias("dst")), ["file", "class_name"]), once=True)


def add_exceptions(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    """(name, file, line_number, context, function_name); the last two are part of the key where they are given."""
    for c in ("context", "function_name"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return upsert(graph, "exceptions", rows.withColumn("id", C.exception_key()))


def add_modules(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    return upsert(graph, "modules", rows.withColumn("id", C.module_key()))


def add_calls(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    """(caller_file, caller, caller_start_line, callee_file, callee, callee_start_line, call_line), or (src, dst, call_line), where the keys are known: then there are no keys to make for
    each call, and ends can be looked up before calls are multiplied."""
    if "src" in rows.columns and "dst" in rows.columns:
        return add_edges(graph, "calls", rows)
    src, dst = C.function_key("caller_file", "caller", "caller_start_line"), C.function_key("callee_file", "callee", "callee_start_line")
    return add_edges(graph, "calls", rows.select(src.alias("src"), dst.alias("dst"), "call_line"))


def add_exception_handling(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    return add_edges(graph, "handles_exception", rows)


def add_attribute_access(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    _only(rows, "access_type", ("read", "write", "read_write"))
    return add_edges(graph, "accesses", rows)


def add_class_dependency(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    return add_edges(graph, "depends_on", rows)


def add_variable_usage(graph: CodeGraph, rows: DataFrame) -> CodeGraph:
    """(function_file, function, start_line, file, name, definition_line, line_number, context): the variable is found by its natural key."""
    variables = graph["variables"].select(F.col("id").alias("dst"), "file", "name", "definition_line")
    found = rows.join(variables, ["file", "name", "definition_line"])
    return add_edges(graph, "references", found.select(C.function_key("function_file", "function", "start_line").alias("src"), "dst", "line_number", "context"))


def _only(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> None:
    bad = rows.where(~F.col(column).isin(list(allowed))).select(column).first()
    if bad is not None:
        raise ValueError(f"{column} must be one of {', '.join(allowed)}, not {bad[0]!r}")


def delete_files(graph: CodeGraph, paths: DataFrame) -> CodeGraph:
    """Removes files (a column ``path``), everything in them, and every edge at what goes."""
    graph.check_writable()
    gone = paths.select("path").distinct()
    changed, dead = {}, {}
    for t in NODES.values():
        df = graph[t.name]
        at = "file" if "file" in df.columns else "path"
        by = gone.withColumnRenamed("path", at)
        changed[t.name] = df.join(by, at, "left_anti").select(*df.columns)
        dead[t.name] = df.join(by, at, "left_semi").select(F.col(t.key).alias("_dead"))
    for t in EDGES.values():
        df = graph[t.name]
        for end, of in (("src", t.src), ("dst", t.dst)):
            df = df.join(dead[of], F.col(end) == F.col("_dead"), "left_anti")
        changed[t.name] = df
    return graph.replaced(**changed)


def merged(old: CodeGraph, new: CodeGraph) -> CodeGraph:
    """Both graphs' rows; where keys meet, the new node stays. Edges add up."""
    old.check_writable()
    out = {}
    for t in NODES.values():
        fresh = new[t.name].dropDuplicates([t.key])
        out[t.name] = old[t.name].join(fresh.select(t.key), t.key, "left_anti").select(*t.schema.names).unionByName(fresh)
    for t in EDGES.values():
        out[t.name] = reduce(DataFrame.unionByName, (old[t.name], new[t.name]))
    return CodeGraph(old.spark, out)
