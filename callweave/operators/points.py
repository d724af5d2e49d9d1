"""Point queries of the graph's API, each a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.columns import null_if_empty, percentage
from callweave.operators.match import hop, sorted_list, top
from callweave.sources.schemas import EDGES, NODES
from callweave.sources.store import CodeGraph, counted


def callers(graph: CodeGraph, file: str, function: str) -> DataFrame:
    rows = hop(graph, "calls").where((F.col("b_file") == file) & (F.col("b_name") == function))
    return rows.select(F.col("a_file").alias("file"), F.col("a_name").alias("name"), F.col("r_call_line").alias("call_line"))


def callees(graph: CodeGraph, file: str, function: str) -> DataFrame:
    rows = hop(graph, "calls").where((F.col("a_file") == file) & (F.col("a_name") == function))
    return rows.select(F.col("b_file").alias("file"), F.col("b_name").alias("name"), F.col("r_call_line").alias("call_line"))


def variable_usage(graph: CodeGraph, file: str, name: str, definition_line: int) -> DataFrame:
    """Functions that use (not define) the variable, found by its natural key."""
    rows = hop(graph, "references").where((F.col("b_file") == file) & (F.col("b_name") == name) & (F.col("b_definition_line") == definition_line))
    return rows.where("r_context = 'use'").select(F.col("a_file").alias("file"), F.col("a_name").alias("name"), F.col("r_line_number").alias("line"))


def _first(df: DataFrame, file: str, name: str) -> DataFrame:
    return df.where((F.col("file") == file) & (F.col("name") == name)).orderBy("start_line", "id").limit(1)


def get_function(graph: CodeGraph, file: str, name: str) -> DataFrame:
    """The first function of that name in the file, or no row."""
    return _first(graph["functions"], file, name)


def get_class(graph: CodeGraph, file: str, name: str) -> DataFrame:
    return _first(graph["classes"], file, name)


def functions_in_file(graph: CodeGraph, file: str) -> DataFrame:
    return graph["functions"].where(F.col("file") == file)


def classes_in_file(graph: CodeGraph, file: str) -> DataFrame:
    return graph["classes"].where(F.col("file") == file)


def multiply_decorated(graph: CodeGraph) -> DataFrame:
    """Functions with more than one decorator, with the names."""
    rows = hop(graph, "decorated_by").groupBy("a_id", "a_name", "a_file").agg(F.count("*").alias("decorator_count"), sorted_list("b_name").alias("decorators"))
    return rows.where("decorator_count > 1").select(F.col("a_id").alias("id"), F.col("a_name").alias("name"), F.col("a_file").alias("file"), "decorator_count", "decorators")


def imports_of_file(graph: CodeGraph, file: str) -> DataFrame:
    rows = hop(graph, "has_import").where(F.col("a_path") == file)
    return rows.select(*[(null_if_empty("b_alias") if c == "alias" else F.col(f"b_{c}")).alias(c) for c in graph["imports"].columns])


def decorators_of_function(graph: CodeGraph, file: str, function: str) -> DataFrame:
    rows = hop(graph, "decorated_by").where((F.col("a_file") == file) & (F.col("a_name") == function))
    return rows.select(*[F.col(f"b_{c}").alias(c) for c in graph["decorators"].columns], F.col("r_position").alias("position"))


def attributes_of_class(graph: CodeGraph, file: str, class_name: str) -> DataFrame:
    rows = hop(graph, "has_attribute").where((F.col("a_file") == file) & (F.col("a_name") == class_name))
    return rows.select(*[(null_if_empty("b_type_hint") if c == "type_hint" else F.col(f"b_{c}")).alias(c) for c in graph["attributes"].columns])


def functions_raising(graph: CodeGraph, exception: str) -> DataFrame:
    rows = hop(graph, "handles_exception").where((F.col("b_name") == exception) & (F.col("r_context") == "raise"))
    return rows.select(F.col("a_file").alias("file"), F.col("a_name").alias("name"), F.col("a_start_line").alias("start_line")).distinct()


def module_hierarchy(graph: CodeGraph) -> DataFrame:
    return graph["modules"].withColumn("docstring", null_if_empty("docstring"))


def import_usages(graph: CodeGraph, name: str) -> DataFrame:
    return graph["imports"].where(F.col("imported_name") == name).select("file", "line_number")


def attribute_modifiers(graph: CodeGraph, class_name: str, attribute: str) -> DataFrame:
    rows = hop(graph, "accesses").where((F.col("b_class_name") == class_name) & (F.col("b_name") == attribute))
    rows = rows.where(F.col("r_access_type").isin("write", "read_write"))
    return rows.select(F.col("a_file").alias("file"), F.col("a_name").alias("name"), F.col("r_line_number").alias("line"))


def files_unchanged(graph: CodeGraph, scanned: DataFrame) -> DataFrame:
    """(path, unchanged) for scanned (path, content_hash)."""
    known = graph["files"].select(F.col("path"), F.col("content_hash").alias("_known"))
    return scanned.join(known, "path", "left").select("path", F.coalesce(F.col("content_hash") == F.col("_known"), F.lit(False)).alias("unchanged"))


def file_exists(graph: CodeGraph, path: str, content_hash: str) -> bool:
    return not graph["files"].where((F.col("path") == path) & (F.col("content_hash") == content_hash)).isEmpty()


def most_called(graph: CodeGraph, n: int = 20) -> DataFrame:
    """Callees by number of call rows, functions of one name and file together."""
    rows = hop(graph, "calls").groupBy(F.col("b_name").alias("name"), F.col("b_file").alias("file")).agg(F.count("*").alias("call_count"))
    return top(rows, n, F.col("call_count").desc(), "name", "file")


def statistics(graph: CodeGraph) -> DataFrame:
    """(table, n, percent): rows of each table, and nodes' and edges' totals; percent is the share of all nodes, or of all edges. Every table is read once."""
    found, rows = counted(graph, [*NODES, *EDGES]), []
    for names, total in ((NODES, "total_nodes"), (EDGES, "total_edges")):
        whole = sum(found[n] for n in names)
        rows += [(n, found[n], whole) for n in names] + [(total, whole, whole)]
    table = graph.spark.createDataFrame(rows, "table string, n long, total long")
    return table.select("table", "n", percentage("n", "total").alias("percent"))


def edge_type_counts(graph: CodeGraph) -> DataFrame:
    """(type, src_label, dst_label, n, total) of all edge types that have edges. Every table is counted once; labels that two tables share are added up."""
    found: dict[tuple[str, str, str], int] = {}
    for name, n in counted(graph, list(EDGES)).items():
        t = EDGES[name]
        key = (t.label, NODES[t.src].label, NODES[t.dst].label)
        found[key] = found.get(key, 0) + n
    whole = sum(found.values())
    return graph.spark.createDataFrame([(*k, n, whole) for k, n in found.items() if n], "type string, src_label string, dst_label string, n long, total long")
