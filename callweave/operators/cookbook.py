"""The query cookbook: named questions about a code graph. Each takes the graph and its parameters and returns a lazy DataFrame.

Every top-k has a total order, so that ties fall alike in every run. Lists are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.columns import percentage
from callweave.operators.match import hop, nodes, optional_hop, sorted_list, sorted_set, then_hop, top, without
from callweave.operators.points import edge_type_counts
from callweave.operators.traverse import call_components, cycles, min_depth, reach
from callweave.sources.schemas import EDGES, NODES
from callweave.sources.store import CodeGraph, tagged_counts

FUNCTION = "name file start_line end_line is_public".split()


def _cols(prefix: str, names: str) -> list:
    return [F.col(f"{prefix}_{n}").alias(n) for n in names.split()]


# 1. Functions


def functions_in_file(g: CodeGraph, file: str) -> DataFrame:
    rows = hop(g, "contains_function").where(F.col("a_path") == file)
    return rows.select(*_cols("b", "name start_line end_line is_public")).orderBy("start_line", "name")


def functions_in_files(g: CodeGraph, files: list[str]) -> DataFrame:
    rows = hop(g, "contains_function").where(F.col("a_path").isin(files))
    return rows.select(*_cols("b", "file name start_line end_line")).orderBy("file", "start_line", "name")


def all_files(g: CodeGraph) -> DataFrame:
    return g["files"].select("path", "language", "content_hash").orderBy("path")


def functions_named_like(g: CodeGraph, part: str) -> DataFrame:
    return g["functions"].where(F.col("name").contains(part)).select(*FUNCTION).orderBy("file", "start_line", "name")


def upstream_callers(g: CodeGraph, file: str, function: str, depth: int = 5) -> DataFrame:
    return reach(g, file, function, True, depth).select("name", "file", "start_line").distinct().orderBy("file", "name", "start_line")


def downstream_callees(g: CodeGraph, file: str, function: str, depth: int = 5) -> DataFrame:
    return reach(g, file, function, False, depth).select("name", "file", "start_line").distinct().orderBy("file", "name", "start_line")


def direct_calls(g: CodeGraph, file: str, function: str) -> DataFrame:
    rows = hop(g, "calls").where((F.col("a_file") == file) & (F.col("a_name") == function))
    return rows.select(F.col("a_name").alias("caller"), F.col("b_name").alias("callee"), F.col("b_file").alias("callee_file"), F.col("r_call_line").alias("call_line")).orderBy("call_line", "callee", "callee_file")


def call_chain_depth(g: CodeGraph, file: str, function: str, depth: int = 10) -> DataFrame:
    return min_depth(g, file, function, depth).select("id", "name", "file", "depth").orderBy("depth", "file", "name", "id")


def most_called_functions(g: CodeGraph, n: int = 20) -> DataFrame:
    """By distinct callers, a function node being its key. Only the winners are joined with their names."""
    best = top(g["calls"].groupBy("dst").agg(F.countDistinct("src").alias("callers")), n, F.col("callers").desc(), "dst")
    rows = best.join(nodes(g, "functions", "b"), F.col("dst") == F.col("b_id"))
    return rows.select(F.col("dst").alias("id"), *_cols("b", "name file"), "callers").orderBy(F.col("callers").desc(), "id")


def dead_code(g: CodeGraph) -> DataFrame:
    """Functions that nothing calls."""
    return without(g["functions"], g, "calls", "id", "dst").select("id", "name", "file", "start_line").orderBy("file", "start_line", "id")


# 2. Classes


def classes_in_file(g: CodeGraph, file: str) -> DataFrame:
    rows = hop(g, "contains_class").where(F.col("a_path") == file)
    return rows.select(*_cols("b", "name start_line end_line is_public")).orderBy("start_line", "name")


def methods_of_class(g: CodeGraph, class_name: str) -> DataFrame:
    rows = hop(g, "method_of").where(F.col("b_name") == class_name)
    return rows.select(*_cols("a", "name file start_line end_line is_public")).orderBy("start_line", "name", "file")


def attributes_of_class(g: CodeGraph, class_name: str) -> DataFrame:
    rows = hop(g, "has_attribute").where(F.col("a_name") == class_name)
    return rows.select(*_cols("b", "name type_hint definition_line is_class_attribute")).orderBy("definition_line", "name")


def bases_of_class(g: CodeGraph, class_name: str) -> DataFrame:
    return g["classes"].where(F.col("name") == class_name).select("name", "file", F.concat_ws(",", "bases").alias("bases"))


def class_with_methods(g: CodeGraph, class_name: str) -> DataFrame:
    rows = hop(g, "method_of").where(F.col("b_name") == class_name).groupBy("b_id", "b_name", "b_file")
    return rows.agg(sorted_list("a_name").alias("methods"), F.count("*").alias("method_count")).select(*_cols("b", "name file"), "methods", "method_count")


# 3. Decorators


def functions_with_decorator(g: CodeGraph, decorator: str) -> DataFrame:
    rows = hop(g, "decorated_by").where(F.col("b_name") == decorator)
    return rows.select(*_cols("a", "name file start_line"), F.col("b_arguments").alias("arguments")).orderBy("file", "start_line", "name")


def classes_with_decorator(g: CodeGraph, decorator: str) -> DataFrame:
    rows = hop(g, "class_decorated_by").where(F.col("b_name") == decorator)
    return rows.select(*_cols("a", "name file start_line")).orderBy("file", "start_line", "name")


def decorators_in_file(g: CodeGraph, file: str) -> DataFrame:
    rows = then_hop(hop(g, "contains_function", r="c").where(F.col("a_path") == file), g, "decorated_by", "b", "d", "r")
    return rows.groupBy(F.col("d_name").alias("decorator")).agg(sorted_set("b_name").alias("functions")).orderBy("decorator")


# 4. Exceptions


def _exception_functions(g: CodeGraph, exception: str, context: str) -> DataFrame:
    rows = hop(g, "handles_exception").where((F.col("b_name") == exception) & (F.col("r_context") == context))
    return rows.select(*_cols("a", "name file"), F.col("r_line_number").alias("line_number")).orderBy("file", "line_number", "name")


def functions_raising(g: CodeGraph, exception: str) -> DataFrame:
    return _exception_functions(g, exception, "raise")


def functions_catching(g: CodeGraph, exception: str) -> DataFrame:
    return _exception_functions(g, exception, "catch")


def exceptions_in_file(g: CodeGraph, file: str) -> DataFrame:
    rows = then_hop(hop(g, "contains_function", r="c").where(F.col("a_path") == file), g, "handles_exception", "b", "x", "r")
    return rows.groupBy(F.col("x_name").alias("exception"), F.col("r_context").alias("context")).agg(sorted_set("b_name").alias("functions")).orderBy("exception", "context")


def exceptions_of_function(g: CodeGraph, file: str, function: str) -> DataFrame:
    rows = hop(g, "handles_exception").where((F.col("a_file") == file) & (F.col("a_name") == function))
    return rows.select(F.col("b_name").alias("exception"), F.col("r_context").alias("context"), F.col("r_line_number").alias("line_number")).orderBy("line_number", "exception")


# 5. Imports


def imports_in_file(g: CodeGraph, file: str) -> DataFrame:
    rows = hop(g, "has_import").where(F.col("a_path") == file)
    return rows.select(*_cols("b", "imported_name import_type alias line_number is_relative")).orderBy("line_number", "imported_name")


def files_importing(g: CodeGraph, name: str) -> DataFrame:
    rows = hop(g, "has_import").where(F.col("b_imported_name") == name)
    return rows.select(F.col("a_path").alias("path"), F.col("b_line_number").alias("line_number")).orderBy("path", "line_number")


def import_statistics(g: CodeGraph) -> DataFrame:
    return hop(g, "has_import").agg(F.count("*").alias("total_imports"), F.countDistinct("b_imported_name").alias("unique_names"), F.countDistinct("a_path").alias("files"))


# 6. Variables


def variables_in_file(g: CodeGraph, file: str) -> DataFrame:
    rows = hop(g, "contains_variable").where(F.col("a_path") == file)
    return rows.select(*_cols("b", "name definition_line scope")).orderBy("definition_line", "name")


def variables_named_like(g: CodeGraph, part: str) -> DataFrame:
    return g["variables"].where(F.col("name").contains(part)).select("name", "file", "definition_line", "scope").orderBy("file", "definition_line", "name")


def module_variables(g: CodeGraph) -> DataFrame:
    return g["variables"].where("scope = 'module'").select("name", "file", "definition_line").orderBy("file", "definition_line", "name")


# 7. Statistics

COUNTED = ("files", "functions", "classes", "variables", "imports", "decorators", "exceptions")


def overall_counts(g: CodeGraph, tables: tuple[str, ...] = COUNTED) -> DataFrame:
    """One row with a count per table; an empty table counts 0."""
    counts = tagged_counts(g, list(tables))
    return counts.agg(*[F.coalesce(F.sum(F.when(F.col("table") == t, F.col("n"))), F.lit(0)).alias(t) for t in tables])


def overall_counts_with_attributes(g: CodeGraph) -> DataFrame:
    return overall_counts(g, (*COUNTED, "attributes"))


def functions_per_file(g: CodeGraph, n: int = 20) -> DataFrame:
    rows = hop(g, "contains_function").groupBy(F.col("a_path").alias("path")).agg(F.count("*").alias("function_count"))
    return top(rows, n, F.col("function_count").desc(), "path")


def most_decorated_functions(g: CodeGraph, n: int = 20) -> DataFrame:
    rows = hop(g, "decorated_by").groupBy(*_cols("a", "name file")).agg(F.count("*").alias("decorator_count"), sorted_set("b_name").alias("decorators"))
    return top(rows, n, F.col("decorator_count").desc(), "name", "file")


def classes_per_file(g: CodeGraph) -> DataFrame:
    rows = hop(g, "contains_class").groupBy(F.col("a_path").alias("path")).agg(F.count("*").alias("class_count"), sorted_list("b_name").alias("classes"))
    return rows.orderBy(F.col("class_count").desc(), "path")


def largest_classes(g: CodeGraph, n: int = 20) -> DataFrame:
    """Methods are counted by class key, before any name is read; lists of methods are gathered for the winners alone."""
    by_key = g["method_of"].join(g["functions"].select("id"), F.col("src") == F.col("id"), "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    named = by_key.join(g["classes"].select("id", "name", "file"), "id")
    best = top(named.groupBy("name", "file").agg(F.sum("n").alias("method_count")), n, F.col("method_count").desc(), "name", "file")
    keys = g["classes"].select(F.col("id").alias("dst"), "name", "file").join(F.broadcast(best), ["name", "file"])  # n names
    methods = g["method_of"].join(F.broadcast(keys), "dst").join(g["functions"].select(F.col("id").alias("src"), F.col("name").alias("method")), "src")
    lists = methods.groupBy("name", "file", "method_count").agg(sorted_list("method").alias("methods"))
    return lists.orderBy(F.col("method_count").desc(), "name", "file")


def most_used_decorators(g: CodeGraph, n: int = 20) -> DataFrame:
    uses = g["decorated_by"].select("dst").unionByName(g["class_decorated_by"].select("dst"))
    rows = uses.join(g["decorators"], F.col("dst") == F.col("id")).groupBy(F.col("name").alias("decorator")).agg(F.count("*").alias("uses"))
    return top(rows, n, F.col("uses").desc(), "decorator")


def exception_coverage(g: CodeGraph, n: int = 20) -> DataFrame:
    rows = hop(g, "handles_exception").groupBy(F.col("b_name").alias("exception"), F.col("r_context").alias("context")).agg(F.countDistinct("a_id").alias("functions"))
    return top(rows, n, F.col("functions").desc(), "exception", "context")


# 8. Findings


def private_methods_without_handling(g: CodeGraph) -> DataFrame:
    rows = without(hop(g, "method_of").where("not a_is_public"), g, "handles_exception", "a_id")
    return rows.select(F.col("b_name").alias("class_name"), *_cols("a", "name file start_line")).orderBy("class_name", "file", "start_line", "name")


def complex_classes(g: CodeGraph, more_than: int = 10) -> DataFrame:
    """Classes with methods and attributes, more than so many together. Each side is counted before the two meet."""
    methods = g["method_of"].groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("methods"))
    attributes = g["has_attribute"].groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("attributes"))
    rows = methods.join(attributes, "id").where(F.col("methods") + F.col("attributes") > more_than).join(g["classes"].select("id", "name", "file"), "id")
    total = (F.col("methods") + F.col("attributes")).alias("complexity")
    return rows.select("id", "name", "file", "methods", "attributes", total).orderBy(F.col("complexity").desc(), "id")


def classes_with_most_methods(g: CodeGraph, n: int = 20) -> DataFrame:
    rows = hop(g, "method_of").groupBy("b_id", *_cols("b", "name file")).agg(F.countDistinct("a_id").alias("method_count")).withColumnRenamed("b_id", "id")
    return top(rows, n, F.col("method_count").desc(), "id")


def files_with_most_imports(g: CodeGraph, n: int = 20) -> DataFrame:
    rows = hop(g, "has_import").groupBy(F.col("a_path").alias("path")).agg(F.countDistinct("b_imported_name").alias("unique_imports"), F.count("*").alias("total_imports"))
    return top(rows, n, F.col("unique_imports").desc(), F.col("total_imports").desc(), "path")


def public_surface(g: CodeGraph, file: str) -> DataFrame:
    """One row: the file's public functions, and the public classes; empty lists where there are none."""
    functions = hop(g, "contains_function").where((F.col("a_path") == file) & F.col("b_is_public"))
    classes = hop(g, "contains_class").where((F.col("a_path") == file) & F.col("b_is_public"))
    names = functions.select(F.col("b_name").alias("f"), F.lit(None).cast("string").alias("c")).unionByName(classes.select(F.lit(None).cast("string").alias("f"), F.col("b_name").alias("c")))
    return names.agg(sorted_set("f").alias("functions"), sorted_set("c").alias("classes"))


def functions_with_optional_class(g: CodeGraph, file: str) -> DataFrame:
    """Every function of the file, with its class where it is a method."""
    rows = optional_hop(nodes(g, "functions", "a").where(F.col("a_file") == file), g, "method_of", "a", "b", "r")
    return rows.select(F.col("a_id").alias("id"), F.col("a_name").alias("name"), F.col("b_name").alias("class_name"))


# 9. Catalog


def file_count(g: CodeGraph) -> DataFrame:
    return g["files"].agg(F.count("*").alias("files"))


def list_tables(g: CodeGraph) -> DataFrame:
    rows = [(t.name, "NODE", t.label, None, None) for t in NODES.values()] + [(t.name, "REL", t.label, NODES[t.src].label, NODES[t.dst].label) for t in EDGES.values()]
    return g.spark.createDataFrame(rows, "name string, kind string, label string, src_label string, dst_label string")


def edge_counts(g: CodeGraph) -> DataFrame:
    """(edge, n) with the total."""
    counts = tagged_counts(g, list(EDGES)).withColumnRenamed("table", "edge")
    return counts.unionByName(counts.agg(F.sum("n").alias("n")).select(F.lit("total").alias("edge"), "n"))


def edge_type_shares(g: CodeGraph) -> DataFrame:
    rows = edge_type_counts(g).select("type", F.concat_ws(" -> ", "src_label", "dst_label").alias("direction"), "n", percentage("n", "total", 2).alias("percent"))
    return rows.orderBy(F.col("n").desc(), "type", "direction")


def populated_labels(g: CodeGraph) -> DataFrame:
    return tagged_counts(g, list(NODES)).where("n > 0").orderBy("table")


# Further reports


def high_fan_in(g: CodeGraph, n: int = 20) -> DataFrame:
    """By call rows, functions of one name together."""
    rows = hop(g, "calls").groupBy(F.col("b_name").alias("name")).agg(F.count("*").alias("calls"))
    return top(rows, n, F.col("calls").desc(), "name")


def call_cycles(g: CodeGraph, max_length: int = 3) -> DataFrame:
    """The cycles of at most ``max_length`` calls, each as a path. functions_on_cycles() has no bound."""
    return cycles(g, max_length)


def functions_on_cycles(g: CodeGraph) -> DataFrame:
    """Every function on a cycle of calls of any length, with its component."""
    return g["functions"].select("id", "name", "file").join(call_components(g), "id").orderBy("component", "id")


def orphans(g: CodeGraph) -> DataFrame:
    """Functions that neither call nor are called."""
    rows = without(without(g["functions"], g, "calls", "id", "dst"), g, "calls", "id", "src")
    return rows.select("id", "name", "file").orderBy("id")


def top_called_by_name(g: CodeGraph, n: int = 5) -> DataFrame:
    return high_fan_in(g, n)


def top_classes_by_methods(g: CodeGraph, n: int = 5) -> DataFrame:
    rows = hop(g, "method_of").groupBy(F.col("b_name").alias("name")).agg(F.count("*").alias("method_count"))
    return top(rows, n, F.col("method_count").desc(), "name")


def top_files_by_functions(g: CodeGraph, n: int = 5) -> DataFrame:
    return functions_per_file(g, n)


def table_counts(g: CodeGraph) -> DataFrame:
    return tagged_counts(g, [*NODES, *EDGES]).orderBy("table")


def most_called_with_names(g: CodeGraph, n: int = 10) -> DataFrame:
    """Edges are counted first; names are joined to the winners, and stay null for unknown ones."""
    best = top(g["calls"].groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("calls")), n, F.col("calls").desc(), "id")
    return best.join(g["functions"].select("id", "name", "file"), "id", "left").orderBy(F.col("calls").desc(), "id")


def classes_with_most_bases(g: CodeGraph, n: int = 10) -> DataFrame:
    best = top(g["inherits"].groupBy(F.col("src").alias("id")).agg(F.count("*").alias("bases")), n, F.col("bases").desc(), "id")
    return best.join(g["classes"].select("id", "name", "file"), "id", "left").orderBy(F.col("bases").desc(), "id")


def inheritance_totals(g: CodeGraph) -> DataFrame:
    edges = g["inherits"].agg(F.count("*").alias("edges"), F.countDistinct("src").alias("classes_with_bases"))
    return edges.crossJoin(g["classes"].agg(F.count("*").alias("classes")))


def file_complexity(g: CodeGraph, n: int = 10) -> DataFrame:
    """Functions, classes and variables per file, absent ones 0. Tagged counts are added up, so no outer join is needed."""
    parts = [g[t].groupBy("file").agg(F.count("*").alias("n")).withColumn("kind", F.lit(t)) for t in ("functions", "classes", "variables")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == t, F.col("n"))), F.lit(0)).alias(t) for t in ("functions", "classes", "variables")]
    return top(rows.groupBy("file").agg(*sums, F.sum("n").alias("total")), n, F.col("total").desc(), "file")


def most_imported(g: CodeGraph, n: int = 15) -> DataFrame:
    rows = g["imports"].groupBy("imported_name").agg(F.count("*").alias("imports"))
    return top(rows, n, F.col("imports").desc(), "imported_name")


def import_types(g: CodeGraph) -> DataFrame:
    return g["imports"].groupBy("import_type").agg(F.count("*").alias("imports")).orderBy(F.col("imports").desc(), "import_type")
