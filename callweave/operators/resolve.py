"""From parsed records to the graph: one row per natural key, surrogate keys, and edges by joins on names.

"First wins" is a row_number over the parser's order within a file, never arrival order, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import columns as C
from callweave.sources.scan import first_parts, module_info, records
from callweave.sources.store import CodeGraph, conform


#: Functions of one name that meet a call in one task.
BLOCK = 1024


def first_by(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row per key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller_file, caller, caller_start_line, callee_file, callee, callee_start_line, call_line), and (src, dst) where functions have an ``id``.

    A call matches every function of its file named as the caller, and every function of any file named as called. Unknown names drop out.

    The result is as large as the product of both, so what is multiplied is not shuffled again: a call is counted on both sides first, meets the side with fewer matches, and then
    the other in the last join. There a name's functions come in blocks of at most about BLOCK, and a call is sent to each of them, so no task has all pairs of a common name.
    The columns of either end are those of its function, and not of the call: a filter on an end, as a semi join is, goes before the multiplication.
    """
    keys = ["id"] if "id" in functions.columns else []
    rows = functions.select("file", "name", "start_line", *keys)

    def side(role: str, end: str, by: list[str]) -> DataFrame:
        """One end's columns, and the block among those of the same ``by``."""
        blocks = F.ceil(F.count("*").over(Window.partitionBy(*by)) / BLOCK)
        df = rows.withColumn(f"{role}_block", F.pmod(F.xxhash64("file", "start_line"), blocks))
        return df.select(F.col("file").alias(f"{role}_file"), F.col("name").alias(role), F.col("start_line").alias(f"{role}_start_line"), *[F.col(k).alias(end) for k in keys], f"{role}_block")

    a, b = side("caller", "src", ["file", "name"]), side("callee", "dst", ["name"])
    c = calls.select(F.col("file").alias("at_file"), F.col("caller_function").alias("at"), F.col("called_name").alias("called"), "call_line")
    c = c.join(rows.groupBy(F.col("file").alias("at_file"), F.col("name").alias("at")).agg(F.count("*").alias("callers")), ["at_file", "at"])
    c = c.join(rows.groupBy(F.col("name").alias("called")).agg(F.count("*").alias("callees")), "called")

    def sent(df: DataFrame, matches: str) -> DataFrame:
        return df.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(matches) / BLOCK) - 1)))

    is_caller, is_callee = (F.col("at_file") == F.col("caller_file")) & (F.col("at") == F.col("caller")), F.col("called") == F.col("callee")
    callers_last = sent(c.where("callees <= callers").join(b, is_callee), "callers").join(a, is_caller & (F.col("block") == F.col("caller_block")))
    callees_last = sent(c.where("callees > callers").join(a, is_caller), "callees").join(b, is_callee & (F.col("block") == F.col("callee_block")))
    out = ["caller_file", "caller", "caller_start_line", "callee_file", "callee", "callee_start_line", "call_line", *(["src", "dst"] if keys else [])]
    return callers_last.select(*out).unionByName(callees_last.select(*out))


def containing_function(points: DataFrame, functions: DataFrame, line: str = "line") -> DataFrame:
    """Points (file, line, ...) with the outermost function around them, as a range join within the file: the first start wins."""
    numbered = points.withColumn("_point", F.monotonically_increasing_id())
    fn = functions.select("file", F.col("name").alias("function"), "start_line", "end_line")
    rows = numbered.join(fn, "file").where((F.col("start_line") <= F.col(line)) & (F.col(line) <= F.col("end_line")))
    w = Window.partitionBy("file", "_point").orderBy("start_line", F.col("end_line").desc(), "function")
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place", "_point", "start_line", "end_line")


def inherits_edges(classes: DataFrame, scope: str = "file") -> DataFrame:
    """INHERITS from lists of bases. ``scope``: a parent is the first class of that name in the child's file (``file``), every class of
    that name (``global``), or the first of them all by file and line (``global_first``)."""
    child = classes.select(F.col("id").alias("src"), "file", F.explode("bases").alias("base"))
    if scope == "file":
        parents = first_by(classes.select("id", "file", "name", "start_line"), ["file", "name"], "start_line", "id")
        rows = child.join(parents.select(F.col("id").alias("dst"), "file", F.col("name").alias("base")), ["file", "base"])
    elif scope == "global":
        rows = child.join(classes.select(F.col("id").alias("dst"), F.col("name").alias("base")), "base")
    elif scope == "global_first":
        parents = classes.groupBy(F.col("name").alias("base")).agg(F.min_by("id", F.struct("file", "start_line", "id")).alias("dst"))
        rows = child.join(parents, "base")
    else:
        raise ValueError(f"scope must be file, global or global_first, not {scope!r}")
    return rows.select("src", "dst")


def build_graph(analysis: DataFrame, inherits_scope: str = "file") -> CodeGraph:
    """The whole graph of an analysis (scan.analyse(), best checkpointed or written first: every table reads it)."""
    spark = analysis.sparkSession
    files = first_parts(analysis).select(F.col("file").alias("path"), F.lit("python").alias("language"), "content_hash")

    functions = first_by(records(analysis, "functions"), ["file", "name", "start_line"], "ord").withColumn("id", C.function_key())
    classes = first_by(records(analysis, "classes"), ["file", "name", "start_line"], "ord").withColumn("id", C.class_key())
    variables = first_by(records(analysis, "variables"), ["file", "name", "definition_line", "scope"], "ord").withColumn("id", C.variable_key())
    imports = first_by(records(analysis, "imports_detailed"), ["file", "imported_name", "line_number"], "ord").withColumn("id", C.import_key())
    decorated = records(analysis, "decorators").withColumn("id", C.decorator_key())
    decorators = first_by(decorated, ["file", "name", "line_number"], "ord")
    attributes = first_by(records(analysis, "attributes"), ["file", "class_name", "name", "definition_line"], "ord").withColumn("id", C.attribute_key())
    thrown = records(analysis, "exceptions").withColumn("id", C.exception_key())
    exceptions = first_by(thrown, ["file", "name", "line_number", "context", "function_name"], "ord")

    first_function = first_by(functions, ["file", "name"], "ord").select("file", F.col("name").alias("function_name"), F.col("id").alias("src"))
    first_class = first_by(classes, ["file", "name"], "ord").select("file", F.col("name").alias("class_name"), F.col("id").alias("class_id"))
    first_variable = first_by(variables, ["file", "name"], "ord").select("file", F.col("name").alias("variable_name"), F.col("id").alias("dst"))
    first_attribute = first_by(attributes, ["file", "class_name", "name"], "ord").select("file", "class_name", "name", F.col("id").alias("dst"))
    last_exception = first_by(exceptions, ["file", "name", "line_number"], F.col("ord").desc()).select("file", "name", "line_number", F.col("id").alias("dst"))

    calls = resolve_calls(records(analysis, "calls"), functions).select("src", "dst", "call_line")
    method_of = functions.where("parent_class is not null").select(F.col("id").alias("src"), "file", F.col("parent_class").alias("class_name")).join(first_class, ["file", "class_name"]).select("src", F.col("class_id").alias("dst"))
    used = records(analysis, "usages").join(first_function, ["file", "function_name"]).join(first_variable, ["file", "variable_name"])
    uses = used.select("src", "dst", F.col("usage_line").alias("line_number"), F.lit("use").alias("context"))
    local = variables.where("scope <> 'module'").select("file", F.regexp_replace("scope", "^function:", "").alias("function_name"), F.col("id").alias("dst"), F.col("definition_line").alias("line_number"))
    defines = local.join(first_function, ["file", "function_name"]).select("src", "dst", "line_number", F.lit("define").alias("context"))
    on_functions = decorated.where("target_type = 'function'").withColumn("function_name", F.col("target_name"))
    decorated_by = on_functions.join(first_function, ["file", "function_name"]).select("src", F.col("id").alias("dst"), F.lit(0).alias("position"))
    on_classes = decorated.where("target_type = 'class'").withColumn("class_name", F.col("target_name"))
    class_decorated_by = on_classes.join(first_class, ["file", "class_name"]).select(F.col("class_id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("position"))
    has_attribute = attributes.join(first_class, ["file", "class_name"]).select(F.col("class_id").alias("src"), F.col("id").alias("dst"))
    owner = functions.select("file", F.col("name").alias("function_name"), F.col("start_line").alias("function_line"), F.col("id").alias("src"))
    accesses = records(analysis, "accesses").join(owner, ["file", "function_name", "function_line"]).join(first_attribute, ["file", "class_name", "name"]).select("src", "dst", "line_number", "access_type")
    handled = records(analysis, "exceptions").where("function_name is not null").select("file", "name", "line_number", "context", "function_name").distinct()
    handles = handled.join(first_function, ["file", "function_name"]).join(last_exception, ["file", "name", "line_number"]).select("src", "dst", "line_number", "context")

    modules = module_info(analysis).withColumn("id", C.module_key())
    inner = modules.where(F.col("name").contains(".")).select(F.col("id").alias("dst"), F.regexp_replace("name", r"\.[^.]*$", "").alias("name"))
    packages = modules.where("is_package").select("name", F.col("id").alias("src"))
    imported = records(analysis, "imports_detailed")
    by_name = F.when(F.col("import_type") == "module", F.col("imported_name")).otherwise(F.col("module"))
    target = modules.select(F.col("name").alias("target"), F.col("path").alias("dst"))
    imports_file = imported.where("not is_relative").select(F.col("file").alias("src"), by_name.alias("target"), "line_number").join(target, "target").select("src", "dst", "line_number", F.lit(True).alias("is_direct"))
    named = imported.where("import_type = 'unknown' and not is_relative").select(C.import_key().alias("src"), F.col("module").alias("target"), F.col("imported_name").alias("function_name"), "line_number")
    top_level = first_function.withColumnRenamed("src", "fn_id").withColumnRenamed("file", "dst_file")
    imports_from = named.join(target.withColumnRenamed("dst", "dst_file"), "target").join(top_level, ["dst_file", "function_name"]).select("src", F.col("fn_id").alias("dst"), "line_number")

    def contains(df: DataFrame) -> DataFrame:
        return df.select(F.col("file").alias("src"), F.col("id").alias("dst"))

    made = {
        "files": files,
        "functions": functions,
        "classes": classes,
        "variables": variables,
        "imports": imports.withColumn("alias", F.coalesce("alias", F.lit(""))),
        "decorators": decorators,
        "attributes": attributes.withColumn("type_hint", F.coalesce("type_hint", F.lit(""))),
        "exceptions": exceptions,
        "modules": modules,
        "calls": calls,
        "references": uses.unionByName(defines),
        "contains_function": contains(functions),
        "contains_class": contains(classes),
        "contains_variable": contains(variables),
        "imports_file": imports_file,
        "inherits": inherits_edges(classes, inherits_scope),
        "method_of": method_of,
        "has_import": contains(imports),
        "imports_from": imports_from,
        "decorated_by": decorated_by,
        "class_decorated_by": class_decorated_by,
        "has_attribute": has_attribute,
        "accesses": accesses,
        "handles_exception": handles,
        "contains_module": inner.join(packages, "name").select("src", "dst"),
        "module_of": modules.select(F.col("path").alias("src"), F.col("id").alias("dst")),
    }
    return CodeGraph(spark, {name: conform(df, name) for name, df in made.items()})


def analyses_of(graph: CodeGraph) -> DataFrame:
    """The inverse of normalisation: one row per file with its functions, classes, variables and imports as sorted lists of structs."""
    out = graph["files"].select(F.col("path").alias("file"), "content_hash")
    for name, order in (("functions", "start_line"), ("classes", "start_line"), ("variables", "definition_line"), ("imports", "line_number")):
        cols = [c for c in graph[name].columns if c not in ("file", order, "id")]
        nested = graph[name].groupBy("file").agg(F.array_sort(F.collect_list(F.struct(order, "id", *cols))).alias(name))
        out = out.join(nested, "file", "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(nested.schema[name].dataType)))
    return out
