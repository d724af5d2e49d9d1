"""Registered queries over source texts: extraction, resolution to edges, the written graph and its exports, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import columns as C
from callweave.operators import mutate as W
from callweave.operators import points as P
from callweave.operators import resolve as R
from callweave.plans.sources_from_suppliers import BLOCK, SQL, supplier_sources
from callweave.session import checkpointed, shared_checkpoint_dir
from callweave.sources import scan, udtf
from callweave.sources.schemas import EDGES, NODES, TABLES
from callweave.sources.store import CodeGraph, export_summary, load_statistics, table_path
from callweave.streaming.refresh import compare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_sources(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region")))


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.analyse(scan.spread(scan.from_texts(sources(spark, sf_dir))))


def graph(spark: SparkSession, sf_dir: str, scope: str = "file") -> CodeGraph:
    """One parse, however many tables read it."""
    return graph_and_analysis(spark, sf_dir, scope)[0]


def graph_and_analysis(spark: SparkSession, sf_dir: str, scope: str = "file") -> tuple[CodeGraph, DataFrame]:
    """The graph, and the parsed records that it was made from."""
    parsed = checkpointed(analysis(spark, sf_dir))
    return R.build_graph(parsed, scope), parsed


def _with(query: str, more: str = "") -> str:
    return f"WITH {SQL.strip()}{', ' + more if more else ''} {query}"


def add(name: str, make: Query, query: str | None, more: str = "") -> None:
    QUERIES[name] = make
    if query is not None:
        ORACLES[name] = _with(query, more)


def _records(name: str, kind: str, columns: str, query: str) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scan.records(analysis(spark, sf_dir), kind)
        return rows.select("file", *[F.array_join(c, ",").alias(c) if c in ("bases", "methods") else c for c in columns.split()])

    add(name, make, query)


def _edges(name: str, table: str, query: str, drop: tuple[str, ...] = ()) -> None:
    add(name, lambda spark, sf_dir: graph(spark, sf_dir)[table].drop(*drop), query)


# Extraction
_records("x1_x5_functions", "functions", "name start_line end_line is_public parent_class", "SELECT file, name, start_line, end_line, is_public, parent_class FROM fns")
_texts = BLOCK.split("\n")


def _slice(low: int, high: int) -> str:
    """SQL of the block's lines ``low`` to ``high``."""
    text = "\n".join(_texts[low - 1 : high]).replace("'", "''").replace("\n", "' || chr(10) || '")
    return "'" + text.replace("{k}", "' || k || '").replace("{p}", "' || p || '") + "'"


add(
    "s6_x1_source_slices",
    lambda spark, sf_dir: scan.records(analysis(spark, sf_dir), "functions").select("file", "name", "start_line", "source_code"),
    " UNION ALL ".join(f"SELECT file, {name} AS name, base + {low} AS start_line, {_slice(low, high)} AS source_code FROM blocks" for name, low, high in (("'__init__'", 4, 6), ("'area'", 8, 9), ("'_grow'", 10, 14), ("'make_' || k", 15, 17))),
)
_records("x4_classes", "classes", "name start_line end_line bases methods is_public", "SELECT file, name, start_line, end_line, 'C' || p AS bases, '__init__,area,_grow' AS methods, true AS is_public FROM cls")
_records(
    "x3_calls", "calls", "caller_function caller_start_line called_name call_line",
    "SELECT file, 'area' AS caller_function, base + 8 AS caller_start_line, 'make_' || p AS called_name, base + 9 AS call_line FROM blocks UNION ALL SELECT file, '_grow', base + 10, 'KeyError', base + 13 FROM blocks UNION ALL SELECT file, '_grow', base + 10, 'Bad', base + 14 FROM blocks UNION ALL SELECT file, 'make_' || k, base + 15, 'C' || k, base + 16 FROM blocks",
)
_records("x6_imports", "imports", "module line_number is_relative", "SELECT file, coalesce(module, imported_name) AS module, line_number, false AS is_relative FROM imps WHERE imported_name <> 'helpers'")
_records("x7_imports_detailed", "imports_detailed", "imported_name import_type alias line_number is_relative module", "SELECT file, imported_name, import_type, alias, line_number, is_relative, module FROM imps")
_records("x8_variables", "variables", "name definition_line scope", "SELECT file, name, line AS definition_line, scope FROM vars")
_records("x9_usages", "usages", "variable_name function_name usage_line", "SELECT file, variable_name, function_name, usage_line FROM uses")
_records("x10_x11_decorators", "decorators", "name line_number arguments target_name target_type target_line", "SELECT file, name, line_number, arguments, target_name, target_type, target_line FROM decs")
_records("x12_attributes", "attributes", "name class_name definition_line type_hint is_class_attribute", "SELECT file, name, class_name, definition_line, type_hint, is_class_attribute FROM attrs")
_records("x12_accesses", "accesses", "name class_name function_name function_line line_number access_type", "SELECT file, name, class_name, function_name, function_line, line_number, access_type FROM touched")
_records("x13_x14_exceptions", "exceptions", "name line_number context function_name", "SELECT file, name, line_number, context, '_grow' AS function_name FROM excs")
add("x15_modules", lambda spark, sf_dir: scan.module_info(checkpointed(analysis(spark, sf_dir))), "SELECT name, path, is_package, docstring FROM mods")


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules with a line of nonsense after each class: every file has an error, and every definition but the class-level rest can be read."""
    texts = sources(spark, sf_dir).select("file", F.replace("text", F.lit("\ndef make_"), F.lit("\nthis is no ( code\ndef make_")).alias("text"))
    return scan.analyse(scan.spread(scan.from_texts(texts)))


def s5_broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {"errors": "errors", "functions": "functions", "classes": "classes", "imports": "imports_detailed"}
    return broken(spark, sf_dir).groupBy("file").agg(*[F.sum(F.size(c)).cast("int").alias(name) for name, c in sizes.items()])


add(
    "s5_broken_files", s5_broken_files,
    "SELECT file, 1 AS errors, CAST(4 * count(*) AS INTEGER) AS functions, CAST(count(*) AS INTEGER) AS classes, 4 AS imports FROM blocks GROUP BY file UNION ALL SELECT path, 0, 0, 0, 0 FROM mods WHERE is_package",
)
add(
    "u1_py_functions_lateral",
    lambda spark, sf_dir: udtf.registered(spark).sql("SELECT s.file, f.* FROM {s} AS s, LATERAL py_functions(s.text) AS f", s=sources(spark, sf_dir)),
    "SELECT file, name, start_line, end_line, is_public, parent_class FROM fns",
)

# Joins of the resolution
_edges("j1_j2_calls", "calls", "SELECT a.id AS src, b.id AS dst, l.base + 9 AS call_line FROM blocks l JOIN fns a ON a.file = l.file AND a.name = 'area' JOIN fns b ON b.name = 'make_' || l.p")
_edges("j3_method_of", "method_of", "SELECT f.id AS src, c.id AS dst FROM fns f JOIN cls c ON c.file = f.file AND c.name = f.parent_class")
_edges(
    "j4_references", "references",
    "SELECT f.id AS src, v.id AS dst, usage_line AS line_number, 'use' AS context FROM uses u JOIN first_fn f ON f.file = u.file AND f.name = u.function_name JOIN (SELECT file, name, arg_min(id, line) AS id FROM vars GROUP BY ALL) v ON v.file = u.file AND v.name = u.variable_name UNION ALL SELECT f.id, v.id, v.line, 'define' FROM vars v JOIN first_fn f ON f.file = v.file AND 'function:' || f.name = v.scope",
)
_edges("j5_decorated_by", "decorated_by", "SELECT f.id AS src, d.id AS dst, CAST(0 AS BIGINT) AS position FROM decs d JOIN first_fn f ON f.file = d.file AND f.name = d.target_name WHERE target_type = 'function'")
_edges("j5_class_decorated_by", "class_decorated_by", "SELECT c.id AS src, d.id AS dst, CAST(0 AS BIGINT) AS position FROM decs d JOIN cls c ON c.file = d.file AND c.name = d.target_name")
_edges("j6_has_attribute", "has_attribute", "SELECT c.id AS src, a.id AS dst FROM attrs a JOIN cls c ON c.file = a.file AND c.name = a.class_name")
_edges("j6_accesses", "accesses", "SELECT f.id AS src, a.id AS dst, t.line_number, t.access_type FROM touched t JOIN fns f ON f.file = t.file AND f.name = t.function_name AND f.start_line = t.function_line JOIN attrs a ON a.file = t.file AND a.class_name = t.class_name AND a.name = t.name")
_edges("j7_handles_exception", "handles_exception", "SELECT f.id AS src, last.id AS dst, e.line_number, e.context FROM excs e JOIN first_fn f ON f.file = e.file AND f.name = '_grow' JOIN (SELECT file, name, line_number, arg_max(id, ord) AS id FROM excs GROUP BY ALL) last ON last.file = e.file AND last.name = e.name AND last.line_number = e.line_number")
add("j8_inherits_of_sources", lambda spark, sf_dir: graph(spark, sf_dir)["inherits"], "SELECT c.id AS src, b.id AS dst FROM cls c JOIN cls b ON b.k = c.p AND b.file = c.file")
add("j10_inherits_of_sources", lambda spark, sf_dir: graph(spark, sf_dir, "global")["inherits"], "SELECT c.id AS src, b.id AS dst FROM cls c JOIN cls b ON b.k = c.p")
_edges("j_imports_file", "imports_file", "SELECT file AS src, target AS dst, CAST(3 AS BIGINT) AS line_number, true AS is_direct FROM heads")
_edges("j_imports_from", "imports_from", "SELECT i.id AS src, f.id AS dst, i.line_number FROM imps i JOIN heads h ON h.file = i.file JOIN first_fn f ON f.file = h.target AND f.name = i.imported_name WHERE i.import_type = 'unknown' AND NOT i.is_relative")
_edges("j_contains_module", "contains_module", "SELECT a.id AS src, b.id AS dst FROM mods a JOIN mods b ON NOT b.is_package AND string_split(b.name, '.')[1] = a.name AND a.is_package")
_edges("j_module_of", "module_of", "SELECT path AS src, id AS dst FROM mods")
_edges("p3_variable_keys", "variables", "SELECT id, name, file, line AS definition_line, scope FROM vars")
_edges("p3_import_keys", "imports", "SELECT id, imported_name, import_type, coalesce(alias, '') AS alias, line_number, is_relative, file FROM imps")
_edges("p3_decorator_keys", "decorators", "SELECT id, name, file, line_number, arguments FROM decs")
_edges("p3_attribute_keys", "attributes", "SELECT id, name, class_name, file, definition_line, coalesce(type_hint, '') AS type_hint, is_class_attribute FROM attrs")
_edges("p3_exception_keys", "exceptions", "SELECT id, name, file, line_number FROM excs")
_edges("p3_module_keys", "modules", "SELECT id, name, path, is_package, docstring FROM mods")
add("p3_class_keys", lambda spark, sf_dir: graph(spark, sf_dir)["classes"].select("id", "name", "file", F.array_join("bases", ",").alias("bases")), "SELECT id, name, file, 'C' || p AS bases FROM cls")

# Rows of all tables of this graph, in SQL
_COUNTS = {
    "files": "mods", "functions": "fns", "classes": "cls", "variables": "vars", "imports": "imps", "decorators": "decs", "attributes": "attrs", "exceptions": "excs", "modules": "mods",
    "contains_function": "fns", "contains_class": "cls", "contains_variable": "vars", "has_import": "imps", "module_of": "mods", "has_attribute": "attrs", "accesses": "touched", "handles_exception": "excs", "method_of": "cls JOIN (SELECT unnest([1, 2, 3])) ON true",
    "imports_file": "heads", "imports_from": "heads", "class_decorated_by": "cls", "decorated_by": "cls", "inherits": "cls c JOIN cls b ON b.k = c.p AND b.file = c.file", "contains_module": "(SELECT 1 FROM mods WHERE NOT is_package)",
    "calls": "blocks l JOIN fns a ON a.file = l.file AND a.name = 'area' JOIN fns b ON b.name = 'make_' || l.p", "depends_on": "(SELECT 1 WHERE false)",
    "references": "(SELECT 1 FROM uses WHERE variable_name IN ('self', 'LIMIT', 'y') UNION ALL SELECT 1 FROM vars WHERE scope <> 'module')",
}
_ROWS = "rows_of AS (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {q}" for t, q in _COUNTS.items()) + ")"
_KIND = f"CASE WHEN \"table\" IN ({', '.join(repr(t) for t in NODES)}) THEN 'node' ELSE 'edge' END"


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The graph, written to a folder of its own in the shared folder."""
    folder = f"{shared_checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
    graph(spark, sf_dir).write(folder)
    return folder


def k1_k2_k3_written_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export of the written and reopened graph holds; a table without rows is there, with its columns."""
    folder = _written(spark, sf_dir)
    back = CodeGraph.from_parquet(spark, folder, read_only=True, strict=True)
    columns = spark.createDataFrame([(t, len(spark.read.parquet(table_path(folder, t)).columns)) for t in TABLES], "table string, columns int")
    return export_summary(back).drop("bytes").join(columns, "table")


add(
    "k1_k2_k3_written_tables", k1_k2_k3_written_tables,
    f"SELECT \"table\", {_KIND} AS kind, n, CASE WHEN n > 0 THEN 'exported' ELSE 'empty' END AS status, CAST(c AS INTEGER) AS columns FROM rows_of JOIN (VALUES {', '.join(f'({t!r}, {len(x.schema)})' for t, x in TABLES.items())}) v(t, c) ON t = \"table\"", _ROWS,
)


def k5_export_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every written table has bytes, and none was left unwritten."""
    folder = _written(spark, sf_dir)
    return export_summary(CodeGraph.from_parquet(spark, folder), folder).select("table", "n", (F.col("bytes") > 0).alias("has_bytes"))


add("k5_export_bytes", k5_export_bytes, "SELECT \"table\", n, true AS has_bytes FROM rows_of", _ROWS)


def k8_load_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load_statistics(CodeGraph.from_parquet(spark, _written(spark, sf_dir)))
    rows = [(t, x["rows"], x["seconds"] >= 0) for t, x in found["tables"].items()] + [("total_nodes", found["total_nodes"], True), ("total_edges", found["total_edges"], True), ("errors", len(found["errors"]), True)]
    return spark.createDataFrame(rows, "table string, n long, timed boolean")


add("k8_load_statistics", k8_load_statistics, f"SELECT \"table\", n, true AS timed FROM rows_of UNION ALL SELECT CASE {_KIND} WHEN 'node' THEN 'total_nodes' ELSE 'total_edges' END, CAST(sum(n) AS BIGINT), true FROM rows_of GROUP BY 1 UNION ALL SELECT 'errors', 0, true", _ROWS)


def s8_s9_s13_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of the written graph with two of its columns; a table that is missing is empty."""
    folder = f"{shared_checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
    graph(spark, sf_dir).write(folder, ["functions"])
    back = CodeGraph.from_parquet(spark, folder)
    return back["functions"].select("id", "name").withColumn("variables", F.lit(back["variables"].count()).cast("long"))


add("s8_s9_s13_load", s8_s9_s13_load, "SELECT id, name, CAST(0 AS BIGINT) AS variables FROM fns")
_edges("s11_files", "files", "SELECT path, 'python' AS language, sha256('\"\"\"' || name || '.\"\"\"' || chr(10)) AS content_hash FROM mods WHERE is_package", ("last_modified",))
QUERIES["s11_files"] = lambda spark, sf_dir: graph(spark, sf_dir)["files"].drop("last_modified").where(F.col("path").endswith("__init__.py"))


def s1_s2_scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as a tree of files, each with a copy in a folder that the default patterns exclude, scanned."""
    root = f"{shared_checkpoint_dir(spark)}/tree-{uuid.uuid4().hex}"
    texts = sources(spark, sf_dir)
    scan.write_tree(texts.unionByName(texts.select(F.concat(F.lit("rebuild/"), "file").alias("file"), "text")).select("file", F.col("text").cast("binary").alias("content")), root)
    return scan.scan_sources(spark, root).select("file", F.octet_length("content").alias("size"), F.col("modified").isNotNull().alias("dated"))


add(
    "s1_s2_scan_tree", s1_s2_scan_tree,
    f"SELECT path AS file, CAST(strlen(docstring) + 7 AS INTEGER) AS size, true AS dated FROM mods WHERE is_package UNION ALL SELECT h.file, CAST(h.size + b.size AS INTEGER), true FROM (SELECT file, strlen('\"\"\"' || file || '.\"\"\"' || 'import os, sys as system' || 'from ' || module || ' import make_' || p || ' as made' || 'from . import helpers' || 'LIMIT = 10') + 5 AS size FROM heads) h JOIN (SELECT file, sum(strlen({_slice(1, len(_texts) - 1)}) + 1) AS size FROM blocks GROUP BY file) b USING (file)",
)


def s17_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = R.analyses_of(graph(spark, sf_dir))
    names = lambda c, key: F.array_join(F.transform(c, lambda r: r[key]), ",").alias(c)
    return nested.select("file", names("functions", "name"), names("classes", "name"), F.size("variables").alias("variables"), names("imports", "imported_name"))


add(
    "s17_nested", s17_nested,
    "SELECT path AS file, coalesce((SELECT string_agg(name, ',' ORDER BY start_line) FROM fns WHERE fns.file = path), '') AS functions, coalesce((SELECT string_agg(name, ',' ORDER BY start_line) FROM cls WHERE cls.file = path), '') AS classes, CAST((SELECT count(*) FROM vars WHERE vars.file = path) AS INTEGER) AS variables, coalesce((SELECT string_agg(imported_name, ',' ORDER BY line_number, id) FROM imps WHERE imps.file = path), '') AS imports FROM mods",
)


def a17_files_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's files against a scan in which all packages but no module have another text."""
    scanned = sources(spark, sf_dir).select(F.col("file").alias("path"), F.sha2(F.when(F.col("file").endswith("__init__.py"), F.concat("text", F.lit("#"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return P.files_unchanged(graph(spark, sf_dir), scanned)


add("a17_files_unchanged", a17_files_unchanged, "SELECT path, NOT is_package AS unchanged FROM mods")


def s213_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of a scan that lacks one region's files, has one more file, and changed texts in another region."""
    now = sources(spark, sf_dir)
    region = F.split("file", "/")[0]
    seen = now.where(region != "ASIA").select("file", F.when(region == "EUROPE", F.concat("text", F.lit("#"))).otherwise(F.col("text")).alias("text"))
    seen = seen.unionByName(spark.createDataFrame([("new.py", "x = 1\n")], "file string, text string"))
    hashes = lambda df: df.select(F.col("file").alias("path"), F.sha2("text", 256).alias("content_hash"))
    return compare(hashes(seen), hashes(now))


add("s213_refresh", s213_refresh, "SELECT path, CASE split_part(path, '/', 1) WHEN 'ASIA' THEN 'deleted' WHEN 'EUROPE' THEN 'changed' ELSE 'unchanged' END AS status FROM mods UNION ALL SELECT 'new.py', 'new'")

# Changes, on the graph of the sources
_NEW = "SELECT file, name, start_line, end_line FROM fns"


def _functions(spark: SparkSession, sf_dir: str) -> tuple[CodeGraph, DataFrame]:
    """The graph without functions, and its functions as rows for an upsert."""
    g, parsed = graph_and_analysis(spark, sf_dir)
    rows = scan.records(parsed, "functions").select("name", "file", "start_line", "end_line", "is_public", "source_code", "parent_class")
    empty = g["functions"].limit(0)
    return g.replaced(functions=empty, contains_function=g["contains_function"].limit(0), method_of=g["method_of"].limit(0)), rows


def c1_upsert(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """All functions, then the public ones again with another last line."""
    g, rows = _functions(spark, sf_dir)
    return W.add_functions(W.add_functions(g, rows), rows.where("is_public").withColumn("end_line", F.col("end_line") + 100))


add("c1_functions", lambda spark, sf_dir: c1_upsert(spark, sf_dir)["functions"].drop("source_code"), "SELECT id, name, file, start_line, CASE WHEN is_public THEN end_line + 100 ELSE end_line END AS end_line, is_public FROM fns")
add("c1_contains_function", lambda spark, sf_dir: c1_upsert(spark, sf_dir)["contains_function"], "SELECT file AS src, id AS dst FROM fns")
add("c1_method_of", lambda spark, sf_dir: c1_upsert(spark, sf_dir)["method_of"], "SELECT f.id AS src, c.id AS dst FROM fns f JOIN cls c ON c.file = f.file AND c.name = f.parent_class")


def c2_upsert(spark: SparkSession, sf_dir: str) -> CodeGraph:
    g, parsed = graph_and_analysis(spark, sf_dir)
    rows = scan.records(parsed, "variables").select("name", "file", "definition_line", "scope")
    g = g.replaced(variables=g["variables"].limit(0), contains_variable=g["contains_variable"].limit(0))
    return W.add_variables(W.add_variables(g, rows), rows.where("scope = 'module'"))


add("c2_variables", lambda spark, sf_dir: c2_upsert(spark, sf_dir)["variables"], "SELECT id, name, file, line AS definition_line, scope FROM vars")
add("c2_contains_variable", lambda spark, sf_dir: c2_upsert(spark, sf_dir)["contains_variable"], "SELECT file AS src, id AS dst FROM vars WHERE scope = 'module'")


def c3_upsert(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """All classes twice; bases meet classes of any file."""
    g, parsed = graph_and_analysis(spark, sf_dir)
    rows = scan.records(parsed, "classes").select("name", "file", "start_line", "end_line", "bases", "is_public", "source_code")
    g = g.replaced(**{t: g[t].limit(0) for t in ("classes", "contains_class", "inherits")})
    return W.add_classes(W.add_classes(g, rows), rows.withColumn("end_line", F.col("start_line")))


add("c3_classes", lambda spark, sf_dir: c3_upsert(spark, sf_dir)["classes"].select("id", "name", "file", "start_line", "end_line"), "SELECT id, name, file, start_line, start_line AS end_line FROM cls")
add("c3_contains_class", lambda spark, sf_dir: c3_upsert(spark, sf_dir)["contains_class"], "SELECT file AS src, id AS dst FROM cls")
add("c3_inherits", lambda spark, sf_dir: c3_upsert(spark, sf_dir)["inherits"], "SELECT c.id AS src, b.id AS dst FROM cls c JOIN cls b ON b.k = c.p")


def c4_upsert(spark: SparkSession, sf_dir: str) -> CodeGraph:
    g = graph(spark, sf_dir)
    rows = g["imports"].drop("id")
    g = g.replaced(has_import=g["has_import"].limit(0))
    return W.add_imports(W.add_imports(g, rows), rows.where("is_relative").withColumn("alias", F.lit("again")))


add("c4_imports", lambda spark, sf_dir: c4_upsert(spark, sf_dir)["imports"].select("id", "imported_name", "file", "alias"), "SELECT id, imported_name, file, CASE WHEN is_relative THEN 'again' ELSE coalesce(alias, '') END AS alias FROM imps")
add("c4_has_import", lambda spark, sf_dir: c4_upsert(spark, sf_dir)["has_import"], "SELECT file AS src, id AS dst FROM imps")


def c5_decorators(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return W.add_decorators(g, g["decorators"].drop("id").where("name = 'property'").withColumn("arguments", F.lit('{"new": 1}')))["decorators"]


add("c5_decorators", c5_decorators, "SELECT id, name, file, line_number, CASE WHEN name = 'property' THEN '{\"new\": 1}' ELSE arguments END AS arguments FROM decs")


def c6_upsert(spark: SparkSession, sf_dir: str) -> CodeGraph:
    g = graph(spark, sf_dir)
    g = g.replaced(has_attribute=g["has_attribute"].limit(0))
    return W.add_attributes(W.add_attributes(g, g["attributes"].drop("id")), g["attributes"].drop("id").where("is_class_attribute").withColumn("type_hint", F.lit("int")))


add("c6_attributes", lambda spark, sf_dir: c6_upsert(spark, sf_dir)["attributes"].select("id", "name", "type_hint"), "SELECT id, name, CASE WHEN is_class_attribute THEN 'int' ELSE coalesce(type_hint, '') END AS type_hint FROM attrs")
add("c6_has_attribute", lambda spark, sf_dir: c6_upsert(spark, sf_dir)["has_attribute"], "SELECT c.id AS src, a.id AS dst FROM attrs a JOIN cls c ON c.file = a.file AND c.name = a.class_name")


def c7_upsert(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Every handled exception again (same key), without context (another key); every package with another docstring; every package's file changed."""
    g, parsed = graph_and_analysis(spark, sf_dir)
    records = scan.records(parsed, "exceptions").select("name", "file", "line_number", "context", "function_name")
    g = W.add_exceptions(W.add_exceptions(g, records.where("context = 'catch'")), records.where("name = 'ValueError'").select("name", "file", "line_number"))
    g = W.add_modules(g, g["modules"].where("is_package").drop("id").withColumn("docstring", F.lit("changed")))
    return W.add_files(g, g["files"].where(F.col("path").endswith("__init__.py")).withColumn("content_hash", F.lit("0")))


add("c7_exceptions", lambda spark, sf_dir: c7_upsert(spark, sf_dir)["exceptions"], "SELECT id, name, file, line_number FROM excs UNION ALL SELECT 'exc_' || substr(sha256(concat_ws('::', file, name, line_number)), 1, 12), name, file, line_number FROM excs WHERE name = 'ValueError'")
add("c7_modules", lambda spark, sf_dir: c7_upsert(spark, sf_dir)["modules"], "SELECT id, name, path, is_package, CASE WHEN is_package THEN 'changed' ELSE docstring END AS docstring FROM mods")
add("c7_files", lambda spark, sf_dir: c7_upsert(spark, sf_dir)["files"].select("path", (F.col("content_hash") == "0").alias("changed")), "SELECT path, is_package AS changed FROM mods")


def _counts(g: CodeGraph) -> DataFrame:
    return export_summary(g).select("table", "n")


def c8_delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table after a region's files went."""
    g = graph(spark, sf_dir)
    return _counts(W.delete_files(g, g["files"].where(F.col("path").startswith("ASIA/")).select("path")))


def _kept(table: str) -> str:
    """The rows whose ends are both kept."""
    no = "NOT starts_with({}, 'ASIA/')"
    own = {"files": "mods WHERE " + no.format("path"), "modules": "mods WHERE " + no.format("path"), "module_of": "mods WHERE " + no.format("path")}
    if table in own:
        return own[table]
    if table == "contains_module":
        return f"(SELECT 1 FROM mods WHERE NOT is_package AND {no.format('path')})"
    if table in ("imports_file", "imports_from"):
        return f"heads WHERE {no.format('file')} AND {no.format('target')}"
    if table == "calls":
        return f"{_COUNTS['calls']} WHERE {no.format('a.file')} AND {no.format('b.file')}"
    if table == "inherits":
        return f"{_COUNTS['inherits']} WHERE {no.format('c.file')}"
    if table == "references":
        return f"(SELECT 1 FROM uses WHERE variable_name IN ('self', 'LIMIT', 'y') AND {no.format('file')} UNION ALL SELECT 1 FROM vars WHERE scope <> 'module' AND {no.format('file')})"
    return _COUNTS[table] + ("" if table == "depends_on" else f" WHERE {no.format('file')}")


add("c8_delete_files", c8_delete_files, " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {_kept(t)}" for t in TABLES))


def c9_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of five kinds added to a graph without any, each kind with as many more whose end is missing."""
    g, parsed = graph_and_analysis(spark, sf_dir)
    bare = g.replaced(**{t: g[t].limit(0) for t in ("calls", "handles_exception", "accesses", "depends_on", "references")})
    lost = lambda df: df.unionByName(df.withColumn("dst", F.lit("gone")))
    calls = R.resolve_calls(scan.records(parsed, "calls"), scan.records(parsed, "functions").withColumn("id", C.function_key()))
    out = W.add_calls(bare, lost(calls))
    out = W.add_exception_handling(out, lost(g["handles_exception"]))
    out = W.add_attribute_access(out, lost(g["accesses"]))
    pairs = g["inherits"].select("src", "dst", F.lit("inheritance").alias("dependency_type"), F.lit(1).alias("line_number"))
    out = W.add_class_dependency(out, lost(pairs))
    used = g["references"].where("context = 'define'").join(g["variables"].withColumnRenamed("id", "dst"), "dst").join(g["functions"].select(F.col("id").alias("src"), F.col("file").alias("function_file"), F.col("name").alias("function"), "start_line"), "src")
    used = used.select("function_file", "function", "start_line", "file", "name", "definition_line", "line_number", "context")
    out = W.add_variable_usage(out, used.unionByName(used.withColumn("name", F.lit("gone"))))
    return _counts(out).where(F.col("table").isin("calls", "handles_exception", "accesses", "depends_on", "references"))


add(
    "c9_edges", c9_edges,
    "SELECT \"table\", n FROM rows_of WHERE \"table\" IN ('calls', 'handles_exception', 'accesses') UNION ALL SELECT 'depends_on', n FROM rows_of WHERE \"table\" = 'inherits' UNION ALL SELECT 'references', count(*) FROM vars a JOIN vars b ON a.scope <> 'module' AND b.file = a.file AND b.name = a.name AND b.line = a.line", _ROWS,
)
add("c10_clear", lambda spark, sf_dir: _counts(graph(spark, sf_dir).cleared()), " UNION ALL ".join(f"SELECT '{t}' AS \"table\", CAST(0 AS BIGINT) AS n" for t in TABLES))

# Scalar functions
add("p12_string_lists", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array_join(C.string_list(F.concat(F.lit(" ,"), F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(", "))), "|").alias("items")), "SELECT p_partkey, replace(p_name, ' ', '|') AS items FROM part")
add("f_json_arguments", lambda spark, sf_dir: scan.records(analysis(spark, sf_dir), "decorators").where("name = 'register'").select("file", "line_number", C.arguments_map("arguments")["weight"].alias("weight"), C.arguments_map("arguments")["tags"].alias("tags")), "SELECT file, base + 1 AS line_number, CAST(k AS VARCHAR) AS weight, '[\"a\",1]' AS tags FROM blocks")
add(
    "f_formats", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", C.thousands(F.col("o_orderkey") * 1000).alias("thousands"), C.seconds(F.col("o_orderkey") / 8).alias("seconds"), C.rate(F.col("o_orderkey") * 1000, F.lit(4)).alias("rate")),
    "SELECT o_orderkey, format('{:,}', o_orderkey * 1000) AS thousands, format('{:.3f}s', o_orderkey / 8) AS seconds, format('{:,}', o_orderkey * 250) || ' rows/s' AS rate FROM orders",
)
add("f_load_stamp", lambda spark, sf_dir: C.stamped(graph(spark, sf_dir)["files"]).select("path", (F.col("loaded_at") > F.lit("2024-01-01").cast("timestamp")).alias("stamped")), "SELECT path, true AS stamped FROM mods")

assert set(_COUNTS) == set(NODES) | set(EDGES)
