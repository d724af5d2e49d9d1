"""The registered queries over the derived graph, each with its SQL for DuckDB. Lists come out as one string, sorted and joined by commas."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions import columns as C
from callweave.operators import cookbook as K
from callweave.operators import points as P
from callweave.operators import resolve as R
from callweave.operators import traverse as V
from callweave.plans import render, source_queries
from callweave.plans.derived import derived_graph, sql
from callweave.plans.sources_from_parts import SQL as PLACED
from callweave.plans.sources_from_parts import part_sources
from callweave.session import checkpointed
from callweave.sources import scan
from callweave.sources.schemas import EDGES, NODES
from callweave.sources.store import CodeGraph, dangling_edges, duplicate_keys, export_edges
from callweave.sources.synthetic import SHARES, generate, sample_graph
from callweave.streaming.refresh import compare

FILE, FILES, FUNCTION, WORD = "Brand#22", ["Brand#22", "Brand#2"], "red rod", "red"
CLASS, CLASS_FILE, EVENT, SEGMENT, LINK = "Supplier#000000000", "NATION_15", "error", "BUILDING", "/de"
DEPTH, SHALLOW = 5, 2

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: F.array_join(c, ",") for c in lists}) if lists else df


def add(name: str, make: Callable[[CodeGraph], DataFrame], query: str | None = None, recursive: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: flat(make(derived_graph(spark, sf_dir)))
    if query:
        ORACLES[name] = sql(query, recursive)


def add_table(name: str, make: Query, query: str | None) -> None:
    QUERIES[name] = make
    if query:
        ORACLES[name] = query


def _sql_name(table: str) -> str:
    return "refs" if table == "references" else table


def hops(edge: str) -> str:
    t = EDGES[edge]
    return f"{_sql_name(edge)} e JOIN {t.src} a ON a.{NODES[t.src].key} = e.src JOIN {t.dst} b ON b.{NODES[t.dst].key} = e.dst"


# Cookbook, section 1
add("q1_1_functions_in_file", lambda g: K.functions_in_file(g, FILE), f"SELECT b.name, b.start_line, b.end_line, b.is_public FROM {hops('contains_function')} WHERE a.path = '{FILE}'")
add("q1_2_functions_in_files", lambda g: K.functions_in_files(g, FILES), f"SELECT b.file, b.name, b.start_line, b.end_line FROM {hops('contains_function')} WHERE a.path IN ('{FILES[0]}', '{FILES[1]}')")
add("q1_3_all_files", K.all_files, "SELECT * FROM files")
add("q1_4_functions_like", lambda g: K.functions_named_like(g, WORD), f"SELECT name, file, start_line, end_line, is_public FROM functions WHERE contains(name, '{WORD}')")


def _walk(start: str, depth: int, upstream: bool) -> str:
    u, v = ("dst", "src") if upstream else ("src", "dst")
    return f"steps AS MATERIALIZED (SELECT DISTINCT {u} AS u, {v} AS v FROM calls), walk AS (SELECT {start} AS id, 0 AS depth FROM functions WHERE file = '{FILE}' AND name = '{FUNCTION}' UNION SELECT v, depth + 1 FROM walk JOIN steps ON u = walk.id WHERE depth < {depth})"


add("q1_5_1_upstream", lambda g: K.upstream_callers(g, FILE, FUNCTION, 5), "SELECT DISTINCT name, file, start_line FROM functions JOIN walk USING (id) WHERE depth > 0", _walk("id", 5, True))
add("q1_5_2_downstream", lambda g: K.downstream_callees(g, FILE, FUNCTION, 5), "SELECT DISTINCT name, file, start_line FROM functions JOIN walk USING (id) WHERE depth > 0", _walk("id", 5, False))
add("q1_5_3_direct_calls", lambda g: K.direct_calls(g, FILE, FUNCTION), f"SELECT a.name AS caller, b.name AS callee, b.file AS callee_file, e.call_line FROM {hops('calls')} WHERE a.file = '{FILE}' AND a.name = '{FUNCTION}'")
add("q1_5_4_call_depth", lambda g: K.call_chain_depth(g, FILE, FUNCTION, 10), "SELECT id, name, file, CAST(min(depth) AS INTEGER) AS depth FROM functions JOIN walk USING (id) GROUP BY ALL HAVING min(depth) > 0", _walk("id", 10, False))
add("q1_5_5_most_called", K.most_called_functions, "SELECT id, name, file, callers FROM (SELECT dst, count(DISTINCT src) AS callers FROM calls GROUP BY dst) JOIN functions ON id = dst ORDER BY callers DESC, id LIMIT 20")
add("q1_5_6_dead_code", K.dead_code, "SELECT id, name, file, start_line FROM functions f WHERE NOT EXISTS (SELECT 1 FROM calls WHERE dst = f.id)")
# 2
add("q2_1_classes_in_file", lambda g: K.classes_in_file(g, CLASS_FILE), f"SELECT b.name, b.start_line, b.end_line, b.is_public FROM {hops('contains_class')} WHERE a.path = '{CLASS_FILE}'")
add("q2_2_methods", lambda g: K.methods_of_class(g, CLASS), f"SELECT a.name, a.file, a.start_line, a.end_line, a.is_public FROM {hops('method_of')} WHERE b.name = '{CLASS}'")
add("q2_3_attributes", lambda g: K.attributes_of_class(g, CLASS), f"SELECT b.name, b.type_hint, b.definition_line, b.is_class_attribute FROM {hops('has_attribute')} WHERE a.name = '{CLASS}'")
add("q2_4_bases", lambda g: K.bases_of_class(g, CLASS), f"SELECT name, file, bases FROM classes WHERE name = '{CLASS}'")
add("q2_5_class_with_methods", lambda g: K.class_with_methods(g, CLASS), f"SELECT b.name, b.file, string_agg(a.name, ',' ORDER BY a.name) AS methods, count(*) AS method_count FROM {hops('method_of')} WHERE b.name = '{CLASS}' GROUP BY b.id, b.name, b.file")
# 3
add("q3_1_functions_with_decorator", lambda g: K.functions_with_decorator(g, WORD), f"SELECT a.name, a.file, a.start_line, b.arguments FROM {hops('decorated_by')} WHERE b.name = '{WORD}'")
add("q3_2_classes_with_decorator", lambda g: K.classes_with_decorator(g, "small"), f"SELECT a.name, a.file, a.start_line FROM {hops('class_decorated_by')} WHERE b.name = 'small'")
add("q3_3_decorators_in_file", lambda g: K.decorators_in_file(g, FILE), f"SELECT b.name AS decorator, string_agg(DISTINCT a.name, ',' ORDER BY a.name) AS functions FROM {hops('decorated_by')} WHERE a.file = '{FILE}' GROUP BY b.name")
# 4
add("q4_1_raising", lambda g: K.functions_raising(g, EVENT), f"SELECT a.name, a.file, e.line_number FROM {hops('handles_exception')} WHERE b.name = '{EVENT}' AND e.context = 'raise'")
add("q4_2_catching", lambda g: K.functions_catching(g, "click"), f"SELECT a.name, a.file, e.line_number FROM {hops('handles_exception')} WHERE b.name = 'click' AND e.context = 'catch'")
add("q4_3_exceptions_in_file", lambda g: K.exceptions_in_file(g, FILE), f"SELECT b.name AS exception, e.context, string_agg(DISTINCT a.name, ',' ORDER BY a.name) AS functions FROM {hops('handles_exception')} WHERE a.file = '{FILE}' GROUP BY b.name, e.context")
add("q4_4_exceptions_of_function", lambda g: K.exceptions_of_function(g, FILE, FUNCTION), f"SELECT b.name AS exception, e.context, e.line_number FROM {hops('handles_exception')} WHERE a.file = '{FILE}' AND a.name = '{FUNCTION}'")
# 5


def _first_page(g: CodeGraph) -> str:
    return g["has_import"].agg(F.min("src")).first()[0] or ""


FIRST_PAGE = "(SELECT min(src) FROM has_import)"
add("q5_1_imports_in_file", lambda g: K.imports_in_file(g, _first_page(g)), f"SELECT b.imported_name, b.import_type, b.alias, b.line_number, b.is_relative FROM {hops('has_import')} WHERE a.path = {FIRST_PAGE}")
add("q5_2_files_importing", lambda g: K.files_importing(g, LINK), f"SELECT a.path, b.line_number FROM {hops('has_import')} WHERE b.imported_name = '{LINK}'")
add("q5_3_import_statistics", K.import_statistics, f"SELECT count(*) AS total_imports, count(DISTINCT b.imported_name) AS unique_names, count(DISTINCT a.path) AS files FROM {hops('has_import')}")
# 6
add("q6_1_variables_in_file", lambda g: K.variables_in_file(g, SEGMENT), f"SELECT b.name, b.definition_line, b.scope FROM {hops('contains_variable')} WHERE a.path = '{SEGMENT}'")
add("q6_2_variables_like", lambda g: K.variables_named_like(g, "0012"), "SELECT name, file, definition_line, scope FROM variables WHERE contains(name, '0012')")
add("q6_3_module_variables", K.module_variables, "SELECT name, file, definition_line FROM variables WHERE scope = 'module'")


# 7
def _counts(tables) -> str:
    return "SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS {t}" for t in tables)


add("q7_1_overall", K.overall_counts, _counts(K.COUNTED))
add("q7_2_functions_per_file", K.functions_per_file, f"SELECT a.path, count(*) AS function_count FROM {hops('contains_function')} GROUP BY a.path ORDER BY 2 DESC, 1 LIMIT 20")
add("q7_3_most_decorated", K.most_decorated_functions, f"SELECT a.name, a.file, count(*) AS decorator_count, string_agg(DISTINCT b.name, ',' ORDER BY b.name) AS decorators FROM {hops('decorated_by')} GROUP BY a.name, a.file ORDER BY 3 DESC, 1, 2 LIMIT 20")
add("q7_4_classes_per_file", K.classes_per_file, f"SELECT a.path, count(*) AS class_count, string_agg(b.name, ',' ORDER BY b.name) AS classes FROM {hops('contains_class')} GROUP BY a.path")
add("q7_5_largest_classes", K.largest_classes, f"SELECT b.name, b.file, count(*) AS method_count, string_agg(a.name, ',' ORDER BY a.name) AS methods FROM {hops('method_of')} GROUP BY b.name, b.file ORDER BY 3 DESC, 1, 2 LIMIT 20")
add("q7_6_most_used_decorators", K.most_used_decorators, "SELECT name AS decorator, count(*) AS uses FROM (SELECT dst FROM decorated_by UNION ALL SELECT dst FROM class_decorated_by) JOIN decorators ON dst = id GROUP BY name ORDER BY 2 DESC, 1 LIMIT 20")
add("q7_7_exception_coverage", K.exception_coverage, f"SELECT b.name AS exception, e.context, count(DISTINCT a.id) AS functions FROM {hops('handles_exception')} GROUP BY b.name, e.context ORDER BY 3 DESC, 1, 2 LIMIT 20")
# 8
add("q8_1_multiply_decorated", P.multiply_decorated, f"SELECT a.id, a.name, a.file, count(*) AS decorator_count, string_agg(b.name, ',' ORDER BY b.name) AS decorators FROM {hops('decorated_by')} GROUP BY a.id, a.name, a.file HAVING count(*) > 1")
add("q8_2_private_unhandled", K.private_methods_without_handling, f"SELECT b.name AS class_name, a.name, a.file, a.start_line FROM {hops('method_of')} WHERE NOT a.is_public AND NOT EXISTS (SELECT 1 FROM handles_exception h WHERE h.src = a.id)")
add("q8_3_complex_classes", K.complex_classes, "SELECT id, name, file, methods, attributes, methods + attributes AS complexity FROM (SELECT dst AS id, count(DISTINCT src) AS methods FROM method_of GROUP BY 1) JOIN (SELECT src AS id, count(DISTINCT dst) AS attributes FROM has_attribute GROUP BY 1) USING (id) JOIN classes USING (id) WHERE methods + attributes > 10")
add("q8_4_most_methods", K.classes_with_most_methods, f"SELECT b.id, b.name, b.file, count(DISTINCT a.id) AS method_count FROM {hops('method_of')} GROUP BY b.id, b.name, b.file ORDER BY 4 DESC, 1 LIMIT 20")
add("q8_5_most_imports", K.files_with_most_imports, f"SELECT a.path, count(DISTINCT b.imported_name) AS unique_imports, count(*) AS total_imports FROM {hops('has_import')} GROUP BY a.path ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
add("q8_6_public_surface", lambda g: K.public_surface(g, FILE), f"SELECT (SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM functions WHERE file = '{FILE}' AND is_public) AS functions, (SELECT coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') FROM classes WHERE file = '{FILE}' AND is_public) AS classes")
# 9
add("q9_1_file_count", K.file_count, "SELECT count(*) AS files FROM files")
_TABLE_ROWS = ", ".join([f"('{t.name}', 'NODE', '{t.label}', NULL, NULL)" for t in NODES.values()] + [f"('{t.name}', 'REL', '{t.label}', '{NODES[t.src].label}', '{NODES[t.dst].label}')" for t in EDGES.values()])
add("q9_2_tables", K.list_tables, f"SELECT * FROM (VALUES {_TABLE_ROWS}) v(name, kind, label, src_label, dst_label)")
add("q9_3_counts", K.overall_counts_with_attributes, _counts((*K.COUNTED, "attributes")))
_EDGE_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS edge, count(*) AS n FROM {_sql_name(t)}" for t in EDGES)
add("q9_3b_edge_counts", K.edge_counts, "SELECT edge, n FROM per_edge UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM per_edge", f"per_edge AS (SELECT * FROM ({_EDGE_ROWS}))")
_TYPE_ROWS = " UNION ALL ".join(f"SELECT '{t.label}' AS type, '{NODES[t.src].label} -> {NODES[t.dst].label}' AS direction, count(*) AS n FROM {_sql_name(t.name)}" for t in EDGES.values())
add("q9_3c_edge_shares", K.edge_type_shares, "SELECT type, direction, n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM per_type), 2) AS percent FROM per_type", f"per_type AS (SELECT * FROM ({_TYPE_ROWS}) WHERE n > 0)")
add("q9_4_populated", K.populated_labels, " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in NODES))
# Reports
add("r1_high_fan_in", K.high_fan_in, f"SELECT b.name, count(*) AS calls FROM {hops('calls')} GROUP BY b.name ORDER BY 2 DESC, 1 LIMIT 20")
add("r2_cycles", lambda g: K.call_cycles(g, 3), "SELECT path, CAST(length AS INTEGER) AS length FROM (SELECT u AS path, 1 AS length FROM steps WHERE u = v UNION ALL SELECT a.u || '>' || a.v, 2 FROM steps a JOIN steps b ON a.v = b.u AND b.v = a.u WHERE a.u < a.v UNION ALL SELECT a.u || '>' || b.u || '>' || c.u, 3 FROM steps a JOIN steps b ON a.v = b.u JOIN steps c ON b.v = c.u AND c.v = a.u WHERE a.u < b.u AND a.u < c.u AND b.u <> c.u)", "steps AS MATERIALIZED (SELECT DISTINCT src AS u, dst AS v FROM calls)")
add("r2_components", lambda g: K.functions_on_cycles(g), "SELECT f.id, f.name, f.file, min(least(w.a, w.b)) AS component FROM (SELECT x.a, x.b FROM walks x JOIN walks y ON x.a = y.b AND x.b = y.a) w JOIN functions f ON f.id = w.a GROUP BY ALL", "steps AS MATERIALIZED (SELECT DISTINCT src AS u, dst AS v FROM calls), walks AS (SELECT u AS a, v AS b FROM steps UNION SELECT walks.a, steps.v FROM walks JOIN steps ON walks.b = steps.u)")
add("r3_orphans", K.orphans, "SELECT id, name, file FROM functions WHERE id NOT IN (SELECT src FROM calls) AND id NOT IN (SELECT dst FROM calls)")
add("l1_top_called", K.top_called_by_name, f"SELECT b.name, count(*) AS calls FROM {hops('calls')} GROUP BY b.name ORDER BY 2 DESC, 1 LIMIT 5")
add("l2_top_classes", K.top_classes_by_methods, f"SELECT b.name, count(*) AS method_count FROM {hops('method_of')} GROUP BY b.name ORDER BY 2 DESC, 1 LIMIT 5")
add("l3_top_files", K.top_files_by_functions, f"SELECT a.path, count(*) AS function_count FROM {hops('contains_function')} GROUP BY a.path ORDER BY 2 DESC, 1 LIMIT 5")
_ALL_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {_sql_name(t)}" for t in (*NODES, *EDGES))
add("l4_table_counts", K.table_counts, _ALL_ROWS)
add("d1_most_called_names", K.most_called_with_names, "SELECT dst AS id, c AS calls, name, file FROM (SELECT dst, count(*) AS c FROM calls GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 10) LEFT JOIN functions ON id = dst")
add("d2_most_bases", K.classes_with_most_bases, "SELECT src AS id, c AS bases, name, file FROM (SELECT src, count(*) AS c FROM inherits GROUP BY src ORDER BY 2 DESC, 1 LIMIT 10) LEFT JOIN classes ON id = src")
add("d2_inheritance_totals", K.inheritance_totals, "SELECT count(*) AS edges, count(DISTINCT src) AS classes_with_bases, (SELECT count(*) FROM classes) AS classes FROM inherits")
add("d3_file_complexity", K.file_complexity, "SELECT file, coalesce(f, 0) AS functions, coalesce(c, 0) AS classes, coalesce(v, 0) AS variables, coalesce(f, 0) + coalesce(c, 0) + coalesce(v, 0) AS total FROM (SELECT file, count(*) AS f FROM functions GROUP BY 1) FULL JOIN (SELECT file, count(*) AS c FROM classes GROUP BY 1) USING (file) FULL JOIN (SELECT file, count(*) AS v FROM variables GROUP BY 1) USING (file) ORDER BY total DESC, file LIMIT 10")
add("d4_most_imported", K.most_imported, "SELECT imported_name, count(*) AS imports FROM imports GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
add("d4_import_types", K.import_types, "SELECT import_type, count(*) AS imports FROM imports GROUP BY 1")


def _share(tables, total: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {_sql_name(t)}" for t in tables)
    return f"SELECT \"table\", n, CASE WHEN sum(n) OVER () > 0 THEN round(100.0::DOUBLE * n / sum(n) OVER (), 1) ELSE 0 END AS percent FROM ({rows}) UNION ALL SELECT '{total}', CAST(sum(n) AS BIGINT), 100.0::DOUBLE FROM ({rows})"


add("a9_d5_statistics", P.statistics, f"{_share(NODES, 'total_nodes')} UNION ALL {_share(EDGES, 'total_edges')}")
add("a9_most_called", P.most_called, f"SELECT b.name, b.file, count(*) AS call_count FROM {hops('calls')} GROUP BY b.name, b.file ORDER BY 3 DESC, 1, 2 LIMIT 20")
# Point queries
add("a1_callers", lambda g: P.callers(g, FILE, FUNCTION), f"SELECT a.file, a.name, e.call_line FROM {hops('calls')} WHERE b.file = '{FILE}' AND b.name = '{FUNCTION}'")
add("a2_callees", lambda g: P.callees(g, FILE, FUNCTION), f"SELECT b.file, b.name, e.call_line FROM {hops('calls')} WHERE a.file = '{FILE}' AND a.name = '{FUNCTION}'")
add("a3_variable_usage", lambda g: P.variable_usage(g, "FURNITURE", "Customer#000000073", 73), f"SELECT a.file, a.name, e.line_number AS line FROM {hops('references')} WHERE b.file = 'FURNITURE' AND b.name = 'Customer#000000073' AND b.definition_line = 73 AND e.context = 'use'")
add("a4_function", lambda g: P.get_function(g, FILE, FUNCTION), f"SELECT * FROM functions WHERE file = '{FILE}' AND name = '{FUNCTION}' ORDER BY start_line, id LIMIT 1")
add("a5_functions", lambda g: P.functions_in_file(g, FILE), f"SELECT * FROM functions WHERE file = '{FILE}'")
add("a6_class", lambda g: P.get_class(g, CLASS_FILE, CLASS), f"SELECT * FROM classes WHERE file = '{CLASS_FILE}' AND name = '{CLASS}' ORDER BY start_line, id LIMIT 1")
add("a7_classes", lambda g: P.classes_in_file(g, CLASS_FILE), f"SELECT * FROM classes WHERE file = '{CLASS_FILE}'")
add("a10_imports", lambda g: P.imports_of_file(g, _first_page(g)), f"SELECT b.* EXCLUDE (alias), CAST(NULL AS VARCHAR) AS alias FROM {hops('has_import')} WHERE a.path = {FIRST_PAGE}")
add("a11_decorators", lambda g: P.decorators_of_function(g, FILE, FUNCTION), f"SELECT b.id, b.name, b.file, b.line_number, b.arguments, e.position FROM {hops('decorated_by')} WHERE a.file = '{FILE}' AND a.name = '{FUNCTION}'")
add("a12_attributes", lambda g: P.attributes_of_class(g, CLASS_FILE, CLASS), f"SELECT b.* FROM {hops('has_attribute')} WHERE a.file = '{CLASS_FILE}' AND a.name = '{CLASS}'")
add("a13_raising", lambda g: P.functions_raising(g, EVENT), f"SELECT DISTINCT a.file, a.name, a.start_line FROM {hops('handles_exception')} WHERE b.name = '{EVENT}' AND e.context = 'raise'")
add("a14_modules", lambda g: P.module_hierarchy(g), "SELECT id, name, path, is_package, nullif(docstring, '') AS docstring FROM modules")
add("a15_import_usages", lambda g: P.import_usages(g, LINK), f"SELECT file, line_number FROM imports WHERE imported_name = '{LINK}'")
add("a16_modifiers", lambda g: P.attribute_modifiers(g, CLASS, "NO"), f"SELECT a.file, a.name, e.line_number AS line FROM {hops('accesses')} WHERE b.class_name = '{CLASS}' AND b.name = 'NO' AND e.access_type IN ('write', 'read_write')")


# Traversal
def _impact(direction: str, depth: int) -> str:
    near, far = ("callee", "caller") if direction == "upstream" else ("caller", "callee")
    kind = "caller" if direction == "upstream" else "callee"
    return (
        f"nc AS MATERIALIZED (SELECT a.file AS caller_file, a.name AS caller, b.file AS callee_file, b.name AS callee, call_line FROM {hops('calls')}), "
        f"steps AS MATERIALIZED (SELECT DISTINCT {near}_file AS uf, {near} AS un, {far}_file AS vf, {far} AS vn FROM nc), "
        f"walk AS (SELECT '{FILE}' AS file, '{FUNCTION}' AS name, 0 AS depth UNION SELECT vf, vn, depth + 1 FROM walk JOIN steps ON uf = walk.file AND un = walk.name WHERE depth < {depth - 1}), "
        "dist AS (SELECT file, name, min(depth) AS depth FROM walk GROUP BY ALL), "
        f"rows AS (SELECT {far}_file AS file, {far} AS \"function\", call_line AS line, '{kind}' AS type, CAST(depth + 1 AS INTEGER) AS depth FROM nc JOIN dist ON dist.file = {near}_file AND dist.name = {near})"
    )


add("t1u_impact_upstream", lambda g: V.impact(g, FILE, FUNCTION, "upstream", DEPTH), "SELECT * FROM rows", _impact("upstream", DEPTH))
add("t1d_impact_downstream", lambda g: V.impact(g, FILE, FUNCTION, "downstream", DEPTH), "SELECT * FROM rows", _impact("downstream", DEPTH))
_down = re.sub(r"\b(steps|walk|dist|rows)\b", r"down_\1", _impact("downstream", DEPTH).split("), ", 1)[1])
add("t1b_v4_impact_both", lambda g: V.impact_table(V.impact(g, FILE, FUNCTION, "both", DEPTH)), "SELECT depth, type, file, \"function\", line FROM rows UNION ALL SELECT depth, type, file, \"function\", line FROM down_rows", f"{_impact('upstream', DEPTH)}, {_down}")
add("t2_neighbourhood", lambda g: V.neighbourhood(g, FILE, FUNCTION, "downstream", SHALLOW), "SELECT DISTINCT file, \"function\", line FROM rows", _impact("downstream", SHALLOW))

# Joins, keys and checks
add("j14_optional_class", lambda g: K.functions_with_optional_class(g, FILE), f"SELECT f.id, f.name, c.name AS class_name FROM functions f LEFT JOIN (method_of m JOIN classes c ON c.id = m.dst) ON m.src = f.id WHERE f.file = '{FILE}'")
add("j10_inherits_global", lambda g: R.inherits_edges(g["classes"], "global"), "SELECT c.id AS src, p.id AS dst FROM classes c JOIN classes p ON p.name = c.bases")
add("j9_inherits_first", lambda g: R.inherits_edges(g["classes"], "global_first"), "SELECT c.id AS src, p.id AS dst FROM classes c JOIN (SELECT name, arg_min(id, (file, start_line, id)) AS id FROM classes GROUP BY name) p ON p.name = c.bases")
add("j8_inherits_file", lambda g: R.inherits_edges(g["classes"], "file"), "SELECT c.id AS src, p.id AS dst FROM classes c JOIN (SELECT file, name, arg_min(id, (start_line, id)) AS id FROM classes GROUP BY ALL) p ON p.name = c.bases AND p.file = c.file")
add("j16_k4_export_calls", lambda g: export_edges(g, "calls"), "SELECT src AS src_id, dst AS dst_id, call_line FROM calls WHERE src IN (SELECT id FROM functions) AND dst IN (SELECT id FROM functions)")
add("s10_dangling_edges", dangling_edges, " UNION ALL ".join(f"SELECT '{t.name}' AS \"table\", (SELECT count(*) FROM {_sql_name(t.name)} e WHERE NOT EXISTS (SELECT 1 FROM {t.src} WHERE {NODES[t.src].key} = e.src)) + (SELECT count(*) FROM {_sql_name(t.name)} e WHERE NOT EXISTS (SELECT 1 FROM {t.dst} WHERE {NODES[t.dst].key} = e.dst)) AS n" for t in EDGES.values()))
add("p11_duplicate_names", lambda g: duplicate_keys(g["functions"], "name"), "SELECT name, count(*) AS n FROM functions GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 5")
add("p3_function_keys", lambda g: g["functions"].select("id", C.function_key().alias("key")), "SELECT id, 'fn_' || substr(sha256(concat_ws('::', file, name, CAST(start_line AS VARCHAR))), 1, 12) AS key FROM functions")
add("p3_synthetic_keys", lambda g: g["functions"].select("id", C.synthetic_key("name", "file").alias("key")), "SELECT id, substr(md5(concat_ws(':', name, file)), 1, 16) AS key FROM functions")
add("p2_first_function", lambda g: R.first_by(g["functions"], ["file", "name"], "start_line", "id").select("file", "name", "id"), "SELECT file, name, arg_min(id, (start_line, id)) AS id FROM functions GROUP BY ALL")
add("v3_node_labels", lambda g: g["functions"].select("id", C.node_label("file", "name").alias("label")), "SELECT id, regexp_replace(file || '_' || name, '[^0-9A-Za-z_]', '_', 'g') AS label FROM functions")
add("p1_relative_path", lambda g: g["files"].select("path", C.relative_path(F.concat(F.when(F.col("path").startswith("Brand"), "/root/").when(F.col("path").startswith("NATION"), "/rooted/").otherwise("/root"), "path"), "/root").alias("relative")), "SELECT path, CASE WHEN starts_with(path, 'Brand') THEN path WHEN starts_with(path, 'NATION') THEN '/rooted/' || path ELSE '/root' || path END AS relative FROM files")


# Charts, line by line
def _chart_id(file: str, name: str) -> str:
    return f"regexp_replace({file} || '_' || {name}, '[^0-9A-Za-z_]', '_', 'g')"


def _chart_node(file: str, name: str, kind: str) -> str:
    return f"'    ' || {_chart_id(file, name)} || '[\"' || {name} || '<br/>' || {file} || '\"]:::' || {kind}"


_FOCUS = f"'{FILE}', '{FUNCTION}'"
_STYLE_ROWS = ", ".join(f"('    {x}')" for x in render.STYLES)
# A node that calls and is called is drawn as a caller, the greater word, and has both arrows.
add(
    "v1_function_chart", lambda g: render.function_chart_lines(g, FILE, FUNCTION, 1),
    f"SELECT {_chart_node('file', 'name', 'kind')} AS line FROM (SELECT file, name, max(kind) AS kind FROM near GROUP BY ALL) UNION ALL SELECT DISTINCT CASE kind WHEN 'caller' THEN '    ' || {_chart_id('file', 'name')} || ' --> ' || focus ELSE '    ' || focus || ' --> ' || {_chart_id('file', 'name')} END FROM near, (SELECT {_chart_id(*_FOCUS.split(', '))} AS focus) WHERE (file, name) <> ({_FOCUS}) UNION ALL VALUES ('flowchart TD'), {_STYLE_ROWS}",
    f"near AS (SELECT DISTINCT a.file, a.name, CASE WHEN (a.file, a.name) = ({_FOCUS}) THEN 'focus' ELSE 'caller' END AS kind FROM {hops('calls')} WHERE (b.file, b.name) = ({_FOCUS}) UNION SELECT b.file, b.name, CASE WHEN (b.file, b.name) = ({_FOCUS}) THEN 'focus' ELSE 'callee' END FROM {hops('calls')} WHERE (a.file, a.name) = ({_FOCUS}) UNION SELECT {_FOCUS}, 'focus')",
)
add(
    "v2_module_chart", lambda g: render.module_chart_lines(g, FILE),
    f"SELECT 'flowchart LR' AS line UNION ALL SELECT '    ' || {_chart_id('file', 'name')} || '[\"' || name || '<br/>' || file || ':' || start_line || '\"]' FROM functions WHERE file = '{FILE}' UNION ALL SELECT DISTINCT '    ' || {_chart_id('file', 'name')} || '(\"' || name || '<br/>' || file || '\")' FROM used WHERE file <> '{FILE}' UNION ALL SELECT '    ' || {_chart_id(repr(FILE), 'caller')} || ' --> ' || {_chart_id('file', 'name')} FROM used",
    f"used AS (SELECT DISTINCT a.name AS caller, b.file, b.name FROM {hops('calls')} WHERE a.file = '{FILE}')",
)

# Generated graphs
_N = SHARES
_KEYED = "substr(md5('functions:' || {}), 1, 16)"


def add_made(name: str, make: Callable[[SparkSession], DataFrame], query: str) -> None:
    add_table(name, lambda spark, sf_dir: make(spark), query)


add_made(
    "s15_generated_functions", lambda spark: generate(spark)["functions"].select("id", "name", "file", "start_line", "end_line"),
    f"SELECT {_KEYED.format('i')} AS id, 'func_' || i AS name, 'src/package_' || (i % {_N['files']}) % {_N['files'] // 20} || '/module_' || i % {_N['files']} || '.py' AS file, i * 7 % 500 + 1 AS start_line, i * 7 % 500 + 2 + i % 30 AS end_line FROM range({_N['functions']}) r(i)",
)
add_made(
    "s15_generated_calls", lambda spark: generate(spark)["calls"].select("src", "dst"),
    f"SELECT DISTINCT {_KEYED.format('i % ' + str(SHARES['functions']))} AS src, {_KEYED.format('(i + 1 + i % 37 + 42) % ' + str(SHARES['functions']))} AS dst FROM range({3 * _N['functions']}) r(i)",
)
add_made(
    "s16_sample_calls", lambda spark: P.callees(sample_graph(spark), "/project/main.py", "func1"),
    "SELECT * FROM (VALUES ('/project/utils.py', 'func2', 5::BIGINT), ('/project/utils.py', 'func3', 6::BIGINT)) v(file, name, call_line)",
)


# Extraction and resolution over whole texts
def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.analyse(scan.spread(scan.from_texts(part_sources(spark.read.parquet(f"{sf_dir}/part.parquet")))))


def x1_extract_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.records(_analysis(spark, sf_dir), "functions").select("file", "name", "start_line", "end_line", "is_public")


def x2_extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.records(_analysis(spark, sf_dir), "calls").select("file", "caller_function", "called_name", "call_line")


def x8_extract_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.records(_analysis(spark, sf_dir), "variables").select("file", "name", "definition_line", "scope")


def j2_resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysis = checkpointed(_analysis(spark, sf_dir))  # three reads, one parse
    return R.resolve_calls(scan.records(analysis, "calls"), scan.records(analysis, "functions"))


def x16_analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.summary(_analysis(spark, sf_dir)).select("files", "files_with_errors", "functions", "calls", "variables")


def s3_documents_as_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose is no Python: every document keeps its row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), "text")
    return scan.first_parts(scan.analyse(scan.from_texts(docs))).select("file", "content_hash")


def s213_refresh_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a snapshot in which each language but the first has another text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text", "lang")
    now = docs.select("path", F.sha2("text", 256).alias("content_hash"))
    was = docs.select("path", F.sha2(F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("content_hash"))
    return compare(now, was)


_WITH = f"WITH {PLACED.strip()} "
_TABLES = (
    (x1_extract_functions, _WITH + "SELECT p_brand AS file, 'part_' || p_partkey AS name, line AS start_line, line + 2 AS end_line, true AS is_public FROM placed"),
    (x2_extract_calls, _WITH + "SELECT p_brand AS file, 'part_' || p_partkey AS caller_function, 'part_' || (p_partkey + 1) AS called_name, line + 1 AS call_line FROM placed"),
    (x8_extract_variables, _WITH + "SELECT p_brand AS file, 'value' AS name, line + 1 AS definition_line, 'function:part_' || p_partkey AS scope FROM placed"),
    (j2_resolve_calls, _WITH + "SELECT a.p_brand AS caller_file, 'part_' || a.p_partkey AS caller, a.line AS caller_start_line, b.p_brand AS callee_file, 'part_' || b.p_partkey AS callee, b.line AS callee_start_line, a.line + 1 AS call_line FROM placed a JOIN placed b ON b.p_partkey = a.p_partkey + 1"),
    (x16_analysis_summary, "SELECT count(DISTINCT p_brand) AS files, 0::BIGINT AS files_with_errors, count(*) AS functions, count(*) AS calls, count(*) AS variables FROM part"),
    (s3_documents_as_sources, "SELECT CAST(doc_id AS VARCHAR) AS file, sha256(text) AS content_hash FROM documents"),
    (s213_refresh_status, "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN lang = 'en' THEN 'unchanged' ELSE 'changed' END AS status FROM documents"),
)
for _f, _q in _TABLES:
    add_table(_f.__name__, _f, _q)
QUERIES |= source_queries.QUERIES
ORACLES |= source_queries.ORACLES
