"""Python source texts made from the supplier, nation and region tables: packages, classes with bases, decorators, attributes, imports, raises and handlers.

Each region is a package, each nation with suppliers a module, each supplier a class and a function. The parser runs over whole tables, with results that SQL can state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = """\"\"\"{file}.\"\"\"
import os, sys as system
from {module} import make_{p} as made
from . import helpers
LIMIT = 10
"""
#: Lines of one supplier k, whose class is derived from that of supplier p = k // 2.
BLOCK = """@register("s{k}", weight={k}, tags=("a", 1), raw=b"x", z=2j)
class C{k}(C{p}):
    kind: str = "a"
    def __init__(self, size):
        self.size = size
        self.total: int = size + LIMIT
    @property
    def area(self):
        return make_{p}(self.size)
    def _grow(self, n):
        try:
            self.size += n
        except (ValueError, KeyError): raise KeyError(n)
        else: raise errors.Bad(n)
def make_{k}(x):
    y = C{k}(x)
    return y.area
"""
HEAD_LINES, BLOCK_LINES = HEAD.count("\n"), BLOCK.count("\n")


def _filled(template: str, **columns: Column) -> Column:
    """The template with columns in its braces, as one JVM expression."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), columns[name].cast("string")]
    return F.concat(*out, F.lit(rest))


def placed_suppliers(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """(k, p, region, nation, file) of every supplier."""
    rows = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    package = F.replace("r_name", F.lit(" "), F.lit("_"))
    return rows.select(
        F.col("s_suppkey").alias("k"), F.floor(F.col("s_suppkey") / 2).cast("long").alias("p"), package.alias("region"), F.col("n_name").alias("nation"), F.concat(package, F.lit("/"), "n_name", F.lit(".py")).alias("file")
    )


def supplier_sources(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """(file, text) of all modules and packages."""
    placed = placed_suppliers(supplier, nation, region)
    block = _filled(BLOCK, k=F.col("k"), p=F.col("p"))
    bodies = placed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", block.alias("block")))).alias("blocks"), (F.floor(F.min("k") / 2)).cast("long").alias("p"))
    target = placed.select(F.col("k").alias("p"), F.concat_ws(".", "region", "nation").alias("module"))
    head = _filled(HEAD, file=F.col("file"), module=F.col("module"), p=F.col("p"))
    modules = bodies.join(target, "p").select("file", F.concat(head, F.array_join(F.transform("blocks", lambda b: b["block"]), "")).alias("text"))
    package = F.replace("r_name", F.lit(" "), F.lit("_"))
    return modules.unionByName(region.select(F.concat(package, F.lit("/__init__.py")).alias("file"), F.concat(F.lit('"""'), package, F.lit('."""\n')).alias("text")))


def _id(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256(concat_ws('::', {', '.join(parts)})), 1, 12)"


#: The same modules in DuckDB: where each supplier's lines begin (``base`` lines are before them), and the graph's node tables with their keys.
SQL = f"""
sup AS (
  SELECT s_suppkey AS k, s_suppkey // 2 AS p, replace(r_name, ' ', '_') AS region, n_name AS nation, replace(r_name, ' ', '_') || '/' || n_name || '.py' AS file
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), blocks AS (
  SELECT *, CAST({HEAD_LINES} + {BLOCK_LINES} * (row_number() OVER (PARTITION BY file ORDER BY k) - 1) AS BIGINT) AS base FROM sup
), heads AS (
  SELECT h.file, h.p, t.region || '.' || t.nation AS module, t.file AS target FROM (SELECT file, min(k) // 2 AS p FROM sup GROUP BY file) h JOIN sup t ON t.k = h.p
), fns AS (
  SELECT *, {_id("fn", "file", "name", "start_line")} AS id FROM (
    SELECT file, k, '__init__' AS name, base + 4 AS start_line, base + 6 AS end_line, 'C' || k AS parent_class, false AS is_public FROM blocks
    UNION ALL SELECT file, k, 'area', base + 8, base + 9, 'C' || k, true FROM blocks
    UNION ALL SELECT file, k, '_grow', base + 10, base + 14, 'C' || k, false FROM blocks
    UNION ALL SELECT file, k, 'make_' || k, base + 15, base + 17, NULL, true FROM blocks)
), first_fn AS (SELECT file, name, arg_min(id, start_line) AS id FROM fns GROUP BY ALL
), cls AS (SELECT file, k, p, 'C' || k AS name, base + 2 AS start_line, base + 14 AS end_line, {_id("cls", "file", "'C' || k", "base + 2")} AS id FROM blocks
), vars AS (
  SELECT *, {_id("var", "file", "name", "line", "scope")} AS id FROM (
    SELECT file, 'LIMIT' AS name, CAST(5 AS BIGINT) AS line, 'module' AS scope FROM heads
    UNION ALL SELECT file, 'kind', base + 3, 'module' FROM blocks
    UNION ALL SELECT file, 'self', base + 5, 'function:__init__' FROM blocks UNION ALL SELECT file, 'self', base + 6, 'function:__init__' FROM blocks
    UNION ALL SELECT file, 'self', base + 12, 'function:_grow' FROM blocks UNION ALL SELECT file, 'y', base + 16, 'function:make_' || k FROM blocks)
), uses AS (
  SELECT file, unnest(['self', 'size', 'self', 'int', 'size', 'LIMIT', 'property', 'make_' || p, 'self', 'self', 'n', 'ValueError', 'KeyError', 'KeyError', 'n', 'errors', 'n', 'C' || k, 'x', 'y']) AS variable_name,
    unnest(['__init__', '__init__', '__init__', '__init__', '__init__', '__init__', 'area', 'area', 'area', '_grow', '_grow', '_grow', '_grow', '_grow', '_grow', '_grow', '_grow', 'make_' || k, 'make_' || k, 'make_' || k]) AS function_name,
    base + unnest([5, 5, 6, 6, 6, 6, 7, 9, 9, 12, 12, 13, 13, 13, 13, 14, 14, 16, 16, 17]) AS usage_line
  FROM blocks
), imps AS (
  SELECT *, {_id("imp", "file", "imported_name", "line_number")} AS id FROM (
    SELECT file, 'os' AS imported_name, 'module' AS import_type, NULL AS alias, CAST(2 AS BIGINT) AS line_number, false AS is_relative, NULL AS module FROM heads
    UNION ALL SELECT file, 'sys', 'module', 'system', 2, false, NULL FROM heads
    UNION ALL SELECT file, 'make_' || p, 'unknown', 'made', 3, false, module FROM heads
    UNION ALL SELECT file, 'helpers', 'unknown', NULL, 4, true, NULL FROM heads)
), decs AS (
  SELECT *, {_id("dec", "file", "name", "line_number")} AS id FROM (
    SELECT file, 'register' AS name, base + 1 AS line_number, '{{"arg_0": "s' || k || '", "weight": ' || k || ', "tags": ["a", 1], "raw": "b''x''", "z": "2j"}}' AS arguments, 'C' || k AS target_name, 'class' AS target_type, base + 2 AS target_line FROM blocks
    UNION ALL SELECT file, 'property', base + 7, '{{}}', 'area', 'function', base + 8 FROM blocks)
), attrs AS (
  SELECT *, {_id("attr", "file", "class_name", "name", "definition_line")} AS id FROM (
    SELECT file, 'kind' AS name, 'C' || k AS class_name, base + 3 AS definition_line, 'str' AS type_hint, true AS is_class_attribute FROM blocks
    UNION ALL SELECT file, 'size', 'C' || k, base + 5, NULL, false FROM blocks UNION ALL SELECT file, 'total', 'C' || k, base + 6, 'int', false FROM blocks)
), touched AS (
  SELECT file, 'C' || k AS class_name, unnest(['size', 'total', 'size', 'size']) AS name, unnest(['__init__', '__init__', 'area', '_grow']) AS function_name, base + unnest([4, 4, 8, 10]) AS function_line,
    base + unnest([5, 6, 9, 12]) AS line_number, unnest(['write', 'write', 'read', 'read_write']) AS access_type FROM blocks
), excs AS (
  SELECT *, {_id("exc", "file", "name", "line_number", "context", "'_grow'")} AS id FROM (
    SELECT file, unnest(['ValueError', 'KeyError', 'KeyError', 'errors.Bad']) AS name, base + unnest([13, 13, 13, 14]) AS line_number, unnest(['catch', 'catch', 'raise', 'raise']) AS context, unnest([1, 2, 3, 4]) AS ord FROM blocks)
), mods AS (
  SELECT *, {_id("mod", "name")} AS id FROM (
    SELECT replace(r_name, ' ', '_') AS name, replace(r_name, ' ', '_') || '/__init__.py' AS path, true AS is_package, replace(r_name, ' ', '_') || '.' AS docstring FROM region
    UNION ALL SELECT DISTINCT region || '.' || nation, file, false, file || '.' FROM sup)
)
"""
