"""A code graph derived from the driver's tables, in Spark and as SQL, so that every operator can be held against DuckDB.

Parts act as functions, suppliers as classes, brands, nations, market segments and page addresses as files; consecutive lines of an order are calls.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.sources.store import CodeGraph, conform


def derived_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Tables are built when they are first used: a query reads only the inputs that its tables need."""

    @cache
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def key(prefix: str, col: str | Column) -> Column:
        return F.concat(F.lit(prefix), (F.col(col) if isinstance(col, str) else col).cast("string"))

    def fn(col: str | Column) -> Column:
        return key("fn_", col)

    def cls(col: str | Column) -> Column:
        return key("cls_", col)

    def files() -> DataFrame:
        paths = (
            t("part").select(F.col("p_brand").alias("path"))
            .union(t("nation").select("n_name"))
            .union(t("customer").select("c_mktsegment"))
            .union(t("pages").select("url"))
            .distinct()
        )
        return paths.select("path", F.lit("python").alias("language"), F.sha2("path", 256).alias("content_hash"))

    def functions() -> DataFrame:
        parts = t("part").select(
            fn("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_size").cast("long").alias("start_line"),
            (F.col("p_size") + F.col("p_partkey") % 40).cast("long").alias("end_line"), (F.col("p_size") % 2 == 0).alias("is_public"), F.col("p_type").alias("source_code"),
        )
        # An entry point per nation, which nothing calls.
        mains = t("nation").select(
            key("fn_main", "n_nationkey"), F.lit("main"), F.col("n_name"), F.lit(1).cast("long"), F.lit(9).cast("long"), F.lit(True), F.lit("")
        )
        return parts.union(mains)

    def nations() -> DataFrame:
        return t("nation").select("n_nationkey", "n_name", "n_regionkey")

    def suppliers() -> DataFrame:
        return t("supplier").join(nations(), F.col("s_nationkey") == F.col("n_nationkey"))

    def classes() -> DataFrame:
        parents = t("supplier").select(F.col("s_suppkey").alias("parent"), F.col("s_name").alias("base"))
        rows = suppliers().join(parents, (F.floor(F.col("s_suppkey") / 2) == F.col("parent")) & (F.col("s_suppkey") > 0), "left")
        return rows.select(
            cls("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("file"), F.col("s_suppkey").alias("start_line"), (F.col("s_suppkey") + 9).alias("end_line"),
            F.array_compact(F.array("base")).alias("bases"), (F.col("s_acctbal") >= 0).alias("is_public"), F.lit("").alias("source_code"),
        )

    def variables() -> DataFrame:
        scope = F.when(F.col("c_acctbal") < 0, "module").otherwise(F.concat(F.lit("function:"), F.col("c_name")))
        return t("customer").select(
            key("var_", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("file"), F.col("c_custkey").alias("definition_line"), scope.alias("scope")
        )

    def links() -> DataFrame:
        found = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href")
        return t("pages").select("page_id", "url", found)

    def imp() -> Column:
        return F.concat_ws("_", F.lit("imp"), F.col("page_id").cast("string"), (F.col("pos") + 1).cast("string"))

    def imports() -> DataFrame:
        return links().select(
            imp().alias("id"), F.col("href").alias("imported_name"), F.when(F.col("href").startswith("http"), "module").otherwise("unknown").alias("import_type"),
            F.lit("").alias("alias"), (F.col("pos") + 1).alias("line_number"), (~F.col("href").startswith("http")).alias("is_relative"), F.col("url").alias("file"),
        )

    def words() -> DataFrame:
        return t("part").select("p_partkey", "p_brand", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))

    def dec() -> Column:
        return F.concat_ws("_", F.lit("dec"), F.col("p_brand"), F.col("word"))

    def decorators() -> DataFrame:
        rows = words().select("p_brand", "word").distinct()
        return rows.select(dec().alias("id"), F.col("word").alias("name"), F.col("p_brand").alias("file"), F.length("word").alias("line_number"), F.lit('{"arg_0": "1"}').alias("arguments"))

    def attr() -> Column:
        return F.concat_ws("_", F.lit("attr"), F.col("l_suppkey").cast("string"), F.concat("l_returnflag", "l_linestatus"))

    def attributes() -> DataFrame:
        rows = t("lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct().join(suppliers(), F.col("l_suppkey") == F.col("s_suppkey"))
        return rows.select(
            attr().alias("id"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("s_name").alias("class_name"), F.col("n_name").alias("file"),
            (F.col("l_suppkey") + F.ascii("l_returnflag")).alias("definition_line"), F.col("l_returnflag").alias("type_hint"), (F.col("l_returnflag") == "A").alias("is_class_attribute"),
        )

    def raised() -> DataFrame:
        return t("events").join(t("part").select("p_partkey", "p_brand"), F.col("user_id") == F.col("p_partkey"))

    def exc() -> Column:
        return F.concat_ws("_", F.lit("exc"), F.col("p_brand"), F.col("event_type"))

    def exceptions() -> DataFrame:
        rows = raised().groupBy("p_brand", "event_type").agg(F.min("event_id").alias("line_number"))
        return rows.select(exc().alias("id"), F.col("event_type").alias("name"), F.col("p_brand").alias("file"), "line_number")

    def modules() -> DataFrame:
        regions = t("region").select(key("mod_r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("r_name").alias("path"), F.lit(True).alias("is_package"), F.lit("").alias("docstring"))
        inner = nations().join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return regions.union(inner.select(key("mod_n", "n_nationkey"), F.concat_ws(".", "r_name", "n_name"), F.concat_ws("/", "r_name", "n_name"), F.lit(False), F.lit("doc")))

    def lines() -> DataFrame:
        """Each line of an order with the next one."""
        a = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("a_line"), F.col("l_partkey").alias("a_part"), F.col("l_suppkey").alias("a_supp"))
        b = t("lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("a_line"), F.col("l_partkey").alias("b_part"), F.col("l_suppkey").alias("b_supp"))
        return a.join(b, ["l_orderkey", "a_line"])

    def calls() -> DataFrame:
        among = lines().select(fn("a_part").alias("src"), fn("b_part").alias("dst"), F.col("a_line").alias("call_line"))
        starts = t("nation").where("n_nationkey % 2 = 0").join(t("part").select("p_partkey"), F.col("n_nationkey") == F.col("p_partkey"))
        return among.union(starts.select(key("fn_main", "n_nationkey"), fn("p_partkey"), F.lit(2)))

    def depends_on() -> DataFrame:
        rows = lines().where("a_supp <> b_supp").groupBy("a_supp", "b_supp").agg(F.min("a_line").alias("line_number"))
        return rows.select(cls("a_supp").alias("src"), cls("b_supp").alias("dst"), F.lit("composition").alias("dependency_type"), "line_number")

    def imports_file() -> DataFrame:
        brand = t("part").select("p_partkey", "p_brand")
        a = brand.select(F.col("p_partkey").alias("a_part"), F.col("p_brand").alias("src"))
        b = brand.select(F.col("p_partkey").alias("b_part"), F.col("p_brand").alias("dst"))
        rows = lines().join(a, "a_part").join(b, "b_part").where("src <> dst").groupBy("src", "dst").agg(F.min("a_line").alias("line_number"))
        return rows.withColumn("is_direct", F.lit(True))

    def references() -> DataFrame:
        rows = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
        context = F.when(F.col("o_orderstatus") == "O", "use").otherwise("define")
        return rows.select(fn("l_partkey").alias("src"), key("var_", "o_custkey").alias("dst"), F.col("l_linenumber").alias("line_number"), context.alias("context"))

    def accesses() -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "A", "read").when(F.col("l_returnflag") == "N", "write").otherwise("read_write")
        return t("lineitem").select(fn("l_partkey").alias("src"), attr().alias("dst"), F.col("l_linenumber").alias("line_number"), kind.alias("access_type"))

    def handles_exception() -> DataFrame:
        context = F.when(F.col("event_type") == "error", "raise").otherwise("catch")
        return raised().select(fn("p_partkey").alias("src"), exc().alias("dst"), F.col("event_id").alias("line_number"), context.alias("context"))

    def pairs(make, a: str | Column, b: str | Column):
        return lambda: make().select((F.col(a) if isinstance(a, str) else a).alias("src"), (F.col(b) if isinstance(b, str) else b).alias("dst"))

    made = {
        "files": files,
        "functions": functions,
        "classes": classes,
        "variables": variables,
        "imports": imports,
        "decorators": decorators,
        "attributes": attributes,
        "exceptions": exceptions,
        "modules": modules,
        "calls": calls,
        "references": references,
        "contains_function": pairs(functions, "file", "id"),
        "contains_class": pairs(classes, "file", "id"),
        "contains_variable": pairs(variables, "file", "id"),
        "imports_file": imports_file,
        "inherits": pairs(lambda: t("supplier").where("s_suppkey > 0"), cls("s_suppkey"), cls(F.floor(F.col("s_suppkey") / 2).cast("long"))),
        "depends_on": depends_on,
        "method_of": pairs(lambda: t("lineitem").select("l_partkey", "l_suppkey").distinct(), fn("l_partkey"), cls("l_suppkey")),
        "has_import": pairs(links, "url", imp()),
        "imports_from": lambda: links().join(t("part").select("p_partkey"), F.col("page_id") == F.col("p_partkey")).select(imp().alias("src"), fn("page_id").alias("dst"), (F.col("pos") + 1).alias("line_number")),
        "decorated_by": lambda: words().select(fn("p_partkey").alias("src"), dec().alias("dst"), F.col("pos").alias("position")),
        "class_decorated_by": lambda: suppliers().join(t("part").where("p_partkey = 0").select("p_brand", F.element_at(F.split("p_name", " "), 1).alias("word")), F.col("s_suppkey") % 3 == 0).select(cls("s_suppkey").alias("src"), dec().alias("dst"), F.lit(0).alias("position")),
        "has_attribute": pairs(lambda: t("lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct(), cls("l_suppkey"), attr()),
        "accesses": accesses,
        "handles_exception": handles_exception,
        "contains_module": pairs(nations, key("mod_r", "n_regionkey"), key("mod_n", "n_nationkey")),
        "module_of": pairs(nations, "n_name", key("mod_n", "n_nationkey")),
    }
    return CodeGraph(spark, {name: (lambda name=name, f=f: conform(f(), name)) for name, f in made.items()})


#: The same tables in DuckDB's SQL. ``refs`` stands for references, a reserved word.
SQL = r"""
files AS (
  SELECT path, 'python' AS language, sha256(path) AS content_hash FROM (
    SELECT p_brand AS path FROM part UNION SELECT n_name FROM nation UNION SELECT c_mktsegment FROM customer UNION SELECT url FROM pages)
), functions AS (
  SELECT 'fn_' || p_partkey AS id, p_name AS name, p_brand AS file, CAST(p_size AS BIGINT) AS start_line, p_size + p_partkey % 40 AS end_line, p_size % 2 = 0 AS is_public,
    p_type AS source_code FROM part
  UNION ALL SELECT 'fn_main' || n_nationkey, 'main', n_name, 1, 9, true, '' FROM nation
), classes AS (
  SELECT 'cls_' || s.s_suppkey AS id, s.s_name AS name, n_name AS file, s.s_suppkey AS start_line, s.s_suppkey + 9 AS end_line, coalesce(b.s_name, '') AS bases, s.s_acctbal >= 0 AS is_public, '' AS source_code
  FROM supplier s JOIN nation ON s.s_nationkey = n_nationkey LEFT JOIN supplier b ON b.s_suppkey = s.s_suppkey // 2 AND s.s_suppkey > 0
), variables AS (
  SELECT 'var_' || c_custkey AS id, c_name AS name, c_mktsegment AS file, c_custkey AS definition_line, CASE WHEN c_acctbal < 0 THEN 'module' ELSE 'function:' || c_name END AS scope FROM customer
), links AS (
  SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages)
), imports AS (
  SELECT 'imp_' || page_id || '_' || pos AS id, href AS imported_name, CASE WHEN href LIKE 'http%' THEN 'module' ELSE 'unknown' END AS import_type, '' AS alias, pos AS line_number,
    href NOT LIKE 'http%' AS is_relative, url AS file FROM links
), words AS (
  SELECT p_partkey, p_brand, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS w FROM part)
), decorators AS (
  SELECT DISTINCT 'dec_' || p_brand || '_' || word AS id, word AS name, p_brand AS file, length(word) AS line_number, '{"arg_0": "1"}' AS arguments FROM words
), flags AS (SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem
), attributes AS (
  SELECT 'attr_' || l_suppkey || '_' || l_returnflag || l_linestatus AS id, l_returnflag || l_linestatus AS name, s_name AS class_name, n_name AS file, l_suppkey + ascii(l_returnflag) AS definition_line,
    l_returnflag AS type_hint, l_returnflag = 'A' AS is_class_attribute
  FROM flags JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), raised AS (SELECT * FROM events JOIN part ON user_id = p_partkey
), exceptions AS (
  SELECT 'exc_' || p_brand || '_' || event_type AS id, event_type AS name, p_brand AS file, min(event_id) AS line_number FROM raised GROUP BY ALL
), modules AS (
  SELECT 'mod_r' || r_regionkey AS id, r_name AS name, r_name AS path, true AS is_package, '' AS docstring FROM region
  UNION ALL SELECT 'mod_n' || n_nationkey, r_name || '.' || n_name, r_name || '/' || n_name, false, 'doc' FROM nation JOIN region ON n_regionkey = r_regionkey
), lines AS (
  SELECT a.l_linenumber AS a_line, a.l_partkey AS a_part, b.l_partkey AS b_part, a.l_suppkey AS a_supp, b.l_suppkey AS b_supp
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
), calls AS (
  SELECT 'fn_' || a_part AS src, 'fn_' || b_part AS dst, CAST(a_line AS BIGINT) AS call_line FROM lines
  UNION ALL SELECT 'fn_main' || n_nationkey, 'fn_' || p_partkey, 2 FROM nation JOIN part ON n_nationkey = p_partkey WHERE n_nationkey % 2 = 0
), refs AS (
  SELECT 'fn_' || l_partkey AS src, 'var_' || o_custkey AS dst, CAST(l_linenumber AS BIGINT) AS line_number, CASE WHEN o_orderstatus = 'O' THEN 'use' ELSE 'define' END AS context
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), contains_function AS (SELECT file AS src, id AS dst FROM functions
), contains_class AS (SELECT file AS src, id AS dst FROM classes
), contains_variable AS (SELECT file AS src, id AS dst FROM variables
), imports_file AS (
  SELECT a.p_brand AS src, b.p_brand AS dst, CAST(min(a_line) AS BIGINT) AS line_number FROM lines JOIN part a ON a_part = a.p_partkey JOIN part b ON b_part = b.p_partkey WHERE a.p_brand <> b.p_brand GROUP BY ALL
), inherits AS (SELECT 'cls_' || s_suppkey AS src, 'cls_' || (s_suppkey // 2) AS dst FROM supplier WHERE s_suppkey > 0
), depends_on AS (SELECT 'cls_' || a_supp AS src, 'cls_' || b_supp AS dst, CAST(min(a_line) AS BIGINT) AS line_number FROM lines WHERE a_supp <> b_supp GROUP BY ALL
), method_of AS (SELECT DISTINCT 'fn_' || l_partkey AS src, 'cls_' || l_suppkey AS dst FROM lineitem
), has_import AS (SELECT url AS src, 'imp_' || page_id || '_' || pos AS dst FROM links
), imports_from AS (SELECT 'imp_' || page_id || '_' || pos AS src, 'fn_' || page_id AS dst FROM links JOIN part ON page_id = p_partkey
), decorated_by AS (SELECT 'fn_' || p_partkey AS src, 'dec_' || p_brand || '_' || word AS dst, pos AS position FROM words
), class_decorated_by AS (
  SELECT 'cls_' || s_suppkey AS src, 'dec_' || p_brand || '_' || string_split(p_name, ' ')[1] AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey, part WHERE p_partkey = 0 AND s_suppkey % 3 = 0
), has_attribute AS (SELECT 'cls_' || l_suppkey AS src, 'attr_' || l_suppkey || '_' || l_returnflag || l_linestatus AS dst FROM flags
), accesses AS (
  SELECT 'fn_' || l_partkey AS src, 'attr_' || l_suppkey || '_' || l_returnflag || l_linestatus AS dst, CAST(l_linenumber AS BIGINT) AS line_number,
    CASE l_returnflag WHEN 'A' THEN 'read' WHEN 'N' THEN 'write' ELSE 'read_write' END AS access_type FROM lineitem
), handles_exception AS (
  SELECT 'fn_' || p_partkey AS src, 'exc_' || p_brand || '_' || event_type AS dst, event_id AS line_number, CASE WHEN event_type = 'error' THEN 'raise' ELSE 'catch' END AS context FROM raised
), contains_module AS (SELECT 'mod_r' || n_regionkey AS src, 'mod_n' || n_nationkey AS dst FROM nation
), module_of AS (SELECT n_name AS src, 'mod_n' || n_nationkey AS dst FROM nation
)
"""


def sql(query: str, recursive: str = "") -> str:
    """``query`` over the derived tables; ``recursive`` adds further common tables, which may refer to themselves."""
    return f"WITH RECURSIVE {SQL.strip()}{', ' + recursive if recursive else ''} {query}"
