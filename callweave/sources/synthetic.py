"""Generated graphs for scale tests, made with range() and modular arithmetic, and a small hand-made one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.columns import synthetic_key
from callweave.sources.schemas import TABLES
from callweave.sources.store import CodeGraph, conform

#: Nodes per 100 files, and hundreds of files by scale.
SHARES = dict(files=100, functions=3_000, classes=500, variables=2_000, imports=1_000, decorators=500, attributes=800, exceptions=300)
SCALES = dict(small=1, medium=10, large=100)


def generate(spark: SparkSession, scale: str = "small", seed: int = 42) -> CodeGraph:
    """A graph of the given scale; the same seed gives the same graph. Every row is a function of its number: nothing is made on the driver."""
    n = {kind: share * SCALES[scale] for kind, share in SHARES.items()}
    draws: dict[str, int] = {}

    def draw(kind: str, below: int):
        """A number below ``below`` from the row's number and the seed."""
        at = draws[kind] = draws.get(kind, 0) + 1
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(kind), F.lit(at)), F.lit(below))

    def ids(kind: str) -> DataFrame:
        return spark.range(n[kind])

    def path(i) -> F.Column:
        return F.format_string("src/package_%d/module_%d.py", F.pmod(i, F.lit(max(1, n["files"] // 20))), i)

    def key(kind: str, i):
        return synthetic_key(F.lit(kind), i)

    def file_of(i):
        return path(F.pmod(i, F.lit(n["files"])))

    i = F.col("id")
    files = ids("files").select(path(i).alias("path"), F.lit("python").alias("language"), F.sha2(i.cast("string"), 256).alias("content_hash"), F.timestamp_seconds(F.lit(1_700_000_000) + i).alias("last_modified"))

    def made(kind: str, name: str, *more) -> DataFrame:
        return ids(kind).select(key(kind, i).alias("id"), F.format_string(name, i).alias("name"), file_of(i).alias("file"), *more)

    line = (F.pmod(i * 7, F.lit(500)) + 1)
    functions = made("functions", "func_%d", line.alias("start_line"), (line + 1 + F.pmod(i, F.lit(30))).alias("end_line"), (draw("f", 10) > 1).alias("is_public"), F.lit("pass").alias("source_code"))
    classes = made("classes", "Class%d", line.alias("start_line"), (line + 40).alias("end_line"), F.array().cast("array<string>").alias("bases"), (draw("c", 10) > 0).alias("is_public"), F.lit("pass").alias("source_code"))
    variables = made("variables", "var_%d", line.alias("definition_line"), F.when(draw("v", 3) == 0, "module").otherwise("function:func_0").alias("scope"))
    imports = ids("imports").select(key("imports", i).alias("id"), F.format_string("module_%d", F.pmod(i, F.lit(200))).alias("imported_name"), F.when(draw("i", 2) == 0, "module").otherwise("unknown").alias("import_type"), F.lit("").alias("alias"), line.alias("line_number"), (draw("i", 5) == 0).alias("is_relative"), file_of(i).alias("file"))
    decorators = made("decorators", "decorator_%d", line.alias("line_number"), F.lit("{}").alias("arguments"))
    attributes = made("attributes", "attr_%d", F.format_string("Class%d", F.pmod(i, F.lit(n["classes"]))).alias("class_name"), line.alias("definition_line"), F.lit("").alias("type_hint"), (draw("a", 2) == 0).alias("is_class_attribute"))
    exceptions = made("exceptions", "Error%d", line.alias("line_number"))

    def edges(times: float, of: str, src: str, dst: str, *props) -> DataFrame:
        rows = spark.range(int(times * n[of]))
        a = F.pmod(i, F.lit(n[src]))
        b = F.pmod(i + 1 + F.pmod(i, F.lit(37)) + F.lit(seed), F.lit(n[dst]))
        return rows.select(key(src, a).alias("src"), key(dst, b).alias("dst"), *props).dropDuplicates(["src", "dst"])

    number = line.alias("line_number")
    out = {
        "files": files,
        "functions": functions,
        "classes": classes,
        "variables": variables,
        "imports": imports,
        "decorators": decorators,
        "attributes": attributes,
        "exceptions": exceptions,
        "calls": edges(3.0, "functions", "functions", "functions", line.alias("call_line")),
        "references": edges(2.0, "functions", "functions", "variables", number, F.when(draw("r", 2) == 0, "use").otherwise("define").alias("context")),
        "accesses": edges(1.5, "functions", "functions", "attributes", number, F.element_at(F.array(F.lit("read"), F.lit("write"), F.lit("read_write")), (draw("x", 3) + 1).cast("int")).alias("access_type")),
        "method_of": edges(0.6, "functions", "functions", "classes"),
        "decorated_by": edges(0.5, "functions", "functions", "decorators", F.lit(0).alias("position")),
        "handles_exception": edges(0.3, "functions", "functions", "exceptions", number, F.when(draw("h", 2) == 0, "raise").otherwise("catch").alias("context")),
        "inherits": edges(0.3, "classes", "classes", "classes"),
        "has_attribute": attributes.select(key("classes", F.regexp_extract("class_name", r"(\d+)", 1).cast("long")).alias("src"), F.col("id").alias("dst")),
        "contains_function": functions.select(F.col("file").alias("src"), F.col("id").alias("dst")),
        "contains_class": classes.select(F.col("file").alias("src"), F.col("id").alias("dst")),
        "contains_variable": variables.select(F.col("file").alias("src"), F.col("id").alias("dst")),
        "has_import": imports.select(F.col("file").alias("src"), F.col("id").alias("dst")),
    }
    return CodeGraph(spark, {name: conform(df, name) for name, df in out.items()})


def sample_graph(spark: SparkSession) -> CodeGraph:
    """Three files, four functions that call each other, two classes: small enough to check by eye."""
    main, utils, models = "/project/main.py", "/project/utils.py", "/project/models.py"
    rows = {
        "files": [(p, "python", f"hash_{i}", None) for i, p in enumerate((main, utils, models))],
        "functions": [("f1", "func1", main, 1, 10, True, ""), ("f2", "func2", utils, 15, 25, True, ""), ("f3", "func3", utils, 30, 40, False, ""), ("f4", "func4", utils, 50, 60, True, "")],
        "classes": [("c1", "DataModel", models, 1, 50, [], True, ""), ("c2", "Helper", utils, 70, 90, [], True, "")],
        "variables": [("v1", "CONFIG", main, 3, "module"), ("v2", "DEBUG", utils, 2, "module"), ("v3", "LIMIT", models, 4, "module")],
        "attributes": [("a1", "value", "DataModel", models, 5, "int", False), ("a2", "name", "DataModel", models, 6, "str", False), ("a3", "KIND", "Helper", utils, 71, "", True)],
        "exceptions": [("e1", "ValueError", main, 8), ("e2", "KeyError", utils, 20)],
        "decorators": [("d1", "property", models, 9, "{}"), ("d2", "cached", utils, 14, "{}")],
        "calls": [("f1", "f2", 5), ("f1", "f3", 6), ("f2", "f4", 20)],
        "method_of": [("f3", "c2"), ("f4", "c2")],
        "accesses": [("f2", "a1", 18, "read"), ("f4", "a1", 55, "write")],
        "references": [("f1", "v1", 4, "use"), ("f2", "v1", 17, "define")],
        "handles_exception": [("f1", "e1", 8, "raise"), ("f2", "e2", 20, "catch")],
        "decorated_by": [("f2", "d2", 0)],
        "has_attribute": [("c1", "a1"), ("c1", "a2"), ("c2", "a3")],
        "contains_function": [(main, "f1"), (utils, "f2"), (utils, "f3"), (utils, "f4")],
        "contains_class": [(models, "c1"), (utils, "c2")],
    }
    return CodeGraph(spark, {name: spark.createDataFrame(r, TABLES[name].schema) for name, r in rows.items()})
