"""Column functions that the tables and operators share. All are JVM expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def surrogate_key(prefix: str, *parts: str | Column) -> Column:
    """``prefix`` and the first twelve hex digits of SHA-256 over the parts joined with '::'. Null parts are left out."""
    joined = F.concat_ws("::", *[as_column(p).cast("string") for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 12))


def function_key(file="file", name="name", start_line="start_line") -> Column:
    return surrogate_key("fn", file, name, start_line)


def class_key(file="file", name="name", start_line="start_line") -> Column:
    return surrogate_key("cls", file, name, start_line)


def variable_key(file="file", name="name", line="definition_line", scope="scope") -> Column:
    return surrogate_key("var", file, name, line, scope)


def import_key(file="file", name="imported_name", line="line_number") -> Column:
    return surrogate_key("imp", file, name, line)


def decorator_key(file="file", name="name", line="line_number") -> Column:
    return surrogate_key("dec", file, name, line)


def attribute_key(file="file", class_name="class_name", name="name", line="definition_line") -> Column:
    return surrogate_key("attr", file, class_name, name, line)


def exception_key(file="file", name="name", line="line_number", context="context", function="function_name") -> Column:
    return surrogate_key("exc", file, name, line, context, function)


def module_key(name="name") -> Column:
    return surrogate_key("mod", name)


def synthetic_key(*parts: str | Column) -> Column:
    """The generated graphs' keys: sixteen hex digits of MD5 over the parts joined with ':'."""
    return F.substring(F.md5(F.concat_ws(":", *[as_column(p).cast("string") for p in parts])), 1, 16)


def content_hash(content: str | Column) -> Column:
    return F.sha2(as_column(content), 256)


def relative_path(path: str | Column, root: str) -> Column:
    """The path below ``root``; other paths stay as they are."""
    p, base = as_column(path), root.rstrip("/") + "/"
    return F.when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 20)).otherwise(p)


def is_excluded(path: str | Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern is a substring of the whole path."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | as_column(path).contains(pattern)
    return out


def null_if_empty(x: str | Column) -> Column:
    return F.nullif(as_column(x), F.lit(""))


def string_list(x: str | Column) -> Column:
    """A list stored as JSON or joined by commas, as an array: trimmed, without empty items. Null gives an empty array."""
    s = F.trim(as_column(x))
    items = F.when(s.startswith("["), F.from_json(s, T.ArrayType(T.StringType()))).otherwise(F.split(s, ","))
    trimmed = F.filter(F.transform(items, lambda i: F.trim(i)), lambda i: i != "")
    return F.coalesce(trimmed, F.array().cast("array<string>"))


def arguments_map(x: str | Column) -> Column:
    """A decorator's JSON arguments as a map."""
    return F.from_json(as_column(x), T.MapType(T.StringType(), T.StringType()))


def percentage(part: str | Column, total: str | Column, digits: int = 1) -> Column:
    """100 * part / total, rounded; 0 where the total is 0."""
    t = as_column(total)
    return F.when(t > 0, F.round(100.0 * as_column(part) / t, digits)).otherwise(F.lit(0.0))


def is_public(name: str | Column) -> Column:
    return ~as_column(name).startswith("_")


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(as_column(path), "/"), -1)


def stem(path: str | Column) -> Column:
    """The file's name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def parent_directory(path: str | Column) -> Column:
    p = as_column(path)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def node_label(file: str | Column, function: str | Column) -> Column:
    """A diagram node's id: ``stem_function`` with every other sign as an underscore."""
    return F.regexp_replace(F.concat_ws("_", stem(file), as_column(function)), "[^0-9A-Za-z_]", "_")


def thousands(x: str | Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(as_column(x).cast("long"), 0)


def seconds(x: str | Column) -> Column:
    """Seconds with three decimals and their unit."""
    return F.concat(F.format_string("%.3f", as_column(x).cast("double")), F.lit("s"))


def rate(n: str | Column, took: str | Column, unit: str = "rows") -> Column:
    """``n`` per second, as whole units; "n/a" where no time passed."""
    t = as_column(took)
    return F.when(t > 0, F.concat(thousands(F.round(as_column(n) / t)), F.lit(f" {unit}/s"))).otherwise(F.lit("n/a"))


def stamped(df, name: str = "loaded_at"):
    """The rows with the time of the query, the same for all of them."""
    return df.withColumn(name, F.current_timestamp())
