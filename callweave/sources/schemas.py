"""Explicit types of the nine node and seventeen edge tables. Edges run from ``src`` to ``dst``; parallel edges are kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {"S": T.StringType(), "L": T.LongType(), "B": T.BooleanType(), "TS": T.TimestampType(), "A": T.ArrayType(T.StringType())}


def schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split(":") for f in spec.split())])


@dataclass(frozen=True)
class NodeTable:
    name: str
    label: str
    schema: T.StructType
    key: str = "id"


@dataclass(frozen=True)
class EdgeTable:
    name: str
    label: str
    src: str
    dst: str
    schema: T.StructType


NODES = {
    t.name: t
    for t in (
        NodeTable("files", "File", schema("path:S language:S content_hash:S last_modified:TS"), "path"),
        NodeTable("functions", "Function", schema("id:S name:S file:S start_line:L end_line:L is_public:B source_code:S")),
        NodeTable("classes", "Class", schema("id:S name:S file:S start_line:L end_line:L bases:A is_public:B source_code:S")),
        NodeTable("variables", "Variable", schema("id:S name:S file:S definition_line:L scope:S")),
        NodeTable("imports", "Import", schema("id:S imported_name:S import_type:S alias:S line_number:L is_relative:B file:S")),
        NodeTable("decorators", "Decorator", schema("id:S name:S file:S line_number:L arguments:S")),
        NodeTable("attributes", "Attribute", schema("id:S name:S class_name:S file:S definition_line:L type_hint:S is_class_attribute:B")),
        NodeTable("exceptions", "Exception", schema("id:S name:S file:S line_number:L")),
        NodeTable("modules", "Module", schema("id:S name:S path:S is_package:B docstring:S")),
    )
}


def _edge(name: str, label: str, src: str, dst: str, props: str = "") -> EdgeTable:
    return EdgeTable(name, label, src, dst, schema(f"src:S dst:S {props}".strip()))


EDGES = {
    t.name: t
    for t in (
        _edge("calls", "CALLS", "functions", "functions", "call_line:L"),
        _edge("references", "REFERENCES", "functions", "variables", "line_number:L context:S"),
        _edge("contains_function", "CONTAINS_FUNCTION", "files", "functions"),
        _edge("contains_class", "CONTAINS_CLASS", "files", "classes"),
        _edge("contains_variable", "CONTAINS_VARIABLE", "files", "variables"),
        _edge("imports_file", "IMPORTS", "files", "files", "line_number:L is_direct:B"),
        _edge("inherits", "INHERITS", "classes", "classes"),
        _edge("depends_on", "DEPENDS_ON", "classes", "classes", "dependency_type:S line_number:L"),
        _edge("method_of", "METHOD_OF", "functions", "classes"),
        _edge("has_import", "HAS_IMPORT", "files", "imports"),
        _edge("imports_from", "IMPORTS_FROM", "imports", "functions", "line_number:L"),
        _edge("decorated_by", "DECORATED_BY", "functions", "decorators", "position:L"),
        _edge("has_attribute", "HAS_ATTRIBUTE", "classes", "attributes"),
        _edge("accesses", "ACCESSES", "functions", "attributes", "line_number:L access_type:S"),
        _edge("handles_exception", "HANDLES_EXCEPTION", "functions", "exceptions", "line_number:L context:S"),
        _edge("contains_module", "CONTAINS_MODULE", "modules", "modules"),
        _edge("module_of", "MODULE_OF", "files", "modules"),
    )
}

#: A decorated class: beside DECORATED_BY, whose source is a function.
CLASS_DECORATED_BY = _edge("class_decorated_by", "DECORATED_BY", "classes", "decorators", "position:L")
EDGES[CLASS_DECORATED_BY.name] = CLASS_DECORATED_BY

TABLES = NODES | EDGES

#: Other producers' spellings of the endpoint columns, and of vocabulary.
ENDPOINTS = {"from": "src", "to": "dst", "src_id": "src", "dst_id": "dst"}
CONTEXTS = {"raises": "raise", "catches": "catch", "read": "use", "write": "define"}
