"""The parser as a table function for SQL: ``SELECT ... FROM sources, LATERAL py_functions(sources.text)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from callweave.session import importable

RETURNS = "name string, start_line bigint, end_line bigint, is_public boolean, parent_class string"


class PyFunctions:
    """One row per function of a Python text. A null text has none, of a broken one those that can be read are given."""

    def eval(self, text: str):
        from callweave.sources.pyparse import functions, pieces

        for f in pieces(text or ""):
            for r in functions(f):
                yield r["name"], f.base + r["start_line"], f.base + r["end_line"], r["is_public"], r["parent_class"]


def registered(spark: SparkSession) -> SparkSession:
    """The session, with py_functions(text) known to its SQL."""
    importable(spark).udtf.register("py_functions", udtf(PyFunctions, returnType=RETURNS))
    return spark
