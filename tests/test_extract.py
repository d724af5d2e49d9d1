"""The parser's records on hand-made sources, and the graph that resolution builds of them."""

import json
import textwrap

import pytest
from pyspark.sql import functions as F

from callweave.operators import resolve
from callweave.operators.resolve import build_graph, containing_function, inherits_edges
from callweave.plans.analyze import analyze
from callweave.session import checkpointed
from callweave.sources import pyparse
from callweave.sources.pyparse import _File, analyse_bytes, analyse_text
from callweave.sources.scan import analyse, excludes, from_texts, scan_sources, summary
from callweave.sources.store import CodeGraph, check_unique, dangling_edges

SHAPES = textwrap.dedent('''\
    """Shapes."""
    import math as m
    from . import helpers
    from os.path import join, split as cut

    LIMIT = 10


    class Base:
        kind: str = "base"

        def __init__(self, size):
            self.size = size
            if size:
                self.half: float = size / 2


    @register("circle", weight=2)
    class Circle(Base, metaclass=Meta):
        @property
        def area(self):
            return m.pi * square(self.size)

        @staticmethod
        def _make(x):
            try:
                return Circle(x)
            except (ValueError, KeyError):
                raise
            except:
                raise errors.Bad("no")


    def square(x):
        def inner(y):
            total = y * LIMIT
            return total
        x, (a, *b) = 1, (2, 3)
        if (n := inner(x)) > LIMIT:
            n += 1
        return inner(x)


    square(2)
    ''')


def values(kind, *names, text=SHAPES, **kw):
    return [tuple(r[n] for n in names) for r in analyse_text(text, **kw)[kind]]


def test_functions_and_classes():
    assert values("functions", "name", "is_public", "parent_class") == [
        ("__init__", False, "Base"), ("area", True, "Circle"), ("_make", False, "Circle"), ("square", True, None), ("inner", True, None),
    ]
    assert values("functions", "name", "parent_class", compat=True)[1] == ("area", None)
    assert values("classes", "name", "bases", "methods") == [("Base", [], ["__init__"]), ("Circle", ["Base"], ["area", "_make"])]
    assert analyse_text(SHAPES)["functions"][1]["source_code"].lstrip().startswith("def area")
    assert analyse_text(SHAPES, source_lines=0)["functions"][0]["source_code"] is None


def test_calls_belong_to_the_outermost_function():
    assert values("calls", "caller_function", "called_name") == [("area", "square"), ("_make", "Circle"), ("_make", "Bad"), ("square", "inner"), ("square", "inner")]


def test_outermost_against_a_plain_search():
    """Also functions that share lines, and lines that other separators would cut."""
    text = SHAPES + "f = 'a\x0cb'\ndef one(): pass\nasync def two(): g(); h()\ndef three():\n    def four(): return g()\n    class C:\n        def m(self): return h()\n    return g()\n"
    f = _File(text, False)
    for line in range(1, len(f.lines) + 1):
        for strict in (False, True):
            plain = next((n for n in f.functions if (n.lineno < line if strict else n.lineno <= line) and line <= n.end_lineno), None)
            assert f.outermost(line, strict) is plain


def test_variables():
    got = values("variables", "name", "scope")
    assert ("LIMIT", "module") in got and ("kind", "module") in got
    assert [n for n, s in got if s == "function:square"] == ["total", "x", "a", "b", "n", "n"]
    assert ("self", "function:__init__") in got
    assert ("LIMIT", "inner") in values("usages", "variable_name", "function_name") and ("LIMIT", "square") in values("usages", "variable_name", "function_name")


def test_imports():
    assert values("imports_detailed", "imported_name", "import_type", "alias", "is_relative", "module") == [
        ("math", "module", "m", False, None), ("helpers", "unknown", None, True, None), ("join", "unknown", None, False, "os.path"), ("split", "unknown", "cut", False, "os.path"),
    ]
    assert values("imports", "module", "is_relative") == [("math", False), ("os.path", False)]
    assert values("imports_detailed", "imported_name", "import_type", text="from a import *") == [("*", "*")]


def test_decorators():
    got = values("decorators", "name", "target_name", "target_type", "arguments")
    assert [g[:3] for g in got] == [("register", "Circle", "class"), ("property", "area", "function"), ("staticmethod", "_make", "function")]
    assert json.loads(got[0][3]) == {"arg_0": "circle", "weight": 2}
    assert json.loads(values("decorators", "arguments", text="@d(1j, {1: (2,)}, b'x', f(y))\ndef g(): pass")[0][0]) == {"arg_0": "1j", "arg_1": {"1": [2]}, "arg_2": "b'x'", "arg_3": "f(y)"}


def test_attributes_and_accesses():
    assert values("attributes", "name", "class_name", "type_hint", "is_class_attribute") == [("kind", "Base", "str", True), ("size", "Base", None, False), ("half", "Base", "float", False)]
    assert values("accesses", "name", "function_name", "access_type") == [("size", "__init__", "write"), ("half", "__init__", "write"), ("size", "area", "read")]


def test_exceptions():
    assert values("exceptions", "name", "context", "function_name") == [
        ("ValueError", "catch", "_make"), ("KeyError", "catch", "_make"), ("<bare-raise>", "raise", "_make"), ("<bare-except>", "catch", "_make"), ("errors.Bad", "raise", "_make"),
    ]
    assert len(values("exceptions", "name", compat=True)) == 10


def test_bad_files_keep_their_row():
    assert analyse_text("def broken(:")["errors"] and analyse_text("def broken(:")["functions"] == []
    assert "Encoding error" in analyse_bytes(b"\xff\xfe\x00")["errors"][0]
    for empty in (b"", None):
        assert analyse_bytes(empty)["errors"] == []
    assert analyse_text("x = '\0'")["errors"]


BROKEN = textwrap.dedent('''\
    """Doc."""
    import os

    print "hello"

    def good(x):
        return helper(x)

    @decorated(1)
    class C(Base):
        kind = 1

        def works(self):
            self.n = 1
            return good(self.n)

        def fails(self):
            y = good(2)
            return y +
        text = """
    def not_code(): pass
        """

        def later(self): return good(3)

    exec "x" in y
    def bad(:
        z = 1

    async def last():
        return good(
            4
        )
    ''')


def test_broken_files_keep_what_can_be_read():
    got = analyse_text(BROKEN)
    assert len(got["errors"]) == 1 and got["errors"][0].startswith("Syntax error")
    lines = BROKEN.split("\n")
    assert [r["name"] for r in got["functions"]] == ["good", "works", "fails", "later", "last"]
    for r in got["functions"]:
        assert f"def {r['name']}(" in lines[r["start_line"] - 1] and r["source_code"].startswith(lines[r["start_line"] - 1])
    assert [(c["name"], c["bases"], c["methods"]) for c in got["classes"]] == [("C", ["Base"], ["works", "fails", "later"])]
    assert [(c["caller_function"], c["called_name"], c["call_line"]) for c in got["calls"]] == [("good", "helper", 7), ("works", "good", 15), ("fails", "good", 18), ("later", "good", 24), ("last", "good", 31)]
    assert got["docstring"] == "Doc." and [i["module"] for i in got["imports"]] == ["os"] and [d["name"] for d in got["decorators"]] == ["decorated"]
    assert analyse_text("x = (\n" * 3000)["functions"] == [] and analyse_text("if x:\n" * 500 + "def f(:")["functions"] == []
    deep = "".join(" " * i + "if x:\n" for i in range(90)) + " " * 90 + "y = = 1\n"
    assert analyse_text(deep)["errors"]


@pytest.mark.parametrize("cut", range(0, 30, 3))
def test_a_broken_line_costs_its_statement_alone(cut):
    """A line of nonsense between two top-level statements takes nothing else away."""
    whole = analyse_text(SHAPES)
    tops = [i for i, line in enumerate(SHAPES.split("\n")) if line and not line[0].isspace() and not line.startswith("@")]
    at = tops[cut // 3 % len(tops)]
    lines = SHAPES.split("\n")
    if lines[at - 1].startswith("@"):
        at -= 1
    broken = analyse_text("\n".join([*lines[:at], "this is = no code (", ")", *lines[at:]]))
    assert broken["errors"]
    for kind in ("functions", "classes", "calls", "variables", "imports", "exceptions"):
        strip = lambda r: {k: v for k, v in r.items() if "line" not in k and k != "source_code"}
        assert [strip(r) for r in broken[kind]] == [strip(r) for r in whole[kind]], kind


def test_long_texts_are_read_in_pieces(monkeypatch):
    """Whatever the size of a piece, the records are those of the text read at once, and a tree holds a few statements."""
    odd = '"""Doc\ndef no(): pass\n"""\nx = (\n1,\n2)\ny = """\ndef f(): pass\n"""; z = 1\n\x0cw = 1 + \\\n2\nif x:\n    pass\n# note\nelse:\n    pass\n@d\n# note\n@e\ndef g():\n    return """\nend"""\ntry:\n    g()\nexcept KeyError: raise\n'
    mixed = odd.replace("\n", "\r\n") + odd
    texts = [SHAPES * 3, odd, mixed, "# only\n" * 9 + odd, BROKEN, odd + BROKEN * 2, SHAPES + "def open(:\n" + odd, odd + "x = (\n" + SHAPES, odd + "y = '''\n" + SHAPES, odd + "a\0b", "", "\n" * 99, odd + "if x:"]
    whole = [(analyse_text(t), analyse_text(t, compat=True, source_lines=1)) for t in texts]
    for size in (1, 7, 40, 90, 200):
        monkeypatch.setattr(pyparse, "PIECE", size)
        for text, (a, b) in zip(texts, whole):
            assert analyse_text(text) == a and analyse_text(text, compat=True, source_lines=1) == b, (size, text)
    monkeypatch.setattr(pyparse, "PIECE", 40)
    assert max(len(f.tree.body) for f in pyparse.pieces(SHAPES * 50)) <= 4 and len(list(pyparse.pieces(BROKEN * 50))) > 50


def test_a_long_file_is_one_file(spark):
    """A file whose records come in several rows has one row in the graph and one docstring, and its lines go on."""
    text = '"""Doc."""\n' + "".join(f"def f{i}():\n    return f{i + 1}()\n\n\n" for i in range(4000))
    files = [("a.py", text), ("b.py", "def f4000(): pass\n"), ("c.py", text + "def broken(:\n")]
    parsed = checkpointed(analyse(from_texts(spark.createDataFrame(files, "file string, text string"))))
    assert parsed.where("file = 'a.py'").count() > 1
    g = build_graph(parsed)
    assert g["files"].count() == 3 and {r.path: r.docstring for r in g["modules"].collect()} == {"a.py": "Doc.", "b.py": "", "c.py": "Doc."}
    assert {r.start_line for r in g["functions"].where("file = 'a.py'").collect()} == {2 + 4 * i for i in range(4000)}
    assert g["calls"].count() == 2 * (2 * 3999 + 1)
    row = summary(parsed).first()
    assert (row.files, row.files_with_errors, row.functions) == (3, 1, 8001)


PROJECT = {
    "src/app/__init__.py": '"""The package."""\n',
    "src/app/utils.py": "def helper():\n    return 1\n\n\ndef again():\n    return helper()\n",
    "src/app/main.py": "from app.utils import helper\n\n\ndef process():\n    return helper()\n\n\ndef main():\n    process()\n    helper()\n",
    "src/app/bad.py": "def broken(:\n",
}


@pytest.fixture(scope="module")
def project(spark):
    df = spark.createDataFrame(list(PROJECT.items()), "file string, text string").repartition(3)
    return checkpointed(analyse(from_texts(df)))


def test_project_graph(spark, project):
    g = build_graph(project)
    names = {r.id: r.name for r in g["functions"].collect()}
    calls = sorted((names[r.src], names[r.dst], r.call_line) for r in g["calls"].collect())
    assert calls == [("again", "helper", 6), ("main", "helper", 10), ("main", "process", 9), ("process", "helper", 5)]
    modules = {r.name: (r.path, r.is_package, r.docstring) for r in g["modules"].collect()}
    assert modules["app"] == ("src/app/__init__.py", True, "The package.") and set(modules) == {"app", "app.utils", "app.main", "app.bad"}
    assert g["contains_module"].count() == 3 and g["module_of"].count() == 4
    assert [(r.src, r.dst) for r in g["imports_file"].collect()] == [("src/app/main.py", "src/app/utils.py")]
    assert [names[r.dst] for r in g["imports_from"].collect()] == ["helper"]
    for t in ("functions", "imports", "variables"):
        check_unique(g[t])
    assert dangling_edges(g).where("n > 0").count() == 0
    row = summary(project).first()
    assert (row.files, row.files_with_errors, row.functions, row.calls) == (4, 1, 4, 4)


def test_same_names_fan_out(spark):
    rows = [("a.py", "def f():\n    g()\n\n\ndef f():\n    g()\n"), ("b.py", "def g():\n    pass\n"), ("c.py", "def g():\n    pass\n")]
    g = build_graph(analyse(from_texts(spark.createDataFrame(rows, "file string, text string"))))
    assert g["calls"].count() == 2 * 2 * 2


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_common_names_meet_in_blocks(spark, monkeypatch, block):
    """Many functions of one name in a file, or in many files: every pair once, whatever the size of a block."""
    monkeypatch.setattr(resolve, "BLOCK", block)
    rows = [("a.py", "def f():\n    g()\n    gone()\n\n\n" * 7 + "def g(): pass\n")] + [(f"{i}.py", "def g():\n    f()\n") for i in range(5)]
    g = build_graph(checkpointed(analyse(from_texts(spark.createDataFrame(rows, "file string, text string")))))
    assert g["calls"].count() == g["calls"].distinct().count() == 7 * 7 * 6 + 5 * 7
    assert dangling_edges(g.replaced(functions=g["functions"].where("name = 'f'"))).where("table = 'calls'").first().n == 7 * 7 * 6 + 5 * 7


def test_ends_are_filtered_before_calls_are_multiplied(spark):
    """A filter on either end of the calls goes below the joins that multiply them: it is not applied to every pair."""
    files = spark.createDataFrame([("a.py", "def f():\n    g()\n" * 3 + "def g(): pass\n")], "file string, text string")
    g = build_graph(checkpointed(analyse(from_texts(files))))
    for end in ("src", "dst"):
        kept = g["calls"].join(g["functions"].where("start_line > 3").select(F.col("id").alias(end)), end, "left_semi")
        plan = [line.strip(" :+-") for line in kept._jdf.queryExecution().optimizedPlan().toString().split("\n")]
        assert plan[0].startswith(("Union", "Project")) and not any(p.startswith("Join LeftSemi") for p in plan[:3]), plan[:5]
        assert kept.count() == {"src": 3, "dst": 9}[end]


def test_inherits_scopes(spark):
    rows = [("1", "A", "x.py", 1, []), ("2", "A", "y.py", 1, []), ("3", "B", "y.py", 9, ["A", "Gone"]), ("4", "C", "z.py", 2, ["A"])]
    df = spark.createDataFrame(rows, "id string, name string, file string, start_line long, bases array<string>")
    got = {s: sorted((r.src, r.dst) for r in inherits_edges(df, s).collect()) for s in ("file", "global", "global_first")}
    assert got == {"file": [("3", "2")], "global": [("3", "1"), ("3", "2"), ("4", "1"), ("4", "2")], "global_first": [("3", "1"), ("4", "1")]}
    with pytest.raises(ValueError):
        inherits_edges(df, "other")


def test_containing_function(spark):
    fn = spark.createDataFrame([("a", "out", 1, 10), ("a", "in", 3, 5), ("b", "x", 1, 2)], "file string, name string, start_line long, end_line long")
    points = spark.createDataFrame([("a", 4), ("a", 4), ("a", 11), ("b", 2)], "file string, line long")
    assert sorted((r.file, r.line, r.function) for r in containing_function(points, fn).collect()) == [("a", 4, "out"), ("a", 4, "out"), ("b", 2, "x")]


def test_scan_analyze_and_refresh(spark, tmp_path):
    root, out = tmp_path / "tree", str(tmp_path / "graph")
    for name, text in PROJECT.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "venv").mkdir()
    (root / "venv/skip.py").write_text("def skip(): pass")
    patterns = excludes()
    assert "venv" not in excludes(include=("venv",)) and "zzz" in excludes(exclude=("zzz",))
    assert sorted(r.file for r in scan_sources(spark, str(root), patterns).select("file").collect()) == sorted(PROJECT)
    assert analyze(spark, str(root), out, patterns)["summary"]["files"] == 4
    before = str(CodeGraph.from_parquet(spark, out, strict=True)["calls"].count())
    assert analyze(spark, str(root), out, patterns, incremental=True)["status"] == {"unchanged": 4}
    assert str(CodeGraph.from_parquet(spark, out)["calls"].count()) == before

    (root / "src/app/utils.py").write_text("def helper():\n    return 2\n\n\ndef extra():\n    return helper()\n")
    (root / "src/app/bad.py").unlink()
    (root / "src/app/more.py").write_text("def more():\n    extra()\n")
    assert analyze(spark, str(root), out, patterns, incremental=True, delete_missing=True)["status"] == {"changed": 1, "new": 1, "deleted": 1, "unchanged": 2}
    incremental, full = CodeGraph.from_parquet(spark, out), build_graph(analyse(scan_sources(spark, str(root), patterns)))
    for t in ("files", "functions", "calls", "contains_function", "modules"):
        cols = [c for c in full[t].columns if c != "last_modified"]
        assert sorted(map(str, incremental[t].select(cols).collect())) == sorted(map(str, full[t].select(cols).collect())), t
