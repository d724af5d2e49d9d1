"""The command line, the measures and the stream, over a small source tree."""

import pytest

from callweave import cli
from callweave.operators.resolve import build_graph
from callweave.plans.measure import Steps, memory, text_table
from callweave.plans.render import function_chart, module_chart
from callweave.session import checkpointed
from callweave.sources.scan import analyse, listed, read_files, scan_sources, write_tree
from callweave.sources.store import ASIDE, CodeGraph, read_table, table_path
from callweave.streaming.refresh import changed_files_stream, refresh

FILES = {
    "pkg/__init__.py": "\"\"\"Package.\"\"\"\n",
    "pkg/util.py": "LIMIT = 3\n\n\ndef low(x):\n    return x + LIMIT\n\n\ndef mid(x):\n    return low(x)\n",
    "pkg/deep/er/main.py": "from pkg.util import mid\n\n\ndef top():\n    return mid(1)\n",
    "pkg/half.py": "def fine():\n    return low(2)\n\n\nprint 'old'\n",
    "build/lib.py": "def skip():\n    pass\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def folder(spark, tree, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out") / "graph")
    assert cli.main(["--graph", out, "analyze", str(tree)]) == 0
    return out


def run(capsys, *argv):
    code = cli.main(list(argv))
    out = capsys.readouterr()
    return code, out.out, out.err


def test_analyze(capsys, spark, tree, folder):
    graph = CodeGraph.from_parquet(spark, folder, strict=True)
    assert {r.name for r in graph["functions"].collect()} == {"low", "mid", "top", "fine"}
    code, out, _ = run(capsys, "--graph", folder, "analyze", str(tree), "--incremental")
    assert code == 0 and "unchanged" in out and "python MB" in out
    code, out, _ = run(capsys, "--graph", folder + "2", "analyze", str(tree), "--include", "build", "--exclude", "half", "--source-lines", "1")
    rows = CodeGraph.from_parquet(spark, folder + "2")["functions"].collect()
    assert code == 0 and {r.name for r in rows} == {"low", "mid", "top", "skip"} and all("\n" not in r.source_code for r in rows)


def test_impact_trace_stats(capsys, folder):
    code, out, _ = run(capsys, "--graph", folder, "impact", "pkg/util.py:low")
    lines = [line.split() for line in out.splitlines()[2:]]
    assert code == 0 and lines == [["1", "caller", "pkg/half.py", "fine", "2"], ["1", "caller", "pkg/util.py", "mid", "9"], ["2", "caller", "pkg/deep/er/main.py", "top", "5"]]
    assert run(capsys, "--graph", folder, "impact", "pkg/util.py:low", "--direction", "both", "--max-depth", "1")[1].count("caller") == 2
    code, out, _ = run(capsys, "--graph", folder, "trace", "pkg/util.py:1", "--variable", "LIMIT")
    assert code == 0 and "low" in out
    code, out, _ = run(capsys, "--graph", folder, "stats", "--top", "3")
    assert code == 0 and "total_nodes" in out and "call_count" in out


def test_bad_requests(capsys, folder, tmp_path):
    assert run(capsys, "--graph", folder, "impact", "no-colon")[0] == 1
    code, _, err = run(capsys, "--graph", folder, "trace", "pkg/util.py:one", "--variable", "LIMIT")
    assert code == 1 and err
    assert run(capsys, "--graph", str(tmp_path / "none"), "stats")[0] == 1
    assert run(capsys, "--graph", str(tmp_path / "none"), "analyze", str(tmp_path / "nowhere"))[0] == 1 and not (tmp_path / "none").exists()
    with pytest.raises(SystemExit):
        cli.main(["--graph", folder, "fly"])


def test_visualize(capsys, spark, folder, tmp_path):
    code, out, _ = run(capsys, "--graph", folder, "visualize", "pkg/util.py", "--function", "mid")
    assert code == 0 and "main_top --> util_mid" in out and "util_mid --> util_low" in out
    target = tmp_path / "chart.md"
    assert run(capsys, "--graph", folder, "visualize", "pkg/util.py", "--output", str(target))[0] == 0 and "util_mid" in target.read_text()
    graph = CodeGraph.from_parquet(spark, folder)
    with pytest.raises(ValueError):
        function_chart(graph, "pkg/util.py", "low", max_rows=1)
    with pytest.raises(ValueError):
        module_chart(graph, "pkg/util.py", max_rows=1)


def test_listing_in_rounds(spark, tree):
    """Whether a task lists all or hands folders on, the same files are found."""
    for entries in (1, 2, 100):
        found = listed(spark, str(tree), ("build",), "*.py", entries)
        assert sorted(r.path.split("/pkg/")[1] for r in found.collect()) == ["__init__.py", "deep/er/main.py", "half.py", "util.py"]
    gone = spark.createDataFrame([(f"file:{tree}/nowhere.py", 1, 1)], "path string, size long, ms long")
    assert read_files(gone).first().content is None
    assert listed(spark, str(tree / "nothing")).count() == 0


def test_write_tree(spark, tmp_path):
    rows = [("a/b/c.py", b"x = 1\n"), ("d.py", b""), ("a/__init__.py", None)]
    write_tree(spark.createDataFrame(rows, "file string, content binary"), str(tmp_path))
    back = {r.file: bytes(r.content) for r in scan_sources(spark, str(tmp_path), ()).collect()}
    assert back == {"a/b/c.py": b"x = 1\n", "d.py": b"", "a/__init__.py": b""}


def test_stream_refreshes_a_package(spark, tmp_path):
    root, graph = tmp_path / "src", {}
    (root / "p").mkdir(parents=True)
    (root / "p/__init__.py").write_text("\"\"\"One.\"\"\"\n")
    (root / "p/a.py").write_text("def a():\n    b()\n")

    def handle(files, batch):
        if "g" not in graph:
            graph["store"] = checkpointed(analyse(files))
            graph["g"] = build_graph(graph["store"])
            return
        graph["g"], status, graph["store"] = refresh(graph["g"], files, graph["store"])
        graph["status"] = {r.path: r.status for r in status.collect()}

    def pass_over():
        changed_files_stream(spark, str(root), handle, str(tmp_path / "cp")).awaitTermination()

    pass_over()
    assert {r.path for r in graph["g"]["files"].collect()} == {"p/__init__.py", "p/a.py"}
    (root / "p/b.py").write_text("def b():\n    pass\n")
    (root / "p/__init__.py").write_text("\"\"\"Two.\"\"\"\n")
    pass_over()
    assert graph["status"] == {"p/__init__.py": "changed", "p/b.py": "new", "p/a.py": "deleted"}
    assert {r.docstring for r in graph["g"]["modules"].where("is_package").collect()} == {"Two."}
    assert graph["g"]["calls"].count() == 1


def test_broken_swap_is_healed(spark, folder, tmp_path):
    """A table that was moved aside when a swap stopped comes back; a folder without Parquet is a table without rows."""
    import shutil
    from pathlib import Path

    out = tmp_path / "graph"
    shutil.copytree(folder, out)
    path = Path(table_path(str(out), "functions"))
    n = read_table(spark, str(out), "functions").count()
    path.rename(f"{path}{ASIDE}")
    assert read_table(spark, str(out), "functions").count() == n and path.exists()
    bad = Path(table_path(str(out), "variables"))
    shutil.rmtree(bad)
    bad.mkdir()
    (bad / "x.parquet").write_text("no parquet")
    with pytest.warns(UserWarning):
        assert read_table(spark, str(out), "variables") is None


def test_measures(spark):
    steps = Steps(spark)
    with steps.step("one") as note:
        note["rows"] = 1234
    with pytest.raises(ZeroDivisionError), steps.step("two"):
        1 / 0
    text = steps.table()
    assert [r["step"] for r in steps.rows] == ["one", "two"] and "1,234" in text and "JVM MB" in text and memory()["python_peak_mb"] > 1
    assert text_table(["a", "n"], [("x", 1000), ("yy", None)]) == "a       n\n--  -----\nx   1,000\nyy"
    assert text_table(["a"], []) == "a\n-"
