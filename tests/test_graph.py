"""Operators on small graphs: traversal against plain Python, point queries, changes, storage, charts."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from callweave.functions import columns as C
from callweave.operators import cookbook as K
from callweave.operators import mutate as W
from callweave.operators import points as P
from callweave.operators.traverse import call_components, cycles, impact, impact_table, levels, min_depth, neighbourhood, reach
from callweave.plans.render import MAX_ROWS, function_chart, function_chart_lines, module_chart, module_chart_lines, node_id, save
from callweave.sources.schemas import TABLES
from callweave.sources.store import CodeGraph, ReadOnlyError, check_unique, conform, dangling_edges, export_summary, load_statistics, read_table
from callweave.sources.synthetic import generate, sample_graph


@pytest.fixture(scope="module")
def g(spark):
    return sample_graph(spark)


def graph_of(spark, calls, functions=None):
    ids = sorted({x for c in calls for x in c[:2]}) if functions is None else functions
    rows = [(i, f"n{i}", "f.py", 1, 2, True, "") for i in ids]
    return CodeGraph(spark, {"functions": spark.createDataFrame(rows, TABLES["functions"].schema), "calls": spark.createDataFrame(calls, TABLES["calls"].schema)})


def test_impact(g):
    down = [tuple(r) for r in impact_table(impact(g, "/project/main.py", "func1", "downstream")).collect()]
    assert down == [(1, "callee", "/project/utils.py", "func2", 5), (1, "callee", "/project/utils.py", "func3", 6), (2, "callee", "/project/utils.py", "func4", 20)]
    up = [tuple(r) for r in impact_table(impact(g, "/project/utils.py", "func4")).collect()]
    assert up == [(1, "caller", "/project/utils.py", "func2", 20), (2, "caller", "/project/main.py", "func1", 5)]
    assert impact(g, "/project/utils.py", "func2", "both").count() == 2
    assert impact(g, "/project/utils.py", "func4", max_depth=0).count() == 0 and impact(g, "no", "no").count() == 0
    assert impact(g, "/project/utils.py", "func4", max_depth=1).count() == 1
    assert neighbourhood(g, "/project/main.py", "func1", "downstream", 3).count() == 3
    with pytest.raises(ValueError):
        impact(g, "a", "b", "sideways")


def bfs_rows(calls, start, depth):
    """Rows of impact() upstream, by a queue."""
    dist, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for s, d, _ in calls:
            if d == at and s not in dist:
                dist[s] = dist[at] + 1
                queue.append(s)
    return sorted((f"n{s}", line, dist[d] + 1) for s, d, line in calls if d in dist and dist[d] < depth)


@pytest.mark.parametrize("seed", range(3))
def test_traversal_on_random_multigraphs(spark, seed):
    rng = random.Random(seed)
    calls = [(str(rng.randrange(9)), str(rng.randrange(9)), rng.randrange(3)) for _ in range(16)] + [("0", "0", 1), ("0", "1", 1), ("1", "0", 2), ("0", "1", 1)]
    graph = graph_of(spark, calls)
    got = sorted((r.function, r.line, r.depth) for r in impact(graph, "f.py", "n0", "upstream", 3).collect())
    assert got == bfs_rows(calls, "0", 3)
    succ = {}
    for s, d, _ in calls:
        succ.setdefault(s, set()).add(d)
    dist, frontier, walk, seen = {"0": 0}, {"0"}, set(), set()
    layer = {"0"}
    for depth in range(1, 4):
        layer = {d for s in layer for d in succ.get(s, ())}
        walk |= layer
        frontier = {d for s in frontier for d in succ.get(s, ())} - set(dist)
        dist |= dict.fromkeys(frontier, depth)
    assert {r.id for r in reach(graph, "f.py", "n0", False, 3).collect()} == walk
    assert {(r.id, r.depth) for r in min_depth(graph, "f.py", "n0", 3).collect()} == {(k, v) for k, v in dist.items() if v}
    simple = set()

    def go(path):
        for d in succ.get(path[-1], ()):
            if d == path[0]:
                simple.add(">".join(path))
            elif d > path[0] and d not in path and len(path) < 3:
                go([*path, d])

    for s in succ:
        go([s])
    assert {r.path for r in cycles(graph, 3).collect()} == simple and not seen


def test_long_chain(spark):
    calls = [(f"{i:03}", f"{i + 1:03}", i) for i in range(30)]
    found = min_depth(graph_of(spark, calls), "f.py", "n000", 100)
    assert found.count() == 30 and found.agg(F.max("depth")).first()[0] == 30


def test_levels_without_start(spark):
    empty = spark.createDataFrame([], "u string, v string")
    step = lambda nodes: empty.join(nodes, empty["u"] == nodes["node"]).select(empty["v"].alias("node"))
    assert levels(step, spark.createDataFrame([(None,)], "node string"), 3).count() == 0
    assert levels(step, spark.createDataFrame([("a",), ("a",)], "node string"), 3).collect() == [("a", 0)]


@pytest.mark.parametrize("listed", [0, 1, 3, 10, 1000])
def test_levels_listed_or_distributed(spark, listed):
    """However many nodes may be listed on the driver, distances are the same."""
    rng = random.Random(3)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    df = spark.createDataFrame(pairs, "u long, v long")
    step = lambda nodes: df.join(nodes, df["u"] == nodes["node"]).select(F.col("v").alias("node"))
    dist, frontier = {0: 0, 1: 0}, {0, 1}
    for depth in range(1, 6):
        frontier = {v for u, v in pairs if u in frontier} - set(dist)
        dist |= dict.fromkeys(frontier, depth)
    got = levels(step, spark.createDataFrame([(0,), (1,), (None,)], "node long"), 5, listed).collect()
    assert len(got) == len(dist) and {r.node: r.depth for r in got} == dist


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    """Strongly connected components against mutual reachability."""
    rng = random.Random(seed)
    calls = [(f"{rng.randrange(14):02}", f"{rng.randrange(14):02}", 1) for _ in range(18)] + [("90", "90", 1), ("91", "92", 1), ("92", "93", 2), ("93", "94", 1), ("94", "91", 1), ("95", "91", 1)]
    reach_of = {}
    for s in {x for c in calls for x in c[:2]}:
        seen, todo = set(), [s]
        while todo:
            at = todo.pop()
            for a, b, _ in calls:
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach_of[s] = seen
    want = {(s, min(t for t in reach_of[s] if s in reach_of[t])) for s in reach_of if s in reach_of[s]}
    got = [(r.id, r.component) for r in call_components(graph_of(spark, calls)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("94", "91") in want


def test_points(g):
    assert [r.name for r in K.dead_code(g).collect()] == ["func1"]
    assert P.functions_in_file(g, "/project/utils.py").count() == 3
    assert [tuple(r) for r in P.attribute_modifiers(g, "DataModel", "value").collect()] == [("/project/utils.py", "func4", 55)]
    assert [tuple(r) for r in P.variable_usage(g, "/project/main.py", "CONFIG", 3).collect()] == [("/project/main.py", "func1", 4)]
    assert P.get_function(g, "/project/main.py", "none").count() == 0 and P.get_class(g, "/project/models.py", "DataModel").count() == 1
    assert P.file_exists(g, "/project/main.py", "hash_0") and not P.file_exists(g, "/project/main.py", "x")
    assert [r.name for r in P.functions_raising(g, "ValueError").collect()] == ["func1"]
    stats = {r.table: (r.n, r.percent) for r in P.statistics(g).collect()}
    assert stats["functions"] == (4, 21.1) and stats["modules"] == (0, 0.0)
    assert K.overall_counts(CodeGraph(g.spark, {})).first().asDict() == dict.fromkeys(K.COUNTED, 0)
    assert [tuple(r) for r in K.classes_with_most_bases(g).collect()] == []
    row = K.public_surface(g, "/project/utils.py").first()
    assert row.functions == ["func2", "func4"] and row.classes == ["Helper"]
    assert K.public_surface(g, "nowhere").first().functions == []


def test_store(spark, g, tmp_path):
    out = str(tmp_path / "graph")
    g.write(out)
    back = CodeGraph.from_parquet(spark, out, read_only=True, strict=True)
    for t in TABLES:
        assert sorted(map(str, back[t].collect())) == sorted(map(str, g[t].collect())), t
        assert back[t].schema.names == TABLES[t].schema.names
    with pytest.raises(ReadOnlyError):
        back.cleared()
    with pytest.raises(ReadOnlyError):
        W.delete_files(back, spark.createDataFrame([("x",)], "path string"))
    assert read_table(spark, out, "functions", ["id"]).columns == ["id"] and read_table(spark, str(tmp_path / "no"), "functions") is None
    assert CodeGraph.from_parquet(spark, str(tmp_path / "no"))["calls"].count() == 0
    assert {r.table: r.n for r in export_summary(g).collect()}["functions"] == 4
    assert load_statistics(g)["total_nodes"] == 19
    CodeGraph(spark, {"functions": g["functions"].limit(1), "calls": g["calls"]}).write(out)
    with pytest.raises(ValueError):
        CodeGraph.from_parquet(spark, out, strict=True)
    g.register_views("t_")
    assert spark.sql("select count(*) from t_calls c join t_functions f on f.id = c.dst").first()[0] == 3


def test_spellings(spark):
    df = spark.createDataFrame([("a", "b", 4)], "`from` string, `to` string, line_number int")
    assert conform(df, "calls").first().asDict() == {"src": "a", "dst": "b", "call_line": 4}
    df = spark.createDataFrame([("1", '["A", " B"]'), ("2", "A, ,B"), ("3", ""), ("4", None)], "`n.id` string, `n.bases` string")
    assert [r.bases for r in conform(df, "classes").orderBy("id").collect()] == [["A", "B"], ["A", "B"], [], []]
    df = spark.createDataFrame([("a", "b", "raises")], "src_id string, dst_id string, context string")
    assert conform(df, "handles_exception").first().context == "raise"


def test_mutations(spark, g):
    fn = spark.createDataFrame([("new", "/project/main.py", 5, 9, True, "x", None), ("meth", "/project/utils.py", 75, 79, False, "y", "Helper")], "name string, file string, start_line long, end_line long, is_public boolean, source_code string, parent_class string")
    h = W.add_functions(W.add_functions(g, fn), fn)
    assert h["functions"].count() == 6 and h["contains_function"].count() == 6 and h["method_of"].count() == 3
    call = spark.createDataFrame([("/project/main.py", "new", 5, "/project/utils.py", "meth", 75, 6), ("/project/main.py", "new", 5, "gone", "gone", 1, 7)], "caller_file string, caller string, caller_start_line long, callee_file string, callee string, callee_start_line long, call_line long")
    assert W.add_calls(h, call)["calls"].count() == 4
    cls = spark.createDataFrame([("Child", "/project/main.py", 1, 2, "DataModel,Helper", True)], "name string, file string, start_line long, end_line long, bases string, is_public boolean")
    h = W.add_classes(h, cls)
    assert h["inherits"].count() == 2 and h["contains_class"].count() == 3
    at = spark.createDataFrame([("size", "Child", "/project/main.py", 2, True)], "name string, class_name string, file string, definition_line long, is_class_attribute boolean")
    assert W.add_attributes(h, at)["has_attribute"].count() == 4
    var = spark.createDataFrame([("a", "/project/main.py", 1, "module"), ("b", "/project/main.py", 2, "function:f")], "name string, file string, definition_line long, scope string")
    h = W.add_variables(h, var)
    assert h["variables"].count() == 5 and h["contains_variable"].count() == 1
    h = W.add_imports(h, spark.createDataFrame([("os", "module", "/project/main.py", 1, False)], "imported_name string, import_type string, file string, line_number long, is_relative boolean"))
    assert h["has_import"].count() == 1
    h = W.add_exceptions(W.add_modules(W.add_decorators(h, spark.createDataFrame([("d", "f", 1)], "name string, file string, line_number long")), spark.createDataFrame([("m",)], "name string")), spark.createDataFrame([("E", "f", 1)], "name string, file string, line_number long"))
    assert (h["decorators"].count(), h["modules"].count(), h["exceptions"].count()) == (3, 1, 3)
    use = spark.createDataFrame([("/project/main.py", "new", 5, "/project/main.py", "a", 1, 6, "use")], "function_file string, function string, start_line long, file string, name string, definition_line long, line_number long, context string")
    assert W.add_variable_usage(h, use)["references"].count() == 3
    bad = spark.createDataFrame([("f1", "a1", 1, "poke")], "src string, dst string, line_number long, access_type string")
    with pytest.raises(ValueError):
        W.add_attribute_access(g, bad)
    gone = W.delete_files(g, spark.createDataFrame([("/project/utils.py",)], "path string"))
    assert gone["functions"].count() == 1 and gone["calls"].count() == 0 and gone["files"].count() == 2 and dangling_edges(gone).where("n > 0").count() == 0
    assert g.cleared()["decorators"].count() == 0


def test_chart_lines(spark, g):
    """The same lines as the text's; a chart of more rows than a text may have comes whole."""
    lines = lambda df: sorted(r.line for r in df.collect())
    assert lines(function_chart_lines(g, "/project/utils.py", "func2")) == sorted(function_chart(g, "/project/utils.py", "func2").split("\n"))
    assert lines(module_chart_lines(g, "/project/main.py")) == sorted(module_chart(g, "/project/main.py").split("\n"))
    n = MAX_ROWS + 500
    large = graph_of(spark, [("hub", f"f{i}", i) for i in range(n)])
    with pytest.raises(ValueError):
        module_chart(large, "f.py")
    assert len(lines(module_chart_lines(large, "f.py"))) == 1 + n + 1 + n
    assert len(lines(function_chart_lines(large, "f.py", "nhub", 1))) == 1 + 3 + n + 1 + n


def test_charts(g, tmp_path):
    text = function_chart(g, "/project/utils.py", "func2")
    assert "main_func1 --> utils_func2" in text and "utils_func2 --> utils_func4" in text
    assert "utils_func2 --> utils_func4" in function_chart(g, "/project/main.py", "func1", edges="path")
    assert "main_func1 --> utils_func4" in function_chart(g, "/project/main.py", "func1")
    assert "utils_func2(" in module_chart(g, "/project/main.py") and "utils_func2" not in module_chart(g, "/project/main.py", False)
    assert "No functions" in module_chart(g, "/project/none.py")
    assert node_id("a/b-c.py", "f.g") == "b_c_f_g"
    save(text, str(tmp_path / "x.md"))
    assert (tmp_path / "x.md").read_text().startswith("```mermaid")


def test_generated(spark):
    graph = generate(spark, "small")
    for t in ("functions", "classes", "variables", "imports"):
        check_unique(graph[t])
    assert graph["functions"].count() == 3000 and 0 < graph["calls"].count() <= 9000
    assert dangling_edges(graph).where("n > 0").count() == 0
    assert sorted(map(str, graph["calls"].limit(5).collect())) == sorted(map(str, generate(spark, "small")["calls"].limit(5).collect()))


def test_columns(spark):
    df = spark.createDataFrame([("/root/a/b.tar.py", '{"k": 1}')], "path string, j string")
    row = df.select(C.relative_path("path", "/root").alias("rel"), C.stem("path").alias("stem"), C.arguments_map("j").alias("m"), C.percentage(F.lit(1), F.lit(3)).alias("p"), C.percentage(F.lit(1), F.lit(0)).alias("z"), C.is_public(F.lit("_x")).alias("pub"), C.parent_directory("path").alias("dir")).first()
    assert tuple(row) == ("a/b.tar.py", "b.tar", {"k": "1"}, 33.3, 0.0, False, "/root/a")
