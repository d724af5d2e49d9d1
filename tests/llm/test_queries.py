"""The registered text queries against their SQL, and the pipeline against a brute-force version of its five stages."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callweave.llm import html_extract, licenses, mixing, packing, quality_rules, simhash, suffix_dedup
from callweave.llm.queries import ORACLES, QUERIES
from tests.llm.test_dedup import groups_of
from tests.llm.test_suffix_dedup import brute, result
from tests.llm.test_text_scans import plain_license, plain_style_tree
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name, sf):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) == ""


@pytest.fixture(scope="module")
def docs():
    return connect(SF).sql("SELECT doc_id, text, source, lang FROM documents").fetchall()


def test_op2_of_the_table(spark, docs):
    templates = licenses.default_templates()
    vocabulary = {w for _, counts, _ in templates for w in counts}
    df = Counter(w for _, t, *_ in docs for w in set(re.findall("[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())) & vocabulary)
    df.update({w: 0 for w in vocabulary})
    plain = {i: plain_license(t or "", templates, len(docs), df) for i, t, *_ in docs}
    files = {}
    for i, _, source, lang in docs:
        name, score, hit, words = plain[i]
        if name and hit * 2 >= words:
            files.setdefault(f"{source}/{lang}", []).append((-score, f"{source}/{lang}/{i}", name))
    want = Counter()
    for i, _, source, lang in docs:
        name, origin, near = plain[i][0], "own", None
        if name is None:
            near = f"{source}/{lang}" if f"{source}/{lang}" in files else None
            name, origin = (min(files[near])[2], "inherited") if near else (None, "none")
        want[i, name, origin, near] += 1
    assert Counter((r.doc_id, r.license, r.origin, r.from_dir) for r in QUERIES["op2_license_scan"](spark, SF).collect()) == want
    assert len({k[1] for k in want}) > 3


def test_op3_of_the_table(spark, docs):
    """One partition: the plain best fit, bin by bin."""
    pieces = []
    for i, t, *_ in docs:
        tokens = -(-len((t or "").encode()) // mixing.BYTES_PER_TOKEN)
        pieces += [(min(packing.CAPACITY, tokens - k * packing.CAPACITY), i, k) for k in range(-(-tokens // packing.CAPACITY))]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    want = sorted((i, k, n, *at) for (n, i, k), at in zip(pieces, slow_best_fit([p[0] for p in pieces], packing.CAPACITY)))
    got = QUERIES["op3_best_fit_packing"](spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.n_tokens, int(r.bin_id.split("-")[1]), r.start) for r in got) == want


def test_op6_of_the_table(spark, docs):
    want = brute([(i, t) for i, t, *_ in docs], suffix_dedup.MIN_WORDS)
    assert result(QUERIES["op6_suffix_dedup"](spark, SF)) == want and len(want) > 20


def test_op8_of_the_table(spark):
    sf = "/root/testdata/sf0.01"  # in smaller tables no host repeats a text
    pages = connect(sf).sql("SELECT page_id, url, html FROM pages").fetchall()
    hosts = {}
    for i, url, html in pages:
        hosts.setdefault(url.split("/")[2].split(":")[0].lower(), []).append((i, html))
    want = {}
    for members in hosts.values():
        plain = plain_style_tree([h for _, h in members], html_extract.THRESHOLD, html_extract.GAMMA) if len(members) > 1 else [(" ".join(text_of(members[0][1])).split(), 0)]
        want |= {i: x for (i, _), x in zip(members, plain)}
    got = {r.page_id: ("".join(r.text.split()), r.n_cut) for r in QUERIES["op8_html_extract"](spark, sf).collect()}
    assert got == {i: ("".join(words), cut) for i, (words, cut) in want.items()} and sum(c for _, c in want.values()) > 10


def text_of(html):
    out, stack = [], [html_extract.parse(html)]
    while stack:
        node = stack.pop()
        out += [node.text] if node.tag == html_extract.TEXT else []
        stack += reversed(node.children)
    return out


def test_op9_of_the_table(spark, docs):
    want = groups_of([(i, t) for i, t, *_ in docs], simhash.BUDGET)
    assert {(r.doc_id, r.near_duplicate_of) for r in QUERIES["op9_simhash_near_dedup"](spark, SF).collect()} == want and len(want) > 10


def test_every_query_is_held_to_something():
    assert set(QUERIES) - set(ORACLES) == {"op2_license_scan", "op3_best_fit_packing", "op5_secret_scan", "op6_suffix_dedup", "op8_html_extract", "op9_simhash_near_dedup"}


def slow_best_fit(lengths, capacity):
    """Bins one by one: the fullest one that still takes the piece, the last opened or used of equals."""
    space, touched, out, clock = [], [], [], 0
    for n in lengths:
        clock += 1
        fits = [b for b in range(len(space)) if space[b] >= n]
        if fits:
            b = min(fits, key=lambda b: (space[b], -touched[b]))
        else:
            b = len(space)
            space.append(capacity)
            touched.append(0)
        out.append((b, capacity - space[b]))
        space[b] -= n
        touched[b] = clock
    return out


def test_pipeline_against_brute_force(spark):
    con = connect(SF)
    docs = con.sql("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE})").fetchall()}
    docs = [d for d in docs if d[0] in good]
    first = {}
    for d in sorted(docs):
        first.setdefault(d[1], d)
    docs = list(first.values())
    gone = {i for i, _ in groups_of([(d[0], d[1]) for d in docs], simhash.BUDGET)}
    docs = [d for d in docs if d[0] not in gone]
    import pandas as pd

    documents = pd.DataFrame(docs, columns=columns)  # noqa: F841
    mixed = duckdb.connect()
    mixed.register("documents", documents)
    taken = {r[0] for r in mixed.sql(f"SELECT doc_id FROM ({mixing.ORACLE})").fetchall()}
    pieces = []
    for d in docs:
        if d[0] in taken:
            tokens = -(-len(d[1].encode()) // mixing.BYTES_PER_TOKEN)
            pieces += [(min(packing.CAPACITY, tokens - k * packing.CAPACITY), d[0], k) for k in range(-(-tokens // packing.CAPACITY))]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    want = sorted((i, k, n, *at) for (n, i, k), at in zip(pieces, slow_best_fit([p[0] for p in pieces], packing.CAPACITY)))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.n_tokens, int(r.bin_id.split("-")[1]), r.start) for r in got) == want and len(want) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_stages_take_odd_tables(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, an empty table, and columns of the operators' own names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = "word " * 300_000
    odd = [(None, None, None, None, None), (None, "text without an id", None, "x", 1), (901, None, "en", "x", 0), (902, "", "en", None, 0), (903, "  ", None, "x", 2), (904, long, "en", "x", 3), (904, long, "en", "x", 3), (905, long, "en", "x", 3), (906, "same text", "en", "x", 9), (906, "same text", "en", "x", 9)]
    extra = ["_row", "_gone", "_unit", "unit", "id", "bin", "grp", "block", "shard", "tokens", "place", "n_copies", "quality_score", "Text_", "level"]
    table = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit(1) for c in extra})
    for whole in (table, table.limit(0)):
        rows = whole
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
            if name != "best_fit_packing":
                assert rows.columns == table.columns, name
        n = rows.count()
        assert n > 50 if whole is table else n == 0
