"""Exact and SimHash dedup against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import simhash
from callweave.llm._frames import Tokens, mix64, token_hash
from callweave.llm.components import connected_components
from callweave.llm.exact_dedup import exact_dedup

DOCS = "doc_id long, text string, source string, n_copies long"


def test_exact_dedup(spark):
    long = "é" * 200_000
    rows = [(3, "a", "s", 1), (1, "a", "t", 2), (None, "a", "a", 0), (2, "A", "s", 1), (5, None, "s", 1), (4, None, None, None), (6, "", "s", 1), (7, long, "s", 1), (8, long + "x", "s", 1), (7, long, "s", 1), (None, "z", "b", 1), (None, "z", "a", 1)]
    df = spark.createDataFrame(rows * 3, DOCS).repartition(6)
    got = {(r.doc_id, r.text and r.text[:3], r.source, r.n_copies, r.n_copies_) for r in exact_dedup(df, salts=3).collect()}
    assert got == {(1, "a", "t", 2, 9), (2, "A", "s", 1, 3), (4, None, None, None, 6), (6, "", "s", 1, 3), (7, "ééé", "s", 1, 6), (8, "ééé", "s", 1, 3), (None, "z", "a", 1, 6)}
    assert exact_dedup(df, copies=False).columns == df.columns and exact_dedup(df.limit(0)).count() == 0


def plain_print(text):
    """The fingerprint, word by word."""
    words = {token_hash(w) for w in text.split()}
    if not words:
        return None
    votes = [0] * 128
    for w in words:
        bits = int(mix64(np.array([w], dtype=np.uint64), 0)[0]) << 64 | int(mix64(np.array([w], dtype=np.uint64), 1)[0])
        for i in range(128):
            votes[i] += bits >> (127 - i) & 1
    return sum(1 << (127 - i) for i in range(128) if votes[i] * 2 > len(words))


def some_texts(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"wört{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))))
    return out


def test_fingerprints_and_tokens():
    texts = [*some_texts(1, 30), None, "", " \t\n", "x"]
    hi, lo, has = simhash.fingerprints(texts)
    assert [int(a) << 64 | int(b) if h else None for a, b, h in zip(hi, lo, has)] == [plain_print(t or "") for t in texts]
    tokens = Tokens(["a  bb", None, "é"])
    assert tokens.hashes.tolist() == [token_hash(x) for x in ("a", "bb", "é")] and tokens.counts.tolist() == [2, 0, 1]


@pytest.mark.parametrize("budget,leaf,chunk", [(23, 1 << 18, 1 << 20), (12, 16, 1 << 20), (23, 40, 20), (23, 200, 30), (3, 20, 10), (29, 30, 1 << 20)])
def test_near_pairs_are_complete(spark, budget, leaf, chunk):
    """Whatever the depth of the cut and the size of chunks, every pair within the budget comes once."""
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 1 << 63, size=(12, 2), dtype=np.int64)
    rows = []
    for i in range(150):
        value = int(base[i % 12][0]) << 64 | int(base[i % 12][1])
        for b in rng.choice(128, size=int(rng.integers(0, budget)), replace=False):
            value ^= 1 << int(b)
        rows.append(value)
    rows = sorted(set(rows))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(v >> 64), signed(v & (1 << 64) - 1)) for i, v in enumerate(rows)], "rep long, hi long, lo long")
    got = sorted((min(r.a, r.b), max(r.a, r.b), r.hamming) for r in simhash.near_pairs(df, budget, leaf, chunk).where("a <> b").collect())
    want = [(i, j, (rows[i] ^ rows[j]).bit_count()) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (rows[i] ^ rows[j]).bit_count() <= budget]
    assert got == want


def groups_of(texts, budget):
    prints = {i: plain_print(t) for i, t in texts if i is not None and t and t.split()}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(i, find(i)) for i in prints if find(i) != i}


def test_near_duplicates(spark):
    texts = list(enumerate(some_texts(7))) + [(900, None), (901, ""), (902, "  "), (None, "wört1 wört2"), (903, "x " * 50_000), (904, "x " * 50_001)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("hi", F.lit("extra")).withColumn("a", F.lit(1)).repartition(4)
    want = groups_of(texts, simhash.BUDGET)
    assert {(r.doc_id, r.near_duplicate_of) for r in simhash.near_duplicates(df).collect()} == want and len(want) > 20
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns and left.count() == len(texts) - len(want)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    clash = df.withColumns({c: F.lit(1) for c in ("_gone", "_row", "id", "lo")})
    assert simhash.drop_near_duplicates(clash).columns == clash.columns and simhash.drop_near_duplicates(clash).count() == left.count()
    with pytest.raises(ValueError):
        simhash.near_pairs(df, budget=99)
    with pytest.raises(TypeError):
        simhash.near_duplicates(df.withColumn("doc_id", F.lit("a")))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (5, 4), (4, 5), (9, 10), (10, 11), (11, 12), (12, 1), (None, 7), (20, 20)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(n, 1) for n in (1, 2, 3, 9, 10, 11, 12)} | {(4, 4), (5, 4)}
