"""Repeated passages against brute force over every window."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.llm.suffix_dedup import repeated_passages, repeated_spans


def brute(rows, n):
    """All maximal runs of windows of n words that stand at two places; rows equal in id and text are one document."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=str)
    places = {}
    for d, (i, t) in enumerate(docs):
        w = t.split()
        for k in range(len(w) - n + 1):
            places.setdefault(tuple(w[k : k + n]), []).append((d, k))
    out = set()
    for d, (i, t) in enumerate(docs):
        hits = sorted((k, min(docs[e][0] for e, _ in at)) for at in places.values() if len(at) > 1 for e, k in at if e == d)
        run = None
        for k, first in hits:
            if run and k <= run[1]:
                run = (run[0], k + n, min(run[2], first))
            else:
                if run:
                    out.add((i, *run))
                run = (k, k + n, first)
        if run:
            out.add((i, *run))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.first_word, r.end_word, r.first_doc_id) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    passages = [" ".join(rng.choices(words, k=rng.randint(5, 14))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(3)]
        rows.append((i, " ".join([parts[0], rng.choice(passages), parts[1], rng.choice(passages), parts[2]])))
    rows += rows[:5] + [(3, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 6)
    assert result(repeated_passages(df, min_words=6, gram=2)) == want
    assert result(repeated_passages(df, min_words=6, gram=2, shard_words=40, at_once=200)) == want
    for hot in (0, 3, 8):
        assert result(repeated_passages(df, min_words=6, gram=2, hot=hot)) == want


def spans_of(pieces, n, **params):
    times, docs = np.ones(len(pieces), dtype=np.int64), np.arange(len(pieces))
    return sorted(zip(*(x.tolist() for x in repeated_spans([np.array(p, dtype=np.int64) for p in pieces], times, docs, n, **params))))


@pytest.mark.parametrize("n", [3, 5])
def test_shared_heads(n):
    """Two segments that share their first k words and nothing else, for every k, in one shard or several."""
    for k in range(2 * n + 2):
        for more in range(n + 2):
            head = list(range(100, 100 + k))
            pieces = [head + [1000 + i * 50 + j for j in range(more)] for i in range(3)]
            pieces = [p for p in pieces if len(p) >= n]
            want = [(i, 0, k, 0) for i in range(len(pieces))] if k >= n and len(pieces) > 1 else []
            if pieces:
                assert spans_of(pieces, n) == want and spans_of(pieces, n, shard_words=1) == want


@given(st.lists(st.lists(st.integers(1, 4), min_size=4, max_size=14), min_size=1, max_size=9), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_merged_shards_equal_windows(pieces, shard_words):
    pieces = [list(x) for x in dict.fromkeys(map(tuple, pieces))]
    places = {}
    for i, p in enumerate(pieces):
        for k in range(len(p) - 3):
            places.setdefault(tuple(p[k : k + 4]), []).append((i, k))
    words = {(i, k + j) for at in places.values() if len(at) > 1 for i, k in at for j in range(4)}
    assert {(i, k) for i, a, b, _ in spans_of(pieces, 4, shard_words=shard_words) for k in range(a, b)} == words


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (None, long), (4, long), (5, "a b"), (4, long), (7, " ".join(["a"] * 8))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mini", F.lit(1)).withColumn("key", F.lit("x"))
    assert result(repeated_passages(df, min_words=6, gram=2)) == [(7, 0, 8, 7)]
    rows.append((9, "begin " + long + " end"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(repeated_passages(df, min_words=6, gram=2)) == [(4, 0, 5000, 4), (7, 0, 8, 7), (9, 1, 5001, 4)]
    assert repeated_passages(df.limit(0), min_words=6, gram=2).count() == 0
    with pytest.raises(ValueError):
        repeated_passages(df, min_words=3, gram=4)
