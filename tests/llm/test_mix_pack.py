"""Mixing against a plain apportionment, packing by its invariants and against the best packing of small cases."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import mixing, packing


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def sainte_lague(weights, has, seats):
    """Seats by highest quotients, one at a time; ties to the smaller name."""
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        open_ = [k for k in weights if weights[k] > 0 and got[k] < has[k]]
        if not open_:
            break
        got[min(open_, key=lambda k: (-weights[k] / (2 * got[k] + 1), k))] += 1
    return got


DOCS = "doc_id long, text string, source string, unit string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "x" * (40 * (1 + i % 7)), "abc"[i % 3] if i % 11 else None, "u") for i in range(300)]
    rows += [(1000, None, "a", "u"), (1001, "", "b", "u"), (None, "some text", "c", "u"), (None, None, None, "u"), (5, "again", "a", "u"), (2000, "y" * 100_000, "b", "u")]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


def plain_quotas(weights, has, short):
    """Seats one at a time; a source without a block left is closed, until the closed ones hold more than ``short`` of all weight."""
    quota = {s: 0 for s, w in weights.items() if w > 0}
    open_, gone, whole = set(quota), 0.0, sum(w for w in weights.values() if w > 0)
    while open_:
        k = min(open_, key=lambda k: (-weights[k] / (2 * quota[k] + 1), k))
        if quota[k] < has[k]:
            quota[k] += 1
            continue
        gone += weights[k]
        if gone > short * whole:
            break
        open_.remove(k)
    return quota


def plain_plan(docs, weights, others, n_blocks, n_shards, short):
    """The plan by loops: units, blocks, seats one at a time."""
    rows = docs.collect()
    units = {}
    for r in rows:
        unit = f"i{r.doc_id}" if r.doc_id is not None else f"t{md5(r.text)}" if r.text is not None else "n"
        source, tokens = units.get(unit, (None, 0))
        own = r.source or ""
        units[unit] = (own if source is None else min(source, own), tokens + -(-len((r.text or "").encode()) // 4))
    size = max(1, -(-sum(t for _, t in units.values()) // n_blocks))
    groups = {}
    for unit, (source, tokens) in units.items():
        place = md5(f"{mixing.SEED}|{unit}")
        groups.setdefault((source, int(place[:8], 16) % n_shards), []).append((place, unit, tokens))
    blocks, seats = {}, {}
    for key, members in groups.items():
        at = 0
        for _, unit, tokens in sorted(members):
            blocks.setdefault((*key, at // size), []).append(unit)
            at += tokens
        own = sorted(b for s, h, b in blocks if (s, h) == key)
        for b, after in zip(own, [*own[1:], max(own[-1] + 1, -(-at // size))]):
            seats[(*key, b)] = after - b
    has = Counter()
    for (s, h, b), n in seats.items():
        has[s] += n
    quota = plain_quotas({s: (weights or {}).get(s, others) for s in has}, has, short)
    taken = set()
    for s, n in quota.items():
        there = {h: sum(m for (a, c, _), m in seats.items() if (a, c) == (s, h)) for a, h in groups if a == s}
        for h, q in sainte_lague(there, there, n).items():
            at, chance = 0, (int(md5(f"{mixing.SEED}|{h}|{s}")[:8], 16) + 1) / 2**32
            for key in sorted((k for k in seats if k[:2] == (s, h)), key=lambda k: (md5(f"{mixing.SEED}|{s}|{h}|{k[2]}"), k[2])):
                if at + seats[key] * chance <= q:
                    taken.add(key)
                at += seats[key]
    return {(unit, *key) for key in taken for unit in blocks[key]}, quota, size, {u: t for u, (_, t) in units.items()}


@pytest.mark.parametrize("weights,others", [(None, 1), ({"a": 3, "b": 1.5, "": 0.5}, 0), ({"c": 1}, 0), ({"a": 0.1, "b": 0.1, "c": 0.3}, 0.1), (None, 0)])
@pytest.mark.parametrize("short", [0.0, 0.3])
def test_plan_against_loops(spark, docs, weights, others, short):
    params = {"n_blocks": 2000, "n_shards": 3, "short": short}
    plan = mixing.mixing_plan(docs, weights, others, **params).collect()
    want, quota, _, _ = plain_plan(docs, weights, others, **params)
    assert {(r.unit, r.source, r.shard, r.block) for r in plan} == want and len(plan) == len(want)
    assert bool(want) == (others > 0 or weights is not None)
    assert mixing.mixing_plan(docs.limit(0), weights, others).count() == 0


@pytest.mark.parametrize("weights", [None, {"hot": 1.0, "b": 2.0, "c": 1.5}, {"hot": 5.0}])
def test_targets_are_met(spark, weights):
    """A hot source takes no seats of those that run out, and long documents count all their tokens: shares are the target's, at a cost of some tokens."""
    rng = np.random.default_rng(5)
    rows = [(i, "x" * int(40 * rng.choice([1, 2, 5, 60])), "hot" if i % 2 else "bcd"[i // 2 % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = mixing.mixing_plan(docs, weights)
    shares = {r.source: r for r in mixing.mixing_shares(docs, plan, weights).collect()}
    assert len(shares) == 4 and all(abs(r.target - r.reached) < 0.04 for r in shares.values())
    assert any(r.tokens > 0.9 * r.of_tokens for r in shares.values())
    assert abs(sum(r.reached for r in shares.values()) - 1) < 1e-9


@pytest.mark.parametrize("seed,listed", [(0, 100), (1, 100), (2, 100), (3, 3), (4, 3), (5, 1), (6, 1)])
def test_closed_form_of_quotas(spark, seed, listed, monkeypatch):
    """Whether sources are listed at once or narrowed down by bins first."""
    monkeypatch.setattr(mixing, "LISTED", listed)
    rng = np.random.default_rng(seed)
    rows = [(f"s{i:02}", float(rng.choice([0.0, 0.25, 0.5, 1, 2, 3])), int(rng.integers(1, 60))) for i in range(25)]
    weight, has = {s: w for s, w, _ in rows}, {s: n for s, _, n in rows}
    for short in (0.0, 0.1, 0.4):
        got = {r.source: r.quota for r in mixing.source_quotas(spark.createDataFrame(rows, "source string, weight double, has long"), short).collect()}
        assert got == {k: v for k, v in plain_quotas(weight, has, short).items() if v}


def test_tiny_source_does_not_bound_the_rest(spark):
    rows = [(i, "x" * 400, f"s{i % 20}") for i in range(2000)] + [(9999, "x", None)]
    plan = mixing.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert plan.count() > 1900


def test_mix_sources(spark, docs):
    kept = mixing.mix_sources(docs, {"a": 2.0}, n_blocks=600, n_shards=3)
    plan = {r.unit for r in mixing.mixing_plan(docs, {"a": 2.0}, n_blocks=600, n_shards=3).collect()}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(r.doc_id for r in docs.collect() if f"i{r.doc_id}" in plan)
    assert sorted(map(str, kept.collect())) == sorted(map(str, mixing.mix_sources(docs.repartition(3), {"a": 2.0}, n_blocks=600, n_shards=3).collect()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    words = docs.select(F.concat(F.lit("doc-"), "doc_id").alias("doc_id"), "text", "source", *[F.lit(1).alias(c) for c in ("_unit", "unit_", "_row", "shard", "tokens")])
    assert mixing.mix_sources(words, {"a": 2.0}).columns == words.columns and mixing.mix_sources(words, {"a": 2.0}).count() > 0


def test_texts_are_not_sorted_to_be_taken(spark, docs):
    """Pages of sorted texts in every task took an executor's memory: selected ids are hashed, and texts pass by them."""
    plan = mixing.mix_sources(docs, {"a": 2.0}, n_blocks=600, n_shards=3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ShuffledHashJoin .*LeftSemi, BuildRight", plan) and not re.search(r"SortMergeJoin .*LeftSemi", plan)


def test_best_fit():
    bins, starts = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and starts.tolist() == [0, 0, 6, 5, 8]


def best(lengths, capacity):
    """The fewest bins, by trying every assignment."""
    for n in range(1, len(lengths) + 1):
        for where in itertools.product(range(n), repeat=len(lengths)):
            if all(sum(x for x, w in zip(lengths, where) if w == b) <= capacity for b in range(n)):
                return n
    return 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(40):
        capacity = int(rng.integers(5, 40))
        lengths = np.sort(rng.integers(1, capacity + 1, size=int(rng.integers(1, 7))))[::-1]
        bound = packing.lower_bound(packing.dff_values(lengths.astype(np.int64), np.ones(len(lengths), dtype=np.int64), capacity), capacity)
        assert bound <= best(lengths.tolist(), capacity) <= packing.best_fit_decreasing(lengths, capacity)[0].max() + 1


def test_pack(spark, docs):
    rows = packing.pack(docs, capacity=100, per_partition=40).collect()
    tokens = Counter()
    for r in docs.collect():
        if r.text:
            tokens[r.doc_id] += -(-len(r.text.encode()) // 4)
    got = Counter()
    bins = {}
    for r in rows:
        got[r.doc_id] += r.n_tokens
        bins.setdefault(r.bin_id, []).append((r.start, r.n_tokens))
    assert got == tokens
    for parts in bins.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 100
    bound = -(-sum(tokens.values()) // 100)
    assert bound <= len(bins) <= bound * 1.05 + 1
    again = packing.pack(docs.repartition(7), capacity=100, per_partition=40).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(docs.withColumn("bin", F.lit(1)).withColumn("grp", F.lit(1)), capacity=100).agg(F.sum("n_tokens")).first()[0] == sum(tokens.values())


@pytest.mark.parametrize("low,high,n,per_partition", [(20, 70, 600, 40), (25, 52, 900, 64), (30, 60, 1500, 100)])
def test_exchange(spark, low, high, n, per_partition):
    """Partitions with a gap exchange pieces, over several rounds: nothing is lost, bins hold, ids above 2**53 and rows without one come back as they were."""
    rng = np.random.default_rng(high)
    rows = [(2**60 + 2 * i + 1 if i % 9 else None, "x" * 4 * int(n)) for i, n in enumerate(rng.integers(low, high, size=n))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = packing.pack(df, capacity=100, per_partition=per_partition).collect()
    assert any(int(r.bin_id.split("-")[0]) >= 1 << 40 for r in out)
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((i, len(t) // 4) for i, t in rows)
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append((r.start, r.n_tokens))
    for parts in bins.values():
        at = 0
        for start, tokens in sorted(parts):
            assert start == at
            at += tokens
        assert at <= 100
    lengths = np.array(sorted((len(t) // 4 for _, t in rows), reverse=True))
    bound = packing.lower_bound(packing.dff_values(lengths, np.ones(len(lengths), dtype=np.int64), 100), 100)
    alone = packing.best_fit_decreasing(lengths, 100)[0].max() + 1
    spread = len({r.bin_id for r in packing.pack(df, capacity=100, per_partition=10**6).collect()})
    assert bound <= spread == alone and bound <= len(bins) <= alone * 1.05 + 2
    # The full bins of a partition are certified when the pool that it joined is.
    pools = {(p - (1 << 40), r.certified) for r in out if (p := int(r.bin_id.split("-")[0])) >> 40 == 1}
    assert all(r.certified for g, met in pools if met for r in out if int(r.bin_id.split("-")[0]) // packing.FAN_IN == g)


def test_pool_is_bounded():
    """Of many bins with slack, the emptiest of ``share`` pieces move."""
    import pandas as pd

    pieces = pd.DataFrame({"doc_id": range(50), "no_id": False, "piece": 0, "n_tokens": [60 + i % 7 for i in range(50)]})
    out = packing._packed(pieces, 100, 12)
    assert out["open"].sum() == 12 and out.loc[out["open"], "n_tokens"].max() <= out.loc[~out["open"], "n_tokens"].min()
