"""SimHash near-dedup: a self-join of 128-bit fingerprints by simultaneous traversal of a binary trie.

A fingerprint's bit is the majority vote of a mixed 128-bit hash over the distinct words of a text. Two documents are near duplicates when at
most ``budget`` of the 128 bits differ. The fingerprint is cut into six blocks; within a budget of 23 errors, some block has at most
23 // 6 = 3 of them, and one half of that block at most 3 // 2 = 1. So for each half there is one trie over the fingerprints that starts with that half
and goes on with its block: pairs of nodes go down together, their differing bits add up, and a pair is dropped as soon as it exceeds the
half's budget, or the block's. What arrives at the block's end is compared over all 128 bits, against the whole budget. The search is exact: every
pair within the budget is found, once, at the first block and half that have it.

Scale: texts never move; 24 bytes per distinct fingerprint do. Above ``leaf_size`` fingerprints the tries are cut at depth t, 10 at most, into 2**t
subtrees, and each pair of subtrees whose prefixes differ in at most 1 bit is a task of its own: a fingerprint is sent 12 * (1 + t) times, 132 at most. A
subtree of more than ``chunk_size`` fingerprints, hot or simply large, is cut into chunks, and pairs of chunks are tasks. The number of compared pairs
grows as the square of the number of distinct fingerprints, at about one in 230 of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm._frames import Tokens, checkpointed, mix64, packed, quoted, text_chunks, unpacked, whole_id
from callweave.llm.components import connected_components
from callweave.session import importable

BITS = 128
BUDGET = 23
BLOCKS = (22, 22, 21, 21, 21, 21)
STARTS = tuple(int(x) for x in np.cumsum((0, *BLOCKS[:-1])))
LEAF_SIZE = 1 << 17
CHUNK_SIZE = 1 << 20
MAX_DEPTH = min(BLOCKS) // 2
MAX_CHUNKS = 1 << 10
AT_ONCE = 1 << 20
#: Node pairs with at most so many numbers on either side are compared directly. Marks fill up rows: 5 bits that no number has, others on the right.
SMALL = 16
LEFT_MARK, RIGHT_MARK = np.uint32(0x1F << 27), np.uint32(0x1F << 22)


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low 64 bits of each text's fingerprint, and whether it has one: a text without a word has none."""
    hi, lo, has = np.zeros(len(texts), dtype=np.uint64), np.zeros(len(texts), dtype=np.uint64), np.zeros(len(texts), dtype=bool)
    for low, high in text_chunks(texts):
        tokens = Tokens(texts[low:high])
        key = np.sort(tokens.owners() << 31 | tokens.hashes)
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        owner, word = key >> 31, (key & 0x7FFFFFFF).astype(np.uint64)
        votes = np.zeros((high - low, BITS), dtype=np.int32)
        for at in range(0, len(word), 1 << 17):
            own = owner[at : at + (1 << 17)]
            w = word[at : at + (1 << 17)]
            bits = np.unpackbits(np.stack([mix64(w, 0), mix64(w, 1)], axis=1).astype(">u8").view(np.uint8), axis=1)
            # Eight byte-wide counters are added as one 64-bit number; 255 rows at most, so that no byte overflows.
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            runs = -(-np.diff(np.concatenate((first, [len(own)]))) // 255)
            of_run = np.cumsum(runs) - runs
            begin = np.repeat(first, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(of_run, runs))
            counts = np.add.reduceat(bits.view(np.uint64), begin, axis=0).view(np.uint8)
            votes[own[first]] += np.add.reduceat(counts, of_run, axis=0, dtype=np.int32)
        words = np.bincount(owner, minlength=high - low)
        packed = np.packbits(votes * 2 > words[:, None], axis=1).view(">u8").astype(np.uint64)
        hi[low:high], lo[low:high], has[low:high] = packed[:, 0], packed[:, 1], words > 0
    return hi, lo, has


def block_of(hi: np.ndarray, lo: np.ndarray, r: int) -> np.ndarray:
    """Bits of block ``r``, as numbers."""
    start, width = STARTS[r], BLOCKS[r]
    end = start + width
    if end <= 64:
        out = hi >> np.uint64(64 - end)
    elif start >= 64:
        out = lo >> np.uint64(128 - end)
    else:
        out = hi << np.uint64(end - 64) | lo >> np.uint64(128 - end)
    return (out & np.uint64((1 << width) - 1)).astype(np.int64)


def first_half(r: int, h: int) -> int:
    """Bits of half ``h`` of block ``r``."""
    return BLOCKS[r] // 2 if h == 0 else BLOCKS[r] - BLOCKS[r] // 2


def arranged(hi: np.ndarray, lo: np.ndarray, r: int, h: int) -> np.ndarray:
    """Block ``r`` with its half ``h`` in front."""
    value, width = block_of(hi, lo, r), BLOCKS[r]
    if h == 0:
        return value
    own = first_half(r, 1)
    return (value & ((1 << own) - 1)) << (width - own) | value >> own


class Trie:
    """Binary trie of distinct numbers of ``width`` bits, level by level: children's positions, and how many numbers lie below a node."""

    def __init__(self, values: np.ndarray, width: int):
        self.values, self.width = values, width
        self.padded = np.concatenate((values, np.zeros(SMALL, dtype=values.dtype))).astype(np.uint32)
        self.zero, self.one, self.below, self.first = [], [], [], []
        nodes = np.unique(values >> width)
        for depth in range(width + 1):
            prefix = values >> (width - depth)
            edge = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            self.first.append(edge.astype(np.int32))
            self.below.append(np.diff(np.concatenate((edge, [len(values)]))).astype(np.int32))
            here = prefix[edge]
            if depth:
                parent = np.searchsorted(nodes, here >> 1)
                for bit, into in ((0, self.zero), (1, self.one)):
                    child = np.full(len(nodes), -1, dtype=np.int32)
                    of = np.flatnonzero(here & 1 == bit)
                    child[parent[of]] = of
                    into.append(child)
            nodes = here

    def pairs(self, start: list[tuple[int, int, int, int]], budget: int, half: int = 0, half_budget: int = 0):
        """Positions (u, v) of numbers that differ in at most ``budget`` bits, and ``half_budget`` of the first ``half``, from the node pairs (depth, i, j, errors)."""
        stack = [(d, np.array([i], dtype=np.int32), np.array([j], dtype=np.int32), np.array([e], dtype=np.int8)) for d, i, j, e in start]
        while stack:
            depth, i, j, e = stack.pop()
            if len(i) > AT_ONCE:
                stack += [(depth, i[k : k + AT_ONCE], j[k : k + AT_ONCE], e[k : k + AT_ONCE]) for k in range(0, len(i), AT_ONCE)]
                continue
            small = (self.below[depth][i] <= SMALL) & (self.below[depth][j] <= SMALL)
            if small.any():
                for u, v in self._direct(depth, i[small], j[small], budget):
                    near = np.bitwise_count((self.padded[u] ^ self.padded[v]) >> np.uint32(self.width - half)) <= half_budget
                    yield u[near], v[near]
                i, j, e = i[~small], j[~small], e[~small]
            if not len(i):
                continue
            zero, one = self.zero[depth], self.one[depth]
            zi, oi, zj, oj = zero[i], one[i], zero[j], one[j]
            across = e < (half_budget if depth < half else budget)
            mixed = across & (i != j)
            new_i = np.concatenate((zi, oi, zi[across], oi[mixed]))
            new_j = np.concatenate((zj, oj, oj[across], zj[mixed]))
            new_e = np.concatenate((e, e, e[across] + 1, e[mixed] + 1)).astype(np.int8)
            there = (new_i >= 0) & (new_j >= 0)
            if there.any():
                stack.append((depth + 1, new_i[there], new_j[there], new_e[there]))


    def _direct(self, depth: int, i: np.ndarray, j: np.ndarray, budget: int):
        """All pairs of numbers below the node pairs, by comparing SMALL x SMALL at once."""
        first, below, across = self.first[depth], self.below[depth], np.arange(SMALL, dtype=np.int32)
        for at in range(0, len(i), AT_ONCE >> 8):
            ii, jj = i[at : at + (AT_ONCE >> 8)], j[at : at + (AT_ONCE >> 8)]
            u, v = first[ii][:, None] + across, first[jj][:, None] + across
            left = np.where(across < below[ii][:, None], self.padded[u], LEFT_MARK)
            right = np.where(across < below[jj][:, None], self.padded[v], RIGHT_MARK)
            pair, x, y = np.nonzero(np.bitwise_count(left[:, :, None] ^ right[:, None, :]) <= budget)
            uu, vv = u[pair, x], v[pair, y]
            once = (ii[pair] != jj[pair]) | (uu <= vv)
            yield uu[once], vv[once]


def search(hi: np.ndarray, lo: np.ndarray, r: int, h: int, budget: int, prefix: tuple[int, int, int] | None = None):
    """Positions (a, b) and distance of all pairs within ``budget`` whose first block within its share of the budget is ``r``, and first half ``h``.

    ``prefix`` (t, p, q) limits the search to pairs of a fingerprint whose arranged block starts with the t bits of p and one that starts with q.
    """
    share, width, half = budget // len(BLOCKS), BLOCKS[r], first_half(r, h)
    block = arranged(hi, lo, r, h)
    order = np.argsort(block, kind="stable")
    values, first, size = np.unique(block[order], return_index=True, return_counts=True)
    if not len(values):
        return
    trie = Trie(values, width)
    start = [(0, 0, 0, 0)]
    if prefix and prefix[0]:
        t, p, q = prefix
        nodes = values[trie.first[t]] >> (width - t)
        i, j = np.searchsorted(nodes, p), np.searchsorted(nodes, q)
        if i == len(nodes) or j == len(nodes) or nodes[i] != p or nodes[j] != q:
            return
        start = [(t, int(i), int(j), (p ^ q).bit_count())]
    for u, v in trie.pairs(start, share, half, share // 2):
        many = size[u] * size[v]
        low = 0
        ends = np.cumsum(many)
        while low < len(u):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, side="right")))
            uu, vv, n = u[low:high], v[low:high], many[low:high]
            low = high
            for of_u, of_v, within in _products(uu, vv, n, size):
                a, b = order[first[of_u] + within // size[of_v]], order[first[of_v] + within % size[of_v]]
                fine = (of_u != of_v) | (a < b)
                a, b = a[fine], b[fine]
                far = np.bitwise_count(hi[a] ^ hi[b]).astype(np.int64) + np.bitwise_count(lo[a] ^ lo[b])
                near = far <= budget
                a, b, far = a[near], b[near], far[near]
                for earlier in range(r):
                    later = np.bitwise_count(block_of(hi[a], lo[a], earlier) ^ block_of(hi[b], lo[b], earlier)) > share
                    a, b, far = a[later], b[later], far[later]
                if h == 1:  # the other half is now behind
                    behind = np.uint64((1 << (width - half)) - 1)
                    later = np.bitwise_count((block[a] ^ block[b]).astype(np.uint64) & behind) > share // 2
                    a, b, far = a[later], b[later], far[later]
                if len(a):
                    yield a, b, far


def _products(u: np.ndarray, v: np.ndarray, n: np.ndarray, size: np.ndarray):
    """All member pairs of the leaf pairs (u, v), in portions of about AT_ONCE; a single large product is cut as well."""
    if len(u) == 1 and n[0] > AT_ONCE:
        for at in range(0, int(n[0]), AT_ONCE):
            within = np.arange(at, min(int(n[0]), at + AT_ONCE))
            yield np.broadcast_to(u, within.shape), np.broadcast_to(v, within.shape), within
        return
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    yield np.repeat(u, n), np.repeat(v, n), within


def with_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, hi, lo) of every document that has an id and a word."""
    importable(docs.sparkSession)

    def run(batches):
        for batch in batches:
            hi, lo, has = fingerprints(batch.column(1).to_pylist())
            keep = pa.array(has)
            arrays = [batch.column(0), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))]
            yield pa.RecordBatch.from_arrays([a.filter(keep) for a in arrays], names=["id", "hi", "lo"])

    read = docs.where(docs[quoted(id_col)].isNotNull()).select(whole_id(docs, id_col), docs[quoted(text_col)])
    return read.mapInArrow(run, "id long, hi long, lo long")


def near_pairs(distinct: DataFrame, budget: int = BUDGET, leaf_size: int = LEAF_SIZE, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """(a, b, hamming) for every pair of the fingerprints (rep, hi, lo) within ``budget``; a and b are the reps. The sizes do not change the result."""
    if not 0 <= budget < 5 * len(BLOCKS):
        raise ValueError(f"budget must be from 0 to {5 * len(BLOCKS) - 1}")
    half_share = budget // len(BLOCKS) // 2
    t = min(MAX_DEPTH, max(0, (-(-distinct.count() // leaf_size) - 1).bit_length()))
    masks = [m for m in range(1 << t) if m.bit_count() <= half_share]
    tries = [(r, h) for r in range(len(BLOCKS)) for h in (0, 1)]

    def prefixes(hi, lo, k):
        r, h = tries[k]
        return arranged(hi, lo, r, h) >> (BLOCKS[r] - t)

    def sizes(batches):
        have = np.zeros((len(tries), 1 << t), dtype=np.int64)
        for batch in batches:
            hi, lo = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1))
            for k in range(len(tries)):
                have[k] += np.bincount(prefixes(hi, lo, k), minlength=1 << t)
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(have.ravel()[at])], names=["subtree", "n"])

    counted = distinct.select("hi", "lo").mapInArrow(sizes, "subtree long, n long").groupBy("subtree").agg(F.sum("n").alias("n"))
    chunks = np.ones((len(tries), 1 << t), dtype=np.int64)
    for row in counted.where(F.col("n") > chunk_size).collect():  # 12 * 2**10 subtrees at most
        chunks.ravel()[row.subtree] = min(MAX_CHUNKS, -(-row.n // chunk_size))

    def salts(rep, k, p):
        return (mix64(rep) % chunks[k][p].astype(np.uint64)).astype(np.int64)

    def route(batches):
        for batch in batches:
            rep, hi, lo = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1, 2))
            for k in range(len(tries)):
                p = prefixes(hi, lo, k)
                salt = salts(rep, k, p)
                for m in masks:
                    q = p ^ m
                    copies = chunks[k][q]
                    row = np.repeat(np.arange(len(p)), copies)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                    own, p_, q_ = salt[row], p[row], q[row]
                    ahead = (own <= other) if m == 0 else (p_ < q_)
                    i, j = np.where(ahead, own, other), np.where(ahead, other, own)
                    subtrees = (k << t | np.minimum(p_, q_)) << t | np.maximum(p_, q_)
                    group = (subtrees * MAX_CHUNKS + i) * MAX_CHUNKS + j
                    yield pa.RecordBatch.from_arrays([pa.array(group), *(c.take(pa.array(row)) for c in batch.columns)], names=["grp", "rep", "hi", "lo"])

    def join(key, table):
        subtrees, i, j = key[0].as_py() // MAX_CHUNKS**2, key[0].as_py() // MAX_CHUNKS % MAX_CHUNKS, key[0].as_py() % MAX_CHUNKS
        rep, hi, lo = (table.column(c).to_numpy() for c in ("rep", "hi", "lo"))
        side = (1 << t) - 1
        k, p, q = subtrees >> 2 * t, subtrees >> t & side, subtrees & side
        salt = salts(rep.view(np.uint64), k, np.full(len(rep), p)) if p == q and i != j else None
        parts = []
        for a, b, far in search(hi.view(np.uint64), lo.view(np.uint64), *tries[k], budget, (t, p, q)):
            if salt is not None:  # pairs within a chunk are found where the chunk meets itself
                across = salt[a] != salt[b]
                a, b, far = a[across], b[across], far[across]
            parts.append((rep[a], rep[b], far))
        a, b, far = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64),) * 3
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "hamming": pa.array(far, pa.int64())})

    routed = distinct.select("rep", "hi", "lo").mapInArrow(route, "grp long, rep long, hi long, lo long")
    groups = int((len(tries) * (1 + len(masks)) << t) // 2)
    # A group's work grows faster than its bytes: a number of partitions that adaptive execution does not lower.
    return routed.repartition(min(4096, max(8, groups)), "grp").groupBy("grp").applyInArrow(join, "a long, b long, hamming long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, text_col: str = "text", id_col: str = "doc_id", leaf_size: int = LEAF_SIZE) -> DataFrame:
    """(doc_id, near_duplicate_of): each document that has a smaller id in its group of near duplicates, with the group's smallest id.

    Groups are the connected components of the relation "at most ``budget`` of 128 bits differ". Null, empty and blank texts and rows
    without an id have no fingerprint and are in no group. Rows that share an id are one document, which has the fingerprints of all its
    rows. Ids must be whole numbers. Equal texts differ in 0 bits. An empty table gives an empty table. Other columns are never read.
    """
    prints = checkpointed(with_fingerprints(docs, text_col, id_col))
    distinct = prints.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    equal = prints.join(distinct, ["hi", "lo"]).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    edges = near_pairs(distinct, budget, leaf_size).select("a", "b").union(equal)
    found = connected_components(edges).where("node <> component")
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("near_duplicate_of"))


def drop_near_duplicates(docs: DataFrame, budget: int = BUDGET, text_col: str = "text", id_col: str = "doc_id", leaf_size: int = LEAF_SIZE) -> DataFrame:
    """The documents without those that near_duplicates() names: of each group the smallest id stays, with all its rows and columns, whatever their names."""
    gone = near_duplicates(docs, budget, text_col, id_col, leaf_size).select("doc_id")
    return unpacked(packed(docs, doc_id=whole_id(docs, id_col)).join(gone, "doc_id", "left_anti"))
