"""Suffix-array dedup: repeated passages from merged Burrows-Wheeler transforms of shards (after Holt and McMillan, 2014; Egidi et al., 2019).

A passage of ``min_words`` words is repeated when it stands at two places of the corpus, in whatever documents. All windows of that length
are covered:

1. A window's minimiser is the smallest hash of its ``gram``-word grams. Equal windows have equal minimisers, so the corpus is cut into
   segments, runs of windows with one minimiser, and a segment whose minimiser is found nowhere else is settled. Only minimisers and places move.
2. The words of the remaining segments move to the partition of their minimiser; equal segments are merged first, with partial aggregation.
3. In a partition, each batch of segments is a shard, and its transform comes from a suffix array of its own. The shards' transforms are merged by refining their
   interleave: in round h, suffixes are put in the order of their first h words by one stable pass that moves every suffix to the bucket of the
   word before it. Boundaries that appear in round h mark a common prefix of h - 1 words. Suffixes alone between two boundaries are settled
   and dropped. What is still together after ``min_words`` rounds are the intervals of suffixes that share so many words: the repeated
   passages. No suffix is sorted again across shards.
4. A minimiser of more than ``hot`` places, as boilerplate has, is not gathered in one task: digests of its single windows are counted instead, with
   partial aggregation, which gives the same passages.
5. Passages return to all places of their segments, and overlapping ones of a document are joined.

Scale: every exchange is keyed by a minimiser, a segment or a document. Texts move once, to be joined with their segments' places. A task refines
``at_once`` words at a time, plus one minimiser's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm._frames import Tokens, mix64, quoted, text_chunks, whole_id
from callweave.session import importable

MIN_WORDS = 50
GRAM = 12
HOT = 20_000
SHARD_WORDS = 1 << 18
AT_ONCE = 1 << 21
#: Words at once when a text is searched for minimisers; longer texts are cut into pieces that share min_words - 1 words.
PIECE = 1 << 22
_PLACE_BITS = 23
_GRAM_BASE = 0x9E3779B97F4A7C15


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values, from minima over blocks of w running forwards and backwards."""
    n = len(x) - w + 1
    if w == 1:
        return x[:n]
    pad = -len(x) % w
    blocks = np.concatenate((x, np.full(pad, np.iinfo(np.int64).max))).reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[w - 1 : w - 1 + n])


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """40-bit hashes of all grams, by prefix sums of a polynomial modulo 2**64."""
    n = len(words)
    if gram not in _powers or len(_powers[gram][0]) < n:
        with np.errstate(over="ignore"):
            size = max(n, 1 << 18)
            up = np.cumprod(np.full(size, _GRAM_BASE, dtype=np.uint64))
            down = np.cumprod(np.full(size, pow(_GRAM_BASE, -1, 1 << 64), dtype=np.uint64))
        _powers[gram] = up, down
    up, down = _powers[gram]
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix64(words) * up[:n])))
        h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    return (mix64(h) >> np.uint64(24)).astype(np.int64)


def segments(words: np.ndarray, offsets: np.ndarray, min_words: int, gram: int):
    """(owner, first word in its text, number of words, minimiser, 1 or 2) of all segments of a batch of texts.

    ``words`` are the hashes of all texts' words, ``offsets`` where each text begins. The last number is 2 if the minimiser occurs more than
    once in the segment, so that a passage may repeat within it.
    """
    lengths = np.diff(offsets)
    enough = np.flatnonzero(lengths >= min_words)
    none = np.zeros(0, dtype=np.int64)
    if not len(enough):
        return none, none, none, none, none
    if len(words) > PIECE:
        out = []
        for i in enough.tolist():
            own = words[offsets[i] : offsets[i + 1]]
            step = PIECE - min_words
            for at in range(0, len(own) - min_words + 1, step):
                part = own[at : at + step + min_words - 1]
                _, first, size, mini, times = segments(part, np.array([0, len(part)]), min_words, gram)
                out.append((np.full(len(first), i), first + at, size, mini, times))
        return tuple(np.concatenate(x) for x in zip(*out))
    w = min_words - gram + 1
    h = _gram_hashes(words, gram)
    place = np.arange(len(h), dtype=np.int64)
    last = (1 << _PLACE_BITS) - 1
    left = _sliding_min(h << _PLACE_BITS | place, w)
    right = _sliding_min(h << _PLACE_BITS | (last - place), w)
    # Windows that lie inside one text.
    keep = np.zeros(len(left), dtype=bool)
    span = np.zeros(len(left) + 1, dtype=np.int64)
    np.add.at(span, offsets[:-1][enough], 1)
    np.add.at(span, offsets[:-1][enough] + lengths[enough] - min_words + 1, -1)
    keep = np.cumsum(span[:-1]) > 0
    at = np.flatnonzero(keep)
    owner = np.searchsorted(offsets, at, side="right") - 1
    mini = left[at] >> _PLACE_BITS
    begins = np.flatnonzero(np.concatenate(([True], (mini[1:] != mini[:-1]) | (owner[1:] != owner[:-1]))))
    ends = np.concatenate((begins[1:], [len(at)])) - 1
    a, b = at[begins], at[ends]
    many = (left[a] & last) != last - (right[b] & last)
    return owner[begins], a - offsets[owner[begins]], b - a + min_words, mini[begins], 1 + many.astype(np.int64)


class Shard:
    """A batch of segments: the transform of its words, and for each suffix, in the shard's order, that of the suffix one word longer.

    Each segment ends with a word of its own that no other has, so no two suffixes agree beyond their segments' ends. The order covers
    ``depth`` words; suffixes equal so far stay in the order of their places.
    """

    def __init__(self, pieces: list[np.ndarray], depth: int):
        sizes = np.array([len(p) + 1 for p in pieces])
        ends = np.cumsum(sizes) - 1
        n = int(sizes.sum())
        self.text = np.empty(n, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        self.text[inside] = np.concatenate(pieces)
        self.text[ends] = -1 - np.arange(len(pieces))
        self.owner = np.repeat(np.arange(len(pieces)), sizes)
        self.start = np.repeat(ends - sizes + 1, sizes)
        rank = np.unique(self.text, return_inverse=True)[1]
        have = 1
        while have < depth:
            later = np.full(n, -1, dtype=np.int64)
            later[:-have] = rank[have:]
            later[np.arange(n) + have > np.repeat(ends, sizes)] = -1
            rank = np.unique(rank.astype(np.int64) * (n + 1) + later + 1, return_inverse=True)[1]
            have *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[self.suffixes] = np.arange(n)
        before = np.arange(n) - 1
        before[self.start == np.arange(n)] = ends
        self.bwt = self.text[before][self.suffixes]
        self.longer = place[before][self.suffixes]


def merge(shards: list[Shard], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes that share at least ``min_words`` words with another: shard, place in the shard's text, and interval number.

    Holds the interleave of the shards' orders as one list of suffixes and refines it ``min_words`` times. Common prefixes need no
    comparison of words: a boundary that first appears in round h lies between suffixes that share h - 1 words.
    """
    base = np.concatenate(([0], np.cumsum([len(s.bwt) for s in shards])))
    bwt = np.concatenate([s.bwt for s in shards])
    longer = np.concatenate([s.longer + b for s, b in zip(shards, base)])
    words, symbol = np.unique(bwt, return_inverse=True)
    ending = np.searchsorted(words, 0)  # symbols below are the segments' own ends
    symbol = symbol.astype(np.uint16 if len(words) <= 1 << 16 else np.int32)
    order = np.arange(len(bwt))
    block = np.zeros(len(bwt), dtype=np.int64)
    for _ in range(min_words):
        s = symbol[order]
        going = np.flatnonzero(s >= ending)  # a suffix that starts at a segment's end shares nothing
        to = going[np.argsort(s[going], kind="stable")]
        if not len(to):
            order, block = to, to
            break
        c, b = s[to], block[to]
        edge = np.concatenate(([True], (c[1:] != c[:-1]) | (b[1:] != b[:-1]), [True]))
        together = ~(edge[:-1] & edge[1:])
        order = longer[order[to]][together]
        block = np.cumsum(edge[:-1])[together]
        if not len(order):
            break
    shard = np.searchsorted(base, order, side="right") - 1
    suffix = np.concatenate([s.suffixes for s in shards])[order] if len(order) else order
    return shard, suffix, block


def repeated_spans(pieces: list[np.ndarray], times: np.ndarray, docs: np.ndarray, min_words: int, shard_words: int = SHARD_WORDS):
    """For distinct segments that occur ``times`` each, first in the document ``docs``: (segment, from, to, first document) of repeated words.

    Windows overlap into spans; a span's document is the smallest that has one of its windows.
    """
    shards, firsts, low = [], [], 0
    sizes = np.cumsum([len(p) for p in pieces])
    while low < len(pieces):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + shard_words, side="right")))
        shards.append(Shard(pieces[low:high], min_words))
        firsts.append(low)
        low = high
    shard, suffix, block = merge(shards, min_words)
    of = np.empty(len(shard), dtype=np.int64)
    at = np.empty(len(shard), dtype=np.int64)
    for k, s in enumerate(shards):
        own = shard == k
        of[own] = s.owner[suffix[own]] + firsts[k]
        at[own] = suffix[own] - s.start[suffix[own]]
    least = np.full(int(block.max()) + 1 if len(block) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, block, docs[of])
    first = least[block]
    # All windows of a segment that occurs more than once are repeated, whatever the transforms say.
    often = np.flatnonzero(times > 1)
    counts = np.array([len(pieces[i]) - min_words + 1 for i in often], dtype=np.int64)
    of = np.concatenate((of, np.repeat(often, counts)))
    at = np.concatenate((at, np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)))
    first = np.concatenate((first, np.repeat(docs[often], counts)))
    if not len(of):
        return of, at, at, first
    order = np.lexsort((first, at, of))
    of, at, first = of[order], at[order], first[order]
    begins = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] > at[:-1] + min_words))))
    ends = np.concatenate((begins[1:], [len(of)])) - 1
    return of[begins], at[begins], at[ends] + min_words, np.minimum.reduceat(first, begins)


def repeated_passages(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    gram: int = GRAM,
    text_col: str = "text",
    id_col: str = "doc_id",
    hot: int = HOT,
    shard_words: int = SHARD_WORDS,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """(doc_id, first_word, end_word, n_words, first_doc_id): the maximal runs of words of each document that lie in repeated passages.

    Words are numbered from 0, end_word is exclusive. ``first_doc_id`` is the smallest id of a document with one of the run's
    passages; the run is the first occurrence where it equals doc_id. A passage that occurs twice within one document is repeated too, also
    when the occurrences overlap. Texts of fewer than ``min_words`` words, null and empty ones have no passages. Rows without an id take
    no part; ids must be whole numbers. Rows equal in id and text are one document; rows with the same id and different texts are different documents, reported
    under one id. Words are compared by 31-bit hashes, all ``min_words`` of them. ``hot``, ``shard_words`` and ``at_once`` do not change the result. Other columns are never read. An empty table gives an empty table.
    """
    if not 1 <= gram <= min_words:
        raise ValueError("gram must be from 1 to min_words")
    importable(docs.sparkSession)
    text = docs[quoted(text_col)]
    # A passage of n words has 2 n - 1 characters at least.
    read = docs.where(docs[quoted(id_col)].isNotNull() & (F.length(text) >= 2 * min_words - 1))
    read = read.select(whole_id(docs, id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))

    def find(batches):
        for batch in batches:
            ids, digests, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for low, high in text_chunks(texts):
                tokens = Tokens(texts[low:high])
                owner, first, size, mini, times = segments(tokens.hashes, tokens.offsets, min_words, gram)
                who = pa.array(owner + low)
                arrays = [ids.take(who), digests.take(who), pa.array(first), pa.array(size), pa.array(mini), pa.array(times)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "digest", "first", "size", "mini", "times"])

    def words_of(batches):
        for batch in batches:
            ids, digests, texts, lists = batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3)
            for low, high in text_chunks(texts):
                tokens = Tokens(texts[low:high])
                words = tokens.hashes.astype("<u4")
                part = lists.slice(low, high - low)
                flat = part.flatten()
                owner = np.repeat(np.arange(high - low), part.value_lengths().to_numpy(zero_copy_only=False))
                first, size = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                begin = tokens.offsets[:-1][owner] + first
                hot_ones = np.flatnonzero(flat.field(3).to_numpy(zero_copy_only=False))
                whole = np.setdiff1d(np.arange(len(owner)), hot_ones)
                # A hot segment goes window by window, as digests without words.
                windows = size[hot_ones] - min_words + 1
                of = np.concatenate((whole, np.repeat(hot_ones, windows)))
                shift = np.concatenate((np.zeros(len(whole), dtype=np.int64), np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)))
                n_words = np.concatenate((size[whole], np.full(int(windows.sum()), min_words)))
                at = begin[of] + shift
                content = [words[a:b].tobytes() for a, b in zip(at.tolist(), (at + n_words).tolist())]
                keys = [hashlib.blake2b(x, digest_size=16).digest() for x in content]
                content[len(whole) :] = [None] * (len(content) - len(whole))
                who = pa.array(owner[of] + low)
                arrays = [ids.take(who), digests.take(who), pa.array(first[of] + shift), flat.field(2).take(pa.array(of)), pa.array(keys, pa.binary()), pa.array(content, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "digest", "first", "mini", "key", "words"])

    def refined(minis, keys, pieces, times, ids):
        of, a, b, first = repeated_spans(pieces, np.array(times), np.array(ids), min_words, shard_words)
        key = pa.array([keys[i] for i in of.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.array(minis)[of]), key, pa.array(a), pa.array(b), pa.array(first)], names=["mini", "key", "low", "high", "first_doc_id"])

    def refine(batches):
        """Segments come sorted by minimiser; those of one are never parted. A window of a hot one, without words, is a span if it occurs more than once."""
        have, n = tuple([] for _ in range(5)), 0
        for batch in batches:
            alone = batch.filter(pa.compute.and_(batch.column(2).is_null(), pa.compute.greater(batch.column(3), 1)))
            if alone.num_rows:
                low, high = (pa.array(np.full(alone.num_rows, x, dtype=np.int64)) for x in (0, min_words))
                yield pa.RecordBatch.from_arrays([alone.column(0), alone.column(1), low, high, alone.column(4)], names=["mini", "key", "low", "high", "first_doc_id"])
            whole = batch.filter(batch.column(2).is_valid())
            for mini, key, words, times, doc in zip(*(c.to_pylist() for c in whole.columns)):
                if n >= at_once and mini != have[0][-1]:
                    yield refined(*have)
                    have, n = tuple([] for _ in range(5)), 0
                piece = np.frombuffer(words, dtype="<u4").astype(np.int64)
                for column, value in zip(have, (mini, key, piece, times, doc)):
                    column.append(value)
                n += len(piece)
        if n:
            yield refined(*have)

    # Repeated rows can make a minimiser look repeated; the transforms, which see each document once, settle that.
    found = read.mapInArrow(find, "id long, digest long, first long, size long, mini long, times long")
    repeated = found.groupBy("mini").agg(F.sum("times").alias("n")).where("n > 1").select("mini", (F.col("n") > hot).alias("hot"))
    left = found.drop("times").join(repeated, "mini").groupBy("id", "digest").agg(F.collect_set(F.struct("first", "size", "mini", "hot")).alias("places"))
    with_text = read.dropDuplicates(["id", "digest"]).join(left, ["id", "digest"]).select("id", "digest", "text", "places")
    placed = with_text.mapInArrow(words_of, "id long, digest long, first long, mini long, key binary, words binary")

    # Words cross the network to be merged, and then to be refined; their places meet the outcome by a 128-bit key.
    merged = placed.groupBy("mini", "key", "words").agg(F.count("*").alias("times"), F.min("id").alias("doc"))
    # A minimiser's segments come together; windows of hot ones, which are counted already, go anywhere.
    home = F.when(F.col("words").isNull(), F.xxhash64("key")).otherwise(F.col("mini"))
    gathered = merged.select("mini", "key", "words", "times", "doc").repartition(home).sortWithinPartitions("mini")
    spans = gathered.mapInArrow(refine, "mini long, key binary, low long, high long, first_doc_id long")
    back = placed.drop("words").join(spans, ["mini", "key"]).select("id", "digest", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"), "first_doc_id")
    return joined_spans(back)


def joined_spans(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans (id, digest, low, high, first_doc_id) of a document become one."""
    by_start = Window.partitionBy("id", "digest").orderBy("low", "high", "first_doc_id")
    reach = F.max("high").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("new", F.when(F.coalesce(reach, F.lit(-1)) < F.col("low"), 1).otherwise(0))
    runs = starts.withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = runs.groupBy("id", "digest", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first_doc_id").alias("first_doc_id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("low").alias("first_word"), F.col("high").alias("end_word"), (F.col("high") - F.col("low")).alias("n_words"), "first_doc_id"
    )
