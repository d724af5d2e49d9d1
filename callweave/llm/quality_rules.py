"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over ``buckets`` hashed word 1- and 2-grams are counted: one from trusted (labelled good) documents, one from every
document. The target is mixed with the raw one, at a share of ``mix``, so that an n-gram that no trusted document has weighs log(mix), whatever the size of
the sample. A document's score is the sum over its n-grams of the log ratio of the two, divided by the number of n-grams. Weights are
whole micro-nats, so that sums do not depend on their order.

A trusted document's own n-grams are left out of the target for its score, which so is distributed as that of any document like it. The threshold is
the ``held_out`` quantile of these scores: that share of trusted documents is rejected, and about as many of all documents like them, at any size.

Scale: every trusted document counts, however many there are. Ids of trusted rows stay distributed; a filter of at most FILTER_BITS bits, which lets through all
of them and few others, goes to every task. Only texts that pass it are shuffled, twice, to meet the ids, and of the result only rows that pass it and whose
outcome hangs on the answer; the rest of the corpus is read and not moved. When trusted ids outgrow the filter, more rows are shuffled and the result is the same.
Else what moves is at most ``buckets`` counts per partition and a score per trusted id; the counts that go to every task have ``buckets`` entries at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.llm._frames import PRIME, Tokens, checkpointed, free_name, mix64, quoted, text_chunks, whole_id, with_fields
from callweave.session import importable

BUCKETS = 65_536
#: The SQL below follows up to so many trusted ids; the operator has no such bound.
MAX_TRUSTED = 20_000
#: Bits of the filter of trusted ids: FILTER_BITS_PER_ID for each, within these bounds.
FILTER_BITS = (1 << 16, 1 << 26)
FILTER_BITS_PER_ID = 16
FILTER_HASHES = 3
#: So many scores at once are looked at on the driver, and so many bins of them.
LISTED = 10_000
BINS = 1024
MIX = 0.5
HELD_OUT = 0.01
MICRO = 1_000_000


def gram_buckets(tokens: Tokens, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each 1-gram, and of each 2-gram with the owner of its first word (2-grams never cross texts)."""
    h = tokens.hashes
    owner = tokens.owners()
    inside = owner[1:] == owner[:-1]
    pair = (h[:-1] * 1_000_033 + h[1:] * 7 + 1) % PRIME
    grams = np.concatenate([h % buckets, pair[inside] % buckets])
    return grams, np.concatenate([owner, owner[:-1][inside]])


def weights_of(raw: np.ndarray, target: np.ndarray, target_all: int, raw_all: int, mix: float = MIX) -> np.ndarray:
    """Log ratio of the mixed target multinomial to the raw one, in whole micro-nats; buckets that the corpus does not use weigh 0."""
    there = raw > 0
    q = np.where(there, raw, 1) / max(raw_all, 1)
    p = (1 - mix) * (target / max(target_all, 1)) + mix * q
    return np.where(there, np.round(np.log(p / q) * MICRO), 0).astype(np.int64)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled of good quality and not toxic: all of them, each once."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").cast("long").alias("id")).distinct()


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter's bits of each id, by FILTER_HASHES hashes."""
    return [(mix64(ids.view(np.uint64), seed) % np.uint64(bits)).astype(np.int64) for seed in range(FILTER_HASHES)]


def id_filter(trusted: DataFrame) -> np.ndarray:
    """Words of 64 bits in which all bits of every trusted id are set; without trusted ids there are no words."""
    n = trusted.count()
    bits = min(max(1 << (FILTER_BITS_PER_ID * n - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1]) if n else 0

    def mark(batches):
        words = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words.view(np.int64)[used])], names=["word", "bits"])

    words = np.zeros(bits // 64, dtype=np.int64)
    if n:
        marked = trusted.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
        words[marked.column("word").to_numpy()] = marked.column("bits").to_numpy()
    return words.view(np.uint64)


def _may_be(ids: pa.Array, words: np.ndarray) -> np.ndarray:
    """Whether an id may be trusted: true of every trusted one, and of few others."""
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    if not len(words):
        return np.zeros(len(ids), dtype=bool)
    for at in _places(ids.fill_null(0).to_numpy(zero_copy_only=False), len(words) * 64):
        there = there & (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return there


def trusted_rows(docs: DataFrame, trusted: DataFrame, words: np.ndarray, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, text) of every row with a trusted id. Rows that the filter rules out are not shuffled; ids are hashed, so that texts need no sorting."""
    importable(docs.sparkSession)

    def sift(batches):
        for batch in batches:
            yield batch.filter(pa.array(_may_be(batch.column(0), words)))

    read = docs.select(whole_id(docs, id_col).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return read.mapInArrow(sift, "id long, text string").join(trusted.hint("shuffle_hash"), "id", "left_semi")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in a table of one column of texts."""
    importable(texts.sparkSession)

    def count(batches):
        have = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            values = batch.column(0).to_pylist()
            for low, high in text_chunks(values):
                have += np.bincount(gram_buckets(Tokens(values[low:high]), buckets)[0], minlength=buckets)
        used = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(have[used])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows at any input size
        out[r.bucket] = r.n
    return out


def own_left_out(grams: np.ndarray, raw: np.ndarray, target: np.ndarray, mix: float = MIX) -> int:
    """A trusted document's sum of weights, with its own n-grams left out of the target."""
    used, n = np.unique(grams, return_counts=True)
    return int((weights_of(raw[used], target[used] - n, int(target.sum() - n.sum()), int(raw.sum()), mix) * n).sum())


def nth_smallest(scores: DataFrame, n: int) -> float:
    """The ``score`` that ``n`` others come before. Bins of scores, BINS at a time, are counted until the one that holds it has at most LISTED."""
    low, high, have = scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
    within = scores
    while low < high and have > LISTED:
        step = (high - low) / BINS
        bins = within.groupBy(F.least(F.lit(BINS - 1), F.floor((F.col("score") - low) / step)).alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for row in sorted(bins.collect(), key=lambda r: r.bin):
            if n < row.n:
                low, high, have = row.low, row.high, row.n
                break
            n -= row.n
        within = scores.where((F.col("score") >= low) & (F.col("score") <= high))
    return low if low == high else sorted(r.score for r in within.collect())[n]


def held_out_threshold(rows: DataFrame, raw: np.ndarray, target: np.ndarray, share: float, mix: float = MIX) -> float:
    """The ``share`` quantile of the held-out scores of all trusted ``rows`` (id, text), an id's lowest counting; without any, every score passes."""

    def score(batches):
        for batch in batches:
            ids, values = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams, _ = gram_buckets(Tokens([text.as_py()]), len(raw))
                if len(grams):
                    ids.append(i)
                    values.append(own_left_out(grams, raw, target, mix) / len(grams) / MICRO)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.float64())], names=["id", "score"])

    scores = checkpointed(rows.mapInArrow(score, "id long, score double").groupBy("id").agg(F.min("score").alias("score")))
    n = scores.count()
    return nth_smallest(scores, int(share * (n - 1))) if n else -np.inf


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    mix: float = MIX,
    held_out: float = HELD_OUT,
    threshold: float | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    score: bool = True,
) -> DataFrame:
    """The documents whose length-normalised log ratio reaches the threshold, with every input column; others go. A score equal to it stays.

    ``threshold`` takes the place of the ``held_out`` quantile. ``score`` adds llr_micro (sum of weights), n_grams and quality_score (llr_micro / n_grams
    / 1e6); a name that the input has already gets an underscore appended. Null, empty and blank texts have no n-gram, hence no evidence of
    quality: they are rejected. Equal texts get equal scores, so repeated rows share their fate; but a trusted document's score is the held-out
    one, also where an equal text that is not trusted has a higher one. Ids must be whole numbers. A null id is scored like any other and never trusted. Without trusted
    rows every document with a token passes. An empty table gives an empty table.
    """
    text = docs.select(F.col(quoted(text_col)))
    trusted = checkpointed(trusted_ids(labels))
    words = id_filter(trusted)
    rows = trusted_rows(docs, trusted, words, text_col, id_col)  # also refuses ids that are not whole numbers
    raw = bucket_counts(text, buckets)
    target = bucket_counts(rows.select("text"), buckets) if len(words) else np.zeros(buckets, dtype=np.int64)
    weights = weights_of(raw, target, int(target.sum()), int(raw.sum()), mix) if target.sum() else np.zeros(buckets, dtype=np.int64)
    if threshold is None:
        threshold = held_out_threshold(rows, raw, target, held_out, mix) if len(words) else -np.inf
    names = []
    for wanted in ("llr_micro", "n_grams", "quality_score"):
        names.append(free_name(wanted, docs.columns + names))
    at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)

    def judge(batches, asked: bool):
        """Rows whose outcome is known without the trusted ids; or, if ``asked``, the others, with their id, both sums and number of n-grams."""
        for batch in batches:
            ids = batch.column(id_at).cast(pa.int64())
            may = _may_be(ids, words)
            if asked or score:
                batch, ids, may = (x.filter(pa.array(may == asked)) for x in (batch, ids, pa.array(may)))
                may = may.to_numpy(zero_copy_only=False)
            texts = batch.column(at).to_pylist()
            total, n = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            for low, high in text_chunks(texts):
                grams, owner = gram_buckets(Tokens(texts[low:high]), buckets)
                total[low:high] = np.bincount(owner, weights=weights[grams], minlength=high - low).round().astype(np.int64)
                n[low:high] = np.bincount(owner, minlength=high - low)
            held = total.copy()
            with np.errstate(divide="ignore", invalid="ignore"):  # of a row that is not trusted after all the sum means nothing, and is not used
                for i in np.flatnonzero(may & (n > 0)).tolist():
                    held[i] = own_left_out(gram_buckets(Tokens([texts[i]]), buckets)[0], raw, target, mix)
            value = total / np.maximum(n, 1) / MICRO
            if_not, if_trusted = ((n > 0) & (v >= threshold) for v in (value, held / np.maximum(n, 1) / MICRO))
            known = ~may if score else if_not == if_trusted
            keep = pa.array(~known & (if_not | if_trusted) if asked else known & if_not)
            columns = list(batch.columns)
            if asked:
                columns += [ids, pa.array(total), pa.array(held), pa.array(n)]
            elif score:
                columns += [pa.array(total), pa.array(n), pa.array(value)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=[str(i) for i in range(len(columns))])

    def judged(asked: bool, *fields: tuple[str, T.DataType]) -> DataFrame:
        inner = T.StructType([T.StructField(str(i), f.dataType, True) for i, f in enumerate(docs.schema.fields)])
        inner = with_fields(inner, *((str(len(inner.fields) + i), kind) for i, (_, kind) in enumerate(fields)))
        return docs.mapInArrow(lambda batches: judge(batches, asked), inner).toDF(*map(str, range(len(docs.columns))), *(name for name, _ in fields))

    out = judged(False, *(zip(names, (T.LongType(), T.LongType(), T.DoubleType())) if score else ()))
    if len(words):
        both = judged(True, *((name, T.LongType()) for name in ("id", "total", "held", "n")))
        both = both.join(trusted.withColumn("good", F.lit(True)).hint("shuffle_hash"), "id", "left")
        total = F.when(F.col("good"), F.col("held")).otherwise(F.col("total"))
        value = total.cast("double") / F.col("n") / F.lit(float(MICRO))
        own = [F.col(str(i)) for i in range(len(docs.columns))]
        out = out.union(both.where(value >= F.lit(float(threshold))).select(*own, *([total, F.col("n"), value] if score else [])))
    return out.toDF(*docs.columns, *(names if score else []))


#: DuckDB: the same scores and threshold from the tables, over hashed words.
ORACLE = f"""
WITH good AS (
  SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL)
  ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {MAX_TRUSTED}
), words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\t\\n\\x0b\\f\\r ]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL
), vocab AS (
  SELECT w, list_reduce(list_reverse(list_transform(string_split(w, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: (a * 1000003 + b) % {PRIME}) AS h
  FROM (SELECT DISTINCT unnest(w) AS w FROM words)
), one AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words
), hashed AS (
  SELECT doc_id, i, h, lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM one JOIN vocab USING (w)
), grams AS (
  SELECT doc_id, h % {BUCKETS} AS b FROM hashed
  UNION ALL SELECT doc_id, (h * 1000033 + nxt * 7 + 1) % {PRIME} % {BUCKETS} FROM hashed WHERE nxt IS NOT NULL
), per_doc AS (
  SELECT doc_id, b, count(*) AS n, doc_id IN (SELECT doc_id FROM good) AS own FROM grams GROUP BY doc_id, b
), counts AS (
  SELECT b, CAST(sum(n) AS BIGINT) AS raw, CAST(coalesce(sum(n) FILTER (WHERE own), 0) AS BIGINT) AS tgt FROM per_doc GROUP BY b
), totals AS (
  SELECT CAST(sum(raw) AS BIGINT) AS raw_all, CAST(sum(tgt) AS BIGINT) AS tgt_all FROM counts
), sizes AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_grams FROM per_doc GROUP BY doc_id
), shares AS (
  SELECT doc_id, n, n_grams, own, CAST(raw AS DOUBLE) / raw_all AS q,
    CAST(tgt - CASE WHEN own THEN n ELSE 0 END AS DOUBLE) / greatest(tgt_all - CASE WHEN own THEN n_grams ELSE 0 END, 1) AS t
  FROM per_doc JOIN counts USING (b) JOIN sizes USING (doc_id), totals
), scores AS (
  SELECT doc_id, own, n_grams, CAST(sum(n * CAST(round(ln(({1 - MIX}::DOUBLE * t + {MIX}::DOUBLE * q) / q) * {MICRO}) AS BIGINT)) AS BIGINT) AS llr_micro
  FROM shares GROUP BY doc_id, own, n_grams
), held AS (
  SELECT list_sort(list(CAST(llr_micro AS DOUBLE) / n_grams / {MICRO})) AS s FROM scores WHERE own
), least AS (
  SELECT s[1 + CAST(floor({HELD_OUT}::DOUBLE * (len(s) - 1)) AS BIGINT)] AS score FROM held
)
SELECT d.doc_id, lang, source, n_chars, llr_micro, n_grams, CAST(llr_micro AS DOUBLE) / n_grams / {MICRO} AS quality_score
FROM documents d JOIN scores USING (doc_id), least WHERE CAST(llr_micro AS DOUBLE) / n_grams / {MICRO} >= least.score
"""
