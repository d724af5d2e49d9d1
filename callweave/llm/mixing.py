"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Each source is cut, shard by shard, into blocks of ``total tokens / n_blocks`` tokens, in a seeded order. A document belongs to the block that
it begins in; a block counts as many seats as there are blocks up to the next one that a document begins in, so that a seat is worth the same
tokens however long documents are. Seats go to sources by highest quotients weight / (2k + 1). The budget follows from the targets: a source that has no block left
ends the apportionment, unless the sources that ran out hold at most ``short`` of all weight together, which are then taken whole. Each source's integer quota then goes to its shards by
the same rule, with the shard's seats as its votes. Every shard takes blocks in a seeded order up to its quota; the block that straddles the quota is
taken with a chance in proportion to the part of it that fits, by a seeded number, so that long documents do not shift the shares.

Scale: only ids, sources and token counts are shuffled and sorted, by (source, shard), so that a hot source is spread over all shards, whose
number grows with the rows. Quotas of sources are found in closed form from one aggregate per source; quotients of shards number about ``n_blocks``, plus one
per shard. Texts move once, when documents are joined with the selected ids, of which a hash table is made in each task, so that texts pass by and are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm._frames import checkpointed, packed, quoted, unpacked

N_BLOCKS = 10_000
N_SHARDS = 16
#: Beyond N_SHARDS times so many units there are more shards, and at least BLOCKS_PER_SHARD blocks for each.
SHARD_UNITS = 1_000_000
BLOCKS_PER_SHARD = 32
SEED = 17
BYTES_PER_TOKEN = 4
#: Target weights of the registered query and of the pipeline: named sources, and every other one.
WEIGHTS = {"src0": 3.0, "src1": 0.5, "src2": 0.75}
OTHERS = 1.0
SHORT = 0.05
#: So many sources at once are looked at on the driver.
LISTED = 10_000


def tokens_of(text: Column) -> Column:
    """Token estimate of a whole text: its UTF-8 bytes by four, rounded up; 0 for null and empty texts."""
    return F.coalesce(F.ceil(F.octet_length(text) / F.lit(BYTES_PER_TOKEN)), F.lit(0)).cast("long")


def unit_of(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What is chosen as one: rows that share an id, or rows without id that share a text."""
    return F.coalesce(
        F.concat(F.lit("i"), docs[quoted(id_col)].cast("string")), F.concat(F.lit("t"), F.md5(docs[quoted(text_col)])), F.lit("n")
    )


def _number(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _weight(weights: dict[str, float] | None, others: float) -> Column:
    if not weights:
        return F.lit(float(others))
    table = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))])
    return F.coalesce(table[F.col("source")], F.lit(float(others)))


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(
        unit_of(docs, id_col, text_col).alias("unit"),
        docs[quoted(id_col)].alias("doc_id"),
        F.coalesce(docs[quoted(source_col)].cast("string"), F.lit("")).alias("source"),
        tokens_of(docs[quoted(text_col)]).alias("tokens"),
    )
    return rows.groupBy("unit").agg(F.min("doc_id").alias("doc_id"), F.min("source").alias("source"), F.sum("tokens").alias("tokens"))


def _end(there: DataFrame, allowed: float) -> tuple[str, float] | None:
    """(source, quotient) of the first source, by falling quotient of the seat it has no block for, at which the weights add up to more than ``allowed``.

    Bins of quotients, 64 at a time, are summed until the one that holds it has at most LISTED sources.
    """
    base, bounds = 0.0, there.agg(F.min("out"), F.max("out")).first()
    low, high = bounds
    if low is None:
        return None
    within = there
    while low < high and within.count() > LISTED:
        step = (high - low) / 64
        bins = within.groupBy(F.least(F.lit(63), F.floor((F.col("out") - low) / step)).alias("bin")).agg(F.sum("weight").alias("weight"), F.min("out").alias("low"), F.max("out").alias("high"))
        for row in sorted(bins.collect(), key=lambda r: -r.bin):
            if base + row.weight > allowed:
                low, high = row.low, row.high
                break
            base += row.weight
        within = there.where((F.col("out") >= low) & (F.col("out") <= high))
    for row in within.orderBy(F.col("out").desc(), "source").select("source", "weight", "out").limit(LISTED).collect():
        base += row.weight
        if base > allowed:
            break
    return row.source, row.out


def source_quotas(sources: DataFrame, short: float = SHORT) -> DataFrame:
    """(source, quota) from (source, weight, has): seats by highest quotients, until more than ``short`` of all weight has run out of blocks.

    Every seat before the end counts: for each source the number of k whose quotient comes before, from the inverse of the quotient, put right by
    comparing the five seats around it, and no more than the source has.
    """
    there = sources.where("weight > 0 and has > 0").withColumn("out", F.col("weight") / (2 * F.col("has") + 1))
    whole = there.agg(F.sum("weight")).first()[0]
    end = _end(there, short * whole) if whole else None
    if end is None:
        return there.select("source", F.col("has").alias("quota"))
    source, last = end
    around = F.greatest(F.lit(0), F.floor((F.col("weight") / F.lit(last) - 1) / 2) - 2).cast("long")
    quotient = lambda k: F.col("weight") / (2 * k + 1)
    before = lambda k: (quotient(k) > last) | (quotient(k) == last) & (F.col("source") < source)
    seats = F.col("around") + F.size(F.filter(F.sequence("around", F.col("around") + 4), before))
    return there.withColumn("around", around).select("source", F.least("has", seats.cast("long")).alias("quota")).where("quota > 0")


def mixing_plan(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    others: float = OTHERS,
    short: float = SHORT,
    n_blocks: int = N_BLOCKS,
    n_shards: int = N_SHARDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The selected units: (unit, doc_id, source, shard, block, tokens).

    ``weights`` gives target shares of named sources, in any unit; every other source has weight ``others``. Sources of weight 0 get nothing. A weighted
    source without rows is left aside. The scarcest sources, relative to their weights, bound the whole result,
    but for those of ``short`` of all weight together: name sources of weight 0 to leave them out. Null sources count as the source ''. Rows that share an id are one unit, of the smallest of its sources and all its rows' tokens; rows with
    neither id nor text are one unit. Ids may be of any type. Empty texts weigh 0 tokens and go with the block they fall in. Ties of quotients go to the
    smaller source, then shard. Other columns, whatever their names, are never read. An empty table gives an empty plan. mixing_shares() reports what was reached.
    """
    units = checkpointed(_units(docs, id_col, text_col, source_col))
    n, total = units.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    n_shards = max(n_shards, n // SHARD_UNITS)
    n_blocks = max(n_blocks, BLOCKS_PER_SHARD * n_shards)
    size = max(1, -(-total // n_blocks))
    units = units.withColumn("place", _number(F.lit(seed), F.col("unit")))
    units = units.withColumn("shard", F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % n_shards)

    before = Window.partitionBy("source", "shard").orderBy("place", "unit").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    blocks = units.withColumn("begins", begins).withColumn("block", F.floor(F.col("begins") / F.lit(size)).cast("long"))
    there = blocks.groupBy("source", "shard", "block").agg(F.max(F.col("begins") + F.col("tokens")).alias("ends"))
    following = F.lead("block").over(Window.partitionBy("source", "shard").orderBy("block"))
    last = F.greatest(F.col("block") + 1, F.ceil(F.col("ends") / F.lit(size)))
    there = checkpointed(there.select("source", "shard", "block", (F.coalesce(following, last) - F.col("block")).cast("long").alias("seats")))

    shards = there.groupBy("source", "shard").agg(F.sum("seats").alias("has"))
    sources = shards.groupBy("source").agg(F.sum("has").alias("has")).withColumn("weight", _weight(weights, others))
    by_source = source_quotas(checkpointed(sources), short)

    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.col("has") - 1)).alias("k")  # n_blocks seats in all
    votes = shards.join(by_source, "source").select("source", "shard", "has", "quota", steps)
    votes = votes.withColumn("quotient", F.col("has") / (2 * F.col("k") + 1))
    best = Window.partitionBy("source").orderBy(F.col("quotient").desc(), "shard", "k")
    by_shard = votes.withColumn("place", F.row_number().over(best)).where("place <= quota").groupBy("source", "shard").agg(F.count("*").alias("quota"))

    seeded = Window.partitionBy("source", "shard").orderBy(_number(F.lit(seed), F.col("source"), F.col("shard"), F.col("block")), "block")
    taken_before = F.coalesce(F.sum("seats").over(seeded.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chance = (F.conv(F.substring(_number(F.lit(seed), F.col("shard"), F.col("source")), 1, 8), 16, 10).cast("double") + 1) / F.lit(2.0**32)
    fits = F.col("before") + F.col("seats") * chance <= F.col("quota")
    taken = there.withColumn("before", taken_before).join(by_shard, ["source", "shard"]).where(fits)
    return blocks.join(taken.select("source", "shard", "block"), ["source", "shard", "block"]).select("unit", "doc_id", "source", "shard", "block", "tokens")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The documents that mixing_plan() selects, with all their columns, whatever their names. See there for nulls, ties and repeated rows."""
    taken = mixing_plan(docs, weights, id_col=id_col, text_col=text_col, source_col=source_col, **params).select("unit")
    return unpacked(packed(docs, unit=unit_of(docs, id_col, text_col)).join(taken.hint("shuffle_hash"), "unit", "left_semi"))


def mixing_shares(docs: DataFrame, plan: DataFrame, weights: dict[str, float] | None = None, others: float = OTHERS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, target, reached, tokens, of_tokens) of every source: its target share, its share of the plan's tokens, and its tokens taken and there."""
    there = _units(docs, id_col, text_col, source_col).groupBy("source").agg(F.sum("tokens").alias("of_tokens"))
    taken = plan.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    both = there.join(taken, "source", "left").withColumns({"weight": F.greatest(_weight(weights, others), F.lit(0.0)), "tokens": F.coalesce("tokens", F.lit(0))})
    whole = both.agg(F.sum("weight").alias("weights"), F.sum("tokens").alias("all_tokens"))
    rows = both.crossJoin(F.broadcast(whole))  # one row
    return rows.select("source", F.try_divide("weight", "weights").alias("target"), F.try_divide("tokens", "all_tokens").alias("reached"), "tokens", "of_tokens")


def oracle(weights: dict[str, float], others: float = OTHERS, short: float = SHORT) -> str:
    """DuckDB SQL of mixing_plan(documents, weights), for at most N_SHARDS * SHARD_UNITS units; quotients are listed seat by seat."""
    weight = "CASE source " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in sorted(weights.items())) + f" ELSE {float(others)}::DOUBLE END"
    return f"""
WITH units AS (
  SELECT 'i' || CAST(doc_id AS VARCHAR) AS unit, min(doc_id) AS doc_id, min(coalesce(source, '')) AS source,
         CAST(sum(coalesce(ceil(strlen(text) / {BYTES_PER_TOKEN}), 0)) AS BIGINT) AS tokens
  FROM documents GROUP BY 1
), placed AS (
  SELECT *, md5('{SEED}|' || unit) AS place, CAST('0x' || substr(md5('{SEED}|' || unit), 1, 8) AS BIGINT) % {N_SHARDS} AS shard FROM units
), size AS (
  SELECT greatest(1, CAST(ceil(sum(tokens) / {N_BLOCKS}) AS BIGINT)) AS n FROM units
), begun AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, shard ORDER BY place, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM placed
), blocks AS (
  SELECT *, CAST(floor(begins / (SELECT n FROM size)) AS BIGINT) AS block FROM begun
), ended AS (SELECT source, shard, block, max(begins + tokens) AS ends FROM blocks GROUP BY ALL
), there AS (
  SELECT source, shard, block, CAST(coalesce(lead(block) OVER (PARTITION BY source, shard ORDER BY block), greatest(block + 1, ceil(ends / (SELECT n FROM size)))) AS BIGINT) - block AS seats
  FROM ended
), shards AS (SELECT source, shard, CAST(sum(seats) AS BIGINT) AS has FROM there GROUP BY ALL
), sources AS (SELECT source, CAST(sum(has) AS BIGINT) AS has, {weight} AS weight FROM shards GROUP BY source
), spent AS (
  SELECT source, weight / (2 * has + 1) AS out, sum(weight) OVER (ORDER BY weight / (2 * has + 1) DESC, source) AS gone, sum(weight) OVER () AS whole FROM sources WHERE weight > 0
), ending AS (
  SELECT source AS last_source, out AS last FROM spent WHERE gone > {short}::DOUBLE * whole ORDER BY out DESC, source LIMIT 1
), wanted AS (
  SELECT source, weight / (2 * k + 1) AS quotient FROM (SELECT source, weight, unnest(generate_series(0, has - 1)) AS k FROM sources WHERE weight > 0)
), by_source AS (
  SELECT source, count(*) AS quota FROM wanted, ending WHERE quotient > last OR quotient = last AND source < last_source GROUP BY source
), votes AS (
  SELECT source, shard, k, quota, CAST(has AS DOUBLE) / (2 * k + 1) AS quotient
  FROM (SELECT source, shard, has, quota, unnest(generate_series(0, has - 1)) AS k FROM shards JOIN by_source USING (source))
), by_shard AS (
  SELECT source, shard, count(*) AS quota
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard, k) AS place FROM votes) WHERE place <= quota GROUP BY ALL
), seeded AS (
  SELECT source, shard, block, seats, quota,
    coalesce(sum(seats) OVER (PARTITION BY source, shard ORDER BY md5(concat_ws('|', '{SEED}', source, CAST(shard AS VARCHAR), CAST(block AS VARCHAR))), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    (CAST('0x' || substr(md5(concat_ws('|', '{SEED}', CAST(shard AS VARCHAR), source)), 1, 8) AS BIGINT) + 1) / CAST(4294967296 AS DOUBLE) AS chance
  FROM there JOIN by_shard USING (source, shard)
)
SELECT unit, doc_id, source, shard, block, tokens
FROM blocks JOIN (SELECT source, shard, block FROM seeded WHERE CAST(before AS DOUBLE) + seats * chance <= quota) USING (source, shard, block)
"""


ORACLE = oracle(WEIGHTS)
