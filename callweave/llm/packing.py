"""Best-fit packing of documents into training sequences, certified by lower bounds.

Documents are cut into pieces of at most ``capacity`` tokens; pieces are spread over partitions and packed by best-fit decreasing. For
each partition, dual-feasible functions give lower bounds on the number of bins. A partition that meets its bound is certified: no packing of its
pieces uses fewer bins. Partitions with a gap exchange: the pieces of their bins with slack are pooled with those of seven neighbours and
packed again by best-fit decreasing, and the result is taken if it needs fewer bins. Bounds add up over partitions, since a
dual-feasible function is summed piece by piece, so the pooled group is certified in turn. Rounds go on until all groups are certified or
one group, the whole, is left.

Scale: only ids and lengths move. A partition holds about ``per_partition`` pieces; a round touches bins with slack in uncertified
partitions alone. Best-fit decreasing leaves slack mainly in its last bins; where more bins have slack, a group sends the emptiest, with an eighth of
``per_partition`` pieces together, so that no pool outgrows a partition. The others stay as they are packed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm._frames import checkpointed, quoted, whole_id
from callweave.llm.mixing import tokens_of
from callweave.session import importable

CAPACITY = 2048
PER_PARTITION = 50_000
FAN_IN = 8

#: No number is ever null, since pandas would get the whole column as floats: a group's statistics have bin -1, a row without an id has no_id.
STATE = "grp long, bin_part long, bin int, doc_id long, no_id boolean, piece int, n_tokens int, start int, open boolean, gap long, bins long, dff array<long>"
PIECE = ["doc_id", "no_id", "piece", "n_tokens"]


def dff_values(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Sums of whole-number dual-feasible functions over pieces; function f's bound is ceil(sum / dff_units(capacity)[f])."""
    out = [int((lengths * counts).sum())]
    for k in range(1, 17):
        exact = (k + 1) * lengths % capacity == 0
        out.append(int((np.where(exact, k * lengths, capacity * ((k + 1) * lengths // capacity)) * counts).sum()))
    for p in _thresholds(capacity):
        out.append(int((np.where(lengths > capacity - p, capacity, np.where(lengths >= p, lengths, 0)) * counts).sum()))
        q = capacity // p
        twice = 2 * lengths
        out.append(int((np.where(twice > capacity, q - (capacity - lengths) // p, np.where(lengths >= p, 1, 0)) * counts).sum()))
    return np.array(out, dtype=np.int64)


def dff_units(capacity: int) -> np.ndarray:
    units = [capacity, *(k * capacity for k in range(1, 17))]
    for p in _thresholds(capacity):
        units += [capacity, capacity // p]
    return np.array(units, dtype=np.int64)


def _thresholds(capacity: int) -> list[int]:
    return sorted({max(1, capacity * j // 64) for j in range(1, 33)})


def lower_bound(sums: np.ndarray, capacity: int) -> int:
    return int((-(-sums // dff_units(capacity))).max())


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and start of each piece. ``lengths`` come in falling order; a piece goes to the fullest bin that still takes it.

    Bins of equal space are taken last opened first. The spaces in use are bits of one whole number, so that the best fit is one shift.
    """
    bins, starts = np.empty(len(lengths), dtype=np.int32), np.empty(len(lengths), dtype=np.int32)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = n = 0
    for at, length in enumerate(lengths.tolist()):
        fits = used >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            here = by_space[space]
            b = here.pop()
            if not here:
                used ^= 1 << space
        else:
            b, space = n, capacity
            n += 1
        bins[at], starts[at] = b, capacity - space
        left = space - length
        if left:
            by_space[left].append(b)
            used |= 1 << left
    return bins, starts


def _packed(pieces: pd.DataFrame, capacity: int, share: int) -> pd.DataFrame:
    """Packed pieces; ``open`` marks the bins that an exchange moves: those with slack, emptiest first, of ``share`` pieces together."""
    pieces = pieces.sort_values(["n_tokens", "no_id", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    pieces["bin"], pieces["start"] = best_fit_decreasing(pieces["n_tokens"].to_numpy(), capacity)
    if not len(pieces):
        return pieces.assign(open=False)
    filled, held = np.bincount(pieces["bin"], weights=pieces["n_tokens"]), np.bincount(pieces["bin"])
    order = np.argsort(filled, kind="stable")
    moves = np.zeros(len(filled), dtype=bool)
    moves[order] = (filled[order] < capacity) & (np.cumsum(held[order]) <= share)
    pieces["open"] = moves[pieces["bin"]]
    return pieces


def _stat(grp: int, bins: int, sums: np.ndarray, capacity: int) -> dict:
    return {"grp": grp, "bins": bins, "dff": sums.tolist(), "gap": bins - lower_bound(sums, capacity)}


def _frame(pieces: pd.DataFrame, stat: dict) -> pd.DataFrame:
    """The pieces' rows and one row, of bin -1, that has the group's bounds."""
    pieces = pieces.assign(grp=stat["grp"], gap=stat["gap"], bins=0, dff=None)
    row = pd.DataFrame([dict.fromkeys(("bin_part", "doc_id", "piece", "n_tokens", "start"), 0) | {"bin": -1, "no_id": False, "open": False} | stat])
    columns = ["grp", "bin_part", "bin", *PIECE, "start", "open", "gap", "bins", "dff"]
    return pd.concat([pieces[columns].astype({"dff": object}), row[columns]], ignore_index=True) if len(pieces) else row[columns]


def pack(docs: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin_id, doc_id, piece, n_tokens, start, certified): every piece of every document with a token, its bin and its place in it.

    Tokens are estimated from the whole text's bytes. Null and empty texts have no token and no piece. Rows without an id are packed, with a
    null doc_id. Ids must be whole numbers. Each of several equal rows is packed: packing drops nothing. Ties of length are broken by id and piece, and equal rows are
    interchangeable, so the table of results is the same in every run. ``certified`` says that the number of bins of the group that the bin ended
    in, through all its exchanges, meets a lower bound. Other columns, whatever their names, are never read. An empty table gives an empty table.
    """
    spark = importable(docs.sparkSession)
    share = max(1, per_partition // FAN_IN)
    texts = docs.select(whole_id(docs, id_col).alias("doc_id"), tokens_of(docs[quoted(text_col)]).alias("tokens")).where("tokens > 0")
    last = F.floor((F.col("tokens") - 1) / capacity).cast("int")
    pieces = texts.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece").cast("long") * capacity).cast("int").alias("n_tokens"))
    pieces = pieces.withColumns({"no_id": F.col("doc_id").isNull(), "hash": F.xxhash64("doc_id", "piece"), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    pieces = checkpointed(pieces)
    parts = max(1, -(-pieces.count() // per_partition))

    def first(key, pdf):
        lengths, counts = np.unique(pdf["n_tokens"].to_numpy(), return_counts=True)
        out = _packed(pdf[PIECE], capacity, share)
        out["bin_part"] = key[0]
        return _frame(out, _stat(key[0], int(out["bin"].max()) + 1, dff_values(lengths.astype(np.int64), counts, capacity), capacity))

    def again(level: int):
        def run(key, pdf):
            stats, rows = pdf[pdf["bin"] < 0], pdf[pdf["bin"] >= 0].drop(columns=["bins", "dff"])
            sums = np.sum([np.array(x, dtype=np.int64) for x in stats["dff"]], axis=0)
            bins = int(stats["bins"].sum())
            old = len(rows[["bin_part", "bin"]].drop_duplicates())
            out = _packed(rows[PIECE], capacity, share)
            new = int(out["bin"].max()) + 1 if len(out) else 0
            if new < old:
                out["bin_part"] = (level << 40) + key[0]
                return _frame(out, _stat(key[0], bins - old + new, sums, capacity))
            return _frame(rows, _stat(key[0], bins, sums, capacity))

        return run

    spread = pieces.withColumn("grp", F.pmod("hash", F.lit(parts)).cast("long")).drop("hash")
    state = checkpointed(spread.groupBy("grp").applyInPandas(first, STATE))
    done, stats, level = [], [], 0
    while True:
        stats.append(state.where("bin < 0").select("grp", (F.col("gap") == 0).alias("met")))
        last_round = stats[-1].where("not met").count() < 2
        finished = state.where("bin >= 0" if last_round else "bin >= 0 and (gap = 0 or not open)")
        done.append(finished.withColumn("level", F.lit(level)))
        if last_round:
            break
        level += 1
        moving = state.where("gap > 0 and (bin < 0 or open)").withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("long"))
        state = checkpointed(moving.groupBy("grp").applyInPandas(again(level), STATE))
    # A group that is not certified is part of a larger one, one level on. One row per group: about a per_partition-th of the pieces.
    met = [stats[-1]]
    for own in reversed(stats[:-1]):
        larger = met[0].select(F.col("grp").alias("up"), F.col("met").alias("later"))
        joined = own.join(larger, F.floor(own["grp"] / FAN_IN) == F.col("up"), "left")
        met.insert(0, joined.select("grp", (F.col("met") | F.coalesce("later", F.lit(False))).alias("met")))
    groups = reduce(DataFrame.unionByName, [m.withColumn("level", F.lit(k)) for k, m in enumerate(met)])
    label = F.concat_ws("-", F.col("bin_part").cast("string"), F.col("bin").cast("string"))
    rows = reduce(DataFrame.unionByName, done).join(groups, ["level", "grp"])
    return rows.select(label.alias("bin_id"), F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "piece", "n_tokens", "start", F.col("met").alias("certified"))
