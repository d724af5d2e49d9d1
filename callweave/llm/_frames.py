"""Shared helpers of the text operators: packing of input rows, free column names, checkpoints and vectorised tokenising."""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "_row"

#: Token separators of all text operators. A fixed ASCII set, so that Python, Spark and SQL split alike.
SPACES = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores appended until no column of the input has the name (case does not count)."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def packed(df: DataFrame, **cols: str | Column) -> DataFrame:
    """The whole input row as one struct ``_row`` beside named working columns, so that extra input columns can have any name."""
    row = F.struct(*[df[quoted(c)].alias(c) for c in df.columns]).alias(ROW)
    return df.select(row, *[(df[quoted(c)] if isinstance(c, str) else c).alias(k) for k, c in cols.items()])


def unpacked(df: DataFrame, added: dict[str, str | Column] | None = None, row: str = ROW) -> DataFrame:
    """The input's columns again, with added ones under names that are free."""
    names = df.schema[row].dataType.fieldNames()
    out = [F.col(f"{row}.{quoted(c)}").alias(c) for c in names]
    taken = list(names)
    for wanted, col in (added or {}).items():
        name = free_name(wanted, taken)
        taken.append(name)
        out.append((F.col(col) if isinstance(col, str) else col).alias(name))
    return df.select(*out)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_id(df: DataFrame, name: str) -> Column:
    """The id column as a long. Other than whole numbers, whose order and arithmetic the caller needs, are refused by type, before any row is read."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{name} must be of an integer type, not {kind.simpleString()}")
    return df[quoted(name)].cast("long")


def tie_break(df: DataFrame, id_col: str, skip: tuple[str, ...] = ()) -> Column:
    """A total order of rows: rows with an id first, by id, then by the JSON of the remaining columns."""
    rest = [df[quoted(c)].alias(c) for c in df.columns if c not in (id_col, *skip)]
    last = F.to_json(F.struct(*rest)) if rest else F.lit("")
    return F.struct(df[quoted(id_col)].isNull().alias("a"), df[quoted(id_col)].alias("b"), last.alias("c"))


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A folder of our own is set only where the session names none (local tests)."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"callweave-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint: lost executors lose none of it."""
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])


_IS_SPACE = np.zeros(0x110000, dtype=bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True

#: Modulus and base of the polynomial hash of a token's code points. Below 2**31, so that products fit 64 bits and SQL can follow.
PRIME = 2_147_483_647
BASE = 1_000_003


def _powers(n: int, base: int) -> np.ndarray:
    """base**i mod PRIME for i < n, by doubling."""
    out = np.ones(max(n, 1), dtype=np.int64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * pow(base, have, PRIME) % PRIME
        have += step
    return out[:n]


def text_chunks(texts: list, max_chars: int = 1 << 20):
    """Ranges (low, high) of consecutive texts of about ``max_chars`` characters together. Bounds working memory; longer texts stay whole."""
    low = total = 0
    for i, t in enumerate(texts):
        total += len(t) if t is not None else 0
        if total >= max_chars:
            yield low, i + 1
            low, total = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Tokens:
    """The tokens of a batch of texts: ``hashes``, and ``offsets`` of each text's first token. A null text has none.

    A token is a maximal run of characters outside SPACES (or ``breaks``, a flag per code point that must hold for a newline); its hash is sum(code_point[i] * BASE**i) mod PRIME.
    All work is on whole arrays; no text is cut short.
    """

    _pow = np.ones(0, dtype=np.int64)
    _inv = np.ones(0, dtype=np.int64)

    def __init__(self, texts: list[str | None], breaks: np.ndarray = _IS_SPACE):
        joined = "\n".join(t or "" for t in texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        space = breaks[points]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        n = len(points)
        if len(Tokens._pow) < n:
            Tokens._pow = _powers(n, BASE)
            Tokens._inv = _powers(n, pow(BASE, -1, PRIME))
        sums = np.empty(n + 1, dtype=np.int64)
        sums[0] = 0
        np.cumsum(points.astype(np.int64) * Tokens._pow[:n] % PRIME, out=sums[1:])
        self.hashes = (sums[self.ends] - sums[self.starts]) % PRIME * Tokens._inv[self.starts] % PRIME
        lengths = np.fromiter((len(t or "") + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate(([0], np.searchsorted(self.starts, np.cumsum(lengths))))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owners(self) -> np.ndarray:
        """For each token the position of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def token_hash(token: str) -> int:
    """The hash of one token, spelt out; tests hold the vectorised form against it."""
    h = 0
    for c in reversed(token):
        h = (h * BASE + ord(c)) % PRIME
    return h
