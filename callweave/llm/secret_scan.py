"""Secret scan by token efficiency: random strings take far more tokens of a text vocabulary than words do.

Candidates are runs of at least ``min_length`` characters of the base64, hex and URL-safe alphabets with a letter among them; "=" belongs to one
as padding at its end alone, so that the name in "name=secret" does not. (Of shorter runs, and of digits alone, words and numbers have as few characters a token
as random ones.) UUIDs, digests that the text names as such, known digests, and identifiers are set aside. An identifier has the form of one, letters with up to
four digits after them between separators, and its words, parted where case changes, pass the test themselves: ``word_ratio`` characters a token,
three letters a word. Every other candidate is encoded with a byte-pair vocabulary; fewer than ``max_ratio`` characters per token expose it.

Scale: one pass over whole texts, without a shuffle; known digests of a table are removed by a join of the few candidates alone.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.llm._frames import quoted, text_chunks, with_fields
from callweave.session import importable

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MIN_LENGTH = 16
MAX_RATIO = 2.2
WORD_RATIO = 2.0

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True

_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_NAME = re.compile(r"[_/+=-]*[A-Za-z]+\d{0,4}([_/+=-]+([A-Za-z]+\d{0,4}|\d{1,4}))*[_/+=-]*")
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
WORD = 3
_DIGEST = re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128}", re.I)
_SAYS_DIGEST = re.compile(r"(?:md5|sha-?\d{1,3}|commit|revision|checksum|digest|integrity|etag|fingerprint|blob|tree)[\s\"':=@(-]{0,4}$", re.I)

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The vocabulary in the file of base64 tokens and ranks, loaded once per process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def excluded(candidate: str, before: str, encode, word_ratio: float = WORD_RATIO) -> bool:
    """Whether the string is an identifier made of words, or a digest that the text before it names as one."""
    if _UUID.fullmatch(candidate):
        return True
    if _NAME.fullmatch(candidate):
        words = _HUMP.findall(candidate)
        letters = sum(map(len, words))
        return letters >= WORD * len(words) and letters >= word_ratio * sum(len(encode(w.lower())) for w in words)
    return bool(_DIGEST.fullmatch(candidate) and _SAYS_DIGEST.search(before))


def candidates(texts: list[str | None], min_length: int):
    """(text number, first character, string, the 24 characters before it) of all candidate runs."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    inside = _INSIDE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    long = end - start >= min_length
    start, end = start[long], end[long]
    letters = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
    lettered = letters[end] > letters[start]
    begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    for s, e in zip(start[lettered].tolist(), end[lettered].tolist()):
        i = int(np.searchsorted(begins, s, side="right")) - 1
        for _ in range(2):  # base64 padding
            e += joined[e : e + 1] == b"="
        before = joined[max(int(begins[i]), s - 96) : s].decode("utf-8", "ignore")
        yield i, int(chars[s] - chars[begins[i]]), joined[s:e].decode(), before[-24:]


def secret_scan(
    docs: DataFrame,
    known: DataFrame | None = None,
    vocabulary: str = VOCABULARY,
    max_ratio: float = MAX_RATIO,
    min_length: int = MIN_LENGTH,
    word_ratio: float = WORD_RATIO,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """(doc_id, start, length, n_tokens, chars_per_token, secret_sha256): every exposed string of every document.

    ``start`` counts characters. The string itself is not returned, only its digest. ``known`` has a column ``digest`` of hex digests that
    are no secrets, in lower case. Null and empty texts have no strings. Rows without an id are scanned and reported with a null doc_id;
    repeated rows are each reported. Ids may be of any type. Strings of exactly ``max_ratio`` characters a token pass as harmless. Other columns, whatever their names, are never read. An empty table gives an empty
    table. ``vocabulary`` must be readable by every worker under the same path.
    """
    importable(docs.sparkSession)

    def run(batches):
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at, rows = [], []
            for low, high in text_chunks(texts):
                for i, start, string, before in candidates(texts[low:high], min_length):
                    if not excluded(string, before, encode, word_ratio):
                        n = len(encode(string))
                        if len(string) / n < max_ratio:
                            at.append(low + i)
                            digest = string.lower() if _DIGEST.fullmatch(string) else None
                            rows.append((start, len(string), n, len(string) / n, hashlib.sha256(string.encode()).hexdigest(), digest))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string())
            arrays = [ids.take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "n_tokens", "chars_per_token", "secret_sha256", "digest"])

    kept = docs.select(docs[quoted(id_col)].alias("doc_id"), docs[quoted(text_col)].alias("text"))
    fields = zip(("start", "length", "n_tokens", "chars_per_token", "secret_sha256", "digest"), (T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.StringType(), T.StringType()))
    found = kept.mapInArrow(run, with_fields(T.StructType([kept.schema["doc_id"]]), *fields))
    if known is not None:
        found = found.join(known.select("digest").distinct(), "digest", "left_anti")
    return found.drop("digest")


def text_digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Hex digests (MD5, SHA-1, SHA-256) of all texts: strings that name a document of the same table are references, not secrets."""
    text = docs[quoted(text_col)]
    return docs.where(text.isNotNull()).select(F.explode(F.array(F.md5(text), F.sha1(text), F.sha2(text, 256))).alias("digest"))
