"""Byte-level BPE as a monoid: halves are encoded by themselves and joined.

A text is halved until a part is a leaf, which the tiktoken library encodes. Two neighbours are joined by encoding a
window around their border anew. The window grows until both its ends are places where the pattern always ends a
match: a space after something that isn't white space. No match of the pattern runs over such a place, no look-ahead
crosses it, and there is no look-behind; so the tokens outside the window are those of the whole text.
Decoding concatenates the bytes of halves up the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.store import id_of, key_of, keyed_text
from strandgraph.llm.text import arrow_limits

#: Characters of a leaf.
LEAF = 1 << 15
#: Characters on either side of a border in the first window.
WINDOW = 32

_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The encoding of a ranks file, once a worker."""
    import tiktoken

    if (path, pattern) not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def always_ends(text: str, p: int) -> bool:
    """Whether every split has a border before text[p], whatever stands further away."""
    return text[p] == " " and not text[p - 1].isspace()


def stable(text: str, a: int, mid: int, b: int) -> tuple[int, int]:
    """The ends of the window around mid, in [a, b]: the text's own ends or places that always end a match."""
    low = high = -1
    reach = WINDOW
    while low < 0 or high < 0:
        if low < 0:
            stop = max(a, mid - reach)
            low = next((p for p in range(mid, stop, -1) if p < b and always_ends(text, p)), a if stop == a else -1)
        if high < 0:
            stop = min(b, mid + reach)
            high = next((p for p in range(max(mid, a + 1), stop) if always_ends(text, p)), b if stop == b else -1)
        reach *= 2
    return low, high


def _cut(enc, ids: np.ndarray, n: int, back: bool) -> int:
    """How many tokens the first (back: last) n bytes take; n ends at a token."""
    i = 0
    while n > 0:
        n -= len(enc.decode_single_token_bytes(int(ids[-1 - i if back else i])))
        i += 1
    if n:
        raise AssertionError("a window's end isn't a token's end")
    return i


def encode(enc, text: str, leaf: int = LEAF, a: int = 0, b: int | None = None) -> np.ndarray:
    """The ids of text[a:b], as enc.encode_ordinary has them."""
    b = len(text) if b is None else b
    if b - a <= leaf:
        return np.asarray(enc.encode_to_numpy(text[a:b], disallowed_special=()), dtype=np.uint32)
    mid = (a + b) // 2
    left, right = encode(enc, text, leaf, a, mid), encode(enc, text, leaf, mid, b)
    low, high = stable(text, a, mid, b)
    drop_left = _cut(enc, left, len(text[low:mid].encode()), True)
    drop_right = _cut(enc, right, len(text[mid:high].encode()), False)
    return np.concatenate([left[: len(left) - drop_left], np.asarray(enc.encode_to_numpy(text[low:high], disallowed_special=()), dtype=np.uint32), right[drop_right:]])


def decode(enc, ids: np.ndarray, leaf: int = LEAF) -> bytes:
    """The bytes of ids: halves, concatenated."""
    if len(ids) <= leaf:
        return enc.decode_bytes(ids.tolist())
    mid = len(ids) // 2
    return decode(enc, ids[:mid], leaf) + decode(enc, ids[mid:], leaf)


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            ids = [encode(enc, t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=["k", "n_tokens", "ids"])

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            body = [decode(enc, np.frombuffer(x, "<u4")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(body, pa.binary())], names=["k", "n_tokens", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """k (the id as a key, see store.key_of), n_tokens and ids (little-endian unsigned 32-bit) of each row of docs.

    No special tokens. A null text is an empty one and has no ids; null ids and repeated rows stay rows of their own.
    An empty table gives no rows. Nothing is shuffled. Other columns aren't read.
    """
    arrow_limits(docs.sparkSession)
    return keyed_text(docs, id_column, text_column).mapInArrow(_encode(ranks_path, pattern), "k long, n_tokens long, ids binary")


def decoded(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded()'s rows with `decoded`, the bytes that the ids stand for."""
    arrow_limits(tokens.sparkSession)
    return tokens.select("k", "n_tokens", "ids").mapInArrow(_decode(ranks_path, pattern), "k long, n_tokens long, ids binary, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8, over all documents."""
    import public_tokenizers as public

    path = str(public.path("byte_bpe_multi_50k.tiktoken"))
    both = decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public.PATTERN), path, public.PATTERN)
    return both.select(id_of("k").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
