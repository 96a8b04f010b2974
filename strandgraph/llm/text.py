"""Vectorised word and shingle helpers for Arrow batches, used inside Spark tasks.

A batch of texts stays one byte buffer; words, hashes and n-grams are arrays over that buffer, so no
loop runs per word. Null texts count as empty. Everything is deterministic: the hash tables come
from fixed seeds, so tasks, retries and runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time inside a task; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20
#: Words whose bytes are laid out at a time while they are hashed.
HASHED_WORDS = 1 << 15
#: Stands for a null id inside operators; ids are 64-bit.
NULL_KEY = -(1 << 63)

U64 = np.uint64


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """True for each byte that ends a word."""
    out = np.zeros(256, dtype=bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


#: Words `[^\x20\x09-\x0D]+`.
WHITE = separators((0x20, 0x20), (0x09, 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, looked up before A-Z is lower-cased.
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, (2, 256), dtype=U64)
_GRAM = _rng.integers(0, 1 << 64, (2, 64), dtype=U64) | U64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[:, _LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes of the Arrow batches that tasks hand to Python; a longer single row is a batch by itself.
BATCH_BYTES = 1 << 20


def arrow_limits(spark) -> None:
    """Keeps memory bounded, whatever rows are like. All operators ask for the same, as the setting counts when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Bytes of a block whose release lets a worker keep its memory: just under the 32 MB up to which glibc adapts.
KEPT_BYTES = 31 << 20


def keep_freed() -> None:
    """Lets this process use freed arrays again. The C library gives arrays above the largest block that was freed so far back to the
    system, and every page of the next one is then asked for and cleared anew, which took half of the time of scoring (op11).
    The block itself isn't touched, so it takes no memory."""
    np.empty(KEPT_BYTES, np.uint8)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Splits a batch by rows; gives each part with its bytes and its len + 1 offsets into them."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first), data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def keys(batch: pa.RecordBatch, column: str = "k") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """The words of a chunk: start and end of each in the buffer, and where each text's words begin."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, ends_word: np.ndarray):
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~ends_word[data]
        edge = inside[1:] != inside[:-1]
        # A text's edge ends a word as well.
        cut = bounds[1:-1]
        cut = cut[inside[cut] & inside[cut + 1]] if len(cut) else cut
        starts = np.flatnonzero(edge[:-1] & inside[1:-1]) if len(data) else np.zeros(0, np.int64)
        ends = np.flatnonzero(edge & inside[:-1])
        if len(cut):
            cut = np.unique(cut)
            starts = np.sort(np.concatenate([starts, cut]))
            ends = np.sort(np.concatenate([ends, cut]))
        self.data, self.bounds, self.starts, self.ends = data, bounds, starts, ends
        self.first = np.searchsorted(starts, bounds)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = False, which: int = 0) -> np.ndarray:
        """64 bits for each word. which: 0 or 1, two independent hashes."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, U64)
        table = (_BYTE_LOWER if lower else _BYTE)[which]
        length = self.ends - self.starts
        factor = mix(np.arange(1, int(length.max()) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15 + 2 * which)) | U64(1)
        out = np.empty(n, U64)
        for a in range(0, n, HASHED_WORDS):
            size, start = length[a : a + HASHED_WORDS], self.starts[a : a + HASHED_WORDS]
            begin = np.cumsum(size) - size
            within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begin, size)
            out[a : a + HASHED_WORDS] = np.add.reduceat(table[self.data[within + np.repeat(start, size)]] * factor[within], begin)
        return mix(out + length.astype(U64) * U64(0xD6E8FEB86659FD93))


def grams(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The hash of each run of `size` words, by its first; runs over a text's end are to be masked."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for i in range(size):
        total += hashes[i : i + n] * (_GRAM[which][i] if i < 64 else mix(_GRAM[which][i % 64 : i % 64 + 1] + U64(i))[0] | U64(1))
    return mix(total + U64(size))


def gram_starts(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the runs of `size` words within one text, and how many each text has."""
    here = np.maximum(counts - size + 1, 0)
    first = np.cumsum(counts) - counts
    begin = np.cumsum(here) - here
    return np.arange(int(here.sum()), dtype=np.int64) + np.repeat(first - begin, here), here


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(starts, n), 1)
    np.add.at(step, np.minimum(ends, n), -1)
    return np.cumsum(step[:-1]) > 0


def binaries(values: np.ndarray, per_row: np.ndarray) -> pa.Array:
    """A binary for each row from its values."""
    bounds = np.concatenate([[0], np.cumsum(per_row)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(per_row), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def numbers(batch: pa.RecordBatch, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of binaries as one array of numbers, and each row's number of them."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), np.diff(bounds) // np.dtype(kind).itemsize
