"""Token-id files: bit-plane shuffling.

Ids are stored in blocks of BLOCK_IDS. A block is transposed into byte planes (all lowest bytes, then all second
bytes, and so on) or into bit planes; each plane is compressed with zstandard by itself. A chunk index at the
file's end has the place of every plane, and the documents' ids and lengths.

File: magic; the planes of block after block; the footer, int64 arrays compressed with zstandard (number of
documents, blocks and columns, kind of planes; key and length of each document; for each block its ids, place and
the sizes of its planes); the footer's length in 8 bytes; magic.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.files import Appender, Reader
from strandgraph.llm.store import id_of, keyed_text, shared_folder, written
from strandgraph.llm.text import arrow_limits

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
#: Ids in a file at most, but for a longer single document.
FILE_IDS = 1 << 26
#: Words in one generation of a worker's cache of encoded words (about 200 bytes each).
CACHED_WORDS = 800_000


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of one block of ids below 2**32, lowest first. All-zero planes are empty."""
    raw = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if bits:
        raw = np.concatenate([np.packbits(p[:, None] >> np.arange(8, dtype=np.uint8) & 1, axis=0, bitorder="little").T for p in raw])
    return [p.tobytes() if p.any() else b"" for p in raw]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    """The n ids of a block again."""
    if bits:
        each = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") if p else np.zeros(n, np.uint8) for p in planes]
        raw = [sum((each[8 * i + j] << np.uint8(j) for j in range(8)), np.zeros(n, np.uint8)) for i in range(4)]
    else:
        raw = [np.frombuffer(p, np.uint8) if p else np.zeros(n, np.uint8) for p in planes]
    return np.ascontiguousarray(np.stack(raw, axis=1)).view("<u4").ravel()


class IdWriter:
    """Writes documents' ids one after another into files of a folder."""

    def __init__(self, folder: str, bits: bool = False):
        self.out, self.bits = Appender(folder, ".ids", 1 << 62), bits
        self.press = zstandard.ZstdCompressor(level=3)
        self._fresh()

    def _fresh(self) -> None:
        self.waiting, self.n_waiting, self.blocks, self.docs, self.total = [], 0, [], [], 0

    def add(self, k: int, ids: np.ndarray, second: int = 0) -> Iterator[tuple[str, int, int, int, int]]:
        """Takes one document's ids, and what orders it among those of its key; gives the file that was full before, if any."""
        if self.total >= FILE_IDS:
            yield from self.finish()
        if self.out.room():
            self.out.write(MAGIC)
        if not self.docs:
            self.second = second
        self.docs.append((k, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.total += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for a in range(0, whole, BLOCK_IDS):
            block = ids[a : min(a + BLOCK_IDS, whole)]
            planes = [self.press.compress(p) if p else b"" for p in to_planes(block, self.bits)]
            _, at, _ = self.out.write(b"".join(planes))
            self.blocks.append((len(block), at, *(len(p) for p in planes)))
        self.waiting = [ids[whole:]]
        self.n_waiting = len(ids) - whole

    def finish(self) -> Iterator[tuple[str, int, int, int, int]]:
        """Ends the file: (name, bytes, smallest key, ids, what orders its first document among those of its key)."""
        if not self.docs:
            return
        self._blocks(True)
        docs, blocks = np.array(self.docs, dtype="<i8"), np.array(self.blocks, dtype="<i8").reshape(len(self.blocks), -1)
        head = np.array([len(docs), len(blocks), blocks.shape[1] if len(blocks) else 0, self.bits], dtype="<i8")
        foot = self.press.compress(head.tobytes() + docs.tobytes() + blocks.tobytes())
        self.out.write(foot + struct.pack("<q", len(foot)) + MAGIC)
        name, size = self.out.name, self.out.at
        self.out.close()
        yield name, size, self.docs[0][0], self.total, self.second
        self._fresh()


class IdReader:
    """A file's chunk index, and any stretch of its ids."""

    def __init__(self, source: Reader, name: str, size: int):
        self.source, self.name = source, name
        tail = source.read(name, size - 16, 16)
        if tail[8:] != MAGIC or source.read(name, 0, 8) != MAGIC:
            raise ValueError(f"{name} isn't an id file")
        (n,) = struct.unpack("<q", tail[:8])
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(name, size - 16 - n, n)), "<i8")
        docs, blocks, width, self.bits = raw[:4]
        self.docs = raw[4 : 4 + 2 * docs].reshape(-1, 2)
        self.blocks = raw[4 + 2 * docs :].reshape(blocks, width) if blocks else np.zeros((0, 6), np.int64)
        self.ends = np.cumsum(self.blocks[:, 0])
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def block(self, i: int) -> np.ndarray:
        if self.last[0] != i:
            n, at, *sizes = self.blocks[i].tolist()
            body, planes = self.source.read(self.name, at, sum(sizes)), []
            for s in sizes:
                planes.append(zstandard.ZstdDecompressor().decompress(body[:s]) if s else b"")
                body = body[s:]
            self.last = i, from_planes(planes, n, bool(self.bits))
        return self.last[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the file's start-th on."""
        out, stop = [], start + n
        while start < stop:
            i = int(np.searchsorted(self.ends, start, side="right"))
            first = int(self.ends[i] - self.blocks[i, 0])
            part = self.block(i)[start - first : stop - first]
            out.append(part)
            start += len(part)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


#: By tokenizer: the words of this generation and of the last one.
_WORDS: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}
_TOKENIZERS: dict[str, object] = {}


#: A word of its own that stands between words that are encoded together.
MARK = "\x02"
TOGETHER = 4096


def _encode_new(path: str, words: list[str]) -> Iterator[tuple[str, bytes]]:
    """Each word with its ids. Many words are one text for the library, with marks between them: a text costs much more than a word."""
    # Spark's tasks share the cores; threads of the library's own would wait for one another.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    tokenizer = _TOKENIZERS[path]
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids
    alone = [w for w in words if MARK in w] if len(mark) == 1 else words
    if alone:
        for w, e in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            yield w, np.array(e.ids, dtype=np.uint32).tobytes()
        words = [w for w in words if MARK not in w] if len(mark) == 1 else []
    parts = [words[a : a + TOGETHER] for a in range(0, len(words), TOGETHER)]
    for part in parts:
        (e,) = tokenizer.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)
        ids = np.array(e.ids, dtype=np.uint32)
        ends = np.append(np.flatnonzero(ids == mark[0]), len(ids)).tolist()
        if len(ends) != len(part):
            raise AssertionError("marks don't tell words apart with this tokenizer")
        raw, begin = ids.tobytes(), 0
        for w, end in zip(part, ends):
            yield w, raw[4 * begin : 4 * end]
            begin = end + 1


def encode_words(path: str, texts: list[str]) -> list[np.ndarray]:
    """Each text's ids, as the library gives them without adding special tokens; strings of special tokens in a text become
    those tokens. White space ends tokens of this kind of tokenizer, special ones included, so each different word is encoded once and its
    ids are looked up from then on; a worker keeps two generations of CACHED_WORDS words."""
    now, last = _WORDS.setdefault(path, ({}, {}))
    split = [t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") for t in texts]
    found = [list(map(now.get, words)) for words in split]
    missing = {w for words, ids in zip(split, found) if None in ids for w, x in zip(words, ids) if x is None}
    if len(now) + len(missing) > CACHED_WORDS:
        now, last = {}, now
        _WORDS[path] = now, last
    new = []
    for w in missing:
        if (ids := last.get(w)) is not None:
            now[w] = ids
        else:
            new.append(w)
    now.update(_encode_new(path, new))
    return [np.frombuffer(b"".join([now[w] if x is None else x for w, x in zip(words, ids)] if None in ids else ids), np.uint32) for words, ids in zip(split, found)]


def _write(folder: str, path: str, end_id: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = IdWriter(folder, bits), []
        end = np.array([end_id], np.uint32)
        for batch in batches:
            k, text, second = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist(), batch.column(2).to_pylist()
            for a in range(0, len(k), 64):
                for key, ids, h in zip(k[a : a + 64], encode_words(path, text[a : a + 64]), second[a : a + 64]):
                    done += out.add(key, np.concatenate([ids, end]), h)
        done += out.finish()
        columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), *[pa.int64()] * 4))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(done)), pa.int64())], names=["file", "bytes", "first", "ids", "second", "nth"])

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2, bits: bool = False, id_column: str = "doc_id", text_column: str = "text") -> tuple[str, DataFrame]:
    """Encodes each text, appends end_id, and writes the ids in ascending order of the documents' ids.

    Gives the folder and a table of its files in order: file, bytes, first (smallest key), ids, place (number of the
    file), start (ids in all files before). Texts are sorted in ranges of ids, one range a task; no range depends on
    another. A null text has the end id alone; a null id comes first. Rows of one id, or of none, are in the order of a hash of
    their text, so many of them are several ranges; repeated rows are written each. An empty table makes
    no file. Other columns aren't read.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    folder = shared_folder(spark, "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("k", "second", "text")
    ranges = keyed_text(docs, id_column, text_column).withColumn("second", F.xxhash64("text")).repartitionByRange(parts, "k", "second").sortWithinPartitions(*order)
    files = written(ranges.mapInArrow(_write(folder, tokenizer_path, end_id, bits), "file string, bytes long, first long, ids long, second long, nth long"), "id-files")
    # One row a file. Files of one range follow one another, and a key and hash never span two ranges.
    total, rows = 0, []
    for i, r in enumerate(files.orderBy("first", "second", "nth").toLocalIterator()):
        rows.append((r.file, r.bytes, r.first, r.ids, i, total))
        total += r.ids
    return folder, spark.createDataFrame(rows, "file string, bytes long, first long, ids long, place long, start long")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Reader(folder)
        for batch in batches:
            for f in batch.to_pylist():
                file = IdReader(source, f["file"], f["bytes"])
                at = 0
                for a in range(0, len(file.docs), 4096):
                    out = []
                    for k, n in file.docs[a : a + 4096].tolist():
                        out.append((k, f["start"] + at, n, zlib.crc32(file.ids(at, n).astype("<u4"))))
                        at += n
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["k", "start", "n_tokens", "ids_crc32"])
        source.close()

    return run


def read_ids(folder: str, files: DataFrame) -> DataFrame:
    """Per document from the files: k, start, n_tokens, ids_crc32 (over little-endian unsigned 32-bit ids)."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "bytes", "start").repartition(parts, "file").mapInArrow(_read(folder), "k long, start long, n_tokens long, ids_crc32 long")


def op10_token_ids(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 10, over all documents."""
    import public_tokenizers

    folder, files = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")))
    return read_ids(folder, files).select(id_of("k").alias("doc_id"), "start", "n_tokens", "ids_crc32")
