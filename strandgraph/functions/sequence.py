"""Functions on sequences: normal form, complements, windows, samples and k-mers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Complements of bases, and letters of amino acids.
BASES, COMPLEMENTS = "ACGTNacgtn", "TGCANtgcan"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWYBXZO"

#: Starts of k-mers in one chunk of a sequence: substring() walks from its string's start.
CHUNK = 64
#: Windows that are cut from one stretch of a sequence, for the same reason.
STRETCH = 64


def normalize(s: Column) -> Column:
    """Upper case, U as T, without line breaks and outer blanks."""
    return F.trim(F.regexp_replace(F.translate(F.upper(s), "U", "T"), "\n", ""))


def header_token(header: Column) -> Column:
    """The first token of a record's header."""
    return F.element_at(F.split(F.trim(header), r"\s+"), 1)


def clean_protein(s: Column) -> Column:
    """Without trailing stop marks; X for what isn't an upper-case amino acid."""
    return F.regexp_replace(F.regexp_replace(s, "[*#+]+$", ""), f"[^{AMINO_ACIDS}]", "X")


def reverse_complement(s: Column) -> Column:
    """Other letters stay as they are."""
    return F.reverse(F.translate(s, BASES, COMPLEMENTS))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def truncated(tokens: Column, window: int) -> Column:
    """At most `window` tokens and the two marks around them."""
    return F.slice(tokens, 1, window + 2)


class Windows:
    """Windows of `width` over n items, by number: every `stride` while a whole window fits; then, if the items don't end with a
    window's stride, the last whole window (once more, if it is one already). With more than `most` of them, `most`
    evenly spread ones. All are closed forms, so no list of starts is made to pick from."""

    def __init__(self, n: Column, width: int, stride: int, most: int | None = None):
        self.n, self.width, self.stride, self.most = n, width, stride, most
        regular = F.floor((n - width) / stride) + 1
        self.all = F.when(n <= width, F.lit(1)).otherwise(regular + F.when(stride * regular < n, 1).otherwise(0)).cast("int")

    def count(self) -> Column:
        return self.all if self.most is None else F.least(self.all, F.lit(self.most))

    def start(self, i: Column) -> Column:
        """The 0-based start of window i."""
        if self.most is not None:
            i = F.when(self.all <= self.most, i).otherwise(F.least(self.all - 1, F.floor(i * (self.all / self.most))))
        # Beyond the regular ones, and with a single window, the start is held back to the last whole window.
        return F.greatest(F.least(i * self.stride, self.n - self.width), F.lit(0)).cast("int")


def windows(sequences: DataFrame, k: int, width: int, stride: int, most: int | None = None, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """keys, win_idx, start, text: windows of `width` k-mers of s. A sequence of fewer letters than k is one window."""
    measured = sequences.select(*keys, "s", F.greatest(F.length("s") - k + 1, F.lit(1)).alias("n"))
    w = Windows(F.col("n"), width, stride, most)
    # Explodes stand between the steps, so that lengths and stretches are made once.
    first = measured.select(*keys, "s", "n", F.explode(F.sequence(F.lit(0), w.count() - 1, F.lit(STRETCH))).alias("first"))
    last = F.least(F.col("first") + STRETCH, w.count()) - 1
    begin = first.select(*keys, "s", "n", "first", last.alias("last"), w.start(F.col("first")).alias("begin"))
    stretch = F.substr("s", F.col("begin") + 1, w.start(F.col("last")) - F.col("begin") + width + k - 1)
    each = begin.select(*keys, "n", "begin", stretch.alias("stretch"), F.explode(F.sequence("first", "last")).alias("win_idx"))
    placed = each.select(*keys, "win_idx", "begin", "stretch", w.start(F.col("win_idx")).alias("start"))
    return placed.select(*keys, "win_idx", "start", F.substr("stretch", F.col("start") - F.col("begin") + 1, F.lit(width + k - 1)).alias("text"))


def _chunks(df: DataFrame, seq: str, k: int) -> DataFrame:
    """df without seq, with _chunk: stretches of it that have each k-mer once."""
    n = F.length(seq)
    starts = F.when(n < k, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)), F.lit(CHUNK)))
    return df.filter(F.col(seq).isNotNull()).withColumn("_at", F.explode(starts)).withColumn("_chunk", F.substr(F.col(seq), F.col("_at"), F.lit(CHUNK + k - 1))).drop("_at", seq)


def kmers(df: DataFrame, seq: str, k: int, out: str = "kmer") -> DataFrame:
    """One row for each k-mer of seq; a sequence shorter than k is its only one, also if empty. Null gives none.

    Sequences are cut into chunks first, so that the work is linear in their length.
    """
    m = F.length("_chunk")
    each = F.when(m < k, F.array("_chunk")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(m - k + 1, F.lit(1))), lambda i: F.substr(F.col("_chunk"), i, F.lit(k))))
    return _chunks(df, seq, k).withColumn(out, F.explode(each)).drop("_chunk")


def canonical_kmers(df: DataFrame, seq: str, k: int, out: str = "kmer") -> DataFrame:
    """canonical() of kmers(), from chunks that are complemented once each."""
    # An explode keeps the complement from being put into the lambda, where it would run for each k-mer.
    both = _chunks(df, seq, k).withColumn("_both", F.explode(F.array(F.struct(F.col("_chunk").alias("s"), reverse_complement(F.col("_chunk")).alias("r"), F.length("_chunk").alias("m"))))).drop("_chunk")
    s, r, m = F.col("_both.s"), F.col("_both.r"), F.col("_both.m")
    each = F.when(m < k, F.array(F.least(s, r))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(m - k + 1, F.lit(1))), lambda i: F.least(F.substr(s, i, F.lit(k)), F.substr(r, m - i - k + 2, F.lit(k)))))
    return both.withColumn(out, F.explode(each)).drop("_both")


#: Bytes of rows that are taken at a time, and letters whose k-mers are made at a time, few enough for a processor's cache.
PIECE, STRIP = 1 << 18, 1 << 15

#: Two bits a letter, in the order of letters; 4 for what is no base.
_CODES = np.full(256, 4, np.uint8)
_CODES[list(b"ACGT")] = range(4)
#: Odd multipliers of kmer_hash.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D)


def packed_kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """The canonical k-mers of a run of codes (0 to 3), packed two bits a letter, first letter highest: the smaller of each and
    its reverse complement, which is the first of both in order of letters. Made from halves, so in log k steps."""
    n = len(codes) - k + 1
    forward, backward, width, done = codes.astype(np.uint8), (3 - codes).astype(np.uint8), 1, 0
    way = back = None
    while width <= k:
        if k & width:
            # Letters done so far, then the next `width`.
            f, b, t = forward[done : done + n], backward[done : done + n], _narrowest(done + width)
            way = f if way is None else way.astype(t) << t(2 * width) | f
            back = b if back is None else b.astype(t) << t(2 * done) | back
            done += width
        if 2 * width <= k:
            t = _narrowest(2 * width)
            forward, backward = forward[:-width].astype(t) << t(2 * width) | forward[width:], backward[width:].astype(t) << t(2 * width) | backward[:-width]
        width *= 2
    return np.minimum(way, back).astype(np.uint64, copy=False)


def _narrowest(letters: int) -> type:
    """The narrowest numbers that hold so many packed letters."""
    return next(t for t, most in ((np.uint8, 4), (np.uint16, 8), (np.uint32, 16), (np.uint64, 32)) if letters <= most)


def kmer_hash(packed: np.ndarray) -> np.ndarray:
    """60 bits of a packed k-mer, by multiplications modulo 2**64 and shifts."""
    x = packed * np.uint64(MULTIPLIERS[0])
    x ^= x >> np.uint64(32)
    x *= np.uint64(MULTIPLIERS[1])
    x ^= x >> np.uint64(29)
    x >>= np.uint64(4)
    return x


def kmer_hash_sql(kmer: str, k: int) -> str:
    """DuckDB SQL for kmer_hash of a canonical k-mer's text."""
    a, b = MULTIPLIERS
    code = f"list_sum(list_transform(range({k}), lambda i: (instr('ACGT', {kmer}[i + 1]) - 1)::HUGEINT * (4::HUGEINT ** ({k - 1} - i))::HUGEINT))"
    one = f"(({code})::HUGEINT * {a}::HUGEINT % {1 << 64}::HUGEINT)::UBIGINT"
    return f"list_transform([{one}], lambda x: list_transform([(xor(x, x >> 32)::HUGEINT * {b}::HUGEINT % {1 << 64}::HUGEINT)::UBIGINT], lambda y: (xor(y, y >> 29) >> 4)::BIGINT)[1])[1]"


def small_batches(df: DataFrame) -> None:
    """Batches that go to Python end at a megabyte, whatever rows are like. All operators ask for the same, as the setting counts when a
    plan runs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))


def _small(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of rows that have PIECE bytes in a column of texts, or are one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(size):
        end = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + PIECE, side="right")))
        yield batch.slice(first, end - first)
        first = end


def _letters(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each text begins, and the end of all."""
    texts = batch.column(column).cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    return np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.uint8), bounds - bounds[0]


def _replaced(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(_small(b, 1) for b in batches):
            data, bounds = _letters(batch, 1)
            out = table[data]
            there = out != 0
            size, some = np.zeros(len(batch), np.int64), bounds[1:] > bounds[:-1]
            if some.any():
                size[some] = np.add.reduceat(there, bounds[:-1][some], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            valid = pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
            buffers = [pa.py_buffer(np.packbits(valid, bitorder="little")), pa.py_buffer(ends), pa.py_buffer(out[there])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.string(), len(batch), buffers)], names=["id", "seq"])

    return run


def replaced_letters(df: DataFrame, key: str, seq: str, letters: dict[str, str]) -> DataFrame:
    """key and seq of each row, of whose letters only these are kept, each replaced: ASCII ones by ASCII ones. Null stays null."""
    small_batches(df)
    table = np.zeros(256, np.uint8)
    for a, b in letters.items():
        table[ord(a)] = ord(b)
    rows = df.select(key, F.col(seq).cast("string"))
    return rows.mapInArrow(_replaced(table), f"id {rows.schema[0].dataType.simpleString()}, seq string").toDF(key, seq)


def _kept(batches: Iterator[pa.RecordBatch], k: int, limit: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (id, seq), a few at a time: ids, and by row and hash the row, its hashes below the limit and how often each is there."""
    for batch in chain.from_iterable(_small(b, 1) for b in batches):
        data, bounds = _letters(batch, 1)
        codes = _CODES[data]
        # A k-mer begins where its letters are bases, and not in the last k - 1 of a row.
        good = np.concatenate([[0], np.cumsum(codes > 3)]) if (codes > 3).any() else None
        rows, hashes = [], []
        for a in range(0, len(codes) - k + 1, STRIP):
            z = min(a + STRIP, len(codes) - k + 1)
            h = kmer_hash(packed_kmers(codes[a : z + k - 1] & 3, k))
            at = np.flatnonzero(h < np.uint64(limit))
            if good is not None:
                at = at[good[a + at] == good[a + at + k]]
            row = np.searchsorted(bounds, a + at, side="right") - 1
            inside = a + at + k <= bounds[row + 1]
            rows.append(row[inside])
            hashes.append(h[at[inside]].astype(np.int64))
        row, h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, hashes))
        by = np.lexsort((h, row))
        row, h = row[by], h[by]
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(h, prepend=-1) != 0))
        yield batch.column(0), row[first], h[first], np.diff(np.append(first, len(row)))


def _kept_hashes(k: int, limit: int):
    """Rows (id, seq) to id, hash, abund: hashes of a row's k-mers below the limit, and how often each is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, h, n in _kept(batches, k, limit):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(h), pa.array(n.astype(np.int64))], names=["id", "hash", "abund"])

    return run


def _kept_sets(k: int, limit: int):
    """Rows (id, seq) to id, hashes: the different hashes of a row's k-mers below the limit; without any, no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, h, _ in _kept(batches, k, limit):
            first = np.flatnonzero(np.diff(row, prepend=-1) != 0)
            sets = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(h))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[first])), sets], names=["id", "hashes"])

    return run


def kept_hashes(sequences: DataFrame, k: int, limit: int, id_column: str = "id", seq: str = "seq") -> DataFrame:
    """id, hash, abund of each row: the hashes (kmer_hash) below the limit of its canonical k-mers, k up to 31. k-mers with
    other letters than A, C, G and T are left out. Made where the sequences are; a task holds one batch of them."""
    rows, kind = _sequences(sequences, k, id_column, seq)
    return rows.mapInArrow(_kept_hashes(k, limit), f"id {kind}, hash long, abund long")


def kept_sets(sequences: DataFrame, k: int, limit: int, id_column: str = "id", seq: str = "seq") -> DataFrame:
    """id, hashes of each row that has any: those of kept_hashes as one array."""
    rows, kind = _sequences(sequences, k, id_column, seq)
    return rows.mapInArrow(_kept_sets(k, limit), f"id {kind}, hashes array<long>")


def _sequences(sequences: DataFrame, k: int, id_column: str, seq: str) -> tuple[DataFrame, str]:
    if not 1 <= k <= 31:
        raise ValueError("k is 1 to 31")
    small_batches(sequences)
    rows = sequences.filter(F.col(seq).isNotNull()).select(F.col(id_column).alias("id"), F.col(seq).cast("string").alias("seq"))
    return rows, rows.schema["id"].dataType.simpleString()


def _count_plain(data: np.ndarray, inside: np.ndarray, k: int) -> dict[str, int]:
    """The k-mers of single-byte letters that begin where `inside` is true."""
    view = np.lib.stride_tricks.sliding_window_view(data, k)[inside]
    if k > 8:
        value, count = np.unique(np.ascontiguousarray(view).view(f"V{k}").ravel(), return_counts=True)
        return {v.tobytes().decode(): c for v, c in zip(value, count.tolist())}
    code = np.zeros(len(view), np.uint64)
    for j in range(k):
        code = code << np.uint64(8) | view[:, j]
    value, count = np.unique(code, return_counts=True)
    return {int(v).to_bytes(k, "big").decode(): c for v, c in zip(value, count.tolist())}


def _counted(k: int):
    """Sequences of a batch to their k-mers' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(_small(b, 0) for b in batches):
            texts = batch.column(0).cast(pa.large_binary())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            body = texts.buffers()[2]
            data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.uint8)
            bounds, size = bounds - bounds[0], np.diff(bounds)
            odd = size < k
            odd |= np.array([bool((data[a:z] >= 128).any()) for a, z in zip(bounds[:-1], bounds[1:])], bool)
            found: Counter = Counter()
            # Letters of several bytes, and sequences that are one k-mer by being short.
            for i in np.flatnonzero(odd):
                s = data[bounds[i] : bounds[i + 1]].tobytes().decode()
                found.update([s] if len(s) < k else (s[j : j + k] for j in range(len(s) - k + 1)))
            # A k-mer begins anywhere but in the last k - 1 letters of a sequence.
            inside = np.zeros(len(data), bool)
            for i in np.flatnonzero(~odd):
                inside[bounds[i] : bounds[i + 1] - k + 1] = True
            for a in range(0, len(data) - k + 1, PIECE):
                z = min(a + PIECE, len(data) - k + 1)
                found.update(_count_plain(data[a : z + k - 1], inside[a:z], k))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["kmer", "n"])

    return run


def kmer_counts(df: DataFrame, seq: str, k: int) -> DataFrame:
    """kmer, n: how often each k-mer of kmers() occurs. Batches are counted where they are, so counts alone are shuffled."""
    small_batches(df)
    part = df.select(F.col(seq).cast("string")).filter(F.col(seq).isNotNull()).mapInArrow(_counted(k), "kmer string, n long")
    return part.groupBy("kmer").agg(F.sum("n").alias("n"))
