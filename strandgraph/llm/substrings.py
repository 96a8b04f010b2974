"""Exact removal of repeated word sequences by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the least hash among its runs of MINIMISER_WORDS
words; consecutive windows of one minimiser are one super-k-mer and travel as one packed string to the
minimiser's bucket. Equal windows have equal minimisers, so they meet in one bucket, where sorting finds
each window's earliest start and all later ones.

Before anything travels, a task compares the super-k-mers that it has gathered: of equal ones only the
earliest is sent, and the others, which are known to be repeats, go as bare spans. A first scan counts
minimisers; very frequent ones come last in the order, so that windows around a passage that very many
documents share go to many buckets instead of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.store import IDENTITY, discard, id_of, identified, identified_text, task_count, written
from strandgraph.llm.text import U64, WHITE, Words, arrow_limits, covered, gram_starts, grams, keys, mix, text_chunks

#: Words in the runs that minimisers are chosen from.
MINIMISER_WORDS = 4
#: A minimiser with more than this share of all super-k-mers is frequent; so at most 1 / share are broadcast.
FREQUENT_SHARE = 1 / 4096
#: Packed bytes that a task gathers before it sends them.
FLUSH_BYTES = 24 << 20
#: Buckets for each task: a bucket is sorted in memory by itself.
BUCKETS_PER_TASK = 8

_TOP = U64(1 << 63)
_BASE = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
_BACK = tuple(U64(pow(int(b), -1, 1 << 64)) for b in _BASE)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _super_kmers(words: Words, h: np.ndarray, window: int, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Minimiser, first word and number of windows of each super-k-mer."""
    m = min(MINIMISER_WORDS, window)
    starts, here = gram_starts(words.counts, window)
    if not len(starts):
        return np.zeros(0, U64), starts, starts
    order = grams(h, m) >> U64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, order), len(frequent) - 1)
        order = np.where(frequent[at] == order, order | _TOP, order)
    least = _least(order, window - m + 1)[starts]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    return least[first], starts[first], np.diff(np.append(first, len(starts)))


def _sequence_hashes(h: np.ndarray, a: np.ndarray, z: np.ndarray, which: int) -> np.ndarray:
    """The hash of each run of words [a, z), wherever it stands."""
    n = len(h) + 1
    up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _BASE[which], U64)]))
    down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _BACK[which], U64)]))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(h * up[:-1])])
    return mix((total[z] - total[a]) * down[a] + (z - a).astype(U64))


#: Bytes that are picked at a time: their places take much more room than they do.
PICKED_BYTES = 1 << 18


def _slices(data: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The bytes of all [a, z), one after another."""
    n = z - a
    end = np.cumsum(n)
    out = np.empty(int(end[-1]) if len(n) else 0, np.uint8)
    i, done = 0, 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(end, done + PICKED_BYTES, side="right")))
        size, stop = n[i:j], int(end[j - 1])
        out[done:stop] = data[np.arange(stop - done) + np.repeat(a[i:j] - (np.cumsum(size) - size), size)]
        i, done = j, stop
    return out


def _count_minimisers(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing, gathered, n, size = np.zeros(0, U64), [], 0, 0

        def flush():
            value, count = np.unique(np.concatenate(gathered), return_counts=True)
            # What is frequent over all is so in some flush.
            often = count > FREQUENT_SHARE * n
            g, c = [None, *value[often].astype(np.int64).tolist()], [n, *count[often].tolist()]
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array([size] + [0] * (len(g) - 1), pa.int64())], names=["g", "c", "bytes"])

        for batch in batches:
            for _, data, bounds in text_chunks(batch):
                words = Words(data, bounds, WHITE)
                g, _, _ = _super_kmers(words, words.hashes(), window, nothing)
                gathered.append(g)
                n += len(g)
                size += len(data)
            if n > 1 << 20:
                yield flush()
                gathered, n, size = [], 0, 0
        if n:
            yield flush()

    return run


_SPAN = np.dtype([("k", "i8"), ("start", "i8"), ("stop", "i8")])
_KMER = np.dtype([("k", "i8"), ("start", "i8"), ("bytes", "i4")])
#: The rest of a row's identity, apart from the others as it is zero for most rows.
_REST = np.dtype([("v1", "i8"), ("v2", "i8")])


def _rest(v1: np.ndarray, v2: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v1), _REST)
    out["v1"], out["v2"] = v1, v2
    return out


def _send(window: int, buckets: int, frequent: np.ndarray):
    """Texts to packed super-k-mers: one blob for each bucket and flush."""

    def flush(parts: list[tuple], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        g, one, two, k, v1, v2, start, wins, size = (np.concatenate(x) for x in zip(*parts))
        data = np.concatenate(texts)
        texts.clear()
        at = np.cumsum(size) - size
        order = np.lexsort((start, v2, v1, k, two, one))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        late = ~new & ((k[order] != k[first]) | (v1[order] != v1[first]) | (v2[order] != v2[first]) | (start[order] != start[first]))
        sent, repeat = order[new], order[late]
        bucket = (mix(g) % U64(buckets)).astype(np.int64)
        sent, repeat = sent[np.argsort(bucket[sent], kind="stable")], repeat[np.argsort(bucket[repeat], kind="stable")]
        cuts, spans = np.searchsorted(bucket[sent], np.arange(buckets + 1)), np.searchsorted(bucket[repeat], np.arange(buckets + 1))
        squeeze = zstandard.ZstdCompressor(level=4)
        out_bucket, out_blob = [], []
        for b in range(buckets):
            mine, gone = sent[cuts[b] : cuts[b + 1]], repeat[spans[b] : spans[b + 1]]
            if not len(mine) and not len(gone):
                continue
            kmers, known = np.zeros(len(mine), _KMER), np.zeros(len(gone), _SPAN)
            kmers["k"], kmers["start"], kmers["bytes"] = k[mine], start[mine], size[mine]
            known["k"], known["start"], known["stop"] = k[gone], start[gone], start[gone] + wins[gone] - 1 + window
            text = _slices(data, at[mine], at[mine] + size[mine])
            out_bucket.append(b)
            out_blob.append(squeeze.compress(b"".join(x.tobytes() for x in (np.array([len(kmers), len(known)]), kmers, known, _rest(v1[mine], v2[mine]), _rest(v1[gone], v2[gone]), text))))
            if len(out_blob) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out_blob, pa.binary())], names=["bucket", "blob"])
                out_bucket, out_blob = [], []
        if out_blob:
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out_blob, pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, texts, gathered = [], [], 0
        for batch in batches:
            for part, data, bounds in text_chunks(batch):
                words = Words(data, bounds, WHITE)
                h = words.hashes()
                g, first, wins = _super_kmers(words, h, window, frequent)
                if not len(g):
                    continue
                last = first + wins - 1 + window
                text = np.searchsorted(words.first, first, side="right") - 1
                a, z = words.starts[first], words.ends[last - 1]
                parts.append((g, _sequence_hashes(h, first, last, 0), _sequence_hashes(h, first, last, 1), *(keys(part, c)[text] for c in IDENTITY), first - words.first[text], wins, z - a))
                texts.append(_slices(data, a, z))
                gathered += len(texts[-1])
                if gathered > FLUSH_BYTES:
                    yield from flush(parts, texts)
                    parts, texts, gathered = [], [], 0
        if parts:
            yield from flush(parts, texts)

    return run


def _meet(window: int):
    """One bucket: sorts its windows; all but the earliest start of a window are repeats."""

    def run(table: pa.Table) -> pa.Table:
        kmers, known, of_kmers, of_known, texts = [], [], [], [], []
        for blob in table.column("blob").to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n, s = np.frombuffer(raw, np.int64, 2)
            kmers.append(np.frombuffer(raw, _KMER, n, 16))
            at = 16 + n * _KMER.itemsize
            known.append(np.frombuffer(raw, _SPAN, s, at))
            at += s * _SPAN.itemsize
            of_kmers.append(np.frombuffer(raw, _REST, n, at))
            at += n * _REST.itemsize
            of_known.append(np.frombuffer(raw, _REST, s, at))
            texts.append(np.frombuffer(raw, np.uint8, -1, at + s * _REST.itemsize))
        kmers, known, of_kmers, of_known = map(np.concatenate, (kmers, known, of_kmers, of_known))
        words = Words(np.concatenate(texts), np.append(0, np.cumsum(kmers["bytes"], dtype=np.int64)), WHITE)
        h = words.hashes()
        starts, here = gram_starts(words.counts, window)
        one = grams(h, window)[starts] if len(starts) else np.zeros(0, U64)
        order = np.argsort(one)
        same = np.concatenate([[False], one[order][1:] == one[order][:-1], [False]]) if len(order) else np.zeros(1, bool)
        order = np.sort(order[same[1:] | same[:-1]])
        k = v1 = v2 = start = np.zeros(0, np.int64)
        if len(order):
            two = grams(words.hashes(which=1), window, 1)[starts[order]]
            which = np.repeat(np.arange(len(kmers)), here)[order]
            k, v1, v2, start = kmers["k"][which], of_kmers["v1"][which], of_kmers["v2"][which], kmers["start"][which] + starts[order] - words.first[which]
            by = np.lexsort((start, v2, v1, k, two, one[order]))
            k, v1, v2, start, two, one = k[by], v1[by], v2[by], start[by], two[by], one[order][by]
            first = np.maximum.accumulate(np.where(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]), np.arange(len(one)), 0))
            late = (k != k[first]) | (v1 != v1[first]) | (v2 != v2[first]) | (start != start[first])
            k, v1, v2, start = k[late], v1[late], v2[late], start[late]
            by = np.lexsort((start, v2, v1, k))
            k, v1, v2, start = k[by], v1[by], v2[by], start[by]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (v1[1:] != v1[:-1]) | (v2[1:] != v2[:-1]) | (start[1:] > start[:-1] + 1)]) if len(k) else np.zeros(0, bool)
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(k)) - 1 if len(a) else a
        columns = ((known["k"], k[a]), (of_known["v1"], v1[a]), (of_known["v2"], v2[a]), (known["start"], start[a]), (known["stop"], start[z] + window))
        return pa.table([pa.array(np.concatenate(c)) for c in columns], names=[*IDENTITY, "start", "stop"])

    return run


def repeat_spans(text: DataFrame, window: int = 20) -> DataFrame:
    """The words [start, stop) of each document that repeat an earlier window: IDENTITY, spans array<struct<start, stop>>.
    text: IDENTITY and text, see store.identified.

    Spans of a document may overlap. Documents without a repeat have no row. See remove_repeats for the rules.
    """
    spark = text.sparkSession
    arrow_limits(spark)
    counts = text.mapInArrow(_count_minimisers(window), "g long, c long, bytes long").groupBy("g").agg(F.sum("c").alias("c"), F.sum("bytes").alias("bytes"))
    counts = written(counts, "minimisers")
    total = counts.filter("g is null").select("c", "bytes").first()
    # Fewer than 1 / FREQUENT_SHARE can have that share.
    often = [r.g for r in counts.filter((F.col("g").isNotNull()) & (F.col("c") > FREQUENT_SHARE * total.c)).select("g").collect()] if total else []
    discard(counts)
    frequent = np.sort(np.array(often, dtype=np.int64).astype(U64))
    tasks = task_count(spark, total.bytes if total else 0)
    sent = text.mapInArrow(_send(window, BUCKETS_PER_TASK * tasks, frequent), "bucket int, blob binary")
    marks = sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_meet(window), "k long, v1 long, v2 long, start long, stop long")
    return marks.groupBy(*IDENTITY).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _stripped(part: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, column: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of words, number of words in the column's spans, and the other words joined by one space, by text."""
    words = Words(data, bounds, WHITE)
    spans = part.column(part.schema.get_field_index(column))
    n = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = spans.flatten()
    begin, stop = np.repeat(words.first[:-1], n), np.repeat(words.first[1:], n)
    a, z = (np.minimum(flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) + begin, stop) for i in (0, 1))
    gone = covered(len(words), a, z)
    kept = np.flatnonzero(~gone)
    text = np.searchsorted(words.first, kept, side="right") - 1
    size = words.ends[kept] - words.starts[kept]
    last = np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else np.zeros(0, bool)
    room = size + ~last
    out = np.full(int(room.sum()), 0x20, np.uint8)
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.cumsum(room) - room, size) + within] = data[np.repeat(words.starts[kept], size) + within]
    lens = np.bincount(text, weights=room, minlength=part.num_rows).astype(np.int64)
    removed = np.concatenate([[0], np.cumsum(gone)])
    made = pa.Array.from_buffers(pa.large_string(), part.num_rows, [None, pa.py_buffer(np.append(0, np.cumsum(lens)).astype(np.int64)), pa.py_buffer(out)])
    return words.counts.astype(np.int64), (removed[words.first[1:]] - removed[words.first[:-1]]).astype(np.int64), made.cast(pa.string())


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, bounds in text_chunks(batch):
            n_words, n_removed, text = _stripped(part, data, bounds, "spans")
            yield pa.RecordBatch.from_arrays([pa.array(keys(part)), pa.array(n_words), pa.array(n_removed), text], names=["k", "n_words", "n_removed", "kept_text"])


def _strip_rows(spans: str):
    """Whole rows: text and n_chars change where there are spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in text_chunks(batch):
                columns = dict(zip(part.schema.names, part.columns))
                hit = columns[spans].is_valid()
                _, _, text = _stripped(part, data, bounds, spans)
                columns["text"] = pc.if_else(hit, text, columns["text"].cast(pa.string()))
                if "n_chars" in columns:
                    n = columns["n_chars"]
                    columns["n_chars"] = pc.if_else(hit, pc.utf8_length(text).cast(n.type), n)
                del columns[spans]
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def remove_repeats(docs: DataFrame, window: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document without the words that a window covers whose word sequence starts earlier as well.

    Earlier: in a document of smaller id, or before in the same document. Windows are judged on the input.
    Returns k (the id as a key, see store.key_of), n_words, n_removed and kept_text, one row for each row of
    docs. Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a null text has none and keeps the empty text, and so does a
    text of nothing but white space. A null id counts as the smallest. Rows that repeat an id and its text count
    as one document and lose the same words; rows of one id (or of none) with different texts are documents each, in
    the order of their texts' MD5 (as two signed halves). An empty table gives no rows. Other columns of docs aren't read.
    """
    text, _ = identified_text(docs, id_column, text_column)
    joined = text.join(repeat_spans(text, window), list(IDENTITY), "left").select("k", "text", "spans")
    return joined.mapInArrow(_strip, "k long, n_words long, n_removed long, kept_text string")


def strip_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """The table docs (doc_id, text and whatever else) with the words that remove_repeats removes taken out of text, and
    with n_chars, if there, counted anew. A document that loses no word keeps its row as it is."""
    spans = "spans"
    while spans in docs.columns:
        spans += "_"
    names = ("span_key_of_row", "span_half_of_row", "span_other_half_of_row")
    rows, _ = identified(docs, names=names)
    text = rows.select(*(F.col(a).alias(b) for a, b in zip(names, IDENTITY)), F.col("text").cast("string").alias("text"))
    found = repeat_spans(text, window).toDF(*names, spans)
    joined = rows.join(found, list(names), "left").select(*docs.columns, spans)
    return joined.mapInArrow(_strip_rows(spans), docs.schema)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 5: windows of 20 words over all documents."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=20)
    return found.select(id_of("k").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
