"""Benchmark decontamination with suffix arrays over the training text.

Every task makes a suffix array over the words of the documents it holds (a shard) and binary-searches every suffix of
every benchmark item in it: word by word, a search narrows the range of the array that begins with the suffix's first words
until it is empty. How far it came is the suffix's longest verbatim match, and the range has its places. A suffix that gets
as far as a window marks the words at those places; all hits come from this search. Suffixes that begin alike share
their searches. The documents aren't shuffled. The benchmark is handed out in blocks of bounded size: each block is one
more scan, whatever the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.store import id_of, keyed_text, written
from strandgraph.llm.text import NOT_ALNUM, U64, Words, arrow_limits, covered, keys, spans_of, text_chunks

#: UTF-8 bytes of benchmark text in one block, which is what a task holds of the benchmark.
BLOCK_BYTES = 16 << 20
#: Bytes of training text in a shard; a longer document is a shard by itself.
SHARD_BYTES = 4 << 20


def _ended(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts with a zero after each text, so that no match runs over a text's end, and each
    text's first place. (A word's hash is zero with a chance of 2**-64.)"""
    h = words.hashes(lower=True)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    out = np.zeros(len(h) + len(words.counts), U64)
    out[np.arange(len(h)) + text] = h
    return out, words.first[:-1] + np.arange(len(words.counts))


class Suffixes:
    """All suffixes of a block of benchmark items: one array of word hashes with places in it, so its size is that of the
    text. names: the items' ids; words: their words, a zero after each item; order: the places of words in the order of
    the suffixes that begin there; and by place item, left (words to the item's end) and need (words of the window that
    begins there; beyond left if none does)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        items = [(str(i), t) for i, t in items if i is not None and t is not None]
        self.names = [i for i, _ in items]
        parts, counts = [], []
        for _, data, bounds in text_chunks(pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.string())], names=["text"])):
            words = Words(data, bounds, NOT_ALNUM)
            parts.append(_ended(words)[0])
            counts.append(words.counts)
        self.words = np.concatenate(parts) if parts else np.zeros(0, U64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        begin = np.cumsum(n + 1) - (n + 1)
        self.item = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
        self.left = (np.repeat(begin + n, n + 1) - np.arange(len(self.words))).astype(np.int32)
        whole = self.left >= window
        self.need = np.where(whole, window, self.left + 1).astype(np.int32)
        # An item of fewer words, but not none, is one window.
        short = begin[(n > 0) & (n < window)]
        self.need[short] = self.left[short]
        array = SuffixArray(self.words)
        array.deepen(window)
        self.order = array.order[self.left[array.order] > 0].astype(np.int32)


class SuffixArray:
    """Places of words in the order of the suffixes that start there, up to `depth` words. Words are ordered by hash."""

    def __init__(self, h: np.ndarray):
        self.h, self.depth = h, 1
        self.order = np.argsort(h)
        self._rank(h[self.order])

    def _rank(self, ordered: np.ndarray) -> None:
        self.rank = np.empty(len(ordered), np.int64)
        self.rank[self.order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]])) if len(ordered) else []

    def deepen(self, depth: int) -> None:
        """Doubles the depth, by pairs of ranks, until it is `depth`. Ranges of suffixes that begin alike stay where they are."""
        while self.depth < depth and len(self.h) and self.rank[self.order[-1]] < len(self.h):
            after = np.zeros(len(self.h), np.int64)
            after[: -self.depth] = self.rank[self.depth :]
            pair = self.rank.astype(U64) << U64(32) | after.astype(U64)
            self.order = np.argsort(pair)
            self._rank(pair[self.order])
            self.depth *= 2

    def narrowed(self, low: np.ndarray, high: np.ndarray, want: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each range order[low:high], whose suffixes agree up to `at` words, the part whose next word is wanted."""
        out = []
        for upper in (False, True):
            a, z = (low if not upper else out[0]).copy(), high.copy()
            while len(live := np.flatnonzero(a < z)):
                mid = (a[live] + z[live]) // 2
                place = self.order[mid] + at
                word = self.h[np.minimum(place, len(self.h) - 1)]
                # What the array's end cuts off comes before any word.
                right = (place >= len(self.h)) | ((word <= want[live]) if upper else (word < want[live]))
                a[live[right]] = mid[right] + 1
                z[live[~right]] = mid[~right]
            out.append(a)
        return out[0], out[1]


def _expanded(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, n of them, one after another."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Found:
    """The search of all suffixes of a block in a shard.

    longest: by place of the shard the words of the longest match that begins there with a window.
    place, words, window: where windows occur, their words and numbers, each occurrence once; window_item, item: windows' numbers,
    ascending, and each one's items. Occurrences and items stand apart, as many items may share a window that occurs often.
    reach, low, high: how far each suffix (by its place in the block) came, and its range of array.order then.
    """

    def __init__(self, h: np.ndarray, block: Suffixes):
        array = self.array = SuffixArray(h)
        self.longest = np.zeros(len(h), np.int32)
        self.reach, self.low, self.high = (np.zeros(len(block.words), t) for t in (np.int32, np.int64, np.int64))
        least = int(block.need[block.need <= block.left].min(initial=len(block.words) + 1))
        p, node = block.order, np.zeros(len(block.order), np.int64)
        low, high = np.zeros(1, np.int64), np.full(1, len(h), np.int64)
        hits, items, windows, depth = [], [], 0, 0
        while len(p) and len(h):
            array.deepen(depth + 1)
            want = block.words[p + depth]
            # Suffixes are in order: those that begin alike are neighbours and one node.
            new = np.concatenate([[True], (node[1:] != node[:-1]) | (want[1:] != want[:-1])])
            first = np.flatnonzero(new)
            low, high = array.narrowed(low[node[first]], high[node[first]], want[first], depth)
            alive = low < high
            node = np.cumsum(new) - 1
            keep = alive[node]
            p, node = p[keep], (np.cumsum(alive) - 1)[node[keep]]
            low, high = low[alive], high[alive]
            depth += 1
            self.reach[p], self.low[p], self.high[p] = depth, low[node], high[node]
            if depth >= least and len(p):
                long = np.unique(node[block.need[p] <= depth])
                self.longest[array.order[_expanded(low[long], (high - low)[long])]] = depth
                hit = np.flatnonzero(block.need[p] == depth)
                if len(hit):
                    pairs = np.unique(np.stack([node[hit], block.item[p[hit]].astype(np.int64)]), axis=1)
                    found, each = np.unique(pairs[0], return_inverse=True)
                    n = (high - low)[found]
                    hits.append((array.order[_expanded(low[found], n)], np.full(int(n.sum()), depth), np.repeat(windows + np.arange(len(found)), n)))
                    items.append((windows + each, pairs[1]))
                    windows += len(found)
            more = block.left[p] > depth
            p, node = p[more], node[more]
        nothing = np.zeros(0, np.int64)
        self.place, self.words, self.window = (np.concatenate(x) for x in zip(*hits)) if hits else (nothing,) * 3
        self.window_item, self.item = (np.concatenate(x) for x in zip(*items)) if items else (nothing,) * 2

    def items_of(self, owner: np.ndarray) -> np.ndarray:
        """The different (owner, item) of occurrences' owners, as columns."""
        pairs = np.unique(np.stack([owner, self.window]), axis=1)
        first = np.searchsorted(self.window_item, pairs[1])
        n = np.searchsorted(self.window_item, pairs[1], side="right") - first
        return np.unique(np.stack([np.repeat(pairs[0], n), self.item[_expanded(first, n)]]), axis=1)


_ROW = "k long, n_words long, spans array<struct<start: long, stop: long>>, items array<string>, longest long, longest_start long, digest string"


def _scan(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = block.value
        for batch in batches:
            for part, data, bounds in text_chunks(batch, limit=SHARD_BYTES):
                words = Words(data, bounds, NOT_ALNUM)
                h, first = _ended(words)
                found = Found(h, sought)
                a, z = spans_of(covered(len(h), found.place, found.place + found.words))
                span_doc = np.searchsorted(first, a, side="right") - 1
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for d, x, y in zip(span_doc.tolist(), a.tolist(), z.tolist()):
                    spans[d].append({"start": x - int(first[d]), "stop": y - int(first[d])})
                items: list[list[str]] = [[] for _ in range(part.num_rows)]
                doc = np.searchsorted(first, found.place, side="right") - 1
                pairs = found.items_of(doc) if len(doc) else np.zeros((2, 0), np.int64)
                for d, i in zip(*pairs.tolist()):
                    items[d].append(sought.names[i])
                at = np.flatnonzero(found.longest)
                owner = np.searchsorted(first, at, side="right") - 1
                # The longest of a document, and of equally long ones the first.
                by = np.lexsort((at, -found.longest[at], owner))
                by = by[np.concatenate([[True], owner[by][1:] != owner[by][:-1]])] if len(by) else by
                longest, start = np.zeros(part.num_rows, np.int64), np.full(part.num_rows, -1)
                longest[owner[by]], start[owner[by]] = found.longest[at[by]], at[by] - first[owner[by]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys(part)),
                        pa.array(words.counts.astype(np.int64)),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                        pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                        pa.array(longest),
                        pa.array(start, mask=start < 0),
                        part.column(part.schema.get_field_index("digest")),
                    ],
                    names=["k", "n_words", "spans", "items", "longest", "longest_start", "digest"],
                )

    return run


def _clean_rows(block):
    """The rows without any window of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in text_chunks(batch, limit=SHARD_BYTES):
                h, first = _ended(Words(data, bounds, NOT_ALNUM))
                clean = np.ones(part.num_rows, bool)
                clean[np.searchsorted(first, Found(h, block.value).place, side="right") - 1] = False
                yield part.filter(pa.array(clean))

    return run


def _longest(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = block.value
        for batch in batches:
            for part, data, bounds in text_chunks(batch, limit=SHARD_BYTES):
                k = keys(part)
                h, first = _ended(Words(data, bounds, NOT_ALNUM))
                found = Found(h, sought)
                best = np.zeros(len(sought.names), np.int32)
                np.maximum.at(best, sought.item, found.reach)
                top = np.flatnonzero((found.reach > 0) & (found.reach == best[sought.item]))
                n = (found.high - found.low)[top]
                place, item = found.array.order[_expanded(found.low[top], n)], np.repeat(sought.item[top], n)
                doc = np.searchsorted(first, place, side="right") - 1
                by = np.lexsort((place - first[doc], k[doc], item))
                by = by[np.concatenate([[True], item[by][1:] != item[by][:-1]])] if len(by) else by
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sought.names[i] for i in item[by]], pa.string()), pa.array(best[item[by]].astype(np.int64)), pa.array(k[doc[by]]), pa.array(place[by] - first[doc[by]])],
                    names=["item", "n_words", "k", "start"],
                )

    return run


def _by_block(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int, window: int, scan: Callable[[object], DataFrame], keep: Callable[[DataFrame], None] | None = None) -> list[DataFrame]:
    """scan(block) of each block of about block_bytes of the benchmark's items. With several blocks each result is written
    before the next block is made, and the block is let go: driver and executors hold one at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, found = max(1, -(-size // block_bytes)), []
    for i in range(n):
        block = spark.sparkContext.broadcast(Suffixes([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()], window))
        if n == 1:
            return [scan(block)]
        found.append(written(scan(block), "leaks"))
        block.destroy()
        if keep:
            keep(found[-1])
    return found


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document with the words that windows of benchmark items cover, and those items.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    Returns k (the id as a key, see store.key_of), n_words, spans array<struct<start, stop>> (disjoint, in order),
    items (sorted as strings), longest (words of the longest verbatim match with an item that begins with a window;
    0 without any) and longest_start (its first word, of equally long ones the first; null without any), one row for
    each row of docs. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null texts have no words; items
    without an id or a text are no items; equal items count each. A null document id counts as the smallest. Rows that
    repeat an id each have their row, with the hits of its own text. Empty tables give no rows, or no hits. Other columns aren't read.
    """
    arrow_limits(docs.sparkSession)
    text = keyed_text(docs, id_column, text_column).withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    found = _by_block(benchmark, item_column, item_text, block_bytes, window, lambda block: text.mapInArrow(_scan(block), _ROW))
    if len(found) == 1:
        return found[0].drop("digest")
    # Rows of one id and text come once a block: they are merged, and repeated rows of both fold into one first.
    rows = reduce(DataFrame.unionByName, found)
    merged = rows.groupBy("k", "n_words", "digest").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max_by(F.struct("longest", "longest_start"), F.struct("longest", -F.col("longest_start"))).alias("m"),
        (F.count("*") / len(found)).cast("int").alias("copies"),
    )
    join = """aggregate(spans, cast(array() as array<struct<start: bigint, stop: bigint>>), (acc, x) ->
        case when size(acc) > 0 and x.start <= element_at(acc, -1).stop
        then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).stop, x.stop) as stop)))
        else concat(acc, array(x)) end)"""
    return merged.select("k", "n_words", F.expr(join).alias("spans"), "items", "m.*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim match of each benchmark item over all documents: item, n_words, k, start (a word's
    place). Of equally long ones that in the smallest id, and there the first. Items that share no word with
    any document have no row. Items of one id count as one."""
    arrow_limits(docs.sparkSession)
    text = keyed_text(docs, id_column, text_column)
    found = _by_block(benchmark, item_column, item_text, block_bytes, 1, lambda block: text.mapInArrow(_longest(block), "item string, n_words long, k long, start long"))
    best = reduce(DataFrame.unionByName, found).groupBy("item").agg(F.max_by(F.struct("n_words", "k", "start"), F.struct("n_words", -F.col("k"), -F.col("start"))).alias("m"))
    return best.select("item", "m.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs (with a column text, and whatever else) that hold no window of a benchmark item. Nothing is
    shuffled: each block of the benchmark filters what the one before left."""
    arrow_limits(docs.sparkSession)
    left = [docs]
    found = _by_block(benchmark, "item_id", "text", block_bytes, window, lambda block: left[-1].mapInArrow(_clean_rows(block), docs.schema), left.append)
    return found[-1]


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 9: windows of ten words of the benchmark's items, over all documents."""
    hits = benchmark_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return hits.select(
        id_of("k").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"), F.col("longest_start").alias("longest_match_start"),
    )
