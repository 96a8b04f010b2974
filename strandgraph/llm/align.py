"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model that puts a space before a text; both see space+text.
The spans that the libraries give (characters of A's, the immutable proto's of B's tokens) are coarse cuts; where tokens divide a
character (A's bytes of one, B's byte fallback) the decoded bytes of the tokens say where each ends. Places where tokens of both
end cut the tokens into groups; tokens of A and B whose bytes overlap are linked.

A space that follows something other than white space begins a word: A's pattern always ends a match there, and no piece of
B has a space behind another character. So texts are aligned word by word, and a worker aligns each different word once while
its cache lasts. Links are counted where they are, and counts alone are shuffled. The counts of all pairs are
handed out in blocks of bounded size, each of which is one more scan of the documents' pairs (not of the texts).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.store import discard, id_of, keyed_text, written
from strandgraph.llm.text import arrow_limits, binaries, numbers

#: Different words of a worker's cache.
CACHED_WORDS = 900_000
#: Words that a library is given at a time.
NEW_WORDS = 4096
#: Id pairs of a block of counts, 17 bytes each.
BLOCK_PAIRS = 2_000_000
#: Id pairs that a task holds before it hands on their counts.
HELD_PAIRS = 1_000_000

# How byte-level vocabularies write bytes. Printable ones stand for themselves; the others follow from U+0100 on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}

_WORD_START = re.compile(r"(?<=\S) (?!\Z)")


def words(text: str) -> list[str]:
    """The words of space+text, each without its first space. A last single space belongs to the word before."""
    if not text:
        return []
    cuts = [m.start() for m in _WORD_START.finditer(text)]
    return [text[a:z] for a, z in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)])]


def _is_odd(word: str) -> bool:
    return not word or word[-1].isspace()


class Pair:
    """The two tokenizers of a worker, and the alignment of words."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        # Strings of special tokens are plain text.
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = {i: bytes(BYTE_OF[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in BYTE_OF for c in t)}
        self.b_size = self.b.vocab_size()
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b_size)]
        size = max(self.a_bytes) + 1
        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(size)], np.int64)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)
        self.a_bytes = [self.a_bytes.get(i, b"") for i in range(size)]
        # Ids as text, each with a comma and with what ends its side of a group.
        self.marked = [f"{i}{m}" for i in range(size) for m in ",|"] + [f"{i}{m}" for i in range(self.b_size) for m in ",;"]
        self.clear()

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def clear(self) -> None:
        #: Numbers of words; those that are empty or end in white space, which only a text's last one may be, by themselves.
        self.index: dict[str, int] = {}
        self.odd: dict[str, int] = {}
        self.groups: list[str] = []
        #: For each word: tokens of A and B, groups, links, whether the bytes are the word's, and where its links begin.
        self.counts = np.zeros((0, 6), np.int64)
        self.links = np.zeros(0, np.uint64)

    def align(self, words: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """counts (without beginnings), groups and links of different words, one after another. All at once: a word's
        places in bytes follow those of the words before."""
        n = len(words)
        a = self.a.encode_batch([" " + w for w in words], add_special_tokens=False)
        b = [x.pieces for x in self.b.encode(words, return_type="proto", num_threads=1)]
        ids = [e.ids for e in a], [[p.id for p in x] for x in b]
        flat = [list(chain.from_iterable(x)) for x in ids]
        spans = [np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in a)), np.int64).reshape(-1, 2)[:, 1], np.fromiter([p.end for x in b for p in x], np.int64) + 1]
        text = [b" " + w.encode() for w in words]
        whole, good = b"".join(text), np.ones(n, bool)
        for each, one, table in zip(ids, flat, (self.a_bytes, self.b_bytes)):
            if b"".join(map(table.__getitem__, one)) != whole:
                good &= [b"".join(map(table.__getitem__, t)) == x for t, x in zip(each, text)]
        size = np.fromiter(map(len, text), np.int64)
        base = np.cumsum(size) - size
        ascii_word = size == np.fromiter(map(len, words), np.int64) + 1
        tokens, ends, of = [], [], []
        for each, one, span, sizes in zip(ids, flat, spans, (self.a_sizes, self.b_sizes)):
            word, one = np.repeat(np.arange(n), np.fromiter(map(len, each), np.int64)), np.array(one, np.int64)
            if not good.all():
                keep = good[word]
                word, one, span = word[keep], one[keep], span[keep]
            # Spans cut where a character is a byte; tokens that divide characters end where their decoded bytes do.
            begin = np.cumsum(sizes[one]) - sizes[one]
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            decoded = begin + sizes[one] - np.repeat(begin[starts], np.diff(np.append(starts, len(one))))
            tokens.append(one)
            ends.append(base[word] + np.where(ascii_word[word], span, decoded))
            of.append(word)
        cut = np.union1d(*ends)
        # Between two neighbouring cuts lies one token of each: these overlap, and overlap nowhere else.
        x, y = np.searchsorted(ends[0], cut), np.searchsorted(ends[1], cut)
        links = (tokens[0][x] * self.b_size + tokens[1][y]).astype(np.uint64)
        both = np.intersect1d(*ends)
        word_of = lambda at: np.searchsorted(base, at - 1, side="right") - 1
        counts = np.stack([*(np.bincount(w, minlength=n) for w in of), np.bincount(word_of(both), minlength=n), np.bincount(word_of(cut), minlength=n), good], 1).astype(np.int64)
        return counts, self._groups(tokens, ends, both, counts[:, 0] + counts[:, 1]), links

    def _groups(self, tokens: list[np.ndarray], ends: list[np.ndarray], both: np.ndarray, per_word: np.ndarray) -> list[str]:
        """The groups of each word as text: ids in the order of groups, A's before B's, each with the mark that follows it."""
        side, mark = [], []
        for one, at in zip(tokens, ends):
            group = np.searchsorted(both, at)
            side.append(group)
            mark.append(both[group] == at)
        order = np.argsort(np.concatenate([2 * side[0], 2 * side[1] + 1]), kind="stable")
        written_as = np.concatenate([2 * tokens[0] + mark[0], 2 * (len(self.a_bytes) + tokens[1]) + mark[1]])[order]
        parts = list(map(self.marked.__getitem__, written_as.tolist()))
        stops = np.cumsum(per_word).tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip([0, *stops], stops)]

    def learn(self, new: list[str]) -> None:
        found = [self.counts], [self.links]
        used = len(self.links)
        for at in range(0, len(new), NEW_WORDS):
            part = new[at : at + NEW_WORDS]
            for i, word in enumerate(part):
                (self.odd if _is_odd(word) else self.index)[word] = len(self.groups) + i
            counts, groups, links = self.align(part)
            begin = used + np.cumsum(counts[:, 3]) - counts[:, 3]
            found[0].append(np.concatenate([counts, begin[:, None]], 1))
            found[1].append(links)
            self.groups += groups
            used += len(links)
        self.counts, self.links = map(np.concatenate, found)

    def numbers(self, text: str) -> tuple[list[int | None], list[str]]:
        """The words of a text as numbers of the cache, None where they aren't in it, and the words."""
        parts = text.split(" ") if text else []
        found = list(map(self.index.get, parts))
        # Words that are cut in the usual way are in the index as they are; others end in white space or are empty.
        if None in found and any(_is_odd(w) for w, i in zip(parts, found) if i is None):
            parts = words(text)
            found = [(self.odd if _is_odd(w) else self.index).get(w) for w in parts]
        return found, parts

    def number(self, word: str) -> int:
        return (self.odd if _is_odd(word) else self.index)[word]


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def _expanded(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


_ALIGNED = "k long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, counts binary"


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(a_path, b_path)
        for batch in batches:
            if len(both.index) + len(both.odd) > CACHED_WORDS:
                both.clear()
            rows = [both.numbers(t or "") for t in batch.column(1).to_pylist()]
            new = dict.fromkeys(w for f, parts in rows if None in f for i, w in zip(f, parts) if i is None)
            if new:
                both.learn(list(new))
            found = [[both.number(w) if i is None else i for i, w in zip(f, parts)] if None in f else f for f, parts in rows]
            size = np.array([len(f) for f in found], np.int64)
            doc = np.repeat(np.arange(len(found)), size)
            w = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
            good = np.bincount(doc, both.counts[w, 4] == 0, len(found)) == 0
            keep = good[doc]
            doc, counts = doc[keep], both.counts[w[keep]]
            n = [np.bincount(doc, counts[:, c], len(found)).astype(np.int64) for c in range(4)]
            each, begin = counts[:, 3], counts[:, 5]
            most = np.uint64(len(both.a_bytes) * both.b_size)
            key, times = np.unique(np.repeat(doc.astype(np.uint64), each) * most + both.links[_expanded(begin, each)], return_counts=True)
            of, pair = (key // most).astype(np.int64), key % most
            per_doc = np.bincount(of, minlength=len(found))
            groups = [";".join(map(both.groups.__getitem__, f)) if g else "" for f, g in zip(found, good.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, n), pa.array(groups, pa.string()), binaries(pair.astype("<u8"), per_doc), binaries(times.astype("<u4"), per_doc)],
                names=["k", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "counts"],
            )

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row of docs with k (the id as a key, see store.key_of), n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: ids in order),
    and its different linked pairs: pairs (id of A times B's size plus id of B, little-endian unsigned 64-bit, ascending) and
    how often each is linked, counts (unsigned 32-bit).

    Texts that are null or empty, or that either tokenizer's bytes don't give back, have no tokens: zeros and empty values.
    Strings of special tokens are plain text. Null ids and repeated rows stay rows of their own. An empty table gives no rows.
    Nothing is shuffled. Other columns aren't read. A task holds a batch of texts, or one longer text.
    """
    arrow_limits(docs.sparkSession)
    return keyed_text(docs, id_column, text_column).mapInArrow(_align(a_path, b_path), _ALIGNED)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = lambda: pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int64)), pa.array(held[1])], names=["pair", "n"])
    for batch in batches:
        pair = np.concatenate([held[0], numbers(batch, "pairs", "<u8")[0]])
        n = np.concatenate([held[1], numbers(batch, "counts", "<u4")[0].astype(np.int64)])
        value, at = np.unique(pair, return_inverse=True)
        total = np.zeros(len(value), np.int64)
        np.add.at(total, at, n)
        held = value, total
        if len(value) > HELD_PAIRS:
            yield packed()
            held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield packed()


def pair_counts(alignments: DataFrame, b_size: int) -> DataFrame:
    """pair, n, best: how many links of the corpus hold each pair linked, and whether no pair of its id of B has more."""
    n = written(alignments.select("pairs", "counts").mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % b_size), "pairs")
    top = n.groupBy("b").agg(F.max("n").alias("top"))
    return n.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _add(block):
    """Adds to n_best and count_sum what a block's pairs give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = block.value
        for batch in batches:
            pair, per_row = numbers(batch, "pairs", "<u8")
            times = numbers(batch, "counts", "<u4")[0].astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            row = np.repeat(np.arange(batch.num_rows), per_row)[known]
            more = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(more[0], row, (times[known] * best[at[known]]))
            np.add.at(more[1], row, (times[known] * counts[at[known]]))
            names = batch.schema.names
            columns = dict(zip(names, batch.columns))
            for name, x in zip(("n_best", "count_sum"), more):
                columns[name] = pa.array(columns[name].to_numpy(zero_copy_only=False) + x)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return run


def with_counts(alignments: DataFrame, counts: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """alignments with n_best (links whose pair is a best one) and count_sum (over links). The counts come in blocks of about
    block_pairs pairs; what a task holds of them is one block."""
    spark = alignments.sparkSession
    zero = F.lit(0).cast("long")
    out = alignments.withColumns({"n_best": zero, "count_sum": zero})
    counts = written(counts, "pair-counts")
    blocks, earlier = max(1, -(-counts.count() // block_pairs)), None
    for i in range(blocks):
        rows = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == i).toArrow().sort_by("pair")
        block = spark.sparkContext.broadcast((rows["pair"].to_numpy().astype(np.uint64), rows["n"].to_numpy(), rows["best"].to_numpy()))
        out = out.mapInArrow(_add(block), out.schema)
        if i < blocks - 1:
            out = written(out, "aligned")
            block.destroy()
            if earlier is not None:
                discard(earlier)
            earlier = out
    return out


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Contract of operator 12, over all documents."""
    import public_tokenizers as public

    a_path, b_path = str(public.path("byte_bpe_50k.json")), str(public.path("piece_bpe_32k.model"))
    rows = aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), a_path, b_path)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    table = written(rows.select("k", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "counts"), "alignments")
    out = with_counts(table, pair_counts(table, _pair(a_path, b_path).b_size), block_pairs)
    return out.select(id_of("k").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
