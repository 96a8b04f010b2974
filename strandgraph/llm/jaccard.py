"""Exact n-gram Jaccard join with a token-group matrix, and its connected components.

Similar documents are put into groups, the union of each group's tokens is kept as rows (token, group), a query's overlap
with a group is bounded by counting those rows, and only groups whose bound qualifies are opened: sets and queries are
shipped to them and compared exactly.

Let t be the threshold. Shingles are ordered by hash. A set's *wide prefix* has its first n - ceil(t n) + l shingles,
l = max(1, floor(n / 4)). Two linked sets share at least the smaller l of shingles inside both wide prefixes, so counts
over wide prefixes bound exactly and nothing is lost:

1. one scan makes each set's signature and wide prefix; per bucket of tokens, tokens of a single set go;
2. sets with fewer shared tokens than any partner needs have no link and go;
3. each remaining set joins the family of the set that most of its tokens name first; a large family is
   split into bands of similar size and these by hash into groups, so that none exceeds GROUP_SETS sets and GROUP_SHINGLES
   shingles;
4. a group's sets are compared with one another. One set of each local component speaks for it among the other groups of
   the family: these sets are grouped and compared in turn, until a family is one group or its sets are no copies of one
   another. So a family of near copies is one component after work in proportion to its sets;
5. what is left are links between components. Sets meet other groups by their rarest tokens: if two sets share l of
   their tokens, they share one of all but the l - 1 commonest; so frequent passages make no pairs. What is shared
   outside both wide prefixes is at most what one of two sets has after its own; so sets of nearly one size need far
   more than l, and documents of one template that aren't near copies mostly fall out here. A set asks only those
   groups that hold a larger component than its own, and opens of these only those whose token union shares as many
   tokens with it as a link needs;
6. links become components; equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.components import components
from strandgraph.llm.store import IDENTITY, discard, id_of, identified_text, task_count, text_bytes, written
from strandgraph.llm.text import U64, WHITE, Words, arrow_limits, gram_starts, grams, keys, mix, text_chunks

#: Sets in a group at most; a larger family of similar sets is several groups.
GROUP_SETS = 512
#: Shingles of a group's sets together at most, but for a longer single set.
GROUP_SHINGLES = 1 << 21
#: Queries that one task compares with a group at most; further ones get a copy of the group.
GROUP_QUERIES = 512
#: Text bytes that a task gathers before it sends blobs out.
FLUSH_BYTES = 16 << 20
#: Shared shingles, in percent of a set, that wide prefixes are made for: more of them make bounds sharper and prefixes longer.
SHARED_PERCENT = 25
#: Token buckets for each task.
BUCKETS_PER_TASK = 4
#: Classes of equal sets with more than this share of all rows are broadcast: at most 1 / share of them.
HOT_SHARE = 1 / 4096


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each text's sorted distinct shingle hashes; a text shorter than `size` words is one shingle."""
    for part, data, bounds in text_chunks(batch):
        words = Words(data, bounds, WHITE)
        h = words.hashes(lower=True)
        starts, here = gram_starts(words.counts, size)
        g = grams(h, size)[starts] if len(starts) else np.zeros(0, U64)
        last = np.cumsum(here)
        out = []
        for i, n in enumerate(words.counts):
            if n >= size:
                u = np.sort(g[last[i] - here[i] : last[i]])
                out.append(u[np.concatenate([[True], u[1:] != u[:-1]])])
            elif n:
                out.append(grams(h[words.first[i] : words.first[i] + n], int(n)))
            else:
                out.append(np.zeros(0, U64))
        yield part, out


def _wide(n: int, num: int, den: int) -> int:
    return min(n, n - -(-num * n // den) + max(1, SHARED_PERCENT * n // 100))


def need_column(n: str, num: int, den: int) -> Column:
    """Shared wide tokens that a set of n shingles has with any set it links with, at least: such a set has ceil(t n) or more."""
    return F.expr(f"greatest(1, {SHARED_PERCENT} * (({num} * cast({n} as bigint) + {den - 1}) div {den}) div 100)")


def _need_of_group(num: int, den: int) -> Column:
    """Shared wide tokens of a set (n) with one that it links with and whose size is from least to most, at least.

    Two linked sets share num (n + m) / (num + den) or more, and after the wide prefix that ends first at most what that
    set has there: below (t - SHARED_PERCENT / 100) of its size plus 2. The difference is concave in m, so least at an end.
    """
    t = num / den
    n = F.col("n")

    def at(m: Column) -> Column:
        return (n + m) * F.lit(num / (num + den)) - F.greatest(n.cast("double"), m) * F.lit(t - SHARED_PERCENT / 100) - 2

    low, high = F.greatest(F.col("least").cast("double"), n * F.lit(t)), F.least(F.col("most").cast("double"), n / F.lit(t))
    return F.greatest(need_column("n", num, den), F.ceil(F.least(at(low), at(high)) - 1e-6))


def _pack(docs: np.ndarray, sets: np.ndarray, entries: np.ndarray, sent: np.ndarray) -> bytes:
    head = np.array([len(docs), len(sets), len(entries), len(sent)], dtype=np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in (head, docs, sets, entries, sent)))


_DOC = np.dtype([("k", "i8"), ("n", "i8"), ("sig", "i8"), ("sig2", "i8")])
_SET = np.dtype([("sig", "i8"), ("n", "i4"), ("entries", "i4"), ("sent", "i4")])


def _signatures(size: int, num: int, den: int, buckets: int):
    """Documents to one blob for each bucket of tokens and flush."""

    def flush(docs: list, owners: list, wide: list) -> Iterator[pa.RecordBatch]:
        rows = np.array(docs, dtype=_DOC)
        sig, n = (np.array([o[i] for o in owners], dtype=np.int64) for i in (0, 1))
        lens = np.array([len(w) for w in wide], dtype=np.int64)
        token = np.concatenate(wide) if wide else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(wide)), lens)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        # A token of two sets of this flush is known to be shared: two of its entries tell its bucket so,
        # the others skip the comparison there.
        first = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
        rank = np.arange(len(token)) - np.maximum.accumulate(np.where(first, np.arange(len(token)), 0)) if len(token) else np.zeros(0, np.int64)
        bucket = (token % U64(buckets)).astype(np.int64)
        order = np.lexsort((owner, rank >= 2, bucket))
        token, owner, bucket, sent = token[order], owner[order], bucket[order], (rank >= 2)[order]
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        doc_bucket = (mix(rows["k"].view(U64)) % U64(buckets)).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        out_bucket, out_blob = [], []
        for b in range(buckets):
            a, z = at[b], at[b + 1]
            mine = rows[doc_bucket == b] if len(rows) else rows
            if a == z and not len(mine):
                continue
            s = sent[a:z]
            cut = a + int(np.count_nonzero(~s))
            sets = np.zeros(0, _SET)
            parts = []
            for x, y, name in ((a, cut, "entries"), (cut, z, "sent")):
                who, count = np.unique(owner[x:y], return_counts=True)
                parts.append((who, count, name))
            both = np.union1d(parts[0][0], parts[1][0])
            sets = np.zeros(len(both), _SET)
            sets["sig"], sets["n"] = sig[both], n[both]
            for who, count, name in parts:
                sets[name][np.searchsorted(both, who)] = count
            out_bucket.append(b)
            out_blob.append(_pack(mine, sets, token[a:cut], token[cut:z]))
        yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out_blob, pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, owners, wide, seen, gathered = [], [], [], {}, 0
        for batch in batches:
            for part, sets in shingle_sets(batch, size):
                for k, u in zip(keys(part).tolist(), sets):
                    if len(u):
                        a, b = (int(x) for x in (mix(u).sum(dtype=U64).view(np.int64), mix(u ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64)))
                    else:
                        a, b = 0, 0
                    docs.append((k, len(u), a, b))
                    if len(u) and (a, b) not in seen:
                        seen[a, b] = True
                        owners.append((a, len(u)))
                        wide.append(u[: _wide(len(u), num, den)])
                        gathered += 8 * len(wide[-1])
                if gathered > FLUSH_BYTES // 2 or len(docs) > 200_000:
                    yield from flush(docs, owners, wide)
                    docs, owners, wide, seen, gathered = [], [], [], {}, 0
        if docs:
            yield from flush(docs, owners, wide)

    return run


_OUT = pa.schema([("tok", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("sig2", pa.int64())])


def _meet(table: pa.Table) -> pa.Table:
    """One bucket: the documents' rows pass; of tokens, those of two different sets."""
    docs, tok, sig, n, sent_tok, sent_sig, sent_n = ([] for _ in range(7))
    for blob in table.column("blob").to_pylist():
        raw = zstandard.ZstdDecompressor().decompress(blob)
        head = np.frombuffer(raw, np.int64, 4)
        at = 32
        docs.append(np.frombuffer(raw, _DOC, head[0], at))
        at += head[0] * _DOC.itemsize
        sets = np.frombuffer(raw, _SET, head[1], at)
        at += head[1] * _SET.itemsize
        entries, sent = np.frombuffer(raw, U64, head[2], at), np.frombuffer(raw, U64, head[3], at + 8 * head[2])
        for part, count, (t, s, m) in ((entries, sets["entries"], (tok, sig, n)), (sent, sets["sent"], (sent_tok, sent_sig, sent_n))):
            t.append(part)
            s.append(np.repeat(sets["sig"], count))
            m.append(np.repeat(sets["n"], count))
    docs, tok, sig, n = np.concatenate(docs), np.concatenate(tok), np.concatenate(sig), np.concatenate(n)
    order = np.argsort(tok)
    t = tok[order]
    same = np.concatenate([[False], t[1:] == t[:-1], [False]]) if len(t) else np.zeros(1, bool)
    order = order[same[1:] | same[:-1]]  # tokens seen twice or more, perhaps in equal sets
    order = order[np.lexsort((sig[order], tok[order]))]
    t, s, m = tok[order], sig[order], n[order]
    if len(t):
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(start, len(t)))
        keep = np.repeat(np.minimum.reduceat(s, start) != np.maximum.reduceat(s, start), size)
        keep &= np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
        t, s, m = t[keep], s[keep], m[keep]
    t, s, m = np.concatenate([t, *sent_tok]), np.concatenate([s, *sent_sig]), np.concatenate([m, *sent_n])
    no, nd = len(t), len(docs)
    nulls = pa.nulls(no, pa.int64()), pa.nulls(nd, pa.int64())
    return pa.Table.from_arrays(
        [
            pa.concat_arrays([pa.array(t.astype(np.int64)), nulls[1]]),
            pa.concat_arrays([pa.array(s), pa.array(docs["sig"].copy())]),
            pa.concat_arrays([pa.array(m.astype(np.int64)), pa.array(docs["n"].copy())]),
            pa.concat_arrays([nulls[0], pa.array(docs["k"].copy())]),
            pa.concat_arrays([nulls[0], pa.array(docs["sig2"].copy())]),
        ],
        schema=_OUT,
    )


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in shingle_sets(batch, size):
                yield pa.RecordBatch.from_arrays([pa.array(keys(part)), pa.array([u.astype("<u8").tobytes() for u in sets], pa.binary())], names=["q", "set"])

    return run


class Union:
    """The sets of a group, and its token union with the sets that have each token."""

    def __init__(self, table: pa.Table, num: int, den: int):
        ids = table.column("q").to_numpy()
        self.order = np.argsort(ids)
        self.ids, self.num, self.den = ids[self.order], num, den
        raw = table.column("set").to_pylist()
        self.sets = [np.frombuffer(raw[i], "<u8") for i in self.order]
        self.sizes = np.array([len(x) for x in self.sets], dtype=np.int64)
        token, member = np.concatenate(self.sets), np.repeat(np.arange(len(ids)), self.sizes)
        by = np.argsort(token)
        token, self.member = token[by], member[by]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        self.token, self.begin = token[begin], np.append(begin, len(member))

    def shared(self, u: np.ndarray) -> np.ndarray:
        """Where the union has the tokens of u."""
        at = np.searchsorted(self.token, u)
        return at[self.token[np.minimum(at, len(self.token) - 1)] == u]

    def linked(self, u: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which sets link with u, whose tokens are in the union at those places."""
        count = self.begin[at + 1] - self.begin[at]
        place = np.repeat(self.begin[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        both = np.bincount(self.member[place], minlength=len(self.sizes))
        return self.den * both >= self.num * (len(u) + self.sizes - both)


def _compared(num: int, den: int):
    """One group: each set with the least one of its local component."""

    def run(table: pa.Table) -> pa.Table:
        group = Union(table, num, den)
        near = np.array([group.linked(u, group.shared(u)) for u in group.sets])
        local = np.arange(len(group.sets))
        while True:
            low = np.where(near, local[None, :], len(local)).min(1)
            low = np.minimum(low, local)[np.minimum(low, local)]
            if (low == local).all():
                break
            local = low
        return pa.table([pa.array(group.ids), pa.array(group.ids[local])] + [table.column(c).take(pa.array(group.order)) for c in ("pivot", "part")], names=["q", "root", "pivot", "part"])

    return run


def _bounded(members: pa.Table, queries: pa.Table) -> pa.Table:
    """One group's token union and the sets that ask: those that share as many wide tokens with it as a link needs."""
    union = np.unique(pc.list_flatten(members.column("toks")).to_numpy())
    token, owner = (x.to_numpy() for x in (pc.list_flatten(queries.column("toks")), pc.list_parent_indices(queries.column("toks").combine_chunks())))
    at = np.minimum(np.searchsorted(union, token), max(len(union) - 1, 0))
    shared = np.bincount(owner[union[at] == token] if len(union) else owner[:0], minlength=queries.num_rows)
    return queries.select(["q", "pivot", "part"]).filter(pa.array(shared >= queries.column("need").to_numpy()))


def _opened(num: int, den: int):
    """One group and the sets that ask it: the pairs of components that a link joins, each once."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        found: set[tuple[int, int]] = set()
        if members.num_rows and queries.num_rows:
            group = Union(members, num, den)
            of = members.column("c").to_numpy()[group.order]
            least = int(group.sizes.min())
            for raw, c in zip(queries.column("set").to_pylist(), queries.column("c").to_pylist()):
                u = np.frombuffer(raw, "<u8")
                at = group.shared(u)
                # With o tokens in the union, no set of the group is closer than o / (|q| + least - o).
                if den * len(at) >= num * (len(u) + least - len(at)):
                    found.update((c, r) for r in np.unique(of[group.linked(u, at)]).tolist() if r != c)
        pairs = sorted(found)
        return pa.table([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def similar_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document with the component of the relation den * |A & B| >= num * |A | B| between shingle sets.

    Returns k (the id as a key, see store.key_of), n_shingles, class_id (smallest id with the very same set),
    component_id, v1 and v2 (with k the row's identity, see store.identified) and first (whether no row of the component
    has a smaller identity), one row for each row of docs. Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a text
    of fewer than `size` words is a single shingle. Texts that are null or have no word get the empty set,
    which is linked with nothing: class and component are the document itself. A null id counts as the
    smallest id. Rows that repeat an id and its text are listed as often as they come; rows of one id (or of none)
    with different texts are documents each, linked by their own texts, and have a 64-bit hash of their identity in
    the place of the id while links are made. An empty table gives no rows. Other columns of docs aren't read.
    """
    if not SHARED_PERCENT * den <= 100 * num <= 100 * den:
        raise ValueError(f"the threshold must be from {SHARED_PERCENT / 100} to 1")
    text, several = identified_text(docs, id_column, text_column)
    if not several:
        found = _components(text.select("k", "text"), size, num, den)
        return found.select("*", F.lit(0).cast("long").alias("v1"), F.lit(0).cast("long").alias("v2"), (F.col("k") == F.col("component_id")).alias("first"))
    node = F.when((F.col("v1") == 0) & (F.col("v2") == 0), F.col("k")).otherwise(F.xxhash64(*IDENTITY))
    found = written(_components(text.select(node.alias("k"), "text"), size, num, den).withColumnRenamed("k", "node"), "nodes")
    rows = found.join(text.select(node.alias("node"), *IDENTITY).distinct(), "node")
    of = F.struct(*IDENTITY)
    classes, labels = (rows.groupBy(c).agg(F.min(of).alias(f"least_{c}")) for c in ("class_id", "component_id"))
    named = rows.join(classes, "class_id").join(labels, "component_id")
    return named.select("k", "n_shingles", F.col("least_class_id.k").alias("class_id"), F.col("least_component_id.k").alias("component_id"), "v1", "v2", (of == F.col("least_component_id")).alias("first"))


def _components(text: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """similar_components of k and text, where no two texts have one k: k, n_shingles, class_id, component_id."""
    spark = text.sparkSession
    arrow_limits(spark)
    tasks = task_count(spark, text_bytes(text))
    blobs = text.mapInArrow(_signatures(size, num, den, BUCKETS_PER_TASK * tasks), "bucket int, blob binary").repartition(tasks, "bucket")
    met = written(blobs.groupBy("bucket").applyInArrow(_meet, "tok long, sig long, n long, k long, sig2 long"), "met")
    rows = written(met.filter("tok is null").select("k", "n", "sig", "sig2"), "rows")
    classes = written(rows.filter("n > 0").groupBy("sig", "sig2", "n").agg(F.min("k").alias("rep"), F.count("*").alias("copies")), "classes")
    shared = met.filter("tok is not null").select("tok", "sig", "n")
    enough = shared.groupBy("sig", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= need_column("n", num, den)).select("sig", "n")
    sets = written(classes.join(enough, ["sig", "n"]).select("sig", "n", F.col("rep").alias("q")), "sets")
    lists = written(shared.join(sets, ["sig", "n"]).groupBy("q", "n").agg(F.collect_set("tok").alias("toks")), "lists")
    discard(met, sets)
    grouped = _grouped(lists, num, den)
    discard(lists)
    full = written(text.join(grouped.select(F.col("q").alias("k")), "k", "left_semi").dropDuplicates(["k"]).mapInArrow(_full_sets(size), "q long, set binary"), "full")
    near = written(_within_families(grouped, full, num, den), "near")
    labels = _across(grouped, full, near, num, den)
    named = classes.join(labels.withColumnRenamed("q", "rep"), "rep", "left").select("sig", "sig2", "n", "rep", F.coalesce("component", "rep").alias("component"), "copies").filter("copies > 1 or component <> rep")
    named = written(named, "named")
    discard(grouped, full, near)
    return _told(rows, named)


def _grouped(lists: DataFrame, num: int, den: int) -> DataFrame:
    """q, n, toks (its tokens that other sets have too), head (the rarest of them, of which linked sets share one), pivot (its family) and
    part (its group in the family) of the sets that can have a link."""
    flat = lists.select("q", "n", F.explode("toks").alias("tok"))
    named = flat.groupBy("tok").agg(F.count("*").alias("df"), F.min("q").alias("pivot")).filter("df > 1")
    ranked = flat.join(named, "tok").groupBy("q", "n").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("toks"), F.mode("pivot", True).alias("pivot"))
    need = need_column("n", num, den)
    ranked = written(ranked.filter(F.size("toks") >= need).select("q", "n", "pivot", "toks.tok", F.slice("toks.tok", F.lit(1), (F.size("toks") - need + 1).cast("int")).alias("head")), "ranked")
    grouped = written(_parted(ranked.withColumnRenamed("tok", "toks"), 0), "groups")
    discard(ranked)
    return grouped


def _parted(sets: DataFrame, level: int) -> DataFrame:
    """sets(q, n, pivot, ...) with part: groups of each family that keep to GROUP_SETS and GROUP_SHINGLES, about."""
    # At first by size as well (a tenth more is another band), which makes bounds sharp; later levels mix what was apart.
    sets = sets.withColumn("band", F.floor(F.log("n") * 10) if level == 0 else F.lit(0).cast("long"))
    bands = sets.groupBy("pivot", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    families = bands.groupBy("pivot").agg(((F.sum("sets") <= GROUP_SETS) & (F.sum("shingles") <= GROUP_SHINGLES)).alias("small"))
    parts = F.greatest(F.ceil(F.col("sets") / GROUP_SETS), F.ceil(F.col("shingles") / GROUP_SHINGLES))
    dealt = bands.join(families, "pivot").select(
        "pivot", "band", F.when(F.col("small"), 1).otherwise(parts).alias("parts"), F.when(F.col("small"), 0).otherwise(F.shiftleft("band", 40)).alias("base")
    )
    part = F.col("base") + F.pmod(F.xxhash64("q", F.lit(level)), F.col("parts"))
    return sets.join(dealt, ["pivot", "band"]).withColumn("part", part).drop("band", "parts", "base")


def _within_families(grouped: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """q, c: each set with the least set of its component, as far as groups of one family show it: see the module's fourth point."""
    level, known, before = 0, None, None
    todo = grouped.select("q", "n", "pivot", "part")
    while True:
        found = written(todo.join(full, "q").select("q", "set", "pivot", "part").groupBy("pivot", "part").applyInArrow(_compared(num, den), "q long, root long, pivot long, part long"), "compared")
        if known is None:
            known = found.select("q", F.col("root").alias("c"))
        else:
            known = known.join(found.select(F.col("q").alias("c"), "root"), "c", "left").select("q", F.coalesce("root", "c").alias("c"))
        several = found.groupBy("pivot").agg(F.count_distinct("part").alias("parts")).filter("parts > 1").select("pivot")
        speakers = written(found.filter("q = root").join(several, "pivot").join(grouped.select("q", "n"), "q").select("q", "n", "pivot"), "speakers")
        now, level = speakers.count(), level + 1
        # Where sets don't speak for others, another level would find little: the rest is left to the search across.
        if not now or before is not None and 2 * now > before:
            return known
        todo, before = _parted(speakers, level), now


def _across(grouped: DataFrame, full: DataFrame, near: DataFrame, num: int, den: int) -> DataFrame:
    """q, component of the sets, from near(q, c), the components that are known: see the fifth point."""
    own = grouped.join(near, "q")
    # A component's rank: links are sought from the smaller one of two.
    ranks = near.groupBy("c").agg(F.count("*").alias("size"))
    state = written(own.join(ranks, "c").select(*own.columns, F.size("toks").alias("s"), F.struct("size", "c").alias("rank")), "state")
    sizes = (F.min("n").alias("least"), F.max("n").alias("most"))
    # The token-group matrix with rarest tokens: a set meets a group at one of all but the need - 1 commonest of its own; first
    # the families, so that a token of a whole family is no row a group for sets that it doesn't help.
    heads = state.select("q", "n", "s", "pivot", "part", "rank", F.posexplode("head").alias("at", "tok"))
    matrix = written(heads.groupBy("tok", F.col("pivot").alias("g"), F.col("part").alias("p")).agg(*sizes, F.max("rank").alias("top")), "matrix")
    families = matrix.groupBy("tok", "g").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("top").alias("top"))
    fits = (F.col("least") * num <= F.col("n") * den) & (F.col("most") * den >= F.col("n") * num) & (F.col("rank") < F.col("top"))
    need = _need_of_group(num, den)
    hopeful = fits & (F.col("at") <= F.col("s") - need)
    met = heads.join(families, "tok").filter(hopeful).drop("least", "most", "top")
    other = (F.col("g") != F.col("pivot")) | (F.col("p") != F.col("part"))
    asked = met.join(matrix, ["tok", "g"]).filter(hopeful & other).select("q", "g", "p", need.alias("need"))
    asked = written(asked.groupBy("q", F.col("g").alias("pivot"), F.col("p").alias("part")).agg(F.min("need").alias("need")), "asked")
    discard(matrix)
    if asked.isEmpty():
        discard(state, asked)
        return near.withColumnRenamed("c", "component")
    # The overlap of each set that asks with each group's token union.
    members, queries = _salted(state, asked)
    tokens = state.select("q", "toks")
    side = lambda df: df.join(tokens, "q").groupBy("pivot", "part", "salt")
    bound = written(side(members).cogroup(side(queries)).applyInArrow(_bounded, "q long, pivot long, part long"), "bound")
    # Opening.
    members, queries = _salted(state, bound)
    members, queries = members.join(near, "q"), queries.join(near, "q")
    by = ["pivot", "part", "salt"]
    side = lambda df: df.select("q", "c", *by).join(full, "q").toDF("q", "c", *by, "set").groupBy(*by)
    links = components(side(members).cogroup(side(queries)).applyInArrow(_opened(num, den), "a long, b long"))
    out = written(near.join(links.select(F.col("node").alias("c"), "component"), "c", "left").select("q", F.coalesce("component", "c").alias("component")), "labels")
    discard(state, asked, bound)
    return out


def _salted(state: DataFrame, asking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of groups that asking(q, pivot, part) names, and asking, with salt: at most GROUP_QUERIES or so ask one copy of a group."""
    salts = asking.groupBy("pivot", "part").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("salts"))
    members = state.select("q", "pivot", "part").join(salts, ["pivot", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    queries = asking.join(salts, ["pivot", "part"]).withColumn("salt", F.expr("cast(pmod(xxhash64(q), salts) as int)"))
    return members.drop("salts"), queries.drop("salts")


def _told(rows: DataFrame, named: DataFrame) -> DataFrame:
    """k, n_shingles, class_id, component_id of rows(k, n, sig, sig2), from the classes that have copies or links. Classes with very many
    rows are broadcast, the rest are shuffled; sets without a word are looked up nowhere."""
    on = ["sig", "sig2", "n"]
    hot = F.col("copies") > HOT_SHARE * rows.count()
    facts = lambda which: named.filter(which).select(*on, "rep", "component")
    first = rows.join(F.broadcast(facts(hot)), on, "left")
    done = F.col("rep").isNotNull() | (F.col("n") == 0)
    other = first.filter(~done).drop("rep", "component").join(facts(~hot), on, "left")
    ids = first.filter(done).unionByName(other)
    return ids.select("k", F.col("n").alias("n_shingles"), F.coalesce("rep", "k").alias("class_id"), F.coalesce("component", "k").alias("component_id"))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 4: four-word shingles, Jaccard of at least 0.85, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = similar_components(docs, size=4, num=85, den=100)
    return found.select(id_of("k").alias("doc_id"), "n_shingles", id_of("component_id").alias("component_id"))
