"""Scores of queries against all candidates, and of given pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions.vectors import cosine, dot, sigmoid
from strandgraph.operators.skew import hot_keys, spread_join
from strandgraph.plans.lineage import cut

#: Candidates of a block, and queries of a slice that meets it.
BLOCK = 32768
SLICE = 32768
#: Candidates of a group within a block, whose products are bounded before they are made.
GROUP = 128
#: Bounds, and products, of some queries that are held at a time.
PRODUCTS = 1 << 20


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("x").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _grouped(x: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in an order in which near ones stand together, that order, and where its groups begin: halves of halves along the widest axis,
    of at most GROUP rows, within a group by idx."""
    done, parts = [], [np.arange(len(x))]
    while parts:
        part = parts.pop()
        if len(part) <= GROUP:
            done.append(part[np.argsort(idx[part])])
            continue
        mine = x[part]
        half, axis = len(part) // 2, int(np.argmax(mine.max(0) - mine.min(0)))
        order = np.argpartition(mine[:, axis], half)
        parts += [part[order[half:]], part[order[:half]]]
    by = np.concatenate(done)
    return x[by], by, np.cumsum([0] + [len(part) for part in done])[:-1]


def _met(ask: np.ndarray, offer: np.ndarray, idx: np.ndarray, first: np.ndarray, k: int, products: int, row: np.ndarray, but: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """idx and dot product (to 12 decimals) of each query's k best of offer, in groups from first on (see _grouped), by product and the smaller
    idx; -inf where there are fewer. row, but: places in ask (or -1) and idx that don't count for them.

    A group lies in a box, and no vector in it has a larger product with a query than the box's own corner. A query meets the group of the
    largest bound first, then all others whose bound reaches what it has. Bounds of `products` pairs are held at a time."""
    last, n, wide = np.append(first[1:], len(idx)), len(first), offer.shape[1]
    low, high = np.minimum.reduceat(offer, first), np.maximum.reduceat(offer, first)
    most = np.sqrt((offer * offer).sum(1).max())
    # Pairs that don't count, by group.
    sort = np.argsort(idx, kind="stable")
    begin, end = (np.searchsorted(idx, but, side, sorter=sort) for side in ("left", "right"))
    many = np.where(row >= 0, end - begin, 0)
    row, at = np.repeat(row, many), sort[np.arange(many.sum()) + np.repeat(begin - np.cumsum(many) + many, many)]
    by = np.lexsort((row, at))
    row, at = row[by], at[by]
    begin = np.searchsorted(at, np.append(first, len(idx)))
    found, best = np.full((len(ask), k), np.iinfo(np.int64).max), np.full((len(ask), k), -np.inf)

    def meet(g: int, rows: np.ndarray) -> None:
        """Some queries, in order, and a group."""
        d = ask[rows] @ offer[first[g] : last[g]].T
        top = d.max(1)
        if begin[g] < begin[g + 1] or not np.isfinite(top).all():
            d[np.isnan(d)] = -np.inf
            r = row[begin[g] : begin[g + 1]]
            to = np.minimum(np.searchsorted(rows, r), len(rows) - 1)
            mine = rows[to] == r
            d[to[mine], at[begin[g] : begin[g + 1]][mine] - first[g]] = -np.inf
            top = d.max(1)
        some = np.flatnonzero(np.round(top, 12) >= best[rows, -1])
        if not len(some):
            return
        d, rows = np.round(d[some], 12), rows[some]
        order = np.argsort(-d, axis=1, kind="stable")[:, :k] if k > 1 else d.argmax(1)[:, None]
        both = np.concatenate([best[rows], np.take_along_axis(d, order, 1)], 1)
        names = np.concatenate([found[rows], idx[first[g] + order]], 1)
        order = np.lexsort((names, -both))[:, :k]
        best[rows], found[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    step = max(1, products // max(n, GROUP))
    for a in range(0, len(ask), step):
        x = ask[a : a + step]
        bound = high @ np.maximum(x, 0).T + low @ np.minimum(x, 0).T
        # More than rounding comes to, here and in products.
        bound += 1e-11 + 1e-14 * wide * most * np.sqrt((x * x).sum(1))
        bound[np.isnan(bound)] = np.inf
        start = bound.argmax(0)
        order = np.argsort(start, kind="stable")
        each, begins = np.unique(start[order], return_index=True)
        for g, rows in zip(each.tolist(), np.split(order, begins[1:])):
            meet(g, a + rows)
        bound[start, np.arange(len(x))] = -np.inf
        for g in range(n):
            rows = np.flatnonzero(bound[g] > np.maximum(best[a : a + step, -1], -1e300))
            if len(rows):
                meet(g, a + rows)
    return found, best


def top_candidates(queries: DataFrame, candidates: DataFrame, logit_scale: float = 1.0, k: int = 1, but_itself: bool = False, but: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """query_id, idx, score, rank: the k candidates of highest sigmoid(dot * exp(logit_scale)); of equal scores (to 12 decimals
    of the dot product) the smaller idx first. but_itself: a candidate whose idx is the query's id is no candidate of it. but(query_id,
    idx): pairs that don't count. more(query_id, idx, x): candidates of one query alone.

    Candidates are dealt to blocks and queries to slices; a slice meets a block in one task that keeps its own k best. Both are keyed by
    (slice, block), so neither side is broadcast or gathered, and each query has k rows a block, of which the best k are picked. Near
    candidates of a block are a group, which a query leaves out only where no vector within the group's bounds reaches its k best so far (see _met):
    what is found is exact. Pairs that don't count go to the block of their candidate.
    """
    n_slices, n_blocks = max(1, -(-queries.count() // SLICE)), max(1, -(-candidates.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vector = F.col("x").cast("array<double>").alias("x")
    slice_of, block_of = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("query_id", n_slices), ("idx", n_blocks)))
    asking = queries.select("query_id", vector, F.lit(None).cast("long").alias("but"), slice_of.alias("slice"), every(n_blocks).alias("block"))
    if but is not None:
        asking = asking.unionByName(but.select("query_id", F.lit(None).cast("array<double>").alias("x"), F.col("idx").cast("long").alias("but"), slice_of.alias("slice"), block_of.alias("block")))
    offered = candidates.select("idx", vector, block_of.alias("block"), every(n_slices).alias("slice"))

    def best(asking: pa.Table, rows: pa.Table) -> pa.Table:
        told = asking.column("but").is_valid()
        never, asking = asking.filter(told), asking.filter(pc.invert(told))
        ids, idx = asking.column("query_id"), rows.column("idx").to_numpy()
        if not len(ids) or not len(idx):
            return pa.table([ids.slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "idx", "d"])
        offer, by, first = _grouped(_matrix(rows), idx)
        idx = idx[by]
        place = {q: i for i, q in enumerate(ids.to_pylist())} if len(never) else {}
        row, but = np.array([place.get(q, -1) for q in never.column("query_id").to_pylist()], np.int64), never.column("but").to_numpy()
        if but_itself:
            row, but = np.append(row, np.arange(len(ids))), np.append(but, ids.to_numpy())
        found, d = _met(_matrix(asking), offer, idx, first, k, PRODUCTS, row, but)
        at, nth = np.nonzero(d > -np.inf)
        return pa.table([ids.combine_chunks().take(pa.array(at)), pa.array(found[at, nth]), pa.array(d[at, nth])], names=["query_id", "idx", "d"])

    # A stated set of queries against all candidates, block by block.
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, idx long, d double"
    met = asking.groupBy("slice", "block").cogroup(offered.groupBy("slice", "block")).applyInArrow(best, schema)
    if more is not None:
        own = queries.select("query_id", F.col("x").cast("array<double>").alias("a")).join(more.select("query_id", "idx", vector), "query_id")
        met = met.unionByName(own.select("query_id", F.col("idx").cast("long").alias("idx"), F.round(dot(F.col("a"), F.col("x")), 12).alias("d")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("d"), "idx"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "idx", sigmoid(F.col("d") * F.exp(F.lit(float(logit_scale)))).alias("score"), "rank")


def _both_ends(pairs: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """pairs with the vectors of their ends, xs and xd; ends that very many pairs share are met in several tasks."""
    pairs = cut(pairs, "pairs")
    hot_src, hot_dst = hot_keys(pairs, ["src"], ["dst"])
    left = spread_join(pairs, src.select(F.col("idx").alias("src"), F.col("x").alias("xs")), ["src"], hot_src)
    return spread_join(left, dst.select(F.col("idx").alias("dst"), F.col("x").alias("xd")), ["dst"], hot_dst)


def decoded_pairs(pairs: DataFrame, src: DataFrame, dst: DataFrame, logit_scale: float = 1.0) -> DataFrame:
    """pairs(src, dst) with logit: cosine times exp(logit_scale). Pairs with an unknown end go."""
    both = _both_ends(pairs, src, dst)
    return both.select("src", "dst", (cosine(F.col("xs"), F.col("xd")) * F.exp(F.lit(float(logit_scale)))).alias("logit"))


def decoded_by_network(pairs: DataFrame, src: DataFrame, dst: DataFrame, hidden: np.ndarray, bias: np.ndarray, out: np.ndarray, out_bias: float = 0.0) -> DataFrame:
    """pairs(src, dst) with logit: two linear maps with ReLU between, over both ends' vectors one after the other. The first map is a sum of
    one of each end, made once a node, where it is narrower than the node's vector; what is narrower travels with a pair."""
    w, b, o = (np.asarray(v, dtype=float) for v in (hidden, bias, out))
    first = src.select(F.size("x").alias("n")).first()
    width = first.n if first else 0

    def mapped(part: np.ndarray):
        @F.pandas_udf("array<double>")
        def apply(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(x.to_numpy()) @ part.T)) if len(x) else pd.Series([], dtype=object)

        return apply

    narrow = [len(w) < part.shape[1] for part in (w[:, :width], w[:, width:])]
    ends = [df.select("idx", mapped(part)("x").alias("x")) if thin else df for df, part, thin in zip((src, dst), (w[:, :width], w[:, width:]), narrow)]
    maps = [np.eye(len(w)) if thin else part for part, thin in zip((w[:, :width], w[:, width:]), narrow)]

    @F.pandas_udf("double")
    def apply(xs: pd.Series, xd: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype=float)
        return pd.Series(np.maximum(np.stack(xs.to_numpy()) @ maps[0].T + np.stack(xd.to_numpy()) @ maps[1].T + b, 0.0) @ o + out_bias)

    return _both_ends(pairs, *ends).select("src", "dst", apply("xs", "xd").alias("logit"))
