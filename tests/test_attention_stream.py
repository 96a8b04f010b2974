"""Attention as a stream of messages sorted by node."""

import numpy as np
import pyarrow as pa
import pytest
from plain_layers import numpy_attended
from pyspark.sql import functions as F

from strandgraph.operators import attention as att
from strandgraph.operators.skew import _fewer, hot_keys


def _model(rng, width, edge=None):
    return att.Attention(rng.normal(size=(6, width)), rng.normal(size=(6, width)), rng.normal(size=(2, 3)), rng.normal(size=3), None if edge is None else rng.normal(size=(6, edge)))


@pytest.mark.parametrize("width, edge", [(4, None), (9, None), (4, 2)])
def test_segments(width, edge):
    """Batches end anywhere; messages to unknown nodes go; nodes without any have the bias."""
    rng = np.random.default_rng(3)
    p, x = _model(rng, width, edge), rng.normal(size=(7, width)) * 20
    late = width < 6
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 7, 60), rng.integers(0, 9, 60)) if b != 3]
    attr = [rng.normal(size=2).tolist() for _ in edges]
    rows = [(i, 0, (x[i] @ p.right.T).tolist(), None) for i in range(7)] + [(b, 1, (x[a] if late else x[a] @ p.left.T).tolist(), w) for (a, b), w in zip(edges, attr)]
    rows = [(("q", k), *rest) for k, *rest in sorted(rows, key=lambda r: r[:2])]
    kind = pa.struct([("query", pa.string()), ("idx", pa.int64())])
    columns = [pa.array([{"query": r[0][0], "idx": r[0][1]} for r in rows], kind), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))]
    columns += [pa.array([r[3] for r in rows], pa.list_(pa.float64()))] if edge else []
    whole = pa.RecordBatch.from_arrays(columns, names=["dst", "kind", "v", "attr"][: len(columns)])
    mine = [(e, a) for e, a in zip(edges, attr) if e[1] < 7]
    want = numpy_attended([e for e, _ in mine], x, x, p, [a for _, a in mine])
    for size in (1, 2, 5, 100):
        batches = [whole.slice(a, size) for a in range(0, len(rows), size)]
        got = {r["idx"]["idx"]: r["out"] for b in att._segments(p, late, False)(iter(batches)) for r in b.to_pylist()}
        assert sorted(got) == list(range(7)) and np.allclose([got[i] for i in range(7)], want)
        parts = [r for b in att._segments(p, late, True)(iter(batches)) for r in b.to_pylist()]
        assert len(parts) == 2 * len({e[1] for e, _ in mine})


def test_one_shuffle_a_side(spark):
    """No window and no second shuffle of messages; a hot node in parts is as one."""
    rng = np.random.default_rng(4)
    p, x = _model(rng, 4), rng.normal(size=(5, 4))
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 5, 80), rng.choice([0, 0, 0, 0, 1, 2], 80))]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>")
    table = spark.createDataFrame(edges, "src long, dst long")
    plain = att.attended(table, nodes, nodes, p)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 3
    want = numpy_attended(edges, x, x, p)
    assert np.allclose([r.out for r in plain.orderBy("idx").collect()], want)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(att, "ROWS", 10)
        m.setattr(att, "hot_keys", lambda many, *keys: hot_keys(many, *keys, rows=10))
        assert np.allclose([r.out for r in att.attended(table, nodes, nodes, p).orderBy("idx").collect()], want)


def test_hot_keys_are_few(spark):
    """Without a hot key there is no table of them; with one it alone is there, though no task has it more often than others."""
    rows = spark.range(4000).select((F.col("id") % 400).alias("a"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("b")).repartition(4)
    none, hot = hot_keys(rows, ["a"], ["b"], rows=1000)
    assert none is None and [tuple(r) for r in hot.collect()] == [(-1, 2)]


def test_frequent_values_outlast_the_others():
    """Counts that fall lose no value that is frequent."""
    rng = np.random.default_rng(1)
    values, times, lost = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for _ in range(50):
        new = np.concatenate([np.full(30, -7), rng.integers(0, 10**9, 100)])
        values, times, fell = _fewer(np.concatenate([values, new]), np.concatenate([times, np.ones(len(new), np.int64)]), 40)
        lost += fell
    assert times[values == -7].sum() + lost >= 1500


def test_gate_and_update_read_vectors_once(spark):
    """Gate, residual and normalisation are one step on batches each, not lambdas within lambdas; a node without aggregate has its own state."""
    rng = np.random.default_rng(6)
    x, outs, gate = rng.normal(size=(4, 8)), rng.normal(size=(2, 3, 8)) * 30, (rng.normal(size=(3, 8)), rng.normal(size=3), rng.normal(size=3))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>")
    rows = spark.createDataFrame([(i, outs[r, i].tolist()) for r in (0, 1) for i in range(3) if (r, i) != (1, 2)], "idx long, out array<double>")
    got = att.updated(nodes, att.gated(rows, *gate))
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    logit = np.tanh(outs @ gate[0].T + gate[1]) @ gate[2]
    logit[1, 2] = -np.inf
    w = np.exp(logit - logit.max(0))
    y = x.copy()
    y[:3] += ((w / w.sum(0))[:, :, None] * outs).sum(0)
    want = np.maximum((y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + 1e-5), 0)
    assert np.allclose([r.x for r in got.orderBy("idx").collect()], want)


def test_tables_that_grow_are_not_broadcast(spark):
    """However small their files are: nodes that edges are resolved by, and ids that new ones are held against."""
    from strandgraph.operators import graph
    from strandgraph.plans.lineage import cut

    nodes = cut(spark.range(20000).select(F.lit("a").alias("ntype"), F.col("id").alias("idx"), F.lpad(F.col("id").cast("string"), 12, "0").alias("id"), F.array().cast("array<double>").alias("x")))
    ends = nodes.select(F.lit("a").alias("src_type"), F.lit("r").alias("rel"), F.lit("a").alias("dst_type"), F.col("id").alias("src_id"), F.col("id").alias("dst_id"))
    for df in (graph.resolved(ends, nodes), graph.conflicts(nodes, nodes.select("ntype", "id"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 20000
