"""Queries without SQL take whole vectors: against numpy on a small fixture."""

import numpy as np
import pytest
from plain_layers import numpy_attended

from strandgraph.plans import queries
from strandgraph.plans.standins import HIDDEN

WIDTH = 11


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Three customers, four parts and two suppliers; the vectors of number 1 and 2 differ past the eighth number only."""
    d, rng = tmp_path_factory.mktemp("wide"), np.random.default_rng(5)
    x = rng.normal(size=(5, WIDTH)).astype(np.float32)
    x[2, :8] = x[1, :8]
    tables = {
        "embeddings": ([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"),
        "customer": ([(1, 0), (2, 0), (3, 0)], "c_custkey long, c_nationkey int"),
        "part": ([(1,), (2,), (3,), (4,)], "p_partkey long"),
        "supplier": ([(1, 0), (2, 0)], "s_suppkey long, s_nationkey int"),
        "orders": ([(1, 1), (2, 2), (3, 3)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(1, 1, 1), (2, 1, 1), (3, 2, 2), (3, 3, 1)], "l_orderkey long, l_partkey long, l_suppkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return str(d), x.astype(float)


def plain(x):
    """The model's vectors by type, and the edges."""
    ids = {"customer": [1, 2, 3], "part": [1, 2, 3, 4], "supplier": [1, 2]}
    buys, supplies = [(0, 0), (1, 0), (2, 1), (2, 2)], [(0, 0), (1, 1), (0, 2)]
    back = lambda e: [(b, a) for a, b in e]
    edges = {("customer", "buys", "part"): buys, ("part", "bought_by", "customer"): back(buys), ("supplier", "supplies", "part"): supplies, ("part", "supplied_by", "supplier"): back(supplies)}
    inputs, layers, final = queries.model(x.shape[1])
    state = {k: np.maximum(x[[i % len(x) for i in ids[k]]] @ w.T + b, 0) for k, (w, b) in inputs.items()}
    for p in layers:
        new = {}
        for k, own in state.items():
            outs = [numpy_attended(edges[r], state[r[0]], own, a) for r, a in p.relations.items() if r[2] == k]
            gate = np.stack([np.tanh(o @ p.gate_in.T + p.gate_bias) @ p.gate_out for o in outs])
            w = np.exp(gate - gate.max(0))
            y = own + sum((w / w.sum(0))[i][:, None] * o for i, o in enumerate(outs))
            new[k] = np.maximum((y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + 1e-5), 0)
        state = new
    out = {k: v @ final[0].T + final[1] for k, v in state.items()}
    return {k: v / np.linalg.norm(v, axis=1, keepdims=True) for k, v in out.items()}, ids, buys


def test_whole_vectors(spark, made):
    folder, x = made
    want, ids, buys = plain(x)
    got = {(r.ntype, r.idx, r.pos): r.value for r in queries.gat_embed(spark, folder).collect()}
    assert len(got) == 9 * HIDDEN
    for k, v in want.items():
        assert np.allclose([[got[k, i, p] for p in range(HIDDEN)] for i in ids[k]], v, atol=2e-6)
    scores = want["customer"] @ want["supplier"].T
    best = {r.query_id: (r.idx, r.score) for r in queries.score_hosts(spark, folder).collect()}
    for q, row in zip(ids["customer"], scores):
        assert best[q] == (ids["supplier"][row.argmax()], pytest.approx(1 / (1 + np.exp(-row.max() * np.e)), abs=2e-6))
    logits = {(r.src, r.dst): r.logit for r in queries.link_decode(spark, folder).collect()}
    assert logits == {(a + 1, b + 1): pytest.approx(float(want["customer"][a] @ want["part"][b]) * np.e, abs=5e-6) for a, b in buys}
