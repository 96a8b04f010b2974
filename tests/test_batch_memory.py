"""What a Python task holds doesn't grow with its input."""

import tracemalloc

import numpy as np
import pyarrow as pa

from strandgraph.functions import sequence as seqf
from strandgraph.operators import scoring


def test_hashes_of_a_large_batch():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ACGTN"), n, p=[0.24, 0.25, 0.25, 0.25, 0.01])) for n in rng.integers(0, 3000, 60)] * 60
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "seq"])
    run = seqf._kept_hashes(21, (1 << 60) // 20)
    first = [r for b in run(iter([batch.slice(0, 60)])) for r in b.to_pylist()]
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 60 * len(first) and peak < 40e6


def test_top_candidates_hold_few_products(spark, monkeypatch):
    """Many small steps find what one does, ties and left-out pairs included."""
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (90, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>")
    q = rows.filter("idx % 2 = 0").withColumnRenamed("idx", "query_id")
    but = spark.createDataFrame([(0, 4), (2, 7), (88, 1)], "query_id long, idx long")
    d = x @ x.T
    for a, b in [(0, 4), (2, 7), (88, 1)] + [(i, i) for i in range(90)]:
        d[a, b] = -np.inf
    want = {(i, n + 1): int(j) for i in range(0, 90, 2) for n, j in enumerate(np.argsort(-d[i], kind="stable")[:3])}
    for products in (200, 1 << 20):
        monkeypatch.setattr(scoring, "PRODUCTS", products)
        got = {(r.query_id, r["rank"]): r.idx for r in scoring.top_candidates(q, rows, 0.0, 3, but_itself=True, but=but).collect()}
        assert got == want
    assert scoring.PRODUCTS * 8 < 10e6
