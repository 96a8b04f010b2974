"""Steps of graph tables: what edges are made from runs once, and frequent keys are found without a gathering task."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.operators import graph, skew
from strandgraph.plans.lineage import as_table, cut


def test_both_directions_of_one_join(spark):
    """the join that gives the edges is in the plan once."""
    ends = spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 10).alias("dst")).hint("merge")
    edges = spark.range(4).select(F.lit("a").alias("src_type"), F.lit("r").alias("rel"), F.lit("b").alias("dst_type"), F.col("id").alias("src"), F.col("id").alias("k")).join(ends, "k")
    both = graph.both_directions(edges, "back")
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    want = [("a", "r", "b", i, 10 * i) for i in range(4)] + [("b", "back", "a", 10 * i, i) for i in range(4)]
    assert sorted(map(tuple, both.collect())) == sorted(want) and both.columns == [*graph.RELATION, "src", "dst"]


def test_a_table_is_not_written_again(spark):
    table = cut(spark.range(3).toDF("x"))
    assert as_table(table) is table
    other = table.filter("x > 0")
    again = as_table(other)
    assert again is not other and sorted(r.x for r in again.collect()) == [1, 2]


def test_hot_keys_gather_no_rows(spark, monkeypatch):
    """rows are counted where they are; a limit would send each task's first ones to one task."""
    many = cut(spark.range(100).select(F.when(F.col("id") < 60, F.lit(7)).otherwise(F.col("id")).alias("a"), (F.col("id") % 2).alias("b")))

    def limit(self, n):
        raise AssertionError("rows are gathered")

    monkeypatch.setattr(DataFrame, "limit", limit)
    a, b = skew.hot_keys(many, ["a"], ["b"], rows=30)
    assert [tuple(r) for r in a.collect()] == [(7, 2)] and sorted(map(tuple, b.collect())) == [(0, 2), (1, 2)]
    assert skew.hot_keys(many, ["a"], rows=100) == [None]


def test_frequent_values_of_many_batches(monkeypatch):
    """Whatever is let go of, no frequent value is missed."""
    monkeypatch.setattr(skew, "HELD", 40)
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(300, 11), np.full(200, 12), rng.integers(1000, 9000, 500)])
    columns = [rng.permutation(values), rng.permutation(values)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + 7]) for c in columns], names=["h0", "h1"]) for a in range(0, 1000, 7)]
    found = list(skew._frequent(0.15)(iter(batches)))
    assert [f.column(0).to_pylist()[0] for f in found] == [0, 1] and all({11, 12} <= set(f.column(1).to_pylist()) for f in found)
    assert list(skew._frequent(0.1)(iter([]))) == []
