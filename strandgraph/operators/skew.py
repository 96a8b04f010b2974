"""Joins of many rows with one row a key, where a few keys may have a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key in one task, about.
ROWS = 1_000_000


#: Different keys that a task counts at a time.
HELD = 1_000_000


def hot_keys(many: DataFrame, *keys: list[str], rows: int = ROWS) -> list[DataFrame | None]:
    """For each list of keys a table keys, _tasks: those with more than `rows` rows, and the tasks that they need. There are no
    more of them than rows of `many` over `rows`; None where there are none. Nothing but candidates is shuffled: a key with more than
    `rows` of all n rows has that share or more of some task's rows. `many` is read several times, so it should be a table."""
    # A limit before the count would send each task's rows to one.
    n = many.count()
    if n <= rows:
        return [None] * len(keys)
    hashed = many.select(*(F.xxhash64(*k).alias(f"h{i}") for i, k in enumerate(keys)))
    found = hashed.mapInArrow(_frequent(rows / n), "place int, h long").distinct().collect()
    return [_hot(many, k, rows, [r.h for r in found if r.place == i]) for i, k in enumerate(keys)]


def _frequent(share: float):
    """The values that may be `share` of a task's rows or more, by column. Where they are too many to be counted, all counts fall by that of the
    first one left out, which `lost` adds up, so no frequent value is missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        # Values of batches since, which are put beside the held ones when there are many.
        new: list[list[np.ndarray]] = []
        n, lost, waiting = 0, [], 0

        def fold() -> None:
            for i, parts in enumerate(new):
                values = np.concatenate([held[i][0], *parts])
                times = np.concatenate([held[i][1], np.ones(len(values) - len(held[i][0]), np.int64)])
                if len(values) > HELD:
                    values, times, fell = _fewer(values, times, HELD // 2)
                    lost[i] += fell
                held[i] = values, times
                parts.clear()

        for batch in batches:
            n += batch.num_rows
            waiting += batch.num_rows
            for i, column in enumerate(batch.columns):
                if i == len(held):
                    held.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    lost.append(0)
                    new.append([])
                new[i].append(column.to_numpy())
            if waiting > HELD // 4:
                fold()
                waiting = 0
        fold()
        for i, (values, times) in enumerate(held):
            values, times, _ = _fewer(values, times, len(values))
            values = values[times + lost[i] >= share * n]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), pa.array(values)], names=["place", "h"])

    return run


def _fewer(values: np.ndarray, times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Different values with their sums of times; of more than `most` the most frequent, less what the next one has."""
    values, at = np.unique(values, return_inverse=True)
    times = np.bincount(at, times, len(values)).astype(np.int64)
    if len(values) <= most:
        return values, times, 0
    fell = int(np.partition(times, len(times) - most - 1)[len(times) - most - 1])
    return values[times > fell], times[times > fell] - fell, fell


def _hot(many: DataFrame, keys: list[str], rows: int, hashes: list[int]) -> DataFrame | None:
    if not hashes:
        return None
    some = many.filter(F.xxhash64(*keys).isin(hashes)).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    hot = some.select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_tasks"))
    found = hot.collect()
    return many.sparkSession.createDataFrame(found, hot.schema) if found else None


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """many.join(one, keys), one having a row for each key at most. A key that is hot (see hot_keys; by all of the keys or some)
    is dealt to as many tasks as it needs by a hash of its rows, so that a task that runs again deals them alike, and its row of
    `one` goes to each of these. `one` grows with the input and is never broadcast, though as compressed files it may look small enough."""
    if hot is None:
        return many.join(one.hint("merge"), keys)
    by, tasks = [k for k in hot.columns if k != "_tasks"], F.coalesce("_tasks", F.lit(1))
    dealt = many.join(F.broadcast(hot), by, "left").withColumn("_task", F.pmod(F.xxhash64(*many.columns), tasks).cast("int")).drop("_tasks")
    copied = one.join(F.broadcast(hot), by, "left").withColumn("_task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("_tasks")
    return dealt.join(copied.hint("merge"), [*keys, "_task"]).drop("_task")
