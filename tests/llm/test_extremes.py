"""Texts that are long or odd enough to end a task."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import leaks, licences
from strandgraph.llm.text import NOT_ALNUM, Words, text_chunks


def test_many_title_lines(spark):
    """op7: a hundred thousand titles before a licence are titles, and nothing nests."""
    text = dict(licences.KNOWN)["MIT"]
    rows = [(1, "MIT License\n" * 100_000 + text), (2, "# The MIT License (MIT)\n\n" + text), (3, "MIT License\n" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license for r in licences.scanned(df, licences.known_licences(spark)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None}


def test_neighbours_of_one_spelling(spark):
    (a, b) = licences.SPELLINGS[0]
    df = spark.createDataFrame([(f"x {a} {a} {a} y",)], "text string")
    assert df.select(licences.canonical(F.col("text")).alias("t")).first().t == f"x {b} {b} {b} y"


def test_items_of_one_template():
    """op9: two thousand items begin alike, and a shard has that beginning twenty thousand times; work isn't their product."""
    head = "answer the question below by one of the letters"
    block = leaks.Suffixes([(f"i{n}", f"{head} now item{n} ends") for n in range(2000)], 10)
    shard = pa.RecordBatch.from_arrays([pa.array([f"{head} now " * 10_000 + "q"] * 2 + ["other words"])], names=["text"])
    ((_, data, bounds),) = text_chunks(shard, limit=64 << 20)
    h, first = leaks._ended(Words(data, bounds, NOT_ALNUM))
    began = time.process_time()
    found = leaks.Found(h, block)
    assert time.process_time() - began < 20
    assert len(found.place) <= len(h)
    owner = np.searchsorted(first, found.place, side="right") - 1
    pairs = found.items_of(owner)
    assert pairs.shape[1] == 4000 and set(pairs[0].tolist()) == {0, 1}


@pytest.mark.parametrize("name", ["op1_warc", "op2_quality_rules", "op3_sharding", "op6_url_filters", "op7_license_scans", "op9_benchmark_decontamination", "op10_token_ids"])
def test_long_texts(spark, name, tmp_path_factory):
    """One word of 8 MB, only blanks, and one line a thousand times."""
    from small_tables import tables

    from strandgraph.llm.queries import QUERIES

    texts = ["x" * (8 << 20), " " * (8 << 20), "one line of words\n" * 1000]
    folder = tables(spark, tmp_path_factory.mktemp("long"), list(enumerate(texts)), [(1, texts[2])], [(i, f"http://h.example/{i}", t) for i, t in enumerate(texts)])
    assert QUERIES[name](spark, folder).count() == 3
