"""Packed k-mers, classes of equal sketches and the inverted index against plain versions."""

import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.functions import sequence as seqf
from strandgraph.operators import sketch as sk
from strandgraph.operators import sketch_index
from strandgraph.plans import standins as st


def canonical(kmer):
    return min(kmer, kmer[::-1].translate(str.maketrans("ACGT", "TGCA")))


@pytest.mark.parametrize("k", [1, 2, 3, 8, 21, 31])
def test_packed(k):
    rng = random.Random(k)
    s = "".join(rng.choice("ACGT") for _ in range(90))
    value = lambda kmer: int("".join(str("ACGT".index(x)) for x in kmer), 4)
    packed = seqf.packed_kmers(seqf._CODES[np.frombuffer(s.encode(), np.uint8)], k)
    assert packed.tolist() == [value(canonical(s[i : i + k])) for i in range(len(s) - k + 1)]
    a, b = seqf.MULTIPLIERS
    for x, h in zip(packed.tolist(), seqf.kmer_hash(packed).tolist()):
        x = x * a % 2**64
        x = (x ^ x >> 32) * b % 2**64
        assert h == (x ^ x >> 29) >> 4


def test_sketch(spark, monkeypatch):
    """Rows of one id, other letters, and sequences over pieces' borders."""
    monkeypatch.setattr(seqf, "PIECE", 50)
    rng = random.Random(1)
    rows = [(i % 5, "".join(rng.choice("ACGTACGTACGTN" if i % 2 else "ACGT") for _ in range(n))) for i, n in enumerate((0, 3, 6, 7, 8, 40, 49, 50, 51, 120, 400))] + [(7, None), (8, "acgtacgtacgt"), (9, "éACGTACGTé")]
    k, scaled, want = 7, 3, {}
    for i, s in rows:
        for kmer in (s[j : j + k] for j in range(len(s or "") - k + 1)):
            if re.fullmatch("[ACGT]+", kmer):
                (h,) = seqf.kmer_hash(seqf.packed_kmers(seqf._CODES[np.frombuffer(kmer.encode(), np.uint8)], k)).tolist()
                if h < sk.TOP // scaled:
                    want[i, h] = want.get((i, h), 0) + 1
    got = sk.sketch(spark.createDataFrame(rows, "id long, seq string"), k, scaled).collect()
    assert {(r.id, r.hash): r.abund for r in got} == want and len(got) == len(want)


def test_many_equal_sequences(spark):
    """A hundred thousand copies are as many rows of members, no pair, and a best match each."""
    n = 100_000
    rows = spark.range(n).selectExpr("id", "explode(array(5L, 6L, 7L)) AS hash").unionByName(spark.createDataFrame([(n + 1, 5), (n + 1, 6), (n + 1, 7), (n + 1, 8)], "id long, hash long"))
    found = sk.classes(rows)
    pairs = sk.similar_classes(found, 0.5)
    assert [tuple(r) for r in pairs.collect()] == [(0, n + 1, 0.75)]
    assert found.members.count() == n + 1 and found.members.filter(f"class_id <> 0 AND id <> {n + 1}").isEmpty()
    best = sk.best_of_classes(found, pairs)
    assert best.count() == n + 1 and best.filter(f"query_id BETWEEN 1 AND {n} AND (ref_id <> 0 OR score <> 1)").isEmpty()
    assert {r.query_id: (r.ref_id, r.score) for r in best.filter(f"query_id IN (0, {n + 1})").collect()} == {0: (1, 1.0), n + 1: (0, 0.75)}


def sketches(seed, n, first=0):
    rng = random.Random(seed)
    sets = {}
    for i in range(first, first + n):
        base = sets[rng.choice(list(sets))] if sets and rng.random() < 0.6 else set(rng.sample(range(200), rng.randrange(1, 25)))
        sets[i] = set(base) if rng.random() < 0.4 else {x for x in base if rng.random() < 0.9} | {rng.randrange(200)}
    return sets


def frame(spark, sets):
    return spark.createDataFrame([(i, h) for i, s in sets.items() for h in s], "id long, hash long")


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_classes(spark, threshold):
    sets = sketches(2, 60)
    found = sk.classes(frame(spark, sets))
    pairs = sk.similar_classes(found, threshold)
    want = {(a, b): jaccard(sets[a], sets[b]) for a in sets for b in sets if a != b and jaccard(sets[a], sets[b]) >= threshold}
    assert {(r.query_id, r.ref_id): r.score for r in sk.expanded(found, pairs).collect()} == want
    best = {a: min((-s, b) for (x, b), s in want.items() if x == a) for a in {x for x, _ in want}}
    assert {r.query_id: (-r.score, r.ref_id) for r in sk.best_of_classes(found, pairs).collect()} == best
    assert {r.id: r.class_id for r in found.members.collect()} == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}


def below_exchange(plan, table):
    """Whether a scan of the table in a plan's text is below an Exchange, looking up to the next join."""
    lines = plan.split("\n")
    depth = lambda x: len(re.match(r"[ :+|*()\d-]*", x)[0])
    scans = [i for i, x in enumerate(lines) if f"{table}[" in x and "Scan" in x]
    assert scans, f"no scan of {table}"
    for i in scans:
        at = depth(lines[i])
        for x in reversed(lines[:i]):
            if depth(x) < at:
                at = depth(x)
                if "Join" in x:
                    break
                if "Exchange" in x:
                    return True
    return False


def test_index(spark, tmp_path):
    """A library that grows in two steps; a probe gives jaccard_pairs' rows and shuffles no table of the library."""
    name = f"lib_{uuid.uuid4().hex}"
    refs, more, asked = sketches(3, 40), sketches(4, 25, 100), sketches(5, 15)
    asked |= {900: set(refs[3]), 901: set(range(1000, 1010)), 902: more[101] | {5000}}
    path = f"file://{tmp_path}/index"
    sketch_index.add_sketches(frame(spark, refs), name, path)
    for every in (refs, refs | more):
        if every is not refs:
            sketch_index.add_sketches(frame(spark, more), name, path)
        for t in (0.05, 0.5, 1.0):
            want = {(a, b): jaccard(asked[a], every[b]) for a in asked for b in every if jaccard(asked[a], every[b]) >= t}
            assert {(r.query_id, r.ref_id): r.score for r in sketch_index.probe(frame(spark, asked), name, t).collect()} == want
    with pytest.raises(ValueError, match="101"):
        sketch_index.add_sketches(frame(spark, {101: {1}}), name, path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sketch_index.probe(frame(spark, asked), name, 0.5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not below_exchange(plan, f"{name}_postings") and not below_exchange(plan, f"{name}_sets")


def test_kmer_text(spark):
    from pyspark.sql import functions as F

    from strandgraph.operators.embed import kmer_text

    rows = ["", "A", "ACGT", "ACGTA", "ACGTACGTAC", "éACGTA", None]
    got = [r.t for r in spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string").orderBy("i").select(kmer_text(F.col("s"), 4).alias("t")).collect()]
    assert got == [None if s is None else s if len(s) < 4 else " ".join(s[i : i + 4] for i in range(len(s) - 3)) for s in rows]


def test_bands(spark):
    """Minima of bands find nearly all pairs, and none that isn't one."""
    from strandgraph.plans.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    exact = {(r.class_a, r.class_b): r.score for r in QUERIES["class_pairs"](spark, folder).collect()}
    found = {(r.class_a, r.class_b): r.score for r in QUERIES["lsh_pairs"](spark, folder).collect()}
    assert found.items() <= exact.items() and len(found) >= 0.9 * len(exact) > 0


def test_hashes_of_one_set_make_no_head(spark):
    """Only sets that share a hash are ranked, and heads hold shared hashes alone, the rarest first."""
    sets = {i: range(100 * i, 100 * i + 10) for i in range(50)} | {100: [*range(10, 18), 5000], 101: [*range(10, 18), 5001]}
    rows = frame(spark, sets).groupBy(F.col("id").alias("query_id")).agg(F.collect_set("hash").alias("hashes"))
    seen = rows.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("df")).filter("df > 1")
    ranks = {r.query_id: r for r in sk._ranked(rows, seen, "query_id", 0.5).collect()}
    assert set(ranks) == {100, 101} and all(r.n == 9 and sorted(r.hashes) == sorted(sets[i]) for i, r in ranks.items())
    # Of nine hashes five are a head, of which one is alone.
    assert [list(ranks[i].head) for i in (100, 101)] == [[10, 11, 12, 13]] * 2
    assert [(r.query_id, r.ref_id, r.score) for r in sk.similar_pairs(frame(spark, sets), 0.5).collect()] == [(100, 101, 0.8)]


def test_sketch_sets(spark):
    """One row a sketch, whether an id has one row or several."""
    rng = random.Random(12)
    rows = [(i % 20, "".join(rng.choice("ACGTN" if i % 3 else "ACGT") for _ in range(rng.choice([0, 5, 300])))) for i in range(30)] + [(50, None), (51, "")]
    df = spark.createDataFrame(rows, "id long, seq string")
    want = {}
    for r in sk.sketch(df, 11, 3).collect():
        want.setdefault(r.id, set()).add(r.hash)
    got = sk.sketch_sets(df, 11, 3).collect()
    assert len(got) == len(want) and {r.id: r.hashes for r in got} == {i: sorted(h) for i, h in want.items()}


def test_sequences_letter_by_letter(spark, tmp_path):
    """The stand-in is that of the column function, for every kind of text."""
    texts = [None, "", "Hello, World! 123", "İKßé ÄÖ z\x00y", "ACGT acgt", "語 a", "\n\t", "x" * 700_000 + "é" + "Q" * 10, None, "ſtop"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = {r.doc_id: r.s for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", st.dna(F.col("text")).alias("s")).collect()}
    assert {r.seq_id: r.seq for r in st.sequences(spark, str(tmp_path)).collect()} == want
