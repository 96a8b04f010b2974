"""Literal expectations, and layers against numpy."""

import numpy as np
import pytest
from plain_layers import numpy_attended
from pyspark.sql import functions as F

from strandgraph.functions import sequence as seqf
from strandgraph.functions import vectors as vec
from strandgraph.operators import attention as att
from strandgraph.operators import embed, graph, hierarchy, scoring
from strandgraph.operators import sketch as sk
from strandgraph.operators.skew import hot_keys, spread_join
from strandgraph.plans.queries import attention, model
from strandgraph.sources import fasta, sinks, tables
from strandgraph.streaming import incremental


def test_ancestors(spark):
    rows = [(562, 561, "Escherichia coli", "species"), (561, 543, "Escherichia", " Genus "), (543, 1224, "Enterobacteriaceae", "family"), (1, None, "root", "no rank"), (7, 8, "a", "x"), (8, 7, "b", "x"), (562, 561, "Escherichia coli", "species")]
    tree = fasta.taxonomy(spark.createDataFrame(rows, "taxid long, parent long, name string, rank string"))
    starts = spark.createDataFrame([(562,), (-1,), (999999,), (561,), (543,), (1,), (7,)], "taxid long")
    want = {562: "Escherichia", -1: "NA", 999999: "NA", 561: "Escherichia", 543: "NA", 1: "NA", 7: "NA"}
    assert {r.taxid: r.name for r in hierarchy.ancestors(tree, starts, "genus").collect()} == want


def test_long_ways_and_cycles(spark):
    """A chain of 300 nodes, a cycle of 90 with a tail, a null rank on the way."""
    rows = [(i, i - 1, f"n{i}", None if i == 150 else "x") for i in range(1, 300)] + [(0, 0, "top", "genus")]
    rows += [(1000 + i, 1000 + (i + 1) % 90, "c", "x") for i in range(90)] + [(2000, 1005, "tail", "x"), (3000, 4000, "lost", "x")]
    tree = spark.createDataFrame(rows, "taxid long, parent long, name string, rank string")
    got = {r.taxid: r.name for r in hierarchy.ancestors(tree, tree, "genus").collect()}
    assert got == {r[0]: "top" if r[0] < 300 else "NA" for r in rows}


def test_dense_index_of_wide_rows(spark):
    """Half a million rows with a feature column: indices without gap or repetition, in order."""
    n = 500_000
    wide = spark.range(n).select(F.concat(F.lit("k"), F.col("id") % 2).alias("kind"), F.sha2(F.col("id").cast("string"), 256).alias("id"), F.array_repeat(F.col("id").cast("double"), 8).alias("x"))
    got = graph.dense_index(wide, "kind", "id")
    by_kind = got.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("a"), F.max("idx").alias("z")).collect()
    assert len(by_kind) == 2 and all((r.n, r.d, r.a, r.z) == (n // 2, n // 2, 0, n // 2 - 1) for r in by_kind)
    steps = got.join(got.select("kind", (F.col("idx") - 1).alias("idx"), F.col("id").alias("after")), ["kind", "idx"])
    assert steps.filter("after <= id").isEmpty() and steps.count() == n - 2
    old = spark.createDataFrame([("k0", 7, "old", [0.0])], "ntype string, idx long, id string, x array<double>")
    nodes = graph.attach_nodes(old, wide.withColumnRenamed("kind", "ntype"))
    ends = {r.ntype: (r.n, r.a, r.z) for r in nodes.groupBy("ntype").agg(F.countDistinct("idx").alias("n"), F.min("idx").alias("a"), F.max("idx").alias("z")).collect()}
    assert ends == {"k0": (n // 2 + 1, 7, n // 2 + 7), "k1": (n // 2, 0, n // 2 - 1)}
    nulls = spark.createDataFrame([(None, 2), ("a", 1), (None, 1)], "kind string, id long")
    assert {(r.kind, r.id): r.idx for r in graph.dense_index(nulls, "kind", "id").collect()} == {(None, 1): 0, (None, 2): 1, ("a", 1): 0}


def test_unique_ids_with_many_taken(spark):
    """Seventy numbers in a row and every second after them are taken."""
    taken = ["s"] + [f"s_{i}" for i in range(1, 71)] + [f"s_{i}" for i in range(72, 120, 2)] + ["s_007", "s_x", "other_3"]
    got = graph.unique_ids(spark.createDataFrame([("s", i) for i in range(40)], "id string, position long"), spark.createDataFrame([(x,) for x in taken], "id string"))
    names = (f"s_{i}" for i in range(1, 999))
    want = [x for x in names if x not in taken][:40]
    assert [r.assigned_id for r in got.orderBy("position").collect()] == want


def test_similarity_edges(spark):
    rows = [("BB_query", "AA_old", 0.91), ("BB_query", "CC_old", 0.95), ("BB_query", "DD_old", 0.79), ("BB_query", "EE_old", 0.8), ("BB_query", "FF_old", 0.7999996)]
    pairs = spark.createDataFrame(rows, "query_id string, ref_id string, score double")
    got = {tuple(r) for r in sk.similarity_edges(pairs, 0.8, "phage-phage").collect()}
    assert got == {("AA_old", "BB_query", "phage-phage", 0.91), ("BB_query", "CC_old", "phage-phage", 0.95), ("BB_query", "EE_old", "phage-phage", 0.8)}
    zero = spark.createDataFrame([("a", "b", 0.0)], "query_id string, ref_id string, score double")
    assert sk.similarity_edges(zero, 0.0, "x").count() == 0
    assert sk.similarity_edges(pairs, 0.8, "x", both_ways=True).count() == 6


def test_attach(spark):
    nodes = spark.createDataFrame([("phage", 0, "old_a", [0.0] * 3), ("phage", 1, "old_b", [0.0] * 3), *[("protein", i, f"p{i}", [0.0] * 4) for i in range(3)]], "ntype string, idx long, id string, x array<double>")
    new = spark.createDataFrame([("phage", "new_query", [1.0, 2.0, 3.0]), ("protein", "new_p2", [2.0] * 4), ("protein", "new_p1", [1.0] * 4)], "ntype string, id string, x array<double>")
    out = graph.attach_nodes(nodes, new)
    assert {(r.ntype, r.id): r.idx for r in out.collect() if r.id.startswith("new")} == {("phage", "new_query"): 2, ("protein", "new_p1"): 3, ("protein", "new_p2"): 4}
    edges = spark.createDataFrame([("phage", "interacts", "phage", "old_b", "new_query"), ("phage", "interacts", "phage", "nobody", "new_query")], "src_type string, rel string, dst_type string, src_id string, dst_id string")
    assert [(r.src, r.dst) for r in graph.resolved(edges, out).collect()] == [(1, 2)]
    encodes = spark.createDataFrame([("phage", "encodes", "protein", 2, 3), ("phage", "encodes", "protein", 2, 4)], "src_type string, rel string, dst_type string, src long, dst long")
    assert {(r.rel, r.src, r.dst) for r in graph.both_directions(encodes, "encoded_by").collect()} == {("encodes", 2, 3), ("encodes", 2, 4), ("encoded_by", 3, 2), ("encoded_by", 4, 2)}
    assert graph.conflicts(nodes, new.withColumn("id", F.lit("old_a"))).count() == 1
    fresh, reused = graph.new_and_reused(nodes, spark.createDataFrame([("phage", "old_a"), ("phage", "x")], "ntype string, id string"))
    assert [r.id for r in fresh.collect()] == ["x"] and [r.idx for r in reused.collect()] == [0]


@pytest.mark.parametrize("seed", range(3))
def test_unique_ids(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["a", "a_1", "a_2", "b", "b_1", "a_1_1"]
    asked = [names[i] for i in rng.integers(0, len(names), 14)]
    existing = {"a", "b_1"} if seed else set()
    taken, want = set(existing), []
    for base in asked:
        name, i = base, 0
        while name in taken:
            i += 1
            name = f"{base}_{i}"
        taken.add(name)
        want.append(name)
    got = graph.unique_ids(spark.createDataFrame(list(zip(asked, range(len(asked)))), "id string, position long"), spark.createDataFrame([(x,) for x in existing], "id string"))
    assert [r.assigned_id for r in got.orderBy("position").collect()] == want


def test_sequence_functions(spark):
    df = spark.createDataFrame([("acgun\nac ",), ("",), ("ACGTNacgtnXy",)], "s string")
    assert [r[0] for r in df.select(seqf.normalize(F.col("s"))).collect()] == ["ACGTNAC", "", "ACGTNACGTNXY"]
    assert [r[0] for r in df.select(seqf.reverse_complement(F.col("s"))).collect()][2] == "yXnacgtNACGT"
    p = spark.createDataFrame([("MKv*#",), ("B*Z+",)], "s string")
    assert [r[0] for r in p.select(seqf.clean_protein(F.col("s"))).collect()] == ["MKX", "BXZ"]
    got = seqf.kmers(spark.createDataFrame([(1, "A" * 450 + "C"), (2, "AC"), (3, ""), (4, None)], "id int, s string"), "s", 4).groupBy("id", "kmer").count().collect()
    assert {(r.id, r.kmer): r["count"] for r in got} == {(1, "AAAA"): 447, (1, "AAAC"): 1, (2, "AC"): 1, (3, ""): 1}


def test_windows(spark):
    def plain(n, w, s):
        if n <= w:
            return [0]
        out, i = [], 0
        while i + w <= n:
            out.append(i)
            i += s
        return out + ([n - w] if i < n else [])

    cases = [(n, w, s) for n in (1, 5, 6, 7, 20, 23) for w in (3, 5, 6) for s in (1, 2, 3, 6, 7)]
    for w, s in {c[1:] for c in cases}:
        ns = [n for n, a, b in cases if (a, b) == (w, s)]
        made = [seqf.Windows(F.col("n"), w, s, most) for most in (None, 3)]
        starts = [F.transform(F.sequence(F.lit(0), x.count() - 1), x.start).alias(c) for x, c in zip(made, "xy")]
        got = spark.createDataFrame([(n,) for n in ns], "n int").select("n", *starts).collect()
        for r in got:
            want = plain(r.n, w, s)
            assert r.x == want
            assert r.y == (want if len(want) <= 3 else sorted({want[min(len(want) - 1, int(i * len(want) / 3))] for i in range(3)}))


def test_windows_of_long_sequences(spark):
    """More windows than one stretch has, of both strands, against slices."""
    seq = "".join("ACGT"[i * i % 7 % 4] for i in range(5000))
    rows = embed.windows(spark.createDataFrame([("a", seq), ("b", "AC"), ("c", ""), ("d", None)], "seq_id string, seq string"), 4, 20, 7, None, both_strands=True).collect()
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    n = len(seq) - 3
    starts = [*range(0, n - 20 + 1, 7)]
    starts += [n - 20] if starts[-1] + 7 < n else []
    want = {("a", strand, i): s[a : a + 23] for strand, s in (("+", seq), ("-", back)) for i, a in enumerate(starts)}
    want |= {("b", "+", 0): "AC", ("b", "-", 0): "GT", ("c", "+", 0): "", ("c", "-", 0): ""}
    assert {(r.seq_id, r.strand, r.win_idx): r.text for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("k", [1, 3, 8, 11])
def test_kmer_counts(spark, k):
    rows = [("ACGTACGTTACGACGTACGTTACG",), ("AC",), ("",), (None,), ("ACéGTACGTTAéGACGTACG",), ("ACGTACGT",), ("N" * 40,)]
    df = spark.createDataFrame(rows, "s string").repartition(2)
    want = {r.kmer: r.n for r in seqf.kmers(df, "s", k).groupBy("kmer").agg(F.count("*").alias("n")).collect()}
    assert {r.kmer: r.n for r in seqf.kmer_counts(df, "s", k).collect()} == want
    one, other = (x.groupBy("kmer").count().collect() for x in (seqf.kmers(df, "s", k).select(seqf.canonical(F.col("kmer")).alias("kmer")), seqf.canonical_kmers(df, "s", k)))
    assert sorted(one) == sorted(other)


def test_similar_pairs(spark):
    """Pairs from rarest hashes are all pairs: with copies, common hashes and sizes at the threshold's edge."""
    rng = np.random.default_rng(3)
    sets = [set(rng.integers(0, 40, rng.integers(1, 25)).tolist()) for _ in range(60)]
    sets += [set(sets[3]), set(range(10)), set(range(8)), set(range(5, 15)), {1}, {1}]
    df = spark.createDataFrame([(i, h) for i, s in enumerate(sets) for h in s for _ in range(1 + h % 2)], "id long, hash long")
    score = lambda a, b: len(a & b) / len(a | b)
    for t in (0.3, 0.8, 1.0):
        want = {(i, j): score(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and score(a, b) >= t}
        assert {(r.query_id, r.ref_id): r.score for r in sk.similar_pairs(df, t).collect()} == want
        some = df.filter("id % 3 = 0")
        both = {(r.query_id, r.ref_id): r.score for r in sk.jaccard_pairs(some, df.filter("id % 3 <> 0"), t).collect()}
        assert both == {(i, j): score(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i % 3 == 0 and j % 3 and score(a, b) >= t}


def test_spread_join(spark):
    many = spark.createDataFrame([(None, 0)] + [(1 if i % 3 else i, i) for i in range(300)], "key int, v int")
    one = spark.createDataFrame([(i, i * i) for i in range(0, 300, 2)] + [(1, 7)], "key int, w int")
    for rows in (20, 10**6):
        got = spread_join(many, one, ["key"], *hot_keys(many, ["key"], rows=rows))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(one, ["key"]).collect())) and got.columns == ["key", "v", "w"]


def test_layer_number():
    assert [embed.layer_number(33, x) for x in (None, 40, 33, 5, 0)] == [32, 32, 32, 5, 0]


def test_widths_must_agree(spark):
    nodes = spark.createDataFrame([("a", [1.0]), ("a", [2.0]), ("b", [1.0, 2.0])], "ntype string, x array<double>")
    assert {(r.ntype, r["count"], r.width) for r in graph.checked_sizes(nodes).collect()} == {("a", 2, 1), ("b", 1, 2)}
    with pytest.raises(Exception, match="several widths"):
        graph.checked_sizes(nodes.union(spark.createDataFrame([("a", [1.0, 2.0])], nodes.schema))).collect()
    with pytest.raises(Exception, match="should have 1 numbers"):
        tables.checked_width(nodes.withColumnRenamed("x", "embedding"), 1).collect()


def test_params_are_strict(spark, tmp_path):
    params = {"a": np.arange(6.0).reshape(2, 3), "b": np.ones(1)}
    tables.write_params(spark, {"model_state.a": params["a"], "b": params["b"]}, str(tmp_path / "p"))
    got = tables.read_params(spark, str(tmp_path / "p"), ["b", "a"])
    assert all((got[k] == v).all() for k, v in params.items())
    with pytest.raises(ValueError, match="missing: \\['c'\\]; unexpected: \\['b'\\]"):
        tables.read_params(spark, str(tmp_path / "p"), ["a", "c"])


def test_fasta(spark, tmp_path):
    (tmp_path / "a.FA").write_text("junk before\n>one first\nAC\r\nGT\n>two\n>three x\nA A\n")
    (tmp_path / "b.fasta").write_text(">four\nAC")
    (tmp_path / "c.txt").write_text(">no\nAC")
    got = fasta.read_fasta(spark, str(tmp_path))
    assert sorted((r.seq_id, r.seq, r.source_file) for r in got.collect()) == [("four", "AC", "b.fasta"), ("one", "ACGT", "a.FA"), ("three", "AA", "a.FA"), ("two", "", "a.FA")]
    assert {r.source_file: r.seq_id for r in fasta.first_ids(got).collect()} == {"a.FA": "one", "b.fasta": "four"}
    (tmp_path / "m.json").write_text('{"phage_map": {"a": 0, "b": 1},\n "host_map": {"h": 0}}')
    assert {tuple(r) for r in fasta.read_node_maps(spark, str(tmp_path / "m.json")).collect()} == {("phage", "a", 0), ("phage", "b", 1), ("host", "h", 0)}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0])], "a array<double>, z array<double>, e array<double>")
    r = df.select(vec.l2_normalize(F.col("a")).alias("n"), vec.l2_normalize(F.col("z")).alias("z"), vec.cosine(F.col("a"), F.col("a")).alias("c"), vec.coerced(F.col("e"), 3).alias("w"), vec.coerced(F.lit(None), 2).alias("o"), vec.layer_norm(F.col("a")).alias("l")).first()
    assert r.n == pytest.approx([0.6, 0.8]) and r.z == [0.0, 0.0] and r.c == pytest.approx(1) and r.w == [1, 1, 1] and r.o == [1, 1]
    assert r.l == pytest.approx([-1, 1], abs=1e-4)


def test_attention_with_loops_and_attributes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 8))
    p = att.Attention(rng.normal(size=(6, 8)), rng.normal(size=(6, 8)), rng.normal(size=(2, 3)), rng.normal(size=3), rng.normal(size=(6, 2)))
    edges = [(0, 1), (2, 1), (1, 1), (3, 0), (4, 5)]
    attr = rng.normal(size=(5, 2))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>")
    table = spark.createDataFrame([(*e, a.tolist()) for e, a in zip(edges, attr)], "src long, dst long, attr array<double>")
    plain = np.array([r.out for r in att.attended(table, nodes, nodes, p).orderBy("idx").collect()])
    assert np.allclose(plain, numpy_attended(edges, x, x, p, attr))
    kept = [(e, a) for e, a in zip(edges, attr) if e[0] != e[1]]
    for i in range(6):
        into = [a for e, a in kept if e[1] == i and e[0] != i]
        kept.append(((i, i), np.mean(into, axis=0) if into else np.zeros(2)))
    looped = np.array([r.out for r in att.attended(table, nodes, nodes, p, loops=True).orderBy("idx").collect()])
    assert np.allclose(looped, numpy_attended([e for e, _ in kept], x, x, p, [a for _, a in kept]))


def test_model(spark):
    """Two relations into part, one of them empty; parts without edges; a type that no relation reaches."""
    rng = np.random.default_rng(2)
    inputs, layers, final = model(8)
    x = {k: rng.normal(size=(n, 8)) for k, n in (("customer", 4), ("part", 5), ("supplier", 3))}
    e = {("customer", "buys", "part"): [(0, 1), (1, 1), (3, 2)], ("part", "bought_by", "customer"): [(1, 0), (1, 1), (2, 3)]}
    nodes = spark.createDataFrame([(k, i, v.tolist()) for k, m in x.items() for i, v in enumerate(m)], "ntype string, idx long, x array<double>")
    edges = spark.createDataFrame([(*r, *p) for r, ps in e.items() for p in ps], "src_type string, rel string, dst_type string, src long, dst long")
    state = {k: np.maximum(x[k] @ w.T + b, 0) for k, (w, b) in inputs.items()}
    for p in layers:
        new = {}
        for k, own in state.items():
            outs = [numpy_attended(e[r], state[r[0]], own, a) for r, a in p.relations.items() if r[2] == k and r in e]
            total = np.zeros_like(own)
            if outs:
                gate = np.stack([np.tanh(o @ p.gate_in.T + p.gate_bias) @ p.gate_out for o in outs])
                w = np.exp(gate - gate.max(0))
                total = sum((w / w.sum(0))[i][:, None] * o for i, o in enumerate(outs))
            y = own + total
            new[k] = np.maximum((y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + 1e-5), 0)
        state = new
    got = att.embedded(nodes, edges, inputs, layers, final)
    for k, v in state.items():
        z = v @ final[0].T + final[1]
        want = z / np.linalg.norm(z, axis=1, keepdims=True)
        assert np.allclose(np.array([r.x for r in got[k].orderBy("idx").collect()]), want, atol=1e-8)
    assert attention(0, 8).attend.shape == (2, 4)


def test_candidates_but_itself(spark, monkeypatch):
    """Several slices and blocks, against one matrix product."""
    monkeypatch.setattr(scoring, "BLOCK", 16)
    monkeypatch.setattr(scoring, "SLICE", 5)
    x = np.random.default_rng(0).normal(size=(70, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<float>").repartition(3)
    x = x.astype(np.float32).astype(float)
    got = {(r.query_id, r["rank"]): r.idx for r in scoring.top_candidates(rows.filter("idx % 4 = 0").withColumnRenamed("idx", "query_id"), rows, 1.0, 3, but_itself=True).collect()}
    d = np.round(x @ x.T, 12)
    np.fill_diagonal(d, -np.inf)
    assert got == {(q, n + 1): int(i) for q in range(0, 70, 4) for n, i in enumerate(np.argsort(-d[q], kind="stable")[:3])}


def test_top_candidates_with_ties(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "query_id string, x array<double>")
    c = spark.createDataFrame([(2, [1.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (9000, [1.0, 0.0])], "idx long, x array<double>")
    got = {(r.query_id, r["rank"]): r.idx for r in scoring.top_candidates(q, c, 1.0, 2).collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, ("b", 1): 0, ("b", 2): 2}


def test_failed_texts_are_rows(spark):
    def hook():
        def embed_texts(texts):
            if "bad" in texts:
                raise ValueError("no")
            return np.ones((len(texts), 2))

        return embed_texts

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "c"])], "i int, text string").coalesce(1)
    got = {r.i: (r.embedding, r.status, r.error) for r in embed.embed_batches(rows, hook, ["i"]).collect()}
    assert got == {0: ([1.0, 1.0], "ok", None), 1: (None, "error", "ValueError: no"), 2: ([1.0, 1.0], "ok", None)}


def test_rerun_of_ingest_finds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">x\nAC\n>y\nGT\n")
    run = lambda: incremental.ingest(incremental.new_records(spark, str(tmp_path / "in")), lambda b: b, str(tmp_path / "out"), str(tmp_path / "marks"))
    assert run() == 2
    assert run() == 0
    (tmp_path / "in" / "b.fa").write_text(">z\nA")
    assert run() == 1
    assert sorted(r.seq_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y", "z"]


def test_last_of_several_files(spark, tmp_path):
    """The file whose path comes last counts, though Spark reads large files first."""
    species = tmp_path / "species"
    species.mkdir()
    (species / "a.tsv").write_text("taxid\tspecies\n" + "".join(f"{i}\told {i}\n" for i in range(3000)))
    (species / "b.tsv").write_text("taxid\tspecies\n7\tnew\n7\tnewer\n")
    (species / "c.tsv").write_text("taxid\tspecies\n" + "".join(f"{i}\tlast {i}\n" for i in range(8, 2000)))
    got = {r.taxid: r.species for r in fasta.read_species(spark, str(species)).collect()}
    assert (got[6], got[7], got[8], got[2999]) == ("old 6", "newer", "last 8", "old 2999")
    folder = tmp_path / "taxonomy"
    folder.mkdir()
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, n, mark in (("a", 3000, "old"), ("b", 1, "new")):
        pq.write_table(pa.table({"taxid": pa.array(range(n), pa.int64()), "parent": pa.array([None] * n, pa.int64()), "name": [mark] * n, "rank": [" Genus "] * n}), folder / f"{name}.parquet")
    rows = {r.taxid: (r.parent, r.name, r.rank) for r in fasta.read_taxonomy(spark, str(folder)).collect()}
    assert rows[0] == (0, "new", "genus") and rows[5] == (5, "old", "genus")


def test_empty_result_writes_no_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5)], "query_id string, score double")
    assert not sinks.write_results(rows.filter("score > 1"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert sinks.write_results(rows, str(tmp_path / "some"))
    assert [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "some")).collect()] == [("a", "0.5")]


def test_label_modes(spark):
    df = spark.createDataFrame
    best = df([("q1", 0, 0.12345678), ("q2", 9, 0.5)], "query_id string, idx long, score double")
    of = lambda mode: {tuple(r) for r in hierarchy.labelled(best, df([(0, 562)], "idx long, taxid long"), df([(562, "E. coli")], "taxid long, species string"), df([(562, "Escherichia")], "taxid long, name string"), mode).collect()}
    assert of(None) == {("q1", "E. coli", "Escherichia", 0.123457), ("q2", "unknown_-1", "NA", 0.5)}
    assert of("species") == {("q1", "E. coli", 0.123457), ("q2", "unknown_-1", 0.5)}
    assert of("genus") == {("q1", "Escherichia", 0.123457), ("q2", "NA", 0.5)}


def test_rows_are_dealt_alike(spark):
    """The tasks that hot rows go to don't depend on the rows' order."""
    rows = [(1, i, float(i)) for i in range(60)] + [(2, i, 0.5) for i in range(5)]
    one = spark.createDataFrame([(1, "x"), (2, "y")], "key long, name string")
    seen = []
    for order in (rows, rows[::-1]):
        many = spark.createDataFrame(order, "key long, n long, v double").repartition(4)
        (hot,) = hot_keys(many, ["key"], rows=10)
        joined = spread_join(many, one, ["key"], hot)
        seen.append({(r.key, r.n): r.name for r in joined.collect()})
    assert seen[0] == seen[1] and len(seen[0]) == 65
    assert "rand(" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_softmax_in_parts(spark):
    """A hot segment in several parts, with logits far apart, is as one."""
    rng = np.random.default_rng(9)
    rows = [(d, 0, rng.normal(size=3).tolist(), float(v)) for d in (1, 2) for v in rng.normal(0, 300, 40)]
    messages = spark.createDataFrame(rows, "dst long, head int, msg array<double>, logit double")
    hot = spark.createDataFrame([(1, 7)], "dst long, _tasks int")
    for table in (None, hot):
        got = {r.dst: r.out for r in att.softmax_means(messages, table).collect()}
        for d in (1, 2):
            logit = np.array([r[3] for r in rows if r[0] == d])
            w = np.exp(logit - logit.max())
            assert got[d] == pytest.approx(w / w.sum() @ np.array([r[2] for r in rows if r[0] == d]))


def test_paths(spark):
    """Paths against walks, on random forests with cycles and lost parents; a new leaf changes no other path."""
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice([i, *range(max(1, i - 6), i + 1), 999]) if i > 1 else 1, f"n{i}", rng.choice(["genus", "x", "y"])) for i in range(1, 80)]
    rows += [(200, 201, "a", "x"), (201, 202, "b", "genus"), (202, 200, "c", "x"), (203, 202, "tail", "y"), (204, 203, "g", "genus"), (205, 204, "below", "x")]
    tree = spark.createDataFrame(rows, "taxid long, parent long, name string, rank string")
    starts = spark.createDataFrame([(r[0],) for r in rows] + [(-1,), (5000,)], "taxid long")
    labels = hierarchy.paths(tree)
    want = {r.taxid: r.name for r in hierarchy.ancestors(tree, starts, "genus").collect()}
    assert {r.taxid: r.name for r in hierarchy.ancestors_by_path(labels, tree, starts, "genus").collect()} == want
    path = {r.taxid: r.path for r in labels.collect()}
    parent = {r[0]: r[1] for r in rows}

    def below(i, top):
        seen = set()
        while i in parent and i not in seen:
            if i == top:
                return True
            seen.add(i)
            i = parent[i]
        return False

    for top in (1, 3, 10, 40):
        assert {r.taxid for r in hierarchy.subtree(labels, path[top]).collect()} == {i for i in range(1, 80) if below(i, top)}
    leaves = spark.createDataFrame([(300, 10), (301, 77777)], "taxid long, parent long")
    grown = {r.taxid: r.path for r in hierarchy.with_leaves(labels, leaves).collect()}
    assert {i: p for i, p in grown.items() if i < 300} == path and grown[300].startswith(path[10]) and len(grown[301]) == hierarchy.STEP


def test_a_group_of_files_has_parts(spark, tmp_path, monkeypatch):
    """A group that is nearly all rows is written by several tasks, and its first record is that of all its parts."""
    monkeypatch.setattr(fasta, "PART_BYTES", 1000)
    rows = spark.range(2000).selectExpr("IF(id = 1500, 'b', 'a') AS kind", "(id * 7) % 2003 + 5 AS n")
    path = str(tmp_path / "parts")
    fasta.write_parts(rows, "kind", "n", F.concat(F.lit(">r"), F.col("n").cast("string"), F.lit("\nAC")), path, 16_000)
    assert len(list((tmp_path / "parts" / "kind=a").glob("*.txt"))) > 8
    got = fasta.read_fasta(spark, path, (".txt",))
    first = {r.kind: r.n for r in rows.groupBy("kind").agg(F.min("n").alias("n")).collect()}
    assert {r.folder[-1]: r.seq_id for r in fasta.first_of_parts(got).collect()} == {k: f"r{n}" for k, n in first.items()}
    order = [f"r{r.n}" for r in rows.orderBy("kind", "n").collect()]
    assert [r.seq_id for r in fasta.positions(got).orderBy("nth_record").collect()] == order


def test_network_decoder_moves_narrow_vectors(spark, monkeypatch):
    """The first map is made once a node: pairs meet its 2 numbers, not a vector of 5, and meet a vector of 1 as it is."""
    rng = np.random.default_rng(9)
    a, b, w, bias, o = rng.normal(size=(4, 5)), rng.normal(size=(3, 1)), rng.normal(size=(2, 6)), rng.normal(size=2), rng.normal(size=2)
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>")
    pairs = spark.createDataFrame([(i, j) for i in range(4) for j in range(3)], "src long, dst long")
    met = []
    inner = scoring._both_ends
    monkeypatch.setattr(scoring, "_both_ends", lambda p, s, d: met.extend([s, d]) or inner(p, s, d))
    got = scoring.decoded_by_network(pairs, frame(a), frame(b), w, bias, o, 0.5).collect()
    assert len(got) == 12
    for r in got:
        assert r.logit == pytest.approx(np.maximum(w @ np.concatenate([a[r.src], b[r.dst]]) + bias, 0) @ o + 0.5)
    assert [df.selectExpr("max(size(x)) AS n").first().n for df in met] == [2, 1]
