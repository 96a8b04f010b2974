"""Rows of one id, or of none, with different texts are documents of their own."""

import hashlib
import random
from collections import Counter

import brute
import corpus_pipeline
import pytest

from strandgraph.llm import leaks, store, substrings
from strandgraph.llm.jaccard import similar_components

NULL = -(1 << 63)


def identity(i, t, several):
    md5 = hashlib.md5((t or "").encode()).digest()
    halves = tuple(int.from_bytes(md5[a : a + 8], "big", signed=True) for a in (0, 8))
    return (NULL if i is None else i, *(halves if i in several else (0, 0)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c, d = (text(60) for _ in range(4))
    near = lambda w: [*w[:30], f"n{rng.randrange(10**6)}", *w[31:]]
    out = [(None, a), (None, a + ["end"]), (None, b), (None, near(b)), (None, c), (None, c), (None, ["x"]), (None, [])]
    out += [(7, a[:40] + text(20)), (7, d), (7, near(d)), (7, near(c)), (9, d[20:50] + text(30)), (9, text(25)), (3, text(30))]
    out = [(i, " ".join(w)) for i, w in out]
    return [*out, out[0], out[9], (8, None), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "z") for i, t in rows], "doc_id long, text string, n_chars long, k string").repartition(3)


@pytest.fixture(params=[500_000, 0])
def limit(request, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_IDS", request.param)


def keyed(rows):
    several = {i for i, n in Counter(i for i, _ in rows).items() if n > 1}
    return [(identity(i, t, several), t) for i, t in rows]


def test_repeats(docs, rows, limit):
    want = brute.repeats(list(dict(keyed(rows)).items()), 10)
    got = substrings.remove_repeats(docs, 10).collect()
    expected = Counter((k[0], *want[k]) for k, _ in keyed(rows))
    assert Counter((r.k, r.n_words, r.n_removed, r.kept_text) for r in got) == expected and any(r.n_removed for r in got)
    out = substrings.strip_repeats(docs, 10)
    assert out.columns == docs.columns
    assert Counter((NULL if r.doc_id is None else r.doc_id, r.text) for r in out.collect()) == Counter((k[0], want[k][2] if want[k][1] else t) for k, t in keyed(rows))


def test_components(spark, docs, rows, limit):
    want = brute.jaccard_components(list(dict(keyed(rows)).items()), 5, 60, 100)
    got = similar_components(docs, 5, 60, 100).collect()
    assert Counter(((r.k, r.v1, r.v2), r.n_shingles, r.component_id, r.first) for r in got) == Counter((k, want[k][0], want[k][1][0], want[k][1] == k) for k, _ in keyed(rows))


def test_near_duplicates(spark, docs, rows):
    want = brute.jaccard_components(list(dict(keyed(rows)).items()), 5, 80, 100)
    kept = {(k[0], t) for k, t in keyed(rows) if want[k][1] == k}
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    plain = lambda x: sorted((k, t or "") for k, t in x)
    assert plain((NULL if r.doc_id is None else r.doc_id, r.text) for r in got) in (plain(kept), plain({(k, t or "") for k, t in kept}))


def test_leaks_in_blocks(spark, docs, rows):
    items = [(i, " ".join(rows[j][1].split()[a : a + 12])) for i, (j, a) in enumerate([(0, 3), (2, 5), (9, 9), (3, 28), (8, 45), (13, 2)])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(list(enumerate(t for _, t in rows)), items, 10)
    expected = Counter((NULL if i is None else i, *want[n][:2], *want[n][2]) for n, (i, _) in enumerate(rows))
    for size in (1 << 20, 20):
        got = leaks.benchmark_hits(docs, bench, 10, block_bytes=size).collect()
        assert Counter((r.k, r.n_words, sum(s.stop - s.start for s in r.spans), *r["items"]) for r in got) == expected
