"""The pipeline against plain versions of its stages."""

import brute
import corpus_pipeline
import public_tokenizers as public
from small_tables import tables

from strandgraph.llm import quality
from strandgraph.llm.bpe import encoding

NULL = -(1 << 63)


def test_run(spark, tmp_path):
    import random

    rng = random.Random(6)
    words = [f"word{a}{b}" for a in "abcdefgh" for b in "ijklmnopqr"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([60, 90, 200]))) for _ in range(30)]
    passage = " ".join(rng.choice(words) for _ in range(55))
    texts += [texts[0], texts[1].replace("wordai", "changed", 1), f"{texts[2]} {passage}", f"{passage} {texts[3]} extra words here", "short", "", None, "SHOUT! " * 80, "same " * 100]
    leak = " ".join(rng.choice(words) for _ in range(15))
    texts.append(f"{texts[4][::-1]} {leak} end")
    rows = [(2 * i + 1, t) for i, t in enumerate(texts)] + [(None, texts[5] + " nobody")]
    folder = tables(spark, tmp_path / "t", rows, [(1, leak), (2, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [f.__name__ for _, f in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "substring_dedup", "decontamination", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes

    good = {r.k for r in quality.ledger(docs).filter(quality.passes(2)).collect()}
    state = [(NULL if i is None else i, t) for i, t in rows if (NULL if i is None else i) in good]
    assert 20 < len(state) < len(rows) - 4
    groups = brute.jaccard_components(state, 5, 80, 100)
    state = [(k, t) for k, t in state if groups[k][1] == k]
    stripped = brute.repeats(state, 20)
    state = [(k, stripped[k][2] if stripped[k][1] else t) for k, t in state]
    hits = brute.leaks(state, [(1, leak)], 10)
    state = [(k, t) for k, t in state if not hits[k][1]]
    enc = encoding(str(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN)
    want = {k: (len(ids := enc.encode_ordinary(t)), b"".join(x.to_bytes(4, "little") for x in ids), brute.sha(t)) for k, t in state}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(NULL if r.doc_id is None else r.doc_id): (r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
