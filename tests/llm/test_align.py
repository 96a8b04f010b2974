"""Alignment of tokenizers against a plain version that encodes whole texts."""

import collections
import random

import brute
import public_tokenizers as public
import pytest

from strandgraph.llm import align

ODD = ["<|endoftext|>", "<s>", "<unk>", "<0x0A>", "a ▁ b", "  two  spaces ", " ", "  ", "\n", "x\n y\t z ", "日本語 🙂🙂 é́ ퟿", "\x00 \x1c \x85   x", "　 y", "don't we'll 123 4", "x" * 3000, " " * 3000, "▁", "é", "\U0001f469‍\U0001f469", "a\x1d b", "end ", "q\n", "q\n r", "q", "q \n", "q r"]


def plain(texts):
    """A row for each text: the counts, and the groups as text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(public.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    a_tok.encode_special_tokens = True
    rows, total = [], collections.Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        a = a_tok.encode(whole.decode(), add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        a_part = [bytes(align.BYTE_OF[c] for c in a_tok.id_to_token(i)) for i in a]
        b_part = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b_tok.id_to_piece, b)]
        if not t or b"".join(a_part) != whole or b"".join(b_part) != whole:
            rows.append(((0, 0, 0, 0), "", collections.Counter()))
            continue
        spans = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
        x, y = spans(a_part), spans(b_part)
        cuts = sorted({z for _, z in x} & {z for _, z in y})
        groups, at = [], 0
        for z in cuts:
            groups.append(",".join(str(i) for i, s in zip(a, x) if at < s[1] <= z) + "|" + ",".join(str(i) for i, s in zip(b, y) if at < s[1] <= z))
            at = z
        links = collections.Counter((a[i], b[j]) for i, s in enumerate(x) for j, r in enumerate(y) if s[0] < r[1] and r[0] < s[1])
        total += links
        rows.append(((len(a), len(b), len(groups), sum(links.values())), ";".join(groups), links))
    top = collections.Counter()
    for (_, b), n in total.items():
        top[b] = max(top[b], n)
    return [(*c, sum(n for p, n in links.items() if total[p] == top[p[1]]), sum(n * total[p] for p, n in links.items()), brute.sha(g) if c[0] else "") for c, g, links in rows], [g for _, g, _ in rows]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [align.BLOCK_PAIRS, 300])
def test_op12(spark, small, block):
    folder, rows, _, _ = small
    want, _ = plain([t for _, t in rows])
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in align.op12_tokenizer_alignment(spark, folder, block).collect()}
    assert got == {i: w for (i, _), w in zip(rows, want)}
    assert any(w[0] for w in want)


def test_odd_texts(spark):
    rng = random.Random(4)
    letters = ["a", "B", " ", "  ", "\n", "é", "日", "🙂", "'s", ".", "1", "▁", "\t", " ", "the", " of", "\x00", "ing"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(400)]
    _, groups = plain(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.k: r.groups for r in align.aligned(df, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == groups[i], repr(t)


def test_words():
    for t in ODD:
        assert " " + " ".join(align.words(t)) == " " + t


def test_long_texts(spark):
    texts = [" " * (4 << 20), "word " * (1 << 20), "é" * (1 << 20), "\n" * (1 << 20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r.k: r for r in align.aligned(df, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")).select("k", "n_a", "n_b", "n_links").collect()}
    assert all(rows[i].n_links >= max(rows[i].n_a, rows[i].n_b) > 0 for i in range(4))
