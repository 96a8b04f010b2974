"""Parts of operators that their queries don't show."""

import math
import pathlib
import random
import re

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from strandgraph.llm import bpe, idfiles, leaks, licences, quality, shards, substrings, urls, warc
from strandgraph.llm.components import components
from strandgraph.llm.files import Reader
from strandgraph.llm.jaccard import similar_components
from strandgraph.llm.text import NOT_ALNUM, WHITE, Words, text_chunks


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a bb\tccc", "", None, "é\n", "ab", "c  d", "A" * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]).slice(0)
    seen = {}
    for limit in (1, 7, 1 << 20):
        got = []
        for _, data, bounds in text_chunks(batch, limit=limit):
            w = Words(data, bounds, WHITE)
            body = [bytes(data[a:z]).decode() for a, z in zip(w.starts, w.ends)]
            for word, h in zip(body, w.hashes().tolist()):
                assert seen.setdefault(word, h) == h
            got += [body[a:z] for a, z in zip(w.first[:-1], w.first[1:])]
        assert got == [brute.words(t) for t in texts]
    assert len(set(seen.values())) == len(seen)
    (_, data, bounds), = text_chunks(pa.RecordBatch.from_arrays([pa.array(["Ab-c1 É_z"])], names=["text"]))
    w = Words(data, bounds, NOT_ALNUM)
    assert [bytes(data[a:z]).decode().lower() for a, z in zip(w.starts, w.ends)] == ["ab", "c1", "é", "z"]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(500, i) for i in range(501, 560)] + [(3, 3)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("size,num", [(4, 85), (3, 50)])
def test_families_of_near_copies(spark, size, num, monkeypatch):
    from strandgraph.llm import jaccard

    monkeypatch.setattr(jaccard, "GROUP_SETS", 8)
    rng = random.Random(size * num)
    vocabulary = [f"v{i}" for i in range(3000)]
    line = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 90]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w += line
            rows.append((rng.randrange(1 << 40), " ".join(w)))
    rows = list(dict(rows).items())
    want = brute.jaccard_components(rows, size, num, 100)
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, num, 100).collect()
    assert {r.k: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("size,num", [(4, 85), (2, 25), (5, 100)])
def test_sizes_at_the_threshold(spark, size, num, monkeypatch):
    """Texts that hold one another: links are where sizes alone just allow them, across bands of size."""
    from strandgraph.llm import jaccard

    monkeypatch.setattr(jaccard, "GROUP_SETS", 8)
    rng = random.Random(num)
    rows = []
    for family in range(3):
        words = [f"f{family}w{rng.randrange(10**6)}" for _ in range(120)]
        for n in rng.sample(range(20, 121), 30):
            at = rng.choice([0, 0, 120 - n])
            rows.append((rng.randrange(1 << 40), " ".join(words[at : at + n])))
    want = brute.jaccard_components(rows, size, num, 100)
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, num, 100).collect()
    assert {r.k: (r.n_shingles, r.component_id) for r in got} == want


def test_templates_ask_few_groups(spark, monkeypatch):
    """Documents that share 100 of 160 words are no near copies: hardly any asks a group, however many there are."""
    from strandgraph.llm import jaccard

    monkeypatch.setattr(jaccard, "GROUP_SETS", 16)
    made = {}
    plain = jaccard.written

    def counted(df, name):
        out = plain(df, name)
        if name in ("asked", "bound"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    rng = random.Random(4)
    template = " ".join(f"t{i}" for i in range(100))
    rows = [(i, f"{template} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(600)]
    rows += [(600 + i, text.replace(" t50 ", " ")) for i, text in rows[:20]]
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert {r.k: r.component_id for r in got} == {i: i - 600 if i >= 600 else i for i, _ in rows}
    # Each set asking each of 38 groups or more would be over 20 000 rows.
    assert made["asked"] < 200 and made["bound"] <= 40, made


def test_repeats_with_frequent_minimisers(spark, monkeypatch):
    """A passage that all documents share, within different words, repeated rows and another window."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(45)]
    rows = []
    for i in range(80):
        a, b = ([f"x{rng.randrange(10**6)}" for _ in range(30)] for _ in range(2))
        rows.append((i, " ".join(a + passage + b)))
    rows += [rows[7], (200, rows[3][1])]
    for share in (1 / 4096, 1 / 64):
        monkeypatch.setattr(substrings, "FREQUENT_SHARE", share)
        monkeypatch.setattr(substrings, "FLUSH_BYTES", 4000)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        for window in (3, 20):
            want = brute.repeats(list(dict(rows).items()), window)
            got = substrings.remove_repeats(df, window).collect()
            assert len(got) == len(rows) and all((r.n_words, r.n_removed, r.kept_text) == want[r.k] for r in got)
    docs = spark.createDataFrame([(i, t, len(t), "s") for i, t in rows[:5]], "doc_id long, text string, n_chars long, spans string")
    out = {r.doc_id: r for r in substrings.strip_repeats(docs, 20).collect()}
    assert out[0].text == rows[0][1] and out[1].n_chars == len(out[1].text) and "p5" not in out[1].text and out[1].spans == "s"


@settings(max_examples=60, deadline=None)
@given(some.lists(some.sampled_from([" ", "  ", "\n", "\t", "a", "é", "'ll", "'", "l", "12", "!", " x", " ", "日", "don't", "\x1c"]), max_size=60).map("".join), some.integers(1, 9))
def test_bpe_tree(text, leaf):
    import public_tokenizers as public

    enc = bpe.encoding(str(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN)
    ids = bpe.encode(enc, text, leaf)
    assert ids.tolist() == enc.encode_ordinary(text)
    assert bpe.decode(enc, ids, leaf) == text.encode()


@settings(max_examples=40, deadline=None)
@given(some.lists(some.integers(0, (1 << 32) - 1), min_size=1, max_size=300), some.booleans())
def test_planes(ids, bits):
    x = np.array(ids, dtype=np.uint32)
    assert idfiles.from_planes(idfiles.to_planes(x, bits), len(x), bits).tolist() == ids


@pytest.mark.parametrize("bits", [False, True])
def test_id_files(tmp_path, monkeypatch, bits):
    monkeypatch.setattr(idfiles, "BLOCK_IDS", 50)
    monkeypatch.setattr(idfiles, "FILE_IDS", 500)
    rng = np.random.default_rng(0)
    docs = [(i, rng.integers(0, 49000, rng.integers(0, 170)).astype(np.uint32)) for i in range(40)]
    out, files = idfiles.IdWriter(f"file://{tmp_path}", bits), []
    for k, ids in docs:
        files += out.add(k, ids)
    files += out.finish()
    assert len(files) > 3
    got, source = [], Reader(f"file://{tmp_path}")
    for name, size, first, total, _ in files:
        f, at = idfiles.IdReader(source, name, size), 0
        assert f.docs[0, 0] == first and f.docs[:, 1].sum() == total
        for k, n in f.docs.tolist():
            got.append((k, f.ids(at, n).tolist()))
            at += n
    assert got == [(k, ids.tolist()) for k, ids in docs]


def test_special_tokens_in_texts():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    path = str(public.path("word_bpe_49k.json"))
    texts = ["a <|startoftext|> b<|endoftext|>c\n<|endoftext|>", "<|startoftext|><|endoftext|>", "<|startoftext |> plain", " <|ENDOFTEXT|>\t<|endoftext|> x", "a.\u00a0<|endoftext|>\u2003b", "\x02 a\x02b \x02\x02 \u0301c", "x \x02"]
    got = [x.tolist() for x in idfiles.encode_words(path, texts)]
    assert got == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert {49406, 49407} <= set(got[0]) and got[1] == [49406, 49407]


def test_warc_ranges(spark, small):
    folder, _, _, pages = small
    where, index = warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"))
    rows = index.collect()
    assert {r.page_id for r in rows} == {p[0] for p in pages} and len({(r.file, r.offset) for r in rows}) == len(rows)
    some_rows = warc.read_records(where, index.filter("url like '%example%' and record_type = 'response'")).collect()
    assert [(r.page_id, r.payload) for r in some_rows] == [(None, dict((p[0], p[2]) for p in pages)[None])] or all(r.payload == dict((p[0], p[2]) for p in pages)[r.page_id] for r in some_rows)


def test_leaks_in_blocks(spark, small):
    folder, rows, items, _ = small
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    key = lambda r: (r.k, r.n_words, [tuple(s) for s in r.spans], r["items"])
    one = sorted(map(key, leaks.benchmark_hits(docs, bench, 10).collect()))
    assert one == sorted(map(key, leaks.benchmark_hits(docs, bench, 10, block_bytes=20).collect()))
    longest = {r.item: r for r in leaks.longest_matches(docs, bench).collect()}
    texts = {(-(1 << 63) if i is None else i): brute.alnum_words(t) for i, t in rows}
    for item, t in items:
        if item is None or not brute.alnum_words(t):
            continue
        w = brute.alnum_words(t)
        best = 0
        for body in texts.values():
            for a in range(len(w)):
                for b in range(a + best + 1, len(w) + 1):
                    if any(body[i : i + b - a] == w[a:b] for i in range(len(body))):
                        best = b - a
                    else:
                        break
        if best:
            r = longest[str(item)]
            found = texts[r.k][r.start : r.start + r.n_words]
            assert r.n_words == best and any(w[a : a + best] == found for a in range(len(w)))
    kept = leaks.without_leaks(docs, bench, 10)
    assert kept.columns == docs.columns and kept.count() == sum(not r[3] for r in one)


def test_shards_stay_level(spark):
    rng = random.Random(5)
    hot = "the same text again and again"
    rows = [(i, hot if i % 3 == 0 else "w " * rng.randrange(1, 60) + str(i)) for i in range(6000)]
    got = shards.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load = [0] * 16
    for r in got:
        load[r.shard] += r.size
    assert max(load) - min(load) < 0.03 * sum(load) / 16
    twice = shards.sharded(spark.createDataFrame([(i, f"text {i % 500}") for i in range(1500)], "doc_id long, text string")).collect()
    where = {}
    for r in twice:
        where.setdefault(r.k % 500, set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_url_trees(spark):
    """Held-out accuracy on URLs that a rule labels."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        lang, tld = rng.choice(["en", "de", "es", "fr"]), rng.choice(["com", "net", "org"])
        rows.append((i, f"https://{rng.choice(['www', 'm', 'blog'])}.h{rng.randrange(40)}.example.{tld}/{lang}/{rng.randrange(10000)}"))
    df = spark.createDataFrame(rows, "page_id long, url string")
    model, tables, prior = urls.train(df.filter("page_id % 4 <> 0"))
    held = urls.lexical(df.filter("page_id % 4 = 0")).withColumn("truth", urls.rule_column(urls.RULES, lambda r: r.verdict)).filter("truth is not null")
    scored = model.transform(urls._vectors(held, tables, prior)).withColumn("guess", F.when(F.col("prediction") == 1, "block").otherwise("allow"))
    right, n = scored.agg(F.count_if(F.col("guess") == F.col("truth")), F.count("*")).first()
    assert right / n > 0.85


def _tree(lines, depth=0):
    """A function of features from a tree's printed form."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        value = float(line.split(":")[1])
        return lambda x: value
    feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines)
    assert lines.pop(0).strip().startswith(f"Else (feature {feature} >")
    high = _tree(lines)
    return lambda x: low(x) if x[int(feature)] <= float(limit) else high(x)


def test_url_verdicts(spark):
    """Every page's score and verdict against the trees walked in Python over features made in Python."""
    rng = random.Random(2)
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', ''])}h{rng.randrange(9)}.{rng.choice(['example', 'else'])}.{rng.choice(['com', 'net', 'org', 'info'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(99)}{rng.choice(['', '?a=1&b=2', '#x'])}" for _ in range(300)]
    made += [None, "none", "http://", "HTTP://Only.Host", made[0], made[1]]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    model, tables, prior = urls.train(df)
    rates = {k: {r[k]: (r[f"{k}_count"], r[f"{k}_rate"]) for r in t.filter("fold is null").collect()} for k, t in tables.items()}
    trees = [_tree(t.toDebugString.split("\n")[1:]) for t in model.trees]
    share = lambda a, b: a / max(b, 1)
    digits = lambda s: sum(c in "0123456789" for c in s)

    def features(u):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.lower()
        query = (re.search(r"\?([^#]*)", u) or ["", ""])[1]
        entropy = -sum(host.count(c) / len(host) * math.log2(host.count(c) / len(host)) for c in set(host))
        suffix, segment = ".".join(host.split(".")[-2:]), re.match("/?[^/]*/?", path)[0]
        n, rate = rates["suffix"].get(suffix, (0, prior))
        m, other = rates["segment"].get(segment, (0, prior))
        return [len(u), len(host), len(path), path.count("/"), host.count("."), share(digits(u), len(u)), digits(path), host.count("-"), entropy, len(query.split("&")) if query else 0, len(query), "#" in u, u.startswith("https:"), len([x for x in path.split("/") if x]), len(segment), rate, n, other, m]

    blocked = 0
    for r in urls.judged(df).collect():
        x = features(made[r.page_id])
        margin = sum(w * t(x) for w, t in zip(model.treeWeights, trees))
        assert r.score == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-9)
        rule = next((q for q in sorted(urls.RULES, key=lambda q: -len(q.text)) if (r.host == q.host or r.host.endswith("." + q.host)) and r.path.startswith(q.path)), None)
        assert r.verdict == (rule.verdict if rule else "block" if r.score >= 0.5 else "allow")
        blocked += rule is None and r.verdict == "block"
    assert blocked


def test_url_statistics(spark, monkeypatch):
    """Counts over all pages, rates over all labelled ones, and a training sample that one hot URL can't fill."""
    hot = "http://hot.example.com/en/1"
    urls_ = [hot] * 60 + [f"http://a{i}.s{i}.net/{lang}/{i}" for i in range(30) for lang in ("de", "fr", "fr")] + [f"http://x{i}.org/es/{i}" for i in range(10)]
    df = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    monkeypatch.setattr(urls, "BROADCAST_KEYS", 7)
    model, tables, prior = urls.train(df, rows=20)
    got = {r.suffix: (r.suffix_count, r.suffix_rate) for r in tables["suffix"].filter("fold is null").collect()}
    assert model is not None and prior == 0.7 and len(got) == 41
    assert got["example.com"] == (60, pytest.approx(63.5 / 65)) and got["s3.net"] == (3, pytest.approx(3.5 / 6)) and got["x2.org"] == (1, pytest.approx(4.5 / 6))
    # All labelled pages of a suffix in one fold: without that fold the rate is that of all.
    assert {r.suffix_rate for r in tables["suffix"].filter("fold is not null and suffix = 'example.com'").collect()} == {prior}
    assert {r.segment: r.segment_count for r in tables["segment"].filter("fold is null").collect()} == {"/en/": 60, "/de/": 30, "/fr/": 60, "/es/": 10}
    judged = urls.judged(df).collect()
    assert len(judged) == len(urls_) and {r.verdict for r in judged if r.path.startswith("/de/")} == {"allow"}


def test_licences(spark):
    known = dict(reversed(licences.KNOWN))
    mit, bsd = known["MIT"] if len(known["MIT"]) > 99 else [t for n, t in licences.KNOWN if n == "MIT"][-1], known["BSD-3-Clause"]
    rows = [(1, f"  # Copyright (c) 2020 Somebody\n{mit.upper()}"), (2, "released under the mit LICENCE"), (3, f"{mit} And more."), (4, "© Me\n© You\nReleased under the MIT License!"), (None, mit), (5, f"some words\n* Licensed under CC BY-NC 4.0!\nReleased under the MIT licence.\nmore"), (6, None), (7, bsd.replace("1. ", "a) ").replace("2. ", " (b) ").replace("3. ", "(c) "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (100_000, 0):
        got = {r.doc_id: (r.license, r.notices) for r in licences.scanned(docs, licences.known_licences(spark), licences.known_notices(spark), small=small).collect()}
        assert got == {1: ("MIT", []), 2: ("MIT", ["MIT"]), 3: (None, []), 4: ("MIT", ["MIT"]), None: ("MIT", []), 5: (None, ["CC-BY-NC-4.0", "MIT"]), 6: (None, []), 7: ("BSD-3-Clause", [])}
    assert licences.scanned(docs, licences.known_licences(spark)).filter("size(notices) > 0").isEmpty()


def test_licence_files(spark):
    """Titles, and lines of the body that start like a copyright line or a clause."""
    isc, mit = ([t for n, t in licences.KNOWN if n == name][-1] for name in ("ISC", "MIT"))
    wrap = lambda t, *at: [t := t.replace(f" {x}", f"\n{x}", 1) for x in at][-1]
    rows = [
        (1, f"MIT License\n\nCopyright (c) 2020 Somebody\n\n{mit}"),
        (2, f"The MIT License (MIT)\n{wrap(mit, 'copyright notice', 'COPYRIGHT HOLDERS')}"),
        (3, f"# ISC License:\r\n# Copyright Somebody Inc.\r\n{wrap(isc, 'copyright notice')}"),
        (4, f"MIT License\n{mit.replace('copyright notice and this', '')}"),
        (5, mit.replace("The above copyright notice", "The above\ncopyright holder")),
        (6, f"(c) retain all notices\n{mit}"),
        (7, f"Copyright  notice\n{mit}"),
    ]
    got = {r.doc_id: r.license for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string"), licences.known_licences(spark)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "ISC", 4: None, 5: None, 6: None, 7: None}


COMMON = pathlib.Path("/usr/share/common-licenses")


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts on this machine")
def test_licence_digests(spark):
    """The digests are those of the published texts, also in capitals and on long lines."""
    files = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    texts = {n: (COMMON / f).read_text() for n, f in files.items() if (COMMON / f).exists()}
    rows = [(n, t) for n, t in texts.items()] + [(n, t.upper()) for n, t in texts.items()] + [(n, t.replace("\n", "\r\n   ")) for n, t in texts.items()]
    got = licences.scanned(spark.createDataFrame(rows, "name string, text string"), licences.known_licences(spark), id_column="name").collect()
    assert len(got) == len(rows) and all(r.doc_id == r.license for r in got)
    assert {n for n, _ in licences.DIGESTS} == set(files)


def test_ablations(spark):
    rows = [(1, "fine words " + " ".join(f"plainword{i}" for i in range(80))), (2, "too short"), (3, " ".join(f"ab{i}*" for i in range(90))), (4, "LOUD " + " ".join(f"WORD{i}!" for i in range(99))), (5, None)]
    book = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.k: [x.name for i, x in enumerate(quality.RULES) if r.failures >> i & 1] for r in book.collect()}
    assert found == {1: [], 2: ["few_words"], 3: ["symbols", "few_letters"], 4: ["capitals", "few_letters", "exclamations"], 5: ["few_words"]}
    table = {r.rule: (r.n_failed, r.n_only, r.n_kept) for r in quality.ablations(book, 2).collect()}
    assert table["few_words"] == (2, 2, 3) and table["capitals"] == (1, 0, 1) and table["few_letters"] == (2, 0, 1)
    assert quality.keep_good(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")).collect()[0].doc_id == 1
