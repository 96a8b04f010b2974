"""Each registered query against a plain version, on a small fixture with the odd cases, and on empty tables."""

import re
import zlib

import brute
import pytest
from small_tables import tables

from strandgraph.llm import licences
from strandgraph.llm.queries import ORACLE, QUERIES

NULL = -(1 << 63)


def by_id(df, key="doc_id"):
    rows = df.collect()
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: r for r in rows}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_op1(spark, small):
    folder, _, _, pages = small
    got = by_id(QUERIES["op1_warc"](spark, folder), "page_id")
    first = {}
    for i, _, h in sorted(pages, key=lambda p: NULL if p[0] is None else p[0]):
        body = (h or "").encode()
        refers = first.get(body) if len(body) >= 100 else None
        if len(body) >= 100 and body not in first:
            first[body] = (i,)
        r = got.pop(i)
        assert (r.payload_bytes, r.payload_digest) == (len(body), brute.sha(body))
        assert (r.record_type, r.refers_to) == (("revisit", refers[0]) if refers else ("response", None))
        assert r.url == dict((p[0], p[1]) for p in pages)[i]
    assert not got


def test_op2(spark, small):
    folder, rows, _, _ = small
    got = by_id(QUERIES["op2_quality_rules"](spark, folder))
    assert len(got) == len(rows)
    for i, t in rows:
        w = brute.words(t)
        wins = {}
        for p in range(len(w) - 2):
            wins.setdefault(tuple(w[p : p + 3]), []).append(p)
        again = {q for ps in wins.values() if len(ps) > 1 for p in ps for q in range(p, p + 3)}
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert r.base_failed == failed and not (failed and r.kept)


def test_op3(spark, small):
    folder, rows, _, _ = small
    got = QUERIES["op3_sharding"](spark, folder).collect()
    texts = {i: t or "" for i, t in rows}
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(i) for i, _ in rows)
    slots, load = {}, [0] * 16
    for r in got:
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert set(slots) <= set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    # One text is larger than a shard's share: it stands alone, and the others fill the other shards.
    largest = max(r.size for r in got)
    assert max(load) == largest or max(load) - min(load) <= largest


def test_op4(spark, small):
    folder, rows, _, _ = small
    want = brute.jaccard_components([(NULL if i is None else i, t) for i, t in rows], 4, 85, 100)
    got = QUERIES["op4_ngram_jaccard_join"](spark, folder).collect()
    key = lambda x: NULL if x is None else x
    assert {key(r.doc_id): (r.n_shingles, key(r.component_id)) for r in got} == want and len(got) == len(rows)


def test_op5(spark, small):
    folder, rows, _, _ = small
    want = brute.repeats([(NULL if i is None else i, t) for i, t in rows], 20)
    got = by_id(QUERIES["op5_substring_dedup"](spark, folder))
    assert {(NULL if i is None else i): (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: (a, b, brute.sha(c)) for i, (a, b, c) in want.items()}


def test_op6(spark, small):
    folder, _, _, pages = small
    got = by_id(QUERIES["op6_url_filters"](spark, folder), "page_id")
    assert {i: (r.host, r.path, r.rule) for i, r in got.items()} == {
        5: ("a.example.com", "/en/1", "com/en/"),
        2: ("b.example.net", "/de/8/x", "example.net/de/8"),
        9: ("c.org", "/es/", "org/es/"),
        7: ("", "", None),
        8: ("", "", None),
        11: ("x", "", None),
        12: ("x", "", None),
        None: ("e.com", "/en/", "com/en/"),
        13: ("e.com", "", None),
        14: ("e.com", "/en/7", "com/en/"),
    }
    assert got[2].verdict == got[5].verdict == "block" and {r.verdict for r in got.values()} <= {"block", "allow"}


def test_op7(spark, small):
    folder, rows, _, _ = small
    got = by_id(QUERIES["op7_license_scans"](spark, folder))
    assert len(got) == len(rows) and all(r.license is None and r.notices == "" for r in got.values())


@pytest.fixture(scope="module")
def licensed(spark, tmp_path_factory):
    """Documents that are known texts, rewrapped, recased, respelled, with titles and copyright lines; and near misses."""
    rows, i = [], 0
    for name, text in licences.KNOWN:
        w = text.split()
        for t in (text, text.upper(), "\n".join(" ".join(w[a : a + 11]) for a in range(0, len(w), 11)), f"Copyright (c) 2001, 2020 Some Body\r\nAll rights reserved.\r\n\r\n{text}", f"/* {text.replace(chr(10), chr(10) + ' * ')} */", re.sub(r"\blicense\b", "licence", text).replace(",", "")):
            rows.append((i, name, t))
            i += 1
        rows.append((i, None, f"{text} Indeed."))
        i += 1
    made = tables(spark, tmp_path_factory.mktemp("licensed"), [(a, t) for a, _, t in rows])
    return made, {a: name for a, name, _ in rows}


def test_op7_hits(spark, licensed):
    folder, want = licensed
    got = by_id(QUERIES["op7_license_scans"](spark, folder))
    assert {i: r.license for i, r in got.items()} == want
    # A notice that is wrapped at eleven words is no line of its own.
    wrapped = {7 * n + 2 for n, (_, t) in enumerate(licences.NOTICES) if len(t.split()) > 11}
    assert {i for i, r in got.items() if r.notices} == {i for i, name in want.items() if i < 7 * len(licences.NOTICES) and name} - wrapped and wrapped


def test_op7_sql(licensed, spark):
    import compare

    folder, _ = licensed
    assert compare.same(QUERIES["op7_license_scans"](spark, folder), compare.database(folder, ["documents"]), ORACLE["op7_license_scans"]) is None


def test_op8(spark, small):
    import public_tokenizers as public

    from strandgraph.llm.bpe import encoding

    folder, rows, _, _ = small
    enc = encoding(str(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN)
    got = by_id(QUERIES["op8_byte_bpe"](spark, folder))
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), brute.sha(b"".join(x.to_bytes(4, "little") for x in ids)), brute.sha(t or ""))


def test_op9(spark, small):
    folder, rows, items, _ = small
    want = brute.leaks(rows, [x for x in items if x[0] is not None and x[1] is not None], 10)
    got = by_id(QUERIES["op9_benchmark_decontamination"](spark, folder))
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in got.items()} == {i: (n, h, len(x), brute.sha(",".join(x)), h > 0) for i, (n, h, x) in want.items()}
    assert any(r.contaminated for r in got.values())
    longest = brute.longest_leaks(rows, [x for x in items if x[0] is not None and x[1] is not None], 10)
    assert {i: (r.longest_match, r.longest_match_start) for i, r in got.items()} == longest


def test_op10(spark, small):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    folder, rows, _, _ = small
    tok = Tokenizer.from_file(str(public.path("word_bpe_49k.json")))
    got = by_id(QUERIES["op10_token_ids"](spark, folder))
    start = 0
    for i, t in sorted(rows, key=lambda r: NULL if r[0] is None else r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
