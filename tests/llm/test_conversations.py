"""Repair of conversations against plain versions."""

import itertools
import random
import re
import zlib

import brute
import pytest

from strandgraph.llm import conversations as conv

COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def exhaustive(rows, faults):
    """The best (cost, audit) of all edit strings with up to two inserts before each row and at the end."""
    best = None
    for ins in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("KRD", repeat=len(rows)):
            audit, roles, cost = "", "", 0
            for i, n in enumerate(ins):
                for _ in range(n):
                    roles += "a" if roles.endswith("u") else "u"
                audit, cost = audit + "I" * n, cost + 5 * n
                if i == len(rows):
                    break
                e = edits[i]
                audit += e
                cost += conv.COST[e] + (5 if faults[i] == "truncated" and e != "D" else 0)
                if e != "D" and faults[i] in ("blank", "duplicate"):
                    break
                roles += rows[i][:1] if e == "K" else ("a" if roles.endswith("u") else "u") if e == "R" else ""
            else:
                i = -1
            if (i == len(rows) or i == -1) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


@pytest.mark.parametrize("seed", range(60))
def test_best_audit_of_all(seed):
    rng = random.Random(seed)
    n = rng.randrange(5)
    rows = [(rng.choice("suax "), rng.choice([None, None, None, "truncated", "blank"])) for _ in range(n)]
    assert conv.best_audit(rows) == exhaustive([r for r, _ in rows], [f for _, f in rows])


def test_equal_hashes_are_verified(monkeypatch):
    """With one hash for all strings every longest common prefix is found by its letters."""
    rng = random.Random(5)
    cases = [[(rng.choice("sua"), rng.choice([None, None, "truncated", "blank"])) for _ in range(rng.randrange(30))] for _ in range(60)]
    want = [conv.best_audit(c) for c in cases]
    monkeypatch.setattr(conv.Audits, "MODULUS", 1)
    assert [conv.best_audit(c) for c in cases] == want


def test_order_of_audits():
    rng = random.Random(2)
    audits = conv.Audits()
    nodes = [0]
    for _ in range(300):
        nodes.append(audits.add(rng.choice(nodes[-20:]), rng.choice("DIKR")))
    for a, b in (rng.sample(nodes, 2) for _ in range(2000)):
        x, y = audits.text(a) + "K", audits.text(b) + "R"
        if not (x.startswith(y) or y.startswith(x)):
            assert audits.less(a, "K", b, "R") == (x < y)


def damage(rows):
    out = []
    for c, t, role, text in rows:
        spaced = [" " if x is None else x for x in (c, t, role, text)]
        h = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        role, text = "user" if h == 4 else spaced[2], "" if h == 1 else re.sub("[.!?]", "", spaced[3]) if h == 2 else spaced[3]
        out += [] if h == 0 else [(c, t, role, text)] * (2 if h == 3 else 1)
    return out


def expected(rows):
    """{conv_id: column: value}"""
    left, out = damage(rows), {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in left if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = {r[1] for r in mine if r[1] is not None}
        found, _ = brute.repaired([r[2:] for r in mine])
        out[c] = {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **found}
    return out


def sample(seed=1, n=60, longest=30):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        turn = 0
        for i in range(rng.randrange(longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 2])
            role = rng.choice([["user", "assistant"][i % 2], ["user", "assistant"][i % 2], "system", "user", "assistant", "", None, "Übung", "tool"])
            text = rng.choice([f"text {rng.randrange(9)}.", f"é {i}!", "breaks off", "", None, " \t\n", "mark. \n", " ", "日本?", "a\nb."])
            rows.append((c, rng.choice([turn, turn, turn, turn, turn, None]), role, text))
    return rows


def folder(spark, path, rows):
    """Other columns have names that the operator uses itself."""
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, k long, audit string, fault string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("chunk", [conv.CHUNK, 3])
def test_op13(spark, tmp_path, chunk):
    rows = sample()
    got = conv.op13_conversation_repair(spark, folder(spark, tmp_path, rows), chunk=chunk).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert {c: r[c] for c in COLUMNS} == want[r.conv_id], r.conv_id


@pytest.mark.parametrize("chunk", [conv.CHUNK, 2])
def test_messages(spark, tmp_path, chunk):
    rows = [r for r in sample(4, 12) if r[0] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in conv.repaired_messages(df, chunk=chunk).orderBy("k", "position").collect():
        got.setdefault(r.k, []).append((r.role, r.text))
    for c in {r[0] for r in rows}:
        mine = sorted(((t, " " if a is None else a, " " if b is None else b) for d, t, a, b in rows if d == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        assert got.get(c, []) == list(brute.repaired([r[1:] for r in mine])[1])


def test_long_texts_and_many_rows(spark, tmp_path):
    rows = [(1, i, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(9000)]
    rows += [(2, 0, "user", "x" * (20 << 20)), (2, 1, "assistant", " " * (20 << 20)), (2, 2, "assistant", ". " * (5 << 20))]
    got = {r.conv_id: r for r in conv.op13_conversation_repair(spark, folder(spark, tmp_path, rows)).collect()}
    want = expected(rows)
    for c in (1, 2):
        assert {x: got[c][x] for x in COLUMNS} == want[c]
