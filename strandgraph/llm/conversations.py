"""Repair of the structure of conversations: the cheapest edits after which roles read `(s?(ua)+)?`.

A row may be kept (K), given the role user or assistant (R, 1), or deleted (D, 2; blank rows and repeats must be); a
message without text may be inserted (I, 5) anywhere; a row whose text breaks off costs 5 more unless it is deleted. Of equally
cheap audits (the edits' letters in order) the least in ASCII is taken. An audit leaves no choice of roles: after nothing, a system
message or an assistant comes a user, after a user an assistant.

The audit DP keeps the best audit for each state (what came last). Audits are persistent: a node of a tree is its parent's
audit and one letter, so prefixes are shared. Each node has its ancestors 1, 2, 4, ... letters back and a rolling hash. Ties
search for the longest common prefix by jumps to ancestors of equal hash, which are then verified letter by letter.

Conversations of ordinary length are repaired row by row as they stream through tasks that hold one of them at a time. Long
ones are cut into chunks: the DP runs over each chunk from each state that it may begin in, the chunks' costs (sixteen
numbers) are put together for a conversation, and chosen audits go back to the rows. Letters I go before the row that follows
them, so no chunk's audit is the beginning of another one's, and the least audit is found chunk by chunk.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.store import discard, id_of, key_of, written
from strandgraph.llm.text import arrow_limits
from strandgraph.operators.graph import dense_index
from strandgraph.operators.skew import hot_keys, spread_join

#: Rows of a chunk; a conversation with more rows, or more bytes than CHUNK_BYTES, is a long one.
CHUNK = 4096
CHUNK_BYTES = 8 << 20
#: Keys of long conversations are broadcast up to so many of them.
BROADCAST_KEYS = 500_000

# What edits cost, white space, and what ends a sentence.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
BROKEN_OFF = 5
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

#: States are what the repaired conversation ends with.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a message of each initial that is legal.
LEGAL = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The state after a message whose role is chosen.
SPEAKS = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
PAIRS = {"su", "ua", "au"}


class Audits:
    """Strings of edits as nodes of a tree; node 0 is the empty one."""

    MODULUS, BASE = (1 << 61) - 1, 1_000_003

    def __init__(self):
        self.edit, self.depth, self.hash = [""], [0], [0]
        #: Ancestors 1, 2, 4, ... letters back, as far as there are any.
        self.up: list[list[int]] = [[]]

    def add(self, parent: int, edit: str) -> int:
        up, j = [parent], 0
        while j < len(self.up[up[j]]):
            up.append(self.up[up[j]][j])
            j += 1
        self.edit.append(edit)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.BASE + ord(edit)) % self.MODULUS)
        self.up.append(up)
        return len(self.up) - 1

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def lifted(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def equal(self, a: int, b: int) -> bool:
        """Of nodes of one depth, letter by letter up to the first shared node."""
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, x: str, b: int, y: str) -> bool:
        """Whether audit a and the letter x come before audit b and the letter y."""
        if a == b:
            return x < y
        depth = min(self.depth[a], self.depth[b])
        c, d = self.lifted(a, depth), self.lifted(b, depth)
        if self.hash[c] == self.hash[d]:
            if not self.equal(c, d):
                return self.text(a) + x < self.text(b) + y
            after = lambda node, letter: self.edit[self.lifted(node, depth + 1)] if self.depth[node] > depth else letter
            return after(a, x) + x < after(b, y) + y if self.depth[a] == self.depth[b] else after(a, x) < after(b, y)
        for j in reversed(range(len(self.up[c]))):
            if j < len(self.up[c]) and self.hash[self.up[c][j]] != self.hash[self.up[d][j]]:
                c, d = self.up[c][j], self.up[d][j]
        if not self.equal(self.up[c][0], self.up[d][0]):
            return self.text(a) + x < self.text(b) + y
        return self.edit[c] < self.edit[d]


def _offer(audits: Audits, best: dict, state: int, cost: int, parent: int, edit: str) -> None:
    """best: state -> (cost, parent, edit), or (cost, node, None) for an audit that is a node already."""
    now = best.get(state)
    if now is None or cost < now[0]:
        best[state] = (cost, parent, edit)
    elif cost == now[0]:
        node, letter = (now[1], now[2]) if now[2] else (audits.up[now[1]][0], audits.edit[now[1]]) if now[1] else (0, "")
        if audits.less(parent, edit, node, letter):
            best[state] = (cost, parent, edit)


def _settled(audits: Audits, best: dict) -> dict[int, tuple[int, int]]:
    return {s: (cost, audits.add(node, edit) if edit else node) for s, (cost, node, edit) in best.items()}


def _inserted(audits: Audits, now: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """The best audits once messages may be inserted; two of them reach any state."""
    for _ in range(2):
        best: dict = {s: (cost, node, None) for s, (cost, node) in now.items()}
        for state, (cost, node) in now.items():
            _offer(audits, best, SPEAKS[state], cost + COST["I"], node, "I")
        now = _settled(audits, best)
    return now


def audits_of(rows: Iterable[tuple[str, str | None]], start: int, last: bool) -> dict[int, tuple[int, str]]:
    """state -> cost, audit: the best edits of rows (initial of the role, fault) from the state before. last: messages may be
    inserted after the rows too, and only whole conversations count."""
    audits = Audits()
    now = {start: (0, 0)}
    for initial, fault in rows:
        best: dict = {}
        more = BROKEN_OFF if fault == "truncated" else 0
        for state, (cost, node) in _inserted(audits, now).items():
            _offer(audits, best, state, cost + COST["D"], node, "D")
            if fault in (None, "truncated"):
                _offer(audits, best, SPEAKS[state], cost + COST["R"] + more, node, "R")
                if (to := LEGAL[state].get(initial)) is not None:
                    _offer(audits, best, to, cost + COST["K"] + more, node, "K")
        now = _settled(audits, best)
    if last:
        now = {s: x for s, x in _inserted(audits, now).items() if s in (NOTHING, ASSISTANT)}
    return {s: (cost, audits.text(node)) for s, (cost, node) in now.items()}


def best_audit(rows: Iterable[tuple[str, str | None]]) -> tuple[int, str]:
    """The cheapest audit of a whole conversation, of equal ones the least."""
    return min(audits_of(rows, NOTHING, True).values())


def applied(audit: str, initials: list[str], state: int = NOTHING) -> list[tuple[str, int]]:
    """For each row its edits (inserts before it, then its own) and the state before them; and once more for inserts after
    all rows, if there are any."""
    out = []
    for i, edits in enumerate(re.findall("I*[KRD]|I+$", audit)):
        out.append((edits, state))
        for e in edits:
            state = after(state, e, initials[i] if e == "K" else "")
    return out


def after(state: int, edit: str, initial: str) -> int:
    return state if edit == "D" else LEGAL[state][initial] if edit == "K" else SPEAKS[state]


def fault(role: str, text: str, seen: set) -> str | None:
    """A row's first fault; seen: role and text of the rows before."""
    end = text.rstrip(WHITE)
    if not end:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    seen.add((role, text))
    return None if end.endswith(ENDS) else "truncated"


EDITS = pa.schema([("k", pa.int64()), ("idx", pa.int64()), ("edits", pa.string()), ("state", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
_EDITS_DDL = "k long, idx long, edits string, state long, role string, text string, fault string"


def _rows(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[tuple]:
    """The rows of batches, a few at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, most).columns))


def _packed(rows: Iterable[tuple], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded numbers of rows, and of bytes where rows have a text."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += sum(len(x) for x in r if isinstance(x, (str, bytes)))
        if len(part) == most or size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, role, text) in order to their edits, one conversation at a time."""

    def repaired() -> Iterator[tuple]:
        for k, group in itertools.groupby(_rows(batches), lambda r: r[0]):
            said = [(role, text) for _, role, text in group]
            seen: set = set()
            faults = [fault(role, text, seen) for role, text in said]
            initials = [role[:1] for role, _ in said]
            _, audit = best_audit(zip(initials, faults))
            for i, (edits, state) in enumerate(applied(audit, initials)):
                role, text = said[i] if i < len(said) else (None, None)
                yield k, i, edits, state, role, text, faults[i] if i < len(said) else None

    yield from _packed(repaired(), EDITS)


_TABLES = pa.schema([("k", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("state", pa.int64()), ("cost", pa.int64()), ("rank", pa.int64()), ("audit", pa.string())])


def _chunk_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, chunk, last, initial, fault) in order to each chunk's costs and audits by the states before and after it. rank: the
    audit's place among those of one state before, in ASCII."""

    def tables() -> Iterator[tuple]:
        for (k, chunk, last), group in itertools.groupby(_rows(batches), lambda r: r[:3]):
            rows = [(r[3], r[4]) for r in group]
            for start in (NOTHING,) if chunk == 0 else range(4):
                found = audits_of(rows, start, last)
                order = sorted(found, key=lambda s: found[s][1])
                for state, (cost, audit) in found.items():
                    yield k, chunk, start, state, cost, order.index(state), audit

    yield from _packed(tables(), _TABLES, 64)


_PATHS = pa.schema([("k", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("state", pa.int64())])


def _chunk_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk tables without audits, in order, to the states of the best path: the cheapest ends are summed backwards, and the
    least audit among what stays cheapest is taken forwards."""

    def paths() -> Iterator[tuple]:
        for k, group in itertools.groupby(_rows(batches), lambda r: r[0]):
            chunks = [list(g) for _, g in itertools.groupby(group, lambda r: r[1])]
            rest: list[dict] = [dict.fromkeys(range(4), 0)]
            for rows in reversed(chunks):
                now: dict = {}
                for _, _, start, state, cost, _ in rows:
                    if state in rest[-1]:
                        now[start] = min(now.get(start, 1 << 60), cost + rest[-1][state])
                rest.append(now)
            at = NOTHING
            for i, rows in enumerate(chunks):
                best, ahead = rest[len(chunks) - i], rest[len(chunks) - i - 1]
                _, state = min((rank, state) for _, _, start, state, cost, rank in rows if start == at and state in ahead and cost + ahead[state] == best[at])
                yield k, rows[0][1], at, state
                at = state

    yield from _packed(paths(), _PATHS)


_SPLIT = pa.schema([("k", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("idx", pa.int64()), ("edits", pa.string())])


def _split_audits(chunk_rows: int):
    """(k, chunk, start, audit) to the edits of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((k, chunk, start, chunk * chunk_rows + i, e) for k, chunk, start, audit in _rows(batches, 16) for i, e in enumerate(re.findall("I*[KRD]|I+$", audit)))
        yield from _packed(each, _SPLIT)

    return run


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits (k, idx, edits, start, role, text, fault) in order, start being the state before a chunk, with the state before each."""

    def stated() -> Iterator[tuple]:
        for _, group in itertools.groupby(_rows(batches), lambda r: (r[0], r[7])):
            state = None
            for k, idx, edits, start, role, text, said, _ in group:
                state = start if state is None else state
                yield k, idx, edits, state, role, text, said
                for e in edits:
                    state = after(state, e, (role or "")[:1])

    yield from _packed(stated(), EDITS)


def repairs(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame | None]:
    """The edits of each conversation, for each row and in order: k (the conversation's id as a key, see store.key_of), idx, edits (inserts
    before the row, and the row's own), state (before these edits), role, text, and the row's first fault (blank, duplicate,
    truncated or null). A last row without role and text has the inserts after all others. Two tables: of ordinary
    conversations, each of which is contiguous and in order in one partition, and of long ones (None without any), unordered.

    Order: by turn (nulls first), and within a turn by role and text. Null roles and texts are one space. Rows of a null id are a
    conversation. Equal rows of a turn are duplicates. Other columns aren't read. An empty table gives no rows. Texts of long
    conversations are compared by MD5.
    """
    spark = messages.sparkSession
    arrow_limits(spark)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = messages.select(key_of(conversation).alias("k"), F.col(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    order = ("k", "turn", "role", "text")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = written(sizes.filter((F.col("n") > chunk) | (F.col("bytes") > CHUNK_BYTES)).select("k", "n"), "long-conversations")
    n_long = long.limit(BROADCAST_KEYS + 1).count()
    if not n_long:
        discard(long)
        return rows.repartition("k").sortWithinPartitions(*order).select("k", "role", "text").mapInArrow(_repair, _EDITS_DDL), None
    long = F.broadcast(long) if n_long <= BROADCAST_KEYS else long
    short = rows.join(long.select("k"), "k", "left_anti").repartition("k").sortWithinPartitions(*order).select("k", "role", "text").mapInArrow(_repair, _EDITS_DDL)
    return short, _long_repairs(rows.join(long, "k"), chunk)


def _long_repairs(rows: DataFrame, chunk: int) -> DataFrame:
    """rows: k, turn, role, text, n. No conversation is gathered: rows are numbered by slices of the order, repeats are found by
    digest, and chunks are dealt to tasks. Only sixteen numbers of each chunk come together."""
    placed = dense_index(rows, "k", "turn", "role", "text")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    looks = F.when(end == "", "blank").when(F.right(end, F.lit(1)).isin(*ENDS), "whole").otherwise("truncated")
    keyed = written(placed.select("k", "idx", "role", "text", "n", digest.alias("digest"), looks.alias("looks")), "messages")
    first = keyed.groupBy("k", "digest").agg(F.min("idx").alias("first"))
    (hot,) = hot_keys(keyed, ["k", "digest"])
    said = F.when(F.col("looks") == "blank", "blank").when(F.col("first") < F.col("idx"), "duplicate").when(F.col("looks") == "truncated", "truncated")
    faulty = written(spread_join(keyed, first, ["k", "digest"], hot).select("k", "idx", "role", "text", "n", said.alias("fault"), F.expr(f"idx div {chunk}").alias("chunk")), "faults")
    discard(keyed)
    last = (F.col("chunk") == F.expr(f"(n - 1) div {chunk}")).alias("last")
    dealt = faulty.select("k", "chunk", last, F.left("role", F.lit(1)).alias("initial"), "fault", "idx").repartition("k", "chunk").sortWithinPartitions("k", "chunk", "idx").drop("idx")
    tables = written(dealt.mapInArrow(_chunk_tables, "k long, chunk long, start long, state long, cost long, rank long, audit string"), "chunks")
    path = tables.drop("audit").repartition("k").sortWithinPartitions("k", "chunk", "start", "state").mapInArrow(_chunk_paths, "k long, chunk long, start long, state long")
    chosen = tables.join(path, ["k", "chunk", "start", "state"]).select("k", "chunk", "start", "audit")
    edits = chosen.mapInArrow(_split_audits(chunk), "k long, chunk long, start long, idx long, edits string")
    # Inserts after all rows have an index that no row has.
    whole = edits.join(faulty.select("k", "idx", "role", "text", "fault"), ["k", "idx"], "left").repartition("k", "chunk").sortWithinPartitions("k", "chunk", "idx")
    return whole.select("k", "idx", "edits", "start", "role", "text", "fault", "chunk").mapInArrow(_states, _EDITS_DDL)


_DIGESTS = pa.schema([(c, pa.int64()) for c in ("k", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order to one row a conversation. Texts stream through; the audit alone is held."""

    def digested() -> Iterator[tuple]:
        for k, group in itertools.groupby(_rows(batches), lambda r: r[0]):
            faults, illegal, cost, audit = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, []
            before, sha, between = None, hashlib.sha256(), b""
            for _, _, edits, state, role, text, said in group:
                audit.append(edits)
                cost += sum(COST[e] for e in edits)
                if role is not None:
                    illegal += before is not None and before + role[:1] not in PAIRS
                    before = role[:1]
                    cost += BROKEN_OFF if said == "truncated" and edits[-1] != "D" else 0
                if said:
                    faults[said] += 1
                for e in edits:
                    state = after(state, e, (role or "")[:1])
                    if e != "D":
                        sha.update(between + f"{role if e == 'K' else ROLES[state]}:{'' if e == 'I' else text}".encode())
                        between = b"\n"
            yield k, *faults.values(), illegal, cost, "".join(audit), sha.hexdigest()

    yield from _packed(digested(), _DIGESTS)


def summaries(messages: DataFrame, **options) -> DataFrame:
    """k, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation; see repairs for columns and order.
    A hash takes its texts one after another, so those of a long conversation stream through one task, which doesn't hold them."""
    ddl = "k long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    short, long = repairs(messages, **options)
    out = short.mapInArrow(_digest, ddl)
    if long is not None:
        out = out.unionByName(long.repartition("k").sortWithinPartitions("k", "idx").mapInArrow(_digest, ddl))
    return out


def repaired_messages(messages: DataFrame, **options) -> DataFrame:
    """k, position, role, text: the repaired conversations, a row for each message."""
    short, long = repairs(messages, **options)
    edits = short if long is None else short.unionByName(long)

    @F.pandas_udf("array<struct<role: string, text: string>>")
    def said(edits: pd.Series, state: pd.Series, role: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for e, s, r, t in zip(edits, state, role, text):
            row = []
            for x in e:
                s = after(s, x, (r or "")[:1])
                if x != "D":
                    row.append({"role": r if x == "K" else ROLES[s], "text": "" if x == "I" else t})
            out.append(row)
        return pd.Series(out)

    # Positions: the row's number, and the place among what its edits give.
    each = edits.select("k", "idx", F.posexplode(said("edits", "state", "role", "text")).alias("place", "m"))
    return dense_index(each, "k", "idx", "place", out="position").select("k", "position", "m.role", "m.text")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the contract's damaged rows, and kept (false for a row that it drops)."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h: Column = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(h == 4, "user").otherwise(spaced("role"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(h == 3, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (h != 0).alias("kept"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark, sf_dir: str, chunk: int = CHUNK) -> DataFrame:
    """Contract of operator 13, over all conversations. Rows of one turn are in the order of role and text."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    kept_turn = F.when(F.col("kept"), F.col("turn"))
    turns = rows.groupBy(key_of("conv_id").alias("k"), "turn").agg(F.max(kept_turn).alias("there"))
    gaps = F.coalesce(F.max("there") - F.min("there") + 1 - F.count("there"), F.lit(0).cast("long"))
    every = turns.groupBy("k").agg(gaps.alias("gaps"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    found = every.join(summaries(rows.filter("kept"), chunk=chunk), "k", "left")
    none = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return found.select(id_of("k").alias("conv_id"), "gaps", *(zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), none)
