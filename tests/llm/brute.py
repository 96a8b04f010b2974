"""Plain versions of the operators, for small fixtures."""

import hashlib
import re

SPACE = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(SPACE, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def jaccard_components(rows, size, num, den):
    """rows: (id, text). {id: (n_shingles, component)}"""
    sets = {k: shingles(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, s in sets.items():
        both = {}
        for x in s:
            for other in holders[x]:
                if other < k:
                    both[other] = both.get(other, 0) + 1
        for other, n in both.items():
            if den * n >= num * (len(s) + len(sets[other]) - n):
                a, b = find(k), find(other)
                parent[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def repeats(rows, window):
    """rows: (id, text). {id: (n_words, n_removed, kept text)}"""
    seen, out = set(), {}
    for k, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone[i : i + window] = [True] * window
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        out[k] = (len(w), sum(gone), kept)
    return out


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def leaks(rows, items, window):
    """{id: (n_words, n_hit, sorted item ids)}"""
    wins = {}
    for item, t in items:
        w = alnum_words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(item)
    lens = {len(x) for x in wins}
    out = {}
    for k, t in rows:
        w = alnum_words(t)
        hit, found = [False] * len(w), set()
        for n in lens:
            for i in range(len(w) - n + 1):
                if got := wins.get(tuple(w[i : i + n])):
                    hit[i : i + n] = [True] * n
                    found |= got
        out[k] = (len(w), sum(hit), sorted(map(str, found)))
    return out


def longest_leaks(rows, items, window):
    """{id: (words, start) of the longest match that begins with a window; (0, None) without any}"""
    sought = [w for _, t in items if (w := alnum_words(t))]
    out = {}
    for k, t in rows:
        d, best = alnum_words(t), (0, None)
        for x in range(len(d)):
            for w in sought:
                for p in range(len(w)):
                    n = 0
                    while x + n < len(d) and p + n < len(w) and d[x + n] == w[p + n]:
                        n += 1
                    if n > best[0] and (n >= window or n == len(w)):
                        best = n, x
        out[k] = best
    return out


def repaired(rows):
    """rows: (role, text) of a conversation in order. {column: value}, from all edit sequences kept by state, as plain strings."""
    white, cost = " \t\n\x0b\x0c\r", {"K": 0, "R": 1, "D": 2, "I": 5}
    faults, seen = [], []
    for r in rows:
        end = r[1].rstrip(white)
        faults.append("blank" if not end else "duplicate" if r in seen else None if end[-1] in ".!?" else "truncated")
        seen.append(r)
    # (what came last, audit, repaired) by row; any best audit is the best of its own beginnings.
    speaks = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    now = {"": (0, "", ())}

    def better(new, state, x):
        if state not in new or x[:2] < new[state][:2]:
            new[state] = x

    def inserted(now):
        for _ in range(3):
            new = dict(now)
            for s, (c, audit, out) in now.items():
                better(new, speaks[s][0], (c + 5, audit + "I", (*out, (speaks[s], ""))))
            now = new
        return now

    for (role, text), fault in zip(rows, faults):
        new = {}
        for s, (c, audit, out) in inserted(now).items():
            better(new, s, (c + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                c += 5 * (fault == "truncated")
                better(new, speaks[s][0], (c + 1, audit + "R", (*out, (speaks[s], text))))
                if role[:1] == speaks[s][0] or (s, role[:1]) == ("", "s"):
                    better(new, role[:1], (c, audit + "K", (*out, (role, text))))
        now = new
    c, audit, out = min(x for s, x in inserted(now).items() if s in ("", "a"))
    first = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return {**{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": c, "audit": audit, "repaired_sha256": sha("\n".join(f"{r}:{t}" for r, t in out))}, out
