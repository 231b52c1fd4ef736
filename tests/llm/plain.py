"""The operators' results in plain, slow code."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def remainder(doc_id, m):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % m


def base_scores(rows):
    """(held_out, n_tokens, n_known, N, base score) of every (doc_id, text)."""
    tokens = [WORD.findall(lower(t)) + ["\n"] for _, t in rows]
    held = [remainder(i, 7) == 2 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws, h in zip(tokens, held)]


def rule_counts(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often, marked = Counter(windows), set()
    for k, x in enumerate(windows):
        if often[x] > 1:
            marked |= set(range(k, k + 5))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(marked) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), failed


def cleaned_lines(rows, least=50):
    """Text without later copies of runs of at least ``least`` words, per (doc_id, text) in reading order."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    full = [[(n, x.strip(" \t\r\x0b\x0c")) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")] if t is not None else [] for _, t in rows]
    words = [[len(WORD.findall(x)) for _, x in f] for f in full]
    seen, gone = set(), [set() for _ in rows]
    for r in order:
        here = [(s, e) for s in range(len(full[r])) for e in range(s + 1, len(full[r]) + 1) if sum(words[r][s:e]) >= least]
        runs = {}
        for s, e in here:
            runs.setdefault(tuple(x for _, x in full[r][s:e]), []).append((s, e))
        for run, places in runs.items():
            for s, e in places if run in seen else places[1:]:
                gone[r] |= set(range(s, e))
        seen |= set(runs)
    out = []
    for (_, t), f, g in zip(rows, full, gone):
        if t is None:
            out.append((None, 0))
            continue
        cut, drop = sorted(g), set()
        for i in cut:
            drop.add(f[i][0])
            if i + 1 in g:
                drop |= set(range(f[i][0], f[i + 1][0]))
        out.append(("\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop), len(g)))
    return out


def fingerprint(t):
    w = WORD.findall(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 3] for i in range(len(w) - 2)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, most=3):
    """A group's number for every fingerprint."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def windows(items, size=10):
    out = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    return out


def hits(t, phrases):
    """Words, hit word numbers, items."""
    w, hit, items = ALNUM.findall(lower(t)), set(), set()
    for n in {len(p) for p in phrases}:
        for k in range(len(w) - n + 1):
            if (p := tuple(w[k : k + n])) in phrases:
                hit |= set(range(k, k + n))
                items |= phrases[p]
    return len(w), hit, items


def without(t, hit):
    """The text without the characters from the first to the last word of each run of hit words."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    drop = set()
    for k in hit:
        drop |= set(range(*at[k]))
        if k + 1 in hit:
            drop |= set(range(at[k][1], at[k + 1][0]))
    return t and "".join(c for i, c in enumerate(t) if i not in drop)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(t):
    out = []
    for order, (kind, pattern) in enumerate(PERSONAL.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), order, m.end(), kind))
    return [f"{k}:{a}:{z}" for a, _, z, k in sorted(out)]


def ids_hash(ids):
    return sha(struct.pack(f"<{len(ids)}I", *ids))
