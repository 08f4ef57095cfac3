"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = words(ascii_lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def near_dup(rows):
    """doc_id -> (n_shingles, component_id, kept), comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    common = Counter()
    for ks in holders.values():
        for a in range(len(ks)):
            for b in range(a + 1, len(ks)):
                common[ks[a], ks[b]] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = root(sets[a][0]), root(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    found.sort()
    names = ["email", "ip", "card", "phone"]
    counts = [sum(k == i for _, k, _ in found) for i in range(4)]
    listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in found)
    return (*counts, hashlib.sha256(listed.encode()).hexdigest()), listed


def held(doc_id, parts, part):
    return zlib.crc32(str(doc_id).encode()) % parts == part


def base_scores(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = {i: [*words(ascii_lower(t)), None] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if not held(i, 7, 2) for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held(i, 7, 2), len(ws), sum(c[w] > 0 for w in ws), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def best_fit(counts):
    """Multiples of the sequences that filling each with the longest pieces that still fit gives."""
    left, out = counts.copy(), []
    while left.any():
        room, one = len(counts) - 1, {}
        for k in reversed([k for k, n in enumerate(left) if n]):
            if a := min(room // k, int(left[k])):
                one[k], room = a, room - a * k
        m = min(int(left[k]) // a for k, a in one.items())
        out.append(m)
        for k, a in one.items():
            left[k] -= a * m
    return out
