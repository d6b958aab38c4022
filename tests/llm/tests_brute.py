"""Brute-force versions that several tests share."""

import re


def components(rows, width=5, percent=80):
    """{doc_id: smallest doc_id of its class} by comparing all pairs that share an n-gram."""
    sets, by = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        for g in sets[i]:
            by.setdefault(g, []).append(i)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in {(a, b) for g in by.values() for k, a in enumerate(g) for b in g[k + 1:]}:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: find(i) for i in sets}
