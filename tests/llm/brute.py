"""Plain Python versions of the operators, row by row, to compare with."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text, size=5):
    w = words(text)
    if 0 < len(w) < size:
        return {tuple(w)}
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def components(rows, size=5, percent=75):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows; no prefix, no hashing."""
    sets = [shingles(t, size) for _, t in rows]
    where = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            where[x].append(n)
    parent = list(range(len(rows)))

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for n, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for m in where[x]:
                if m < n:
                    common[m] += 1
        for m, c in common.items():
            if rows[n][0] is not None and rows[m][0] is not None and 100 * c >= percent * (len(s) + len(sets[m]) - c):
                parent[find(n)] = find(m)
    least = {}
    for n, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(n)] = min(least.get(find(n), doc_id), doc_id)
    return [(doc_id, len(sets[n]), least.get(find(n)) if doc_id is not None else None) for n, (doc_id, _) in enumerate(rows)]


def drop_lines(rows, min_docs=10, min_chars=1):
    """(doc_id, n_lines, n_dropped, kept text) of (doc_id, text) rows."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(holders.get(key(x), ())) < min_docs]
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def jump_hash_moves(before, after, shards):
    """With one shard more a key stays or goes to the new one."""
    return all(a == b or a == shards for b, a in zip(before, after))
