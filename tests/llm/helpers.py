"""Brute-force versions used by several tests."""

import collections

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def near_groups(sets, percent=85):
    """doc -> smallest reachable doc, by brute force over shared shingles."""
    held = collections.defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            held[x].append(doc)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for doc, s in sets.items():
        common = collections.Counter(o for x in s for o in held[x] if o < doc)
        for other, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = sorted((find(doc), find(other)))
                up[b] = a
    return {d: find(d) for d in sets}
