"""Plain loops that state what the distributed operators must return."""

import math
from collections import defaultdict


def fold(rows, *, unit_seconds, rate, reward, keep, start=50.0):
    """rows of (key, ts, seq, good) -> {(key, seq): trust}"""
    trust, seen, out = {}, {}, {}
    for key, ts, seq, good in sorted(rows, key=lambda r: (r[1], r[2])):
        x = trust.get(key, start)
        if key in seen:
            x *= math.exp(-rate * (ts - seen[key]).total_seconds() / unit_seconds)
        x = x + reward * (100.0 - x) if good else x * keep
        trust[key], seen[key], out[(key, seq)] = x, ts, x
    return out


def propagate(edges, direct, nodes=(), iterations=10, damping=0.85):
    citers = defaultdict(list)
    every = set(nodes)
    for src, dst in edges:
        citers[dst].append(src)
        every |= {src, dst}
    base = {n: direct.get(n, 0.5) for n in every}
    trust = dict(base)
    for _ in range(iterations):
        trust = {
            n: (1 - damping) * base[n]
            + damping * (sum(trust[c] for c in citers[n]) / len(citers[n]) if citers[n] else 0.5)
            for n in every
        }
    return trust
