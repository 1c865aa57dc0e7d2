"""Prediction by partial matching by definition, byte by byte, from counts in dictionaries."""

import math
from collections import Counter


def slow_model(train, depth):
    """log10 probability of a text and its end, given the training texts (bytes)."""
    seen = [{} for _ in range(depth + 1)]
    for s in (bytes(depth) + t + b"\xff" for t in train):
        for k in range(depth, len(s)):
            for d in range(depth + 1):
                seen[d].setdefault(s[k - d : k], Counter())[s[k]] += 1

    def kind(d, total, different):
        t = total if total <= 16 else min(17 + math.floor(2 * math.log2(total / 16)), 63)
        return d, t, min(different, 63)

    novel, known = Counter(), Counter()
    for d in range(depth + 1):
        for c in seen[d].values():
            total, once = sum(c.values()), sum(n == 1 for n in c.values())
            if total > 1:
                novel[kind(d, total - 1, len(c) - 1)] += once
                known[kind(d, total - 1, len(c))] += total - once

    def escape(d, total, different):
        if different == 256:
            return 0.0
        k = kind(d, total, different)
        return min(0.999, max(1e-6, (novel[k] + 8 * different / (2 * total)) / (novel[k] + known[k] + 8)))

    def one(s, k):
        out, p = set(), 1.0
        for d in range(depth, -1, -1):
            all_here = seen[d].get(s[k - d : k], {})
            here = {b: n for b, n in all_here.items() if b not in out}
            if here:
                total = sum(all_here.values())
                e = escape(d, total, len(all_here))
                whole = (1 - e) * sum(here.values()) / total + e
                if s[k] in here:
                    return p * (1 - e) * here[s[k]] / total / whole
                p *= e / whole
                out |= set(here)
        return p / (256 - len(out))

    return lambda t: sum(math.log10(one(bytes(depth) + t + b"\xff", k)) for k in range(depth, depth + len(t) + 1))
