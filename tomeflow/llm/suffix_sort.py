"""Suffix array by Lyndon grouping, without renaming a reduced text; linear but for sorting the alphabet and each group's members.

Suffixes are grouped by their longest Lyndon prefix. Groups are settled from the
largest down: each member points to the nearest earlier suffix of a smaller
group, and the suffixes pointed at move up, behind those of their group that
gained less, as their Lyndon prefix now includes the member's. Then groups are
emitted in ascending order: a suffix of the array places, at the front of their
groups, exactly those suffixes whose Lyndon prefix ends where it starts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of all suffixes of ``symbols`` in lexicographic order; a shorter suffix comes before its extensions."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    n += 1  # the end is a symbol of its own, below all others
    head: dict[int, int] = {}
    at = 1
    counts = Counter(symbols)
    for c in sorted(counts):
        head[c] = at
        at += counts[c]
    group = [head[c] for c in symbols]  # first slot of each suffix's group
    group.append(0)
    size = [0] * n
    for c, k in counts.items():
        size[head[c]] = k
    size[0] = 1
    free = dict(head)
    slots, slot = [n - 1] * n, [0] * n
    for s, c in enumerate(symbols):
        i = free[c]
        free[c] = i + 1
        slots[i] = s
        slot[s] = i
    smaller = [-1] * n

    hi = n - 1
    while hi > 0:
        lo = group[slots[hi]]
        members = slots[lo : hi + 1]
        if hi > lo:
            members.sort()
        gained: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= lo:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                gained[p] = gained.get(p, 0) + 1
        if gained:
            by_gain: dict[int, list[int]] = {}
            for p, k in gained.items():
                by_gain.setdefault(k, []).append(p)
            for k in sorted(by_gain, reverse=True) if len(by_gain) > 1 else by_gain:
                moved = by_gain[k]
                for p in moved:
                    g = group[p]
                    left = size[g] - 1
                    size[g] = left
                    last = g + left
                    here = slot[p]
                    if here != last:
                        other = slots[last]
                        slots[here] = other
                        slot[other] = here
                        slots[last] = p
                        slot[p] = last
                for p in moved:
                    g = group[p]
                    group[p] = -(g + size[g])  # marked until all of its group have moved
                for p in moved:
                    g = -group[p]
                    group[p] = g
                    size[g] += 1
        hi = lo - 1

    out = [0] * n
    out[0] = n - 1
    front = list(range(n))
    for s in out:  # grows ahead of the loop: a suffix is placed by a smaller one
        p, end = s - 1, smaller[s]
        while p != end:
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            p = smaller[p]
    return out[1:]
