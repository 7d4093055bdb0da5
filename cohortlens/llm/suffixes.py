"""Suffix order of integer sequences by Lyndon groups, and longest common prefixes of neighbours in that order."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order; the last symbol must be the smallest and occur once.

    First the suffixes are grouped by their Lyndon prefix.  Groups start as equal first symbols and are taken in
    descending order.  Every member's nearest smaller position to the left (over already known pointers) is the
    one whose Lyndon prefix the group's own prolongs; these positions move on to new groups right above their old
    ones, those prolonged more often further up.  A group is final when it is taken, so none is renamed.  Then the
    suffixes are put out in ascending order: when one is out, the positions that its end closes take the next
    place of their groups.  Both phases do a bounded amount of work per position.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], symbols[order][1:] != symbols[order][:-1])))
    sizes = np.diff(np.append(first, n))
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(first, sizes)
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    members, place, group = order.tolist(), place_of.tolist(), group_of.tolist()
    size = [0] * n
    for f, s in zip(first.tolist(), sizes.tolist(), strict=True):
        size[f] = s
    smaller = [-1] * n

    top = n
    while top > 0:
        start = group[members[top - 1]]
        if top - start == 1:
            # a single member: at most one position is prolonged, once
            s = members[start]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                g = group[p]
                k = size[g] - 1
                if k:
                    size[g] = k
                    to = g + k
                    at = place[p]
                    other = members[to]
                    members[at], place[other] = other, at
                    members[to], place[p] = p, to
                    group[p] = to
                    size[to] = 1
            top = start
            continue
        times: dict[int, int] = {}
        for s in sorted(members[start:top]):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            most = max(times.values())
            by_times: list[list[int]] = [[] for _ in range(most + 1)]
            for p, t in times.items():
                by_times[t].append(p)
            for t in range(most, 0, -1):
                # of one old group, all that are prolonged t times make one new group
                moved: dict[int, list[int]] = {}
                for p in by_times[t]:
                    g = group[p]
                    if g in moved:
                        moved[g].append(p)
                    else:
                        moved[g] = [p]
                for g, ps in moved.items():
                    k = size[g] - len(ps)
                    if not k:
                        continue
                    size[g] = k
                    to = g + k
                    size[to] = len(ps)
                    for j, p in enumerate(ps, to):
                        at = place[p]
                        other = members[j]
                        members[at], place[other] = other, at
                        members[j], place[p] = p, j
                        group[p] = to
        top = start

    out = [-1] * n
    free = list(range(n))
    out[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    free[0] = 1
    for r in range(n):
        p = out[r] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = 1
            p = smaller[p]
    return np.array(out, np.int64)


def common_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For every place in the order, the symbols its suffix shares with the one before, up to ``most``."""
    n = len(symbols)
    shared = np.zeros(n, np.int64)
    left, right = order[:-1], order[1:]
    active = np.arange(n - 1)
    for k in range(most):
        a, b = left[active] + k, right[active] + k
        inside = (a < n) & (b < n)
        active, a, b = active[inside], a[inside], b[inside]
        active = active[symbols[a] == symbols[b]]
        if not len(active):
            break
        shared[active + 1] += 1
    return shared
