"""Suffix array of an integer string by grouping suffixes on their Lyndon prefixes.

After Baier, "Linear-time suffix sorting - a new approach for suffix array
construction" (CPM 2016). First suffixes are put into groups by their longest
Lyndon prefix: groups are taken from the largest down, and each lifts the
positions before its members, found through pointers to the previous smaller
suffix, out of their groups. Then the order inside the groups follows in one
pass, without naming anything anew and without recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in lexicographic order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # a smallest character behind the text, so that no suffix is a prefix of another
    ranks = np.append(np.unique(text, return_inverse=True)[1].ravel() + 1, 0)
    n += 1
    order = np.argsort(ranks, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    starts = np.searchsorted(ranks[order], ranks)
    group, prev = _lyndon_groups(order.tolist(), place.tolist(), starts.tolist())
    return _inside_groups(group, prev)[1:]


def _lyndon_groups(sa: list[int], place: list[int], group: list[int]) -> tuple[list[int], list[int]]:
    """Of each suffix: where its group starts, and the previous position of a smaller group.

    ``sa`` holds the groups one after the other, ``place`` inverts it, and
    ``group`` has the start of each suffix's group.
    """
    n = len(sa)
    prev = [-1] * n
    size = [0] * n
    for g in group:
        size[g] += 1
    end = n
    while end:
        start = group[sa[end - 1]]
        if end - start == 1:
            i = sa[start]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[i] = p
            rounds = ((p,),) if p >= 0 else ()
        else:
            times: dict[int, int] = {}
            for i in sorted(sa[start:end]):
                p = i - 1
                while p >= 0 and group[p] >= start:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            by_times: dict[int, list[int]] = {}
            for p, t in times.items():
                by_times.setdefault(t, []).append(p)
            rounds = [by_times[t] for t in sorted(by_times, reverse=True)]
        for ps in rounds:
            # move the positions to the end of their groups ...
            moved: dict[int, int] = {}
            for p in ps:
                g = group[p]
                k = moved.get(g, 0) + 1
                moved[g] = k
                to = g + size[g] - k
                at = place[p]
                if at != to:
                    q = sa[to]
                    sa[at], place[q] = q, at
                    sa[to], place[p] = p, to
            # ... and make each such end a group of its own, right above the rest
            for g, k in moved.items():
                if k < size[g]:
                    size[g] -= k
                    new = g + size[g]
                    size[new] = k
                    for p in sa[new : new + k]:
                        group[p] = new
        end = start
    return group, prev


def _inside_groups(group: list[int], prev: list[int]) -> np.ndarray:
    n = len(group)
    out = [-1] * n
    free = list(range(n))  # at a group's start: the next free place in it
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = True
            p = prev[p]
    return np.array(out)
