"""Suffix sorting by grouping, in linear time and without recursion.

Suffixes start in one group per first symbol. Groups are processed from the
greatest to the least: each member follows previous-smaller pointers to the
last earlier suffix of a lesser group, and the suffixes so found move into new
groups right behind their old ones, the more members point to them the further
back. In the end a group holds the suffixes of one longest Lyndon prefix; the
order inside groups is then emitted from the least suffix on, by following the
same pointers.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in ascending order. The last symbol must be less than all others."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    sa = order.tolist()
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    at = at.tolist()
    first = np.repeat(starts, np.diff(np.append(starts, n)))
    group = np.empty(n, np.int64)
    group[order] = first
    group = group.tolist()  # where the suffix's group starts
    end = [0] * n  # by the group's start
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n]):
        end[a] = b
    prev = [-1] * n

    top = n
    while top > 0:
        g = group[sa[top - 1]]
        members = sa[g:top]
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            if len(times) == 1 or max(times.values()) == 1:
                layers = [list(times)] if len(set(times.values())) == 1 else None
            else:
                layers = None
            if layers is None:
                by: dict[int, list[int]] = {}
                for p, k in times.items():
                    by.setdefault(k, []).append(p)
                layers = [by[k] for k in sorted(by, reverse=True)]
            for layer in layers:
                touched: dict[int, int] = {}
                for p in layer:
                    h = group[p]
                    e = end[h]
                    if h not in touched:
                        touched[h] = e
                    e -= 1
                    end[h] = e
                    q, x = sa[e], at[p]
                    sa[x], at[q] = q, x
                    sa[e], at[p] = p, e
                for h, e in touched.items():
                    s = end[h]
                    for x in range(s, e):
                        group[sa[x]] = s
                    end[s] = e
        top = g

    out = [-1] * n
    place = list(range(n))  # by group start: the next free slot
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            done[j] = True
            j = prev[j]
    return np.array(out, np.int64)
