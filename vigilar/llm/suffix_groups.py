"""Suffix arrays by linear grouping: Lyndon prefixes in descending order, then emission of each group.

Every suffix starts in the group of its first symbol. Groups are taken from the highest down; a
group's suffixes then share their longest Lyndon prefix. Each suffix points to the nearest earlier
position of a lower group (previous-smaller pointer), whose prefix ends where the suffix begins: it
grows by the group's prefix, once or several times, and moves to a higher group of its own.

After that, the order inside groups needs no renaming: suffixes are emitted from the smallest on, and
an emitted suffix lets those that end their Lyndon prefix at it take the next place in their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of an integer text in lexicographic order (shorter first)."""
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    widths = np.diff(np.concatenate([heads, [n]]))
    sizes_at = np.zeros(n, dtype=np.int64)
    sizes_at[heads] = widths
    group_of = np.empty(n, dtype=np.int64)
    group_of[order] = np.repeat(heads, widths)
    place_of = np.empty(n, dtype=np.int64)
    place_of[order] = np.arange(n)
    smaller, group = _group(order.tolist(), place_of.tolist(), group_of.tolist(), sizes_at.tolist())
    return np.array(_emit(smaller, group), dtype=np.int64)


def _group(at: list[int], place: list[int], group: list[int], size: list[int]) -> tuple[list[int], list[int]]:
    """Previous-smaller pointers and final groups (named by their first place)."""
    n = len(at)
    smaller = [-1] * n
    end = n
    while end:
        g = group[at[end - 1]]
        if end - g == 1:
            s = at[g]
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                h = group[p]
                m = size[h]
                if m > 1:
                    last = h + m - 1
                    q, where = at[last], place[p]
                    at[where], place[q] = q, where
                    at[last], place[p] = p, last
                    size[h], size[last], group[p] = m - 1, 1, last
        else:
            times: dict[int, int] = {}
            for s in sorted(at[g:end]):
                p = s - 1
                while p >= 0 and group[p] >= g:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            grown: dict[int, list[tuple[int, int]]] = {}
            for p, k in times.items():
                grown.setdefault(group[p], []).append((k, p))
            for h, members in grown.items():
                members.sort(reverse=True)
                stop = h + size[h]
                i = 0
                while i < len(members):
                    k, j = members[i][0], i
                    while j < len(members) and members[j][0] == k:
                        p = members[j][1]
                        stop -= 1
                        q, where = at[stop], place[p]
                        at[where], place[q] = q, where
                        at[stop], place[p] = p, stop
                        j += 1
                    for _, p in members[i:j]:
                        group[p] = stop
                    size[stop] = j - i
                    i = j
                if stop > h:
                    size[h] = stop - h
        end = g
    return smaller, group


def _emit(smaller: list[int], group: list[int]) -> list[int]:
    n = len(group)
    out = [0] * n
    free = list(range(n))  # next free place of the group that starts there
    done = bytearray(n + 1)
    i = n - 1
    while i >= 0:  # suffixes whose Lyndon prefix ends with the text
        g = group[i]
        out[free[g]] = i
        free[g] += 1
        done[i] = 1
        i = smaller[i]
    for r in range(n):
        i = out[r] - 1
        while i >= 0 and not done[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            done[i] = 1
            i = smaller[i]
    return out


def repeated(symbols: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``order`` in intervals of common prefixes of at least ``length``.

    Returns the positions of the suffixes in these intervals and the start of each interval among them.
    """
    fit = order + length <= len(symbols)
    kept = order[fit]
    if len(kept) < 2:
        return kept[:0], kept[:0]
    same = np.ones(len(kept) - 1, dtype=bool)
    # Suffixes too short for it were left out above: they cannot stand between two that share a prefix of that length.
    for j in range(length):
        row = symbols[kept + j]
        same &= row[1:] == row[:-1]
    inside = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    first = ~np.concatenate([[False], same])
    return kept[inside], np.flatnonzero(first[inside])
