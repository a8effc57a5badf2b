"""Suffix arrays by linear grouping along Lyndon prefixes."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The order of the suffixes of a sequence of small non-negative integers.

    First phase: suffixes lie in groups, at first by their first symbol, in the end by their Lyndon
    prefix.  Groups are processed in descending order.  A suffix of the group looks for the nearest
    suffix to its left in a lower group, jumping along the pointers of those already processed; the
    one found is followed by the group's prefix, as often as members of the group point to it in a row,
    and so moves behind the rest of its own group, further the more often.

    Second phase: the smallest suffix is known.  Going up the order, a suffix s determines those whose
    Lyndon prefix ends just before s - they form the chain of pointers from s - 1 - and each is the next
    of its group.  Nothing is renamed or solved recursively, and every step is constant time amortised.
    """
    n = len(text)
    if n == 0:
        return []
    # The end is a symbol of its own, smaller than all.
    count = [0] * (max(text) + 2)
    for x in text:
        count[x + 1] += 1
    start, total = [], 1
    for c in count[1:]:
        start.append(total)
        total += c
    group = [start[x] for x in text] + [0]  # first place of the suffix's group
    size = [0] * (n + 1)
    order, place = [0] * (n + 1), [0] * (n + 1)
    order[0] = n
    size[0] = 1
    for i, g in enumerate(group[:n]):
        p = g + size[g]
        order[p], place[i] = i, p
        size[g] += 1
    before = [-1] * (n + 1)
    high = n
    while high > 0:
        low = group[order[high]]
        members = order[low : high + 1]
        members.sort()
        times: dict[int, int] = {}  # members in a row that point to a suffix of a lower group
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > low:
                p = before[p]
            if p >= 0 and group[p] == low:  # the same prefix again: what the last one points to
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            if len(times) == 1 or max(times.values()) == 1:
                levels = [list(times)]
            else:
                by: dict[int, list[int]] = {}
                for p, k in times.items():
                    by.setdefault(k, []).append(p)
                levels = [by[k] for k in sorted(by, reverse=True)]
            for moved in levels:
                for p in moved:
                    g = group[p]
                    size[g] -= 1
                    end, at = g + size[g], place[p]
                    other = order[end]
                    order[at], place[other] = other, at
                    order[end], place[p] = p, end
                for p, g in zip(moved, [group[p] + size[group[p]] for p in moved]):
                    group[p] = g
                    size[g] += 1
        high = low - 1
    # Second phase; size now counts what is left to be placed, place marks what was placed.
    out = [0] * (n + 1)
    out[0] = n
    done = bytearray(n + 1)
    filled = [0] * (n + 1)
    for r in range(n + 1):
        p = out[r] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[g + filled[g]] = p
            filled[g] += 1
            done[p] = 1
            p = before[p]
    return out[1:]
