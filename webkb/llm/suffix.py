"""Suffix sorting by linear grouping.

Suffixes are first grouped by their Lyndon prefix. Groups are taken from the highest to the lowest. For
every suffix of the group the previous smaller pointer is the nearest earlier suffix of a lower group; that
suffix's Lyndon prefix goes on with the group's, as often as members of the group point to it. Suffixes that
go on alike leave their group for a new one just above it. When all groups are fixed, one pass over the
suffix array emits every group's order along the pointers: a placed suffix places its predecessor.
Nothing is renamed or sorted recursively, and every pointer is followed a bounded number of times.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Positions of the suffixes of text in their order. The last symbol has to be smaller than every other."""
    n = len(text)
    if n == 0:
        return []
    number = {symbol: g for g, symbol in enumerate(sorted(set(text)))}
    group = [number[symbol] for symbol in text]
    members: list[list[int]] = [[] for _ in number]
    for i, g in enumerate(group):
        members[g].append(i)
    lower, upper = list(range(-1, len(number) - 1)), [*range(1, len(number)), -1]
    smaller, passed = [-1] * n, bytearray(n)
    fixed = []
    g = len(number) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        if own:
            fixed.append(g)
            targets, times = [], []
            for i in own:  # ascending, and so are their pointers
                s = i - 1
                while s >= 0 and passed[s]:
                    s = smaller[s]
                if s >= 0 and group[s] == g:
                    s = smaller[s]
                smaller[i] = s
                if s >= 0:
                    if targets and targets[-1] == s:
                        times[-1] += 1
                    else:
                        targets.append(s)
                        times.append(1)
            for i in own:
                passed[i] = 1
            members[g] = own
            if targets:
                most = max(times)
                for k in range(most, 0, -1) if most < 4 else sorted(set(times), reverse=True):
                    raised: dict[int, int] = {}
                    for s, t in zip(targets, times):
                        if t == k:
                            old = group[s]
                            new = raised.get(old)
                            if new is None:
                                new = raised[old] = len(members)
                                members.append([])
                                above = upper[old]
                                lower.append(old)
                                upper.append(above)
                                upper[old] = new
                                lower[above] = new
                            members[new].append(s)
                            group[s] = new
        g = lower[g]
    place, at = [0] * len(members), 0
    for g in reversed(fixed):
        place[g] = at
        at += len(members[g])
    out, placed = [0] * n, bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for at in range(n):
        s = out[at] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[place[g]] = s
            place[g] += 1
            placed[s] = 1
            s = smaller[s]
    return out
