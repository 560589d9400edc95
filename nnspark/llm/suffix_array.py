"""Linear-time suffix sorting by grouping on Lyndon prefixes, without recursion or renaming.

Every suffix has a Lyndon prefix: its part before the next smaller suffix.  The first phase keeps suffixes in ordered
groups and visits the groups from the highest to the lowest.  When a group is visited its members share their Lyndon
prefix for good.  Each member hands that prefix to the suffix its previous-smaller pointer names, the nearest one to
its left in a lower group, and a group whose members receive it a different number of times is split by that number.
The second phase walks the suffix array from its smallest entry; each entry is the next smaller suffix of a chain of
previous-smaller pointers, and every suffix of that chain takes the next free place of its group.

This is the task-level helper of ``suffix_dedup``; it sorts the symbols of one bucket.
"""

from __future__ import annotations


def lyndon_groups(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(group of each suffix, previous-smaller pointer of each suffix, groups from the highest to the lowest).

    A pointer is -1 where no suffix to the left is in a lower group.
    """
    n = len(symbols)
    letters = sorted(set(symbols))
    number = {c: g for g, c in enumerate(letters)}
    group = [number[c] for c in symbols]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    lower = list(range(-1, len(letters) - 1))
    upper = [*range(1, len(letters)), -1]
    previous = [-1] * n
    visited = bytearray(n)
    visits = []
    g = len(letters) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        own.sort()  # a pointer may lead over a member of the same group, which then is known already
        visits.append(g)
        for i in own:
            visited[i] = 1
        received: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and visited[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                received[j] = received.get(j, 0) + 1
        if received:
            by_times: dict[int, list[int]] = {}
            for j, times in received.items():
                by_times.setdefault(times, []).append(j)
            for times in sorted(by_times, reverse=True):
                split: dict[int, list[int]] = {}
                for j in by_times[times]:
                    split.setdefault(group[j], []).append(j)
                for old, moved in split.items():
                    if len(moved) == size[old]:
                        continue  # the whole group extends its prefix alike
                    new = len(members)
                    members.append(moved)
                    size.append(len(moved))
                    size[old] -= len(moved)
                    for j in moved:
                        group[j] = new
                    above = upper[old]
                    lower.append(old)
                    upper.append(above)
                    upper[old] = new
                    if above >= 0:
                        lower[above] = new
        g = lower[g]
    return group, previous, visits


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of the suffixes of ``symbols`` in ascending order.

    The last symbol must be smaller than every other one.  An empty list gives an empty list.
    """
    n = len(symbols)
    if not n:
        return []
    group, previous, visits = lyndon_groups(symbols)
    count = [0] * (max(group) + 1)
    for g in group:
        count[g] += 1
    free = [0] * len(count)
    at = 0
    for g in reversed(visits):
        free[g] = at
        at += count[g]
    order = [0] * n
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return order
