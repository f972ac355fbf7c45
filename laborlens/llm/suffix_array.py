"""A suffix array by linear grouping, without recursion or renaming.

First, suffixes are grouped by their Lyndon prefix.  Groups start as equal first symbols and are
processed from the highest down; a suffix of the group being processed extends the prefix of the
nearest suffix before it that is in a lower group, which moves to a new group right above its old
one.  Then suffixes are put in order from the lowest up: each suffix that gets its place gives the
next place of their groups to the suffixes before it that lead to it by those pointers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Start positions of all suffixes in order; a suffix that is a prefix of another comes first."""
    text = [*(s + 1 for s in symbols), 0]  # an end that is smaller than all
    if min(text[:-1], default=1) < 1:
        raise ValueError("symbols must not be negative")
    previous, group_of = _groups(text)
    return _emit(previous, group_of)[1:]


def _groups(text: list[int]) -> tuple[list[int], list[int]]:
    """(previous smaller suffix of each, start of its group in the order)."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group_of = [0] * n
    end_of: dict[int, int] = {}
    start = 0
    for k, suffix in enumerate(order):
        if text[suffix] != text[order[start]]:
            end_of[start] = k
            start = k
        place[suffix] = k
        group_of[suffix] = start
    end_of[start] = n
    previous = [-1] * n
    top = n
    while top:
        low = group_of[order[top - 1]]
        members = order[low:top]
        top = low
        members.sort()
        copies: dict[int, int] = {}
        for suffix in members:
            before = suffix - 1
            while before >= 0 and group_of[before] >= low:
                before = previous[before]
            previous[suffix] = before
            if before >= 0:
                copies[before] = copies.get(before, 0) + 1
        if not copies:
            continue
        moved: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for before, times in copies.items():
            moved[group_of[before]][times].append(before)
        for group, by_times in moved.items():
            end = end_of[group]
            # The more copies of this prefix follow, the higher the new group.
            for times in sorted(by_times, reverse=True):
                stop = end
                for suffix in by_times[times]:
                    end -= 1
                    other, at = order[end], place[suffix]
                    order[at], place[other] = other, at
                    order[end], place[suffix] = suffix, end
                end_of[end] = stop
                for suffix in by_times[times]:
                    group_of[suffix] = end
            if end > group:
                end_of[group] = end
    return previous, group_of


def _emit(previous: list[int], group_of: list[int]) -> list[int]:
    n = len(previous)
    order = [-1] * n
    order[0] = n - 1
    free = list(range(n))  # next place of the group that starts here
    put = [False] * n
    put[n - 1] = True
    for k in range(n):
        before = order[k] - 1
        while before >= 0 and not put[before]:
            group = group_of[before]
            order[free[group]] = before
            free[group] += 1
            put[before] = True
            before = previous[before]
    return order
