"""Suffix array by linear grouping.

The Lyndon prefix of a suffix is its longest prefix that is smaller than all of its own proper
suffixes; it ends where the next smaller suffix begins. Suffixes with equal Lyndon prefixes are
a group. A suffix's Lyndon prefix is its first symbol followed by the Lyndon prefixes of its
children, the suffixes whose previous smaller suffix it is, in order, none larger than the one
before. So groups can be refined from the largest down: a finished group hands itself to the
previous smaller suffixes of its members, which leave their own group upwards, those with more
members in it further up. At last the members of a group are put in order by the suffixes that
follow their common prefix, which come out in ascending order themselves. Nothing is renamed.
"""

from __future__ import annotations


def smaller_suffixes(text: str) -> tuple[list[int], list[int]]:
    """Next smaller suffix (or the length) and previous smaller suffix (or -1) of each suffix."""
    n = len(text)
    after, before = [n] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        j = i + 1
        # Two neighbouring Lyndon words make one if the first is the smaller.
        while j < n and text[i:j] < text[j : after[j]]:
            before[j] = i
            j = after[j]
        after[i] = j
    return after, before


def suffix_array(text: str) -> list[int]:
    """Starts of all suffixes in ascending order; symbols are characters, compared by number."""
    n = len(text)
    after, before = smaller_suffixes(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n  # where a suffix's group begins in order
    end = [0] * (n + 1)  # of the group that begins here
    begin = 0
    for k, i in enumerate(order):
        place[i] = k
        if k and text[i] != text[order[k - 1]]:
            end[begin] = k
            begin = k
        group[i] = begin
    if n:
        end[begin] = n
    top = n
    while top > 0:
        low = group[order[top - 1]]
        handed: dict[int, int] = {}
        for k in range(low, top):
            p = before[order[k]]
            if p >= 0:
                handed[p] = handed.get(p, 0) + 1
        if handed:
            split: dict[int, list[int]] = {}
            for p in handed:
                split.setdefault(group[p], []).append(p)
            for g, own in split.items():
                if len(own) > 1:
                    own.sort(key=handed.__getitem__)
                # Move them to the end of their group, fewest members first, and part them.
                k = end[g]
                if k - g == len(own) and handed[own[0]] == handed[own[-1]]:
                    continue
                for p in reversed(own):
                    k -= 1
                    other, at = order[k], place[p]
                    order[k], order[at] = p, other
                    place[p], place[other] = k, at
                last = end[g]
                if k > g:
                    end[g] = k
                begin = k
                for q in range(k, last):
                    p = order[q]
                    if q > k and handed[p] != handed[order[q - 1]]:
                        end[begin] = q
                        begin = q
                    group[p] = begin
                end[begin] = last
        top = low
    # Members of a group in the order of what follows their common prefix.
    free = list(range(n + 1))
    out = [0] * n
    following = n
    for k in range(n + 1):
        s = following - 1
        while s >= 0 and after[s] == following:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = before[s]
        if k < n:
            following = out[k]
    return out
