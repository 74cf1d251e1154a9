"""Byte-pair merging of one pre-token, by ranks.

Short pre-tokens take a plain scan for the lowest rank; long ones a heap over a
linked list, so one very long pre-token costs O(n log n).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

SHORT = 48


def merge(parts: list, rank: Callable, join: Callable) -> list:
    """Merge neighbours of ``parts``, lowest rank first, leftmost on ties.

    ``rank(a, b)`` is None where the two don't merge; ``join(a, b)`` is the
    merged symbol.
    """
    if len(parts) > SHORT:
        return _merge_long(parts, rank, join)
    parts = list(parts)
    ranks = [rank(a, b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for i, r in enumerate(ranks):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return parts
        parts[at : at + 2] = [join(parts[at], parts[at + 1])]
        del ranks[at]
        if at:
            ranks[at - 1] = rank(parts[at - 1], parts[at])
        if at < len(ranks):
            ranks[at] = rank(parts[at], parts[at + 1])


def _merge_long(parts: list, rank: Callable, join: Callable) -> list:
    symbol = list(parts)
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank(symbol[i], symbol[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if symbol[i] is not None else n
        if j >= n or symbol[i] != a or symbol[j] != b:
            continue
        symbol[i], symbol[j] = join(a, b), None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(symbol[i], symbol[k])) is not None:
                heapq.heappush(heap, (r, i, symbol[i], symbol[k]))
        if (h := before[i]) >= 0 and (r := rank(symbol[h], symbol[i])) is not None:
            heapq.heappush(heap, (r, h, symbol[h], symbol[i]))
    return [s for s in symbol if s is not None]
