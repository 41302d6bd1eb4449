"""The window of a text that is most like a body, by the standard library's ratio, without measuring every window.

All windows have the body's length, so the ratio grows with the number of characters in common blocks.  That is never
above the longest common subsequence, which is found for all windows at once: each is a lane of bits of one long number.
Windows are measured in order of this bound, and only as long as a block may still make up for what was lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np

#: Characters from which the standard library leaves popular ones out.
_POPULAR = 200
#: Characters of a body up to which common subsequences are worth their time; beyond, common characters are counted.
_LONGEST = 512
#: Bytes of lanes made at once.
_LANES = 1 << 22

Longest = Callable[[int, int, int, int], tuple[int, int, int]]


def _subsequences(body: str, source: str, starts: range) -> list[int]:
    """The length of the longest common subsequence of the body and each window."""
    m, stride, lane = len(body), starts.step, len(body) // 8 + 1
    masks: dict[str, int] = {}
    for i, c in enumerate(body):
        masks[c] = masks.get(c, 0) | 1 << i
    none, packed = bytes(lane), {c: x.to_bytes(lane, "little") for c, x in masks.items()}
    turns, most, out = -(-m // stride), max(1, _LANES // (lane * min(stride, m))), []
    for begin in range(0, len(starts), most):
        part = starts[begin : begin + most]
        n, first = len(part), part[0]
        full = int.from_bytes(((1 << m) - 1).to_bytes(lane, "little") * n, "little")
        # windows that begin a stride apart see the same characters a lane apart
        rows = [int.from_bytes(b"".join([packed.get(c, none) for c in source[first + i : first + i + (n + turns - 1) * stride : stride]]), "little") for i in range(min(stride, m))]
        v = full
        for i in range(m):
            turn, row = divmod(i, stride)
            u = v & (rows[row] >> (8 * lane * turn))
            v = ((v + u) | (v - u)) & full
        bits = np.frombuffer(v.to_bytes(lane * n, "little"), np.uint8).reshape(n, lane)
        out += (m - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)).tolist()
    return out


def _common(body: str, source: str, starts: range) -> list[int]:
    """How many characters the body and each window have in common, in whatever order."""
    codes = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), np.uint32)
    begin, total = np.asarray(starts), np.zeros(len(starts), np.int64)
    for c in set(body):
        seen = np.concatenate([[0], np.cumsum(codes == ord(c))])
        total += np.minimum(body.count(c), seen[begin + len(body)] - seen[begin])
    return total.tolist()


def _places(text: str, begin: int, end: int) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i in range(begin, end):
        out.setdefault(text[i], []).append(i)
    return out


def _matched(longest: Longest, size: int, begin: int, end: int, need: int) -> int:
    """Characters in the blocks of ``size`` characters and of those from ``begin`` to ``end``; anything below ``need`` if fewer."""
    total, room, todo = 0, min(size, end - begin), [(0, size, begin, end)]
    while todo and total + room >= need:
        i, i_end, j, j_end = todo.pop()
        room -= min(i_end - i, j_end - j)
        a, b, n = longest(i, i_end, j, j_end)
        if n:
            total += n
            for x in ((i, a, j, b), (a + n, i_end, b + n, j_end)):
                if least := min(x[1] - x[0], x[3] - x[2]):
                    room += least
                    todo.append(x)
    return total if total + room >= need else 0


def _by_runs(body: str, text: str) -> Longest:
    """The longest common stretch, first in ``body``, then in ``text``: bits say where stretches of each length begin."""
    lane = len(text) + 1
    masks: dict[str, int] = {}
    for j, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << j
    size = lane // 8 + 1
    lane = 8 * size
    none, packed = bytes(size), {c: x.to_bytes(size, "little") for c, x in masks.items()}
    equal = int.from_bytes(b"".join([packed.get(c, none) for c in body]), "little")
    runs, ones = [equal], [0]
    while runs[-1]:
        runs.append(runs[-1] & (equal >> ((lane + 1) * len(runs))))
    for i in range(len(body)):
        ones.append(ones[-1] | 1 << (i * lane))

    def longest(i: int, i_end: int, j: int, j_end: int) -> tuple[int, int, int]:
        low, high, best = 0, min(i_end - i, j_end - j, len(runs) - 1), 0
        while low < high:
            n = (low + high + 1) // 2
            rows = ones[i_end - i - n + 1]
            found = (runs[n - 1] >> (i * lane)) & ((rows << (j_end - n + 1)) - (rows << j))
            if found:
                low, best = n, found
            else:
                high = n - 1
        if not low:
            return i, j, 0
        a, b = divmod((best & -best).bit_length() - 1, lane)
        return i + a, b, low

    return longest


def _by_rare(body: str, own: dict[str, list[int]], source: str, places: dict[str, list[int]], begin: int) -> Longest:
    """The standard library's search in the window from ``begin``; ``own`` and ``places`` are where the body's characters are.

    Stretches of characters that are not popular in the window count, then they grow by whatever is equal beside them.
    """
    end, most, found = begin + len(body), len(body) // 100 + 1, []
    for c, at in places.items():
        low = bisect_left(at, begin)
        high = bisect_left(at, end, low)
        if low < high <= low + most:
            part = at[low:high]
            found += [(i, part) for i in own[c]]
    found.sort()
    order = [i for i, _ in found]

    def longest(i: int, i_end: int, j: int, j_end: int) -> tuple[int, int, int]:
        a, b, n, before, last = i, j, 0, -2, {}
        for k in range(bisect_left(order, i), bisect_left(order, i_end)):
            at, part = found[k]
            new, old = {}, last if at == before + 1 else {}
            for x in part:
                if j <= x < j_end:
                    size = new[x] = old.get(x - 1, 0) + 1
                    if size > n:
                        a, b, n = at - size + 1, x - size + 1, size
            before, last = at, new
        while a > i and b > j and body[a - 1] == source[b - 1]:
            a, b, n = a - 1, b - 1, n + 1
        while a + n < i_end and b + n < j_end and body[a + n] == source[b + n]:
            n += 1
        return a, b, n

    return longest


def _first_best(bounds: list[int], measure: Callable[[int, int], int], floor: int) -> tuple[int, int | None]:
    """The greatest measure above ``floor`` and the first place that has it; ``floor`` and None if there is none."""
    best, at = floor, None
    for k in sorted(range(len(bounds)), key=lambda k: (-bounds[k], k)):
        if bounds[k] < best:
            break
        need = best + (at is None or k > at)
        if bounds[k] >= need and (found := measure(k, need)) >= need:
            best, at = found, k
    return best, at


def most_like(body: str, source: str, starts: range, floor: int) -> tuple[int, int | None]:
    """The most characters above ``floor`` in the blocks of the body and a window, and where the first such window begins."""
    m = len(body)
    if not starts:
        return floor, None
    bounds = (_subsequences if m <= _LONGEST else _common)(body, source, starts)
    if m >= _POPULAR:
        own, there = _places(body, 0, m), _places(source, starts[0], starts[-1] + m)
        places = {c: there[c] for c in own if c in there}

        def measure(k: int, need: int) -> int:
            return _matched(_by_rare(body, own, source, places, starts[k]), m, starts[k], starts[k] + m, need)

    elif starts.step == 1:
        longest = _by_runs(body, source[starts[0] : starts[-1] + m])

        def measure(k: int, need: int) -> int:
            return _matched(longest, m, k, k + m, need)

    else:

        def measure(k: int, need: int) -> int:
            return _matched(_by_runs(body, source[starts[k] : starts[k] + m]), m, 0, m, need)

    best, at = _first_best(bounds, measure, floor)
    return best, None if at is None else starts[at]


def ratio(a: str, b: str) -> float:
    """``SequenceMatcher(None, a, b).ratio()``."""
    if a == b or not a or not b or len(b) >= _POPULAR or len(a) >= _POPULAR:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _matched(_by_runs(a, b), len(a), 0, len(b), 0) / (len(a) + len(b))
