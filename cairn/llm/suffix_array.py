"""Suffix arrays of shards by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their next one; a leftmost S is an LMS
suffix. LMS substrings are sorted by inducing from the LMS positions, named, and the string of names
is sorted in turn, by the same way, until all names differ. From sorted LMS suffixes the whole array
is induced in one scan up and one down. A scan takes as many buckets in one numpy step as induce
nothing into each other; a bucket that induces into itself goes alone, in waves: all that follow
from places already there at once, as many waves as the longest run of its symbol.
"""

from __future__ import annotations

import numpy as np

def _types(s: np.ndarray) -> np.ndarray:
    """True for S; the last symbol is smallest and S."""
    n = len(s)
    out = np.ones(n, bool)
    if n > 1:
        change = np.flatnonzero(s[:-1] != s[1:])
        nearest = np.searchsorted(change, np.arange(n - 1))
        ahead = change[np.minimum(nearest, len(change) - 1)] if len(change) else np.zeros(n - 1, np.int64)
        out[:-1] = s[ahead] < s[ahead + 1]
    return out


def _steps(inner: np.ndarray, own: np.ndarray) -> list[int]:
    """Edges of runs of buckets, in scanning order, of which none induces into another of its run.

    inner: of each bucket, the last of the buckets scanned before it that induce into it, or -1;
    own: whether it induces into itself, and so must be a run by itself.
    """
    edges, low = [0], 0
    for k, (before, alone) in enumerate(zip(inner.tolist(), own.tolist(), strict=True)):
        if k > low and (before >= low or alone):
            edges.append(k)
            low = k
        if alone:
            edges.append(k + 1)
            low = k + 1
    if edges[-1] < len(inner):
        edges.append(len(inner))
    return edges


def _scanned(s: np.ndarray, kind: np.ndarray, order: np.ndarray, own_size: np.ndarray, other_size: np.ndarray, others: np.ndarray, given: int = 0) -> np.ndarray:
    """All places that one scan passes, in its order: of each bucket those it finds itself, then `others`.

    Of each place passed, the one before it in s goes to the next free slot of its bucket if it is of
    the wanted kind. order: symbols as they are scanned; sizes are in that order. given: how many of
    the last bucket's own are there from the start, being the last places of s.
    """
    n, size = len(s), own_size + other_size
    edge = np.concatenate([[0], np.cumsum(size)])
    rank, at = np.zeros((2, int(order.max()) + 1), np.int64)
    rank[order], at[order] = np.arange(len(order)), edge[:-1]
    places = np.empty(edge[-1], np.int64)
    places[np.repeat(edge[:-1] + own_size - (np.cumsum(other_size) - other_size), other_size) + np.arange(len(others))] = others
    if given:
        places[at[order[-1]]] = n - 1
        at[order[-1]] += 1
    mine = np.flatnonzero(kind[:-1])
    to, by = rank[s[mine]], rank[s[mine + 1]]
    inner, alone = np.full(len(order), -1, np.int64), np.zeros(len(order), bool)
    np.maximum.at(inner, to[by < to], by[by < to])
    alone[to[by == to]] = True
    follows, count = np.zeros(n, bool), np.arange(n)
    follows[mine + 1] = True

    def put(found: np.ndarray) -> None:
        before = found[follows[found]] - 1
        if not (m := len(before)):
            return
        symbol = s[before]
        turn = symbol.argsort(kind="stable")
        symbol = symbol[turn]
        first = np.empty(m, bool)
        first[0] = True
        np.not_equal(symbol[1:], symbol[:-1], out=first[1:])
        mark = count[:m] * first
        slot = at[symbol] + (count[:m] - np.maximum.accumulate(mark, out=mark))
        places[slot] = before[turn]
        at[symbol] = slot + 1  # of equal symbols the last one counts

    steps, edges = _steps(inner, alone), edge.tolist()
    for a, z in zip(steps[:-1], steps[1:], strict=True):
        low, high = edges[a], edges[z]
        if alone[a]:  # in waves: what is there, then what that brought in, until nothing does
            while low < (now := int(at[order[a]])):
                put(places[low:now])
                low = now
        put(places[low:high])
    return places


def _induced(s: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, induced from LMS suffixes in order (or LMS substrings, if those are only in order of their first symbol)."""
    s = s.astype(np.uint16 if symbols <= 1 << 16 else np.int64, copy=False)
    size = np.bincount(s, minlength=symbols)
    used = np.flatnonzero(size)
    large = np.bincount(s[~small], minlength=symbols)[used]
    n_seeds = np.bincount(s[lms], minlength=symbols)[used]
    up = _scanned(s, ~small, used, large, n_seeds, lms[s[lms].argsort(kind="stable")])
    # The scan down passes a bucket's S places, then its L places, each from the last to the first.
    each = large + n_seeds
    found = up[np.repeat(np.cumsum(each) - each - (np.cumsum(large) - large), large) + np.arange(large.sum())]
    return _scanned(s, small, used[::-1], (size[used] - large)[::-1], large[::-1], found[::-1], given=1)[::-1]


def _names(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For strings in order, the number of each among the distinct ones: neighbours are compared symbol by symbol while they are equal."""
    other = sizes[1:] != sizes[:-1]
    left, k = np.flatnonzero(~other), 0
    while len(left):
        differ = s[starts[left] + k] != s[starts[left + 1] + k]
        other[left[differ]] = True
        k += 1
        left = left[~differ & (sizes[left] > k)]
    return np.concatenate([[0], np.cumsum(other)])


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes of s in order. The last symbol must be the smallest and nowhere else."""
    n = len(s)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _induced(s, small, lms, symbols)
    first = _induced(s, small, lms, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    # Names: LMS substrings run to the next LMS position; equal ones have equal symbols and length.
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    size = np.append(np.diff(lms) + 1, n - lms[-1])
    names_sorted = _names(s, order, size[place[order]])
    count = int(names_sorted[-1]) + 1
    if count < len(lms):
        names = np.empty(len(lms), np.int64)
        names[place[order]] = names_sorted
        order = lms[suffix_array(names, count)]
    return _induced(s, small, order, symbols)


def common_prefixes(s: np.ndarray, sa: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In text order: the suffix before each one in the array (-1 for the first), and their common prefix, ended by either one's `room`.

    Where a place and its predecessor both follow those of the place before, the prefix is one less;
    only the others are compared, eight bytes at a time.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (room[1:] == room[:-1] - 1)
    follows[1:] &= (s[:-1] == s[np.maximum(before[:-1], 0)]) & (room[np.maximum(before[:-1], 0)] > 0) & (room[:-1] > 0)
    mine = np.flatnonzero(~follows & (before >= 0))
    other = before[mine]
    most = np.minimum(room[mine], room[other])
    raw = np.concatenate([s.astype(np.uint8), np.zeros(8, np.uint8)])
    # Eight bytes from each place as one number, the first byte lowest.
    block = np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, (n + 1, 8), (1, 1))).view("<u8")[:, 0]
    length = np.zeros(len(mine), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        differ = block[np.minimum(mine[live] + length[live], n)] ^ block[np.minimum(other[live] + length[live], n)]
        run = np.full(len(live), 8)
        some = np.flatnonzero(differ)
        x = differ[some]
        run[some] = np.log2((x & (~x + np.uint64(1))).astype(np.float64)).astype(np.int64) // 8  # the lowest bit that differs
        length[live] += run
        live = live[(run == 8) & (length[live] < most[live])]
    start = np.zeros(n, np.int64)
    start[mine] = np.minimum(length, most) + mine
    # A place that follows has what its last compared one had, less the steps between.
    anchor = np.maximum.accumulate(np.where(follows, 0, at))
    out = start[anchor] - at
    out[(before < 0) | (out < 0)] = 0
    return before, out


def repeated(parts: list[bytes], width: int) -> list[np.ndarray]:
    """For each part, which of its `width`-byte strings (by start) also starts at another place of any part."""
    sizes = np.array([len(x) for x in parts], np.int64)
    joined = np.frombuffer(b"\0".join(parts) + b"\0\0", np.uint8)
    s = joined.astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    s[ends], s[-1] = 1, 0
    room = np.append(np.repeat(ends, sizes + 1) - np.arange(len(s) - 1), 0)
    sa = suffix_array(s, 258)
    # Separators end a common prefix by `room`, so bytes do for comparing.
    before, prefix = common_prefixes(joined, sa, room)
    hit = np.zeros(len(s), bool)
    long = np.flatnonzero(prefix >= width)
    hit[long] = hit[before[long]] = True
    starts = ends - sizes
    return [hit[a : max(a, z - width + 1)] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
