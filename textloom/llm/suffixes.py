"""Suffix arrays of byte strings by induced sorting, in whole-array steps.

``suffix_array`` follows induced sorting: suffixes are classified as S or L,
the leftmost S suffixes (LMS) start the substrings that get sorted and named,
the string of names is sorted recursively, and its order induces the rest.
Instead of moving one suffix at a time, a bucket's suffixes induce their
predecessors together; runs of one byte take a round for each repetition. The
strings of names, at most half as long each, have many small buckets: there
suffixes are moved one by one.

``long_common`` computes permuted common prefixes: in text order the common
prefix with the predecessor in the suffix array shrinks by one at most from
one position to the next, so only irreducible positions are compared.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S. The end of the string is smaller than any byte."""
    n = len(t)
    s = np.zeros(n, dtype=bool)
    if n < 2:
        return s
    change = np.append(t[1:] != t[:-1], True)  # i and i + 1 differ; the last one differs from the end
    less = np.append(t[:-1] < t[1:], False)
    following = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]
    return less[following]


def _induce(t: np.ndarray, s: np.ndarray, seeds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from LMS suffixes ``seeds`` that are in order inside each bucket."""
    n = len(t)
    sa = np.full(n, -1, dtype=np.int64)
    sizes_l = np.bincount(t[~s], minlength=256)
    begin_l, begin_s = bounds[:-1].copy(), bounds[:-1] + sizes_l
    seed_of = np.searchsorted(t[seeds], np.arange(257)) if len(seeds) else np.zeros(257, dtype=np.int64)

    def append(j: np.ndarray, ptr: np.ndarray, reverse: bool) -> None:
        c = t[j]
        order = np.argsort(c, kind="stable")
        c = c[order]
        n_of = np.bincount(c, minlength=256)
        inside = np.arange(len(c)) - (np.cumsum(n_of) - n_of)[c]
        if reverse:
            sa[ptr[c] - 1 - inside] = j[order]
            ptr -= n_of
        else:
            sa[ptr[c] + inside] = j[order]
            ptr += n_of

    # L suffixes, from small to large; the end of the string induces the last byte.
    ptr = begin_l.copy()
    if not s[n - 1]:
        append(np.array([n - 1]), ptr, False)
    present = np.flatnonzero(np.diff(bounds))
    for c in present:
        done = begin_l[c]
        while done < ptr[c]:
            j = sa[done : ptr[c]] - 1
            done = ptr[c]
            j = j[j >= 0]
            j = j[~s[j]]
            if len(j):
                append(j, ptr, False)
        j = seeds[seed_of[c] : seed_of[c + 1]] - 1
        if len(j):
            append(j, ptr, False)  # the byte before an LMS suffix begins an L suffix
    # S suffixes, from large to small.
    ptr = bounds[1:].copy()
    for c in present[::-1]:
        done = bounds[c + 1]
        while done > ptr[c]:
            j = sa[ptr[c] : done][::-1] - 1
            done = ptr[c]
            j = j[j >= 0]
            j = j[s[j]]
            if len(j):
                append(j, ptr, True)
        j = sa[begin_l[c] : begin_s[c]][::-1] - 1
        j = j[j >= 0]
        j = j[s[j]]
        if len(j):
            append(j, ptr, True)
    return sa


def _induce_names(t: list[int], s: list[bool], seeds: list[int], bounds: list[int]) -> list[int]:
    """_induce() for a string of names, suffix by suffix."""
    n = len(t)
    sa = [-1] * n
    tail = bounds[1:]
    for p in reversed(seeds):
        c = t[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head = bounds[:-1]
    sa[head[t[-1]]] = n - 1
    head[t[-1]] += 1
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not s[j]:
            c = t[j]
            sa[head[c]] = j
            head[c] += 1
    tail = bounds[1:]
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and s[j]:
            c = t[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The order of the suffixes of an array of uint8, or of names; a suffix that is another's prefix comes first."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int64)
    s = _types(t)
    bytes_ = t.dtype == np.uint8
    bounds = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=256 if bytes_ else 1))))
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if bytes_:

        def induce(seeds: np.ndarray) -> np.ndarray:
            return _induce(t, s, seeds[np.argsort(t[seeds], kind="stable")], bounds)
    else:
        listed = t.tolist(), s.tolist(), bounds.tolist()

        def induce(seeds: np.ndarray) -> np.ndarray:
            return np.array(_induce_names(listed[0], listed[1], seeds.tolist(), listed[2]), dtype=np.int64)

    if not len(lms):
        return induce(lms)
    # LMS suffixes in text order induce an order by LMS substrings.
    first = induce(lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    name = _names(t, lms, ordered)
    if name.max() + 1 < len(lms):
        ordered = lms[suffix_array(name)]
    return induce(ordered)


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Equal LMS substrings get equal numbers, by their order; in text order. The last one is unlike any other."""
    n, m = len(t), len(lms)
    rank = np.searchsorted(lms, ordered)
    ends = np.append(lms[1:] + 1, n)
    size = (ends - lms)[rank]
    new = np.ones(m, dtype=bool)
    new[1:] = (size[1:] != size[:-1]) | (rank[1:] == m - 1) | (rank[:-1] == m - 1)
    same = np.flatnonzero(~new)
    if len(same):
        k = size[same]
        inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        differs = t[np.repeat(ordered[same], k) + inside] != t[np.repeat(ordered[same - 1], k) + inside]
        new[same] = np.add.reduceat(differs, np.cumsum(k) - k) > 0
    out = np.empty(m, dtype=np.int64)
    out[rank] = np.cumsum(new) - 1
    return out


def long_common(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """For every position whether its suffix shares ``least`` bytes with another one.

    ``starts``: positions that are compared in any case, as no prefix is
    carried over them; no string of interest may reach over the next start.
    """
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    reducible = np.zeros(n, dtype=bool)
    reducible[1:] = (phi[1:] > 0) & (phi[:-1] >= 0) & (phi[1:] == phi[:-1] + 1) & (t[:-1] == t[phi[1:] - 1])
    reducible[starts] = False
    most = int(np.diff(np.append(starts, n)).max()) if len(starts) else n
    words = np.zeros(n, dtype=np.uint64)
    padded = np.append(t, np.zeros(8, dtype=np.uint8)).astype(np.uint64)
    for k in range(8):
        words |= padded[k : k + n] << np.uint64(8 * k)
    at = np.flatnonzero(~reducible & (phi >= 0))
    plcp = np.zeros(n, dtype=np.int64)
    a, b = at, phi[at]
    done = 0
    while len(at) and done < most + 8:
        room = (a + done + 8 <= n) & (b + done + 8 <= n)
        x = np.zeros(len(a), dtype=np.uint64)
        x[room] = words[a[room] + done] ^ words[b[room] + done]
        equal = room & (x == 0)
        stop = ~equal
        i = np.flatnonzero(stop & room)
        low = x[i] & (~x[i] + np.uint64(1))
        plcp[at[i]] = done + (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
        for k in np.flatnonzero(stop & ~room):
            e = done
            while max(a[k], b[k]) + e < n and t[a[k] + e] == t[b[k] + e]:
                e += 1
            plcp[at[k]] = e
        done += 8
        at, a, b = at[equal], a[equal], b[equal]
    plcp[at] = done
    last = np.where(reducible, -1, np.arange(n))
    last = np.maximum.accumulate(last)
    plcp = np.maximum(plcp[last] - (np.arange(n) - last), 0)
    hit = plcp >= least
    shared = hit.copy()
    shared[phi[hit]] = True
    return shared
