"""Suffix sorting in memory: induced sorting of bytes, prefix doubling of integers, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 in the order of the keys, equal keys alike."""
    return np.unique(keys, return_inverse=True)[1]


def doubled(rank: np.ndarray, h: int = 1, end: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of an integer string by prefix doubling; only tied suffixes are sorted again.

    ``rank`` orders the suffixes by their first ``h`` integers. ``end``: where each position's own string ends, if
    several stand end to end. A suffix that is a prefix of another comes first.
    """
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    # the rank of a suffix is the first place of its group
    first = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at = np.empty(n + 1, np.int64)
    at[order], at[n] = group, -1
    tied = np.flatnonzero(_tied(group))
    while len(tied):
        places = order[tied]
        after = at[np.minimum(places + h, n)]
        if end is not None:
            after = np.where(places + h < end[places], after, -1)
        again = np.lexsort((after, group[tied]))
        places, after = places[again], after[again]
        order[tied] = places
        g = group[tied]  # groups hold contiguous places, so they stay as they are
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (after[1:] != after[:-1])])
        group[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        at[places] = group[tied]
        tied = tied[_tied(group[tied])]
        h *= 2
    return order


def _tied(group: np.ndarray) -> np.ndarray:
    """Whether each place shares its group with a neighbour."""
    same = group[1:] == group[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same])


def induced(text: np.ndarray) -> np.ndarray:
    """Suffix array of a string of small integers (0 to a few hundred) by induced sorting.

    Suffixes are classified as larger (L) or smaller (S) than their successor; leftmost-smaller (LMS) substrings are
    sorted by one induction, named, and the string of their names is sorted in turn; a second induction from the sorted
    LMS suffixes orders all. Both inductions go bucket by bucket with whole-bucket vector operations: what a bucket
    induces into others is appended in one step, what it induces into itself in one step per length of a run.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    text = text.astype(np.int32, copy=False)
    # type of each suffix: that of the next position where neighbours differ; the last suffix is L
    step = np.diff(text)
    nearest = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    small = np.zeros(n + 1, bool)
    small[: n - 1] = np.where(nearest < n - 1, step[np.minimum(nearest, n - 2)] > 0, False)
    small[n] = True  # the empty suffix
    lms = np.flatnonzero(small[1:n] & ~small[: n - 1]) + 1
    sizes = np.bincount(text)
    if len(lms) == 0:
        return _induce(text, small, sizes, lms)
    if len(lms) > 1:
        order = _induce(text, small, sizes, lms[np.argsort(text[lms], kind="stable")])
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        sorted_lms = order[is_lms[order]]
        names = np.empty(n, np.int32)
        names[sorted_lms] = np.cumsum(np.concatenate([[0], _differ(text, lms, sorted_lms)]))
        names = names[lms]
        if names.max() + 1 < len(lms):
            lms = lms[doubled(names)]
        else:
            lms = sorted_lms
    return _induce(text, small, sizes, lms)


def _differ(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each LMS substring in ``order`` differs from the one before it."""
    n = len(text)
    end = np.empty(n, np.int32)  # last position of the substring that starts here
    end[lms[:-1]], end[lms[-1]] = lms[1:], n
    a, b = order[:-1], order[1:]
    length = end[b] - b
    differ = (length != end[a] - a) | (end[a] == n) | (end[b] == n)
    live = np.flatnonzero(~differ)
    k = 0
    while len(live):
        unequal = text[a[live] + k] != text[b[live] + k]
        differ[live[unequal]] = True
        live = live[~unequal & (k < length[live])]
        k += 1
    return differ


def _induce(text: np.ndarray, small: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array induced from LMS suffixes given in order (bucket by bucket)."""
    n, k = len(text), len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int32)
    lms_at = np.searchsorted(text[lms], np.arange(k + 1))
    # larger suffixes, buckets upwards
    head = starts.copy()
    used = np.flatnonzero(sizes)

    def put(found: np.ndarray) -> None:
        """Append larger suffixes to the heads of their buckets, in the given order."""
        chars = text[found]
        by = np.argsort(chars, kind="stable")
        found, chars = found[by], chars[by]
        new = np.concatenate([[0], np.flatnonzero(chars[1:] != chars[:-1]) + 1])
        counts = np.diff(np.append(new, len(chars)))
        for c, i, m in zip(chars[new].tolist(), new.tolist(), counts.tolist(), strict=True):
            sa[head[c] : head[c] + m] = found[i : i + m]
            head[c] += m

    if not small[n - 1]:
        put(np.array([n - 1]))  # the empty suffix induces the last
    for c in used.tolist():
        at = starts[c]
        while at < head[c]:  # this bucket's larger suffixes, with what they add to it
            now = sa[at : head[c]]
            at = head[c]
            before = now[now > 0] - 1
            before = before[~small[before]]
            if len(before):
                put(before)
        before = lms[lms_at[c] : lms_at[c + 1]] - 1
        if len(before):
            put(before)
    # smaller suffixes, buckets downwards
    tail = ends.copy()

    def put_back(found: np.ndarray) -> None:
        """Put smaller suffixes before the tails of their buckets, the first one last."""
        chars = text[found]
        by = np.argsort(chars, kind="stable")
        found, chars = found[by], chars[by]
        new = np.concatenate([[0], np.flatnonzero(chars[1:] != chars[:-1]) + 1])
        counts = np.diff(np.append(new, len(chars)))
        for c, i, m in zip(chars[new].tolist(), new.tolist(), counts.tolist(), strict=True):
            sa[tail[c] - m : tail[c]] = found[i : i + m][::-1]
            tail[c] -= m

    for c in used[::-1].tolist():
        at = ends[c]
        while at > tail[c]:
            now = sa[tail[c] : at][::-1]
            at = tail[c]
            before = now[now > 0] - 1
            before = before[small[before]]
            if len(before):
                put_back(before)
        now = sa[starts[c] : head[c]][::-1]  # the bucket's larger suffixes
        before = now[now > 0] - 1
        before = before[small[before]]
        if len(before):
            put_back(before)
    return sa


def permuted_prefixes(text: np.ndarray, phi: np.ndarray, floor: np.ndarray | None = None, limit: int | None = None) -> np.ndarray:
    """Common prefix of each suffix i with suffix ``phi[i]`` (-1: none), in the order of the text.

    Where the characters before both agree, the value is that of i - 1, less one; only the others are compared.
    ``floor``: first position that may be compared with i's, so that texts laid end to end stay apart; a suffix ends
    where ``floor`` changes. ``limit``: values are only right up to it.
    """
    n = len(text)
    value = np.zeros(n, np.int32)
    has = phi >= 0
    i = np.flatnonzero(has).astype(np.int32)
    j = phi[i].astype(np.int32)
    if not len(i):
        return value
    if floor is None:
        end = np.full(n, n, np.int32)
        low = np.zeros(n, np.int32)
    else:
        bounds = np.append(np.flatnonzero(np.concatenate([[True], floor[1:] != floor[:-1]])), n).astype(np.int32)
        end = np.repeat(bounds[1:], np.diff(bounds))
        low = np.repeat(bounds[:-1], np.diff(bounds))
    carried = (i > low[i]) & (j > low[j])
    carried &= (text[np.maximum(i - 1, 0)] == text[np.maximum(j - 1, 0)]) & has[np.maximum(i - 1, 0)] & (phi[np.maximum(i - 1, 0)] == j - 1)
    a, b = i[~carried], j[~carried]
    live = np.arange(len(a))
    length = np.zeros(len(a), np.int32)
    most = np.minimum(end[a] - a, end[b] - b)
    if limit is not None:
        # a value carried to i + d has to be right up to limit there, so runs are compared as far as they go
        most = np.minimum(most, limit + _run(i, carried, n)[~carried])
    k = 0
    while len(live):
        live = live[k < most[live]]
        live = live[text[a[live] + k] == text[b[live] + k]]
        k += 1
        length[live] = k
    value[a] = length
    source = np.zeros(n, np.int32)
    source[a] = a
    source = np.maximum.accumulate(source)
    c = i[carried]
    value[c] = np.maximum(value[source[c]] - (c - source[c]), 0)
    return value


def _run(i: np.ndarray, carried: np.ndarray, n: int) -> np.ndarray:
    """For each entry of i, how many entries after it carry its value."""
    breaks = np.flatnonzero(~carried)
    lengths = np.diff(np.append(breaks, len(i))) - 1
    out = np.zeros(len(i), np.int64)
    out[breaks] = lengths
    return out
