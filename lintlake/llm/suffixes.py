"""Suffix sorting by linear grouping construction, for one text and for many short texts at once.

Phase 1 gathers the suffixes that share their Lyndon prefix: groups, at first one for each first symbol, are
taken in descending order; each suffix of a group points to the previous smaller suffix (the nearest to its
left whose group is lower), and the suffixes pointed at move, together with those pointed at equally often,
into a new group just above the rest of theirs. Phase 2 emits the order: from the smallest suffix on, the
chain of previous-smaller pointers to the left of each suffix is put at the next free place of its groups.
Nothing is renamed and no smaller problem is solved.

``order`` sorts one text with plain lists. ``orders`` does the same for many texts in lockstep, one group of
each text at a time, so that the work of a step is a few vector operations over all texts.
"""

from __future__ import annotations

import numpy as np


def order(text: np.ndarray) -> np.ndarray:
    """The suffix array of ``text``, whose last symbol must be smaller than all others."""
    n = len(text)
    sa = np.argsort(text, kind="stable").tolist()
    t = text.tolist()
    at = [0] * n
    group = [0] * n
    size = [0] * n
    for k in range(n):
        s = sa[k]
        at[s] = k
        group[s] = k if k == 0 or t[sa[k - 1]] != t[s] else group[sa[k - 1]]
        size[group[s]] += 1
    prev = list(range(-1, n - 1))
    end = n
    while end > 0:
        start = group[sa[end - 1]]
        times: dict[int, int] = {}
        for s in sa[start:end]:
            p = prev[s]
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            levels: dict[int, list[int]] = {}
            for p, k in times.items():
                levels.setdefault(k, []).append(p)
            for k in sorted(levels, reverse=True):
                moved: dict[int, int] = {}
                for p in levels[k]:  # each to the end of its group
                    g = group[p]
                    m = moved.get(g, 0) + 1
                    moved[g] = m
                    to = g + size[g] - m
                    here, other = at[p], sa[to]
                    sa[here], sa[to] = other, p
                    at[other], at[p] = here, to
                for g, m in moved.items():
                    if m < size[g]:
                        new = g + size[g] - m
                        size[g] -= m
                        size[new] = m
                        for s in sa[new : new + m]:
                            group[s] = new
        end = start
    free = list(range(n))
    done = bytearray(n)
    out = [0] * n
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = prev[s]
    return np.array(out, np.int64)


def orders(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffix arrays of the texts ``text[starts[k]:starts[k + 1]]``, as positions in ``text``.

    Each text must end with a symbol that is smaller than all others in it.
    """
    n, lanes = len(text), len(starts) - 1
    lane = np.repeat(np.arange(lanes), np.diff(starts))
    sa = np.lexsort((text, lane)).astype(np.int32)
    at = np.empty(n, np.int32)
    at[sa] = np.arange(n, dtype=np.int32)
    new = np.r_[True, (lane[sa[1:]] != lane[sa[:-1]]) | (text[sa[1:]] != text[sa[:-1]])]
    heads = np.flatnonzero(new).astype(np.int32)
    group = np.empty(n, np.int32)
    group[sa] = np.repeat(heads, np.diff(np.r_[heads, n]))
    size = np.zeros(n, np.int32)
    size[heads] = np.diff(np.r_[heads, n])
    prev = np.arange(-1, n - 1, dtype=np.int32)
    prev[starts[:-1]] = -1
    base = starts[:-1].astype(np.int32)
    end = starts[1:].astype(np.int32)
    live = np.flatnonzero(end > base)
    while len(live):
        stop = end[live]
        begin = group[sa[stop - 1]]
        count = stop - begin
        if count.max() == 1:
            s, bound = sa[begin], begin
        else:
            first = np.cumsum(count) - count
            s = sa[np.arange(count.sum()) - np.repeat(first - begin, count)]
            bound = np.repeat(begin, count)
        p = prev[s]
        open_ = np.flatnonzero((p >= 0) & (group[p] >= bound))
        while len(open_):
            q = prev[p[open_]]
            p[open_] = q
            open_ = open_[(q >= 0) & (group[q] >= bound[open_])]
        prev[s] = p
        p = p[p >= 0]
        if len(p):
            p = np.sort(p)
            edge = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            times = np.diff(np.r_[edge, len(p)])
            p = p[edge]
            if len(p) and times.max() == 1:
                _raise(p, sa, at, group, size)
            else:
                for k in np.unique(times)[::-1].tolist():
                    _raise(p[times == k], sa, at, group, size)
        end[live] = begin
        live = live[begin > base[live]]
    return _emit(group, prev, starts)


def _raise(p: np.ndarray, sa: np.ndarray, at: np.ndarray, group: np.ndarray, size: np.ndarray) -> None:
    """Move the suffixes ``p`` of each group into a new group at its end."""
    g = group[p]
    by = np.argsort(g, kind="stable")
    p, g = p[by], g[by]
    edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    m = np.diff(np.r_[edge, len(g)])
    heads = g[edge]
    part = m < size[heads]  # a group that moves whole stays as it is
    if not part.all():
        keep = np.repeat(part, m)
        p, heads, m = p[keep], heads[part], m[part]
        if not len(p):
            return
    fresh = (heads + size[heads] - m).astype(np.int32)
    to = np.repeat(fresh, m)
    # what is outside the new group's places changes with what is in them and must not be
    outside = p[at[p] < to]
    inside = np.zeros(0, np.int32)
    if len(outside):
        slots = to + (np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)).astype(np.int32)
        held = sa[slots]
        mark = np.zeros(len(p), bool)
        here = at[p]
        index = np.repeat(np.cumsum(m) - m, m) + here - to
        ok = here >= to
        mark[index[ok]] = True
        free = ~mark
        inside, places = held[free], slots[free]
        back = at[outside]
        sa[places], sa[back] = outside, inside
        at[outside], at[inside] = places, back
    group[p] = to
    size[heads] -= m
    size[fresh] = m


def _emit(group: np.ndarray, prev: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Phase 2 for all texts in lockstep: each step puts one suffix of each text in its place, or moves on."""
    n = len(group)
    free = np.arange(n, dtype=np.int32)
    out = np.zeros(n, np.int32)
    done = np.zeros(n + 1, bool)
    done[n] = True  # what -1 stands for
    base, last = starts[:-1].astype(np.int32), starts[1:].astype(np.int32)
    some = base < last
    base, last = base[some], last[some]
    out[base] = last - 1
    done[last - 1] = True
    k = base.copy()
    s = np.full(len(base), -1, np.int32)
    while len(k):
        idle = done[s]
        if idle.any():
            w = np.flatnonzero(idle)
            t = out[k[w]]
            k[w] += 1
            s[w] = np.where(t > base[w], t - 1, -1)
            if (k[w] >= last[w]).any():
                stay = (k < last) | ~done[s]
                k, s, base, last = k[stay], s[stay], base[stay], last[stay]
        w = np.flatnonzero(~done[s])
        if len(w):
            t = s[w]
            g = group[t]
            out[free[g]] = t
            free[g] += 1
            done[t] = True
            s[w] = prev[t]
    return out.astype(np.int64)
