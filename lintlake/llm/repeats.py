"""Removal of byte strings that also start in an earlier document, by suffix sorting.

A string of ``length`` bytes is anchored at the least of the hashes of its ``_GRAM``-byte substrings (the leftmost
of equals), so equal strings have equal anchors. Blocks of documents ask which anchors occur in more than one
document; of those they send the context (the bytes of all strings so anchored) with the least document id.
A range of anchors joins the distinct contexts of each anchor into one text, sorts its suffixes by linear
grouping construction (``suffixes``), and reads off, for each string, the least document that holds it. An
anchor in more than ``HOT`` documents is split: its strings are sent each under their own hash.

Cases: ids must be whole numbers; a null text is an empty one; matches never cross documents; nothing is removed from texts shorter than
``length``; of rows with one id none is earlier than the other; rows with a null id count as before all others;
repeated rows keep the first id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lintlake.llm import exchange
from lintlake.llm.bytesets import column, mix, slices
from lintlake.llm.suffixes import order, orders

_GRAM = 24
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Documents of an anchor beyond which its strings are sent one by one.
HOT = 4096
#: Suffixes sorted in lockstep at once, at most, and the texts that make lockstep worth its overhead.
_LOCKSTEP, _FEW = 1 << 20, 24
#: Bytes of contexts whose holders are found at once, about; one anchor's are not parted.
_SLICE = 1 << 22
#: Bytes of contexts that a range compares at once, about, besides the values that it was sent.
_PART = 8 << 20
#: Ranges of contexts, at least, where there are as many blocks: of few blocks a range would else hold ten and more.
_RANGES = 32
NO_ID = np.int64(-(1 << 63))


def _eights(buf: np.ndarray) -> np.ndarray:
    """The little-endian number in the 8 bytes from each position."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,)).astype(np.uint64)


def anchors(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first string, last string and row of each anchor: its strings begin at all positions between."""
    none = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    n = len(buf) - length + 1
    if n <= 0:
        return none
    e = _eights(buf)
    h = e[: len(buf) - _GRAM + 1] * _A
    h += e[8 : 8 + len(h)] * _B
    h ^= h >> np.uint64(29)
    h += e[16 : 16 + len(h)] * _C
    h ^= h >> np.uint64(32)
    h *= _A
    h ^= h >> np.uint64(29)
    width = length - _GRAM + 1
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    inside = starts[1:][row] - np.arange(n) >= length
    place = np.flatnonzero(inside)
    if not len(place):
        return none
    at = (least[place] & low).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1) | (row[place[1:]] != row[place[:-1]])])
    first = place[edge]
    last = place[np.r_[edge[1:], len(place)] - 1]
    return mix(h[at[edge]]), first, last, row[first]


def _table(table: pa.Table, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """Slices of a block: bytes, offsets, ids and anchors."""
    buf, starts = column(table["text"])
    ids = table["id"].cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()
    for a, b in slices(starts, 1 << 20):
        part, at = buf[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        yield part, at, ids[a:b], anchors(part, at, length)


def _hash_strings(buf: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the strings of ``length`` bytes at ``begin``."""
    e = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    out = np.full(len(begin), np.uint64(length))
    for k in [*range(0, length - 8, 8), length - 8]:
        out = mix(out * _B + e[begin + k])
    return out


def _hash_contexts(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [begin, end), each at least 8 bytes."""
    e = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    out = mix((end - begin).astype(np.uint64))
    for k in range(0, int((end - begin).max(initial=0)) - 7, 8):
        go = begin + k + 8 <= end
        out = np.where(go, mix(out * _B + e[np.where(go, begin + k, begin)]), out)
    return mix(out * _C + e[end - 8])


def _gather(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of the ranges, end to end."""
    size = end - begin
    total = int(size.sum())
    at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    return buf[at]


def _least(key: np.ndarray, other: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Indexes of one entry for each (key, other), of the least id, ordered by key and other."""
    by = np.lexsort((ids, other, key))
    k, o = key[by], other[by]
    return by[np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]] if len(by) else by


def ask_anchors(length: int, n: int):
    def make(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        seen = []
        for _, _, _, (h, _, _, row) in _table(table, length):
            seen.append(_pairs(h, row))
        h = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        many = np.diff(np.r_[edge, len(h)])
        h = h[edge]
        at = exchange.cut(h, n)
        for r in range(n):
            a, b = at[r], at[r + 1]
            if a < b:
                extra = np.flatnonzero(many[a:b] > 1)
                yield r, exchange.pack(0, **exchange.pack_sorted(h[a:b]), i=extra.astype(np.int32), m=many[a:b][extra].astype(np.int32))

    return make


def _pairs(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The hash of each distinct (hash, row)."""
    by = np.lexsort((row, h))
    h, row = h[by], row[by]
    return h[np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]] if len(h) else h


def reply_anchors(hot: int):
    """For each block: its hashes that several documents have, and those that more than ``hot`` have."""

    def reply(values: list[dict[str, np.ndarray]]) -> list[bytes]:
        every = [exchange.unpack_sorted(v) for v in values]
        h = np.concatenate(every)
        m = np.ones(len(h), np.int64)
        at = 0
        for v, own in zip(values, every, strict=True):
            m[at + v["i"]] = v["m"]
            at += len(own)
        by = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.r_[True, h[by][1:] != h[by][:-1]])
        per = np.empty(len(h), np.int64)
        per[by] = np.repeat(np.add.reduceat(m[by], edge), np.diff(np.r_[edge, len(h)]))
        out, at = [], 0
        for own in every:
            mine = per[at : at + len(own)]
            at += len(mine)
            out.append(exchange.pack(0, **exchange.pack_sorted(own[mine > 1]), hot=own[mine > hot]))
        return out

    return reply


def _answered(found: dict[int, dict[str, np.ndarray]], name: str, kind=np.uint64) -> np.ndarray:
    parts = [found[r][name] for r in sorted(found)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def send_contexts(length: int, n: int):
    def finish(table: pa.Table, found: dict[int, dict[str, np.ndarray]]) -> pa.Table:
        shared = np.concatenate([exchange.unpack_sorted(found[r]) for r in sorted(found)]) if found else np.zeros(0, np.uint64)
        hot = _answered(found, "hot")
        entries: list[tuple] = []  # key, context hash, least id, size, bytes
        for buf, _, ids, (h, first, last, row) in _table(table, length):
            keep = _in(h, shared) >= 0
            h, first, last, row = h[keep], first[keep], last[keep], row[keep]
            if not len(h):
                continue
            single = _in(h, hot) >= 0
            if single.any():  # each string of a hot anchor under its own hash
                count = (last - first + 1)[single]
                begin = np.repeat(first[single], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                key = mix(_hash_strings(buf, begin, length) * _B + np.uint64(1))
                entries.append((key, _hash_contexts(buf, begin, begin + length), ids[np.repeat(row[single], count)], begin, begin + length, buf))
                told = np.flatnonzero(single)[np.unique(h[single], return_index=True)[1]]  # and once the anchor's mark, so that its block knows
                begin = first[told]
                entries.append((_hot_mark(h[told]), _hash_contexts(buf, begin, begin + length), ids[row[told]], begin, begin + length, buf))
            plain = ~single
            if plain.any():
                begin, end = first[plain], last[plain] + length
                entries.append((h[plain], _hash_contexts(buf, begin, end), ids[row[plain]], begin, end, buf))
        if not entries:
            return exchange.sent(0, iter(()))
        kept = []
        for key, ctx, who, begin, end, buf in entries:
            i = _least(key, ctx, who)
            kept.append((key[i], ctx[i], who[i], end[i] - begin[i], _gather(buf, begin[i], end[i])))
        key, ctx, who, size = (np.concatenate([x[k] for x in kept]) for k in range(4))
        body = np.concatenate([x[4] for x in kept])
        at = np.cumsum(size) - size
        i = _least(key, ctx, who)
        key, ctx, who, size, at = key[i], ctx[i], who[i], size[i], at[i]
        place = exchange.cut(key, n)

        def made() -> Iterator[tuple[int, bytes]]:
            for r in range(n):
                a, b = place[r], place[r + 1]
                if a < b:
                    yield r, exchange.pack(3, **exchange.pack_sorted(key[a:b]), who=who[a:b], size=size[a:b].astype(np.int16), body=_gather(body, at[a:b], at[a:b] + size[a:b]))

        return exchange.sent(table["block"][0].as_py(), made())

    return finish


def least_holders(group: np.ndarray, size: np.ndarray, body: np.ndarray, who: np.ndarray, length: int) -> np.ndarray:
    """For each string of each context, end to end, the least id among equal strings of its group.

    group: sorted numbers; size, body: the contexts, distinct within a group; who: their least ids.
    """
    strings = size - length + 1
    out = np.repeat(who, strings)
    if not len(group):
        return out
    begin = np.cumsum(size) - size
    string_at = np.cumsum(strings) - strings
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    count = np.diff(np.r_[edge, len(group)])
    several = np.flatnonzero(count > 1)  # one context: all its strings have its least id
    if not len(several):
        return out
    ends = np.add.reduceat(size + 1, edge) + 1  # a mark after each context and one at the end
    several = several[np.argsort(ends[several], kind="stable")]
    at = 0
    while at < len(several):
        stop = at + max(1, int(np.searchsorted(np.cumsum(ends[several[at:]]), _LOCKSTEP, "right")))
        # texts of like size: none more than twice as long as the first
        stop = min(stop, max(at + 1, int(np.searchsorted(ends[several], 2 * ends[several[at]], "right"))))
        lanes = several[at:stop]
        at = stop
        members = np.repeat(edge[lanes] - (np.cumsum(count[lanes]) - count[lanes]), count[lanes]) + np.arange(count[lanes].sum())
        # text of a lane: context, 1, context, 1, ..., 0
        sizes = size[members]
        closing = np.zeros(len(members), np.int64)
        closing[np.cumsum(count[lanes]) - 1] = 1
        place = np.cumsum(sizes + 1 + closing) - (sizes + 1 + closing)
        text = np.zeros(int((sizes + 1 + closing).sum()), np.int16)
        raw = _gather(body, begin[members], begin[members] + sizes)
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text[np.repeat(place, sizes) + inner] = raw.astype(np.int16) + 2
        text[place + sizes] = 1
        lane_starts = np.r_[place[np.cumsum(count[lanes]) - count[lanes]], len(text)]
        if len(lanes) >= _FEW:
            sa = orders(text, lane_starts)
        else:
            sa = np.concatenate([order(text[a:b]) + a for a, b in zip(lane_starts, lane_starts[1:], strict=False)])
        # the string that begins at each position, or -1
        number = np.full(len(text), -1, np.int64)
        per = strings[members]
        step = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        number[np.repeat(place, per) + step] = np.repeat(string_at[members], per) + step
        holder = np.repeat(who[members], per)
        held = np.empty(len(text), np.int64)
        held[np.repeat(place, per) + step] = holder
        sa = sa[number[sa] >= 0]
        lane = np.searchsorted(lane_starts, sa, "right")
        new = np.r_[True, lane[1:] != lane[:-1]]
        check = np.flatnonzero(~new)
        wide = np.ndarray((len(text) - 3,), "<u8", text, strides=(2,))
        for k in [*range(0, length - 4, 4), length - 4]:  # neighbours in suffix order that agree on `length` symbols
            if not len(check):
                break
            differ = wide[sa[check] + k] != wide[sa[check - 1] + k]
            new[check[differ]] = True
            check = check[~differ]
        runs = np.flatnonzero(new)
        least = np.minimum.reduceat(held[sa], runs)
        out[number[sa]] = np.repeat(least, np.diff(np.r_[runs, len(sa)]))
    return out


def _runs_of(key: np.ndarray, size: np.ndarray, body: np.ndarray, at: np.ndarray, who: np.ndarray, lead: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of strings of one holder within each context of ``lead`` (by key): how many, their lengths and holders.

    Keys are taken some at a time, of about ``_SLICE`` bytes together: what is held for each byte is held for those only.
    """
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    edge = np.flatnonzero(np.r_[True, key[lead][1:] != key[lead][:-1]]) if len(lead) else np.zeros(0, np.int64)
    ends = np.r_[edge[1:], len(lead)]
    upto = np.cumsum(size[lead])
    first = 0
    while first < len(edge):
        a = edge[first]
        last = max(first, int(np.searchsorted(upto[ends - 1], (upto[a - 1] if a else 0) + _SLICE, "right")) - 1)
        some = lead[a : ends[last]]
        first = last + 1
        found = least_holders(key[some], size[some], _gather(body, at[some], at[some] + size[some]), who[some], length)
        strings = size[some] - length + 1
        begins = np.zeros(len(found), bool)
        begins[np.cumsum(strings) - strings] = True
        begins[1:] |= found[1:] != found[:-1]
        run = np.flatnonzero(begins)
        own = np.searchsorted(run, np.cumsum(strings) - strings)
        made.append((np.diff(np.r_[own, len(run)]), np.diff(np.r_[run, len(found)]), found[run]))
    return tuple(np.concatenate([m[k] for m in made]) for k in range(3))


def _parts_of(keys: list[np.ndarray], sizes: list[np.ndarray]) -> list[np.ndarray]:
    """Where in each of several sorted lists of keys the parts of the keys begin and end; a part has about ``_PART`` bytes, and all of a key."""
    total = sum(int(x.sum(dtype=np.int64)) for x in sizes)
    every = np.sort(np.concatenate(keys))
    n = min(len(every), 1 + total // _PART)
    edges = np.unique(every[[len(every) * k // n for k in range(1, n)]]) if n > 1 else every[:0]
    return [np.r_[0, np.searchsorted(own, edges), len(own)].astype(np.int64) for own in keys]


def _held(key: np.ndarray, size: np.ndarray, who: np.ndarray, body: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For contexts end to end: their names, how many runs of strings of one holder each has, and lengths and holders of the runs."""
    at = np.cumsum(size) - size
    ctx = _hash_contexts(body, at, at + size)
    by = np.lexsort((who, ctx, key))
    k, c = key[by], ctx[by]
    new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
    lead = by[new]  # one context for each (key, hash), of the least id
    runs, length_of, holder = _runs_of(key, size, body, at, who, lead, length)
    run_of = np.cumsum(runs) - runs
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) - 1
    n = runs[rank]
    pick = np.repeat(run_of[rank] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return mix(key * _A + ctx), n.astype(np.int16), length_of[pick].astype(np.int16), holder[pick]


def reply_contexts(length: int):
    def reply(values: list[dict[str, np.ndarray]]) -> list[bytes]:
        keys = [exchange.unpack_sorted(v) for v in values]
        parts = _parts_of(keys, [v["size"] for v in values])
        ends = [np.r_[0, np.cumsum(v["size"], dtype=np.int64)] for v in values]
        made: list[list[tuple[np.ndarray, ...]]] = [[] for _ in values]
        for j in range(len(parts[0]) - 1 if parts else 0):
            some = [(i, int(p[j]), int(p[j + 1])) for i, p in enumerate(parts) if p[j] < p[j + 1]]
            if not some:
                continue
            key = np.concatenate([keys[i][a:b] for i, a, b in some])
            who, size = (np.concatenate([values[i][x][a:b] for i, a, b in some]) for x in ("who", "size"))
            body = np.concatenate([values[i]["body"][ends[i][a] : ends[i][b]] for i, a, b in some])
            name, runs, length_of, holder = _held(key, size.astype(np.int64), who, body, length)
            run_at = np.r_[0, np.cumsum(runs, dtype=np.int64)]
            at = 0
            for i, a, b in some:
                to = at + b - a
                made[i].append((name[at:to].copy(), runs[at:to].copy(), length_of[run_at[at] : run_at[to]].copy(), holder[run_at[at] : run_at[to]].copy()))
                at = to
        values.clear()
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int16), np.zeros(0, np.int16), np.zeros(0, np.int64))
        out = []
        for own, pieces in zip(keys, made, strict=True):
            name, runs, size, who = (np.concatenate([x[k] for x in [none, *pieces]]) for k in range(4))
            pieces.clear()
            out.append(exchange.pack(1, **exchange.pack_sorted(own), name=name, runs=runs, size=size, who=who))
        return out

    return reply


def mark(length: int):
    def finish(table: pa.Table, found: dict[int, dict[str, np.ndarray]]) -> pa.Table:
        name, runs, size, who = (_answered(found, x, k) for x, k in (("name", np.uint64), ("runs", np.int64), ("size", np.int64), ("who", np.int64)))
        shared = np.concatenate([exchange.unpack_sorted(found[r]) for r in sorted(found)]) if found else np.zeros(0, np.uint64)
        by = np.argsort(name, kind="stable")
        name = name[by]
        runs = runs.astype(np.int64)
        begins = np.cumsum(runs) - runs
        runs, begins = runs[by], begins[by]
        spans, kept = [], []
        for buf, starts, ids, (h, first, last, row) in _table(table, length):
            cover = np.zeros(len(buf) + 1, np.int64)
            if len(h) and len(name):
                keep = _in(h, shared) >= 0
                single = np.flatnonzero(_in(_hot_mark(h), shared) >= 0)
                if keep.any():
                    key = mix(h[keep] * _A + _hash_contexts(buf, first[keep], last[keep] + length))
                    cover += _cover(len(buf), _in(key, name), first[keep], ids[row[keep]], runs, begins, size, who, length)
                if len(single):  # strings of hot anchors
                    count = (last - first + 1)[single]
                    begin = np.repeat(first[single], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    own = mix(_hash_strings(buf, begin, length) * _B + np.uint64(1))
                    cover += _cover(len(buf), _in(mix(own * _A + _hash_contexts(buf, begin, begin + length)), name), begin, ids[np.repeat(row[single], count)], runs, begins, size, who, length)
            gone = np.cumsum(cover[:-1]) > 0
            for k in range(len(ids)):
                a, b = int(starts[k]), int(starts[k + 1])
                g = gone[a:b]
                if g.any():
                    edges = np.flatnonzero(np.diff(np.r_[0, g.view(np.int8), 0]))
                    spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                    kept.append(buf[a:b][~g].tobytes())
                else:
                    spans.append([])
                    kept.append(buf[a:b].tobytes())
        carried = {"carried": table["carried"]} if "carried" in table.column_names else {}
        return pa.table({"id": table["id"], **carried, "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    return finish


def _hot_mark(h: np.ndarray) -> np.ndarray:
    return mix(h * _C + np.uint64(7))


def _cover(n: int, at: np.ndarray, first: np.ndarray, own: np.ndarray, runs: np.ndarray, begins: np.ndarray, size: np.ndarray, who: np.ndarray, length: int) -> np.ndarray:
    """The differences that cover each string of n bytes whose least holder is before its own document."""
    hit = np.flatnonzero(at >= 0)
    m = runs[at[hit]]
    pick = np.repeat(begins[at[hit]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    sizes = size[pick].astype(np.int64)
    before = np.cumsum(sizes) - sizes
    inner = before - np.repeat(before[np.cumsum(m) - m], m) if len(m) else before
    begin = np.repeat(first[hit], m) + inner
    early = who[pick] < np.repeat(own[hit], m)
    begin, end = begin[early], (begin + sizes + length - 1)[early]
    return np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)


def remove_repeats(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, hot: int = HOT, block_bytes: int = exchange.BLOCK_BYTES) -> DataFrame:
    """``id_col``, ``carried`` (a struct of the columns ``carry``, if any), the removed ``spans`` in bytes, and the ``kept`` bytes of every row."""
    if length < 32:
        raise ValueError("strings of at least 32 bytes are anchored")
    full, n_blocks = exchange.blocks(df, id_col, text_col, block_bytes, carry)
    docs = full.select("block", "id", "text")
    n, m = exchange.ranges(n_blocks), max(exchange.ranges(n_blocks, 2 * exchange.FAN), min(n_blocks, _RANGES))
    shared = exchange.answer(exchange.ask(docs, ask_anchors(length, n)), reply_anchors(hot))
    contexts = exchange.told(docs, shared, send_contexts(length, m), exchange.SENT)
    holders = exchange.answer(contexts, reply_contexts(length))
    kind = df.schema[id_col].dataType.simpleString()
    carried = f"carried {full.schema['carried'].dataType.simpleString()}, " if carry else ""
    out = exchange.told(full, holders, mark(length), f"id {kind}, {carried}spans array<struct<begin:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)
