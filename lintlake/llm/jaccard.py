"""Jaccard join of documents on word n-grams, with T-occurrence search.

1. A fixed-size sketch counts the shingles of all documents; it only orders shingles, rare ones first.
2. Every document becomes a class (its set's hash), a prefix (the first shingles in that order, of which two
   similar sets must share one) and a parity bitmap. Classes with equal sets are one from here on.
3. Classes that share a prefix shingle, and whose sizes and bitmaps allow the similarity, are candidates
   (an exact filter); candidate links are joined into clusters by connected components.
4. The whole sets of a cluster are dealt to chunks of about ``CLUSTER`` shingles. In a task every set asks an inverted
   index for the sets that share at least T of its shingles: DivideSkip merges its short lists with a heap and probes
   the long ones by binary search for what the short ones found, and a union-find skips those already known to be
   connected. About ``LEADERS`` sets of a cluster visit all its chunks, so that a group of near copies becomes one
   component at once. Sets outside a cluster's largest component then visit its other chunks; those inside need not,
   as every link between them joins what is joined.

A class is known by 63 bits of its set's hash, so two of n unlike sets are taken for equal with a probability of about
n * n / 2**64. Cases: a null or blank text has no shingles, and is linked with nothing (its component is its own id);
fewer words than n are one shingle; copies share a class, so groups of thousands cost one set; null ids are
carried through; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm import exchange
from lintlake.llm.bytesets import column, mix, shingles, slices, word_hashes
from lintlake.llm.components import components
from lintlake.llm.storage import bounded, kept

#: Counters of the shingle sketch.
SKETCH = 1 << 20
_SHIFT = np.uint64(64 - 20)
#: Shingles of a chunk of a cluster, about, and sets of a cluster that visit all its chunks.
CLUSTER = 1 << 14
LEADERS = 32
#: The newest members of a group of candidates, which are tried before its others.
_NEWEST = 8
_MOST_BITS = 1 << 13
#: Fixed value: the weight of DivideSkip's published rule for the number of long lists.
_MU = 0.0085


def sketch(df: DataFrame, words: int, text_col: str = "text") -> np.ndarray:
    """How many shingles of all documents fall on each counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            buf, starts = column(batch["text"])
            for a, b in slices(starts):
                h, row = word_hashes(buf[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                total += np.bincount((shingles_raw(h, row, words) >> _SHIFT).astype(np.int64), minlength=SKETCH)
        step = SKETCH // 16
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([exchange.pack(1, n=total[k * step : (k + 1) * step]) for k in range(16)], pa.binary())], ["slice", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(exchange.unpack(d.as_py())["n"] for d in table["data"])
        return pa.table({"slice": table["slice"][:1], "data": pa.array([exchange.pack(1, n=total)], pa.binary())})

    made = bounded(df).select(F.col(text_col).alias("text")).mapInArrow(count, "slice int, data binary")
    made = made.withColumn("part", F.spark_partition_id() % 64)
    once = made.groupBy("slice", "part").applyInArrow(add, "slice int, data binary")
    out = np.zeros(SKETCH, np.int64)
    for r in once.groupBy("slice").applyInArrow(add, "slice int, data binary").collect():
        n = exchange.unpack(r["data"])["n"]
        out[r["slice"] * len(n) : (r["slice"] + 1) * len(n)] = n
    return out


def shingles_raw(h: np.ndarray, row: np.ndarray, words: int) -> np.ndarray:
    """The shingles of texts with enough words, with repetitions, unordered: what the sketch counts."""
    if len(h) < words:
        return h[:0]
    joined = h[: len(h) - words + 1].copy()
    for k in range(1, words):
        joined = mix(joined * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - words + 1 + k])
    return joined[row[: len(joined)] == row[words - 1 :]]


def needed(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The least size of a set that is similar to one of size n, which is also the overlap it needs."""
    return -(-n * share[0] // share[1])


def differ(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """How many shingles two similar sets with n shingles in all can have apart."""
    return n * (share[1] - share[0]) // (share[1] + share[0])


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles on at least half as many bits as there are shingles, a power of two; as 64-bit words."""
    bits = min(_MOST_BITS, max(64, 1 << int(len(s) // 2).bit_length()))
    odd = np.bincount(((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def fold(maps: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps at fewer words."""
    while maps.shape[1] > size:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def sets(df: DataFrame, words: int, share: tuple[int, int], order: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``id, n, cls, prefix, bits`` of every document; cls is null without shingles."""
    held = df.sparkSession.sparkContext.broadcast(np.minimum(16 * np.log2(order + 1), 65535).astype(np.uint16))  # SKETCH numbers
    rows = bounded(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = held.value
        for batch in batches:
            buf, starts = column(batch["text"])
            for a, b in slices(starts):
                h, row = word_hashes(buf[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                s, row = shingles(h, row, words)
                by = np.lexsort((s, rank[(s >> _SHIFT).astype(np.int64)], row))
                rare = s[by]
                edge = np.searchsorted(row, np.arange(b - a + 1))
                n, cls, prefix, bits = [], [], [], []
                for k in range(b - a):
                    own = s[edge[k] : edge[k + 1]]
                    m = len(own)
                    n.append(m)
                    if not m:
                        cls.append(None)
                        prefix.append(None)
                        bits.append(None)
                        continue
                    cls.append(cls_of(own))
                    prefix.append(rare[edge[k] : edge[k] + m - int(needed(np.int64(m), share)) + 1].tobytes())
                    bits.append(bitmap(own).tobytes())
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())], ["id", "n", "cls", "prefix", "bits"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, cls long, prefix binary, bits binary")


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Prefix shingles of a block's classes, sorted, with the row of each."""
    parts = [np.frombuffer(p.as_py(), np.uint64) for p in table["prefix"]]
    h = np.concatenate(parts)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    by = np.argsort(h, kind="stable")
    return h[by], row[by]


def ask_prefixes(n: int):
    def make(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        h, _ = _entries(table)
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        many = np.diff(np.r_[edge, len(h)]) > 1
        h = h[edge]
        at = exchange.cut(h, n)
        for r in range(n):
            a, b = at[r], at[r + 1]
            if a < b:
                yield r, exchange.pack(0, **exchange.pack_sorted(h[a:b]), many=np.packbits(many[a:b]))

    return make


def reply_prefixes(values: list[dict[str, np.ndarray]]) -> list[bytes]:
    """The hashes of each block that several classes have."""
    every = [exchange.unpack_sorted(v) for v in values]
    h = np.concatenate(every)
    many = np.concatenate([np.unpackbits(v["many"], count=len(k)) for v, k in zip(values, every, strict=True)]).astype(bool)
    found, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    shared = (count > 1)[inverse] | many
    out, at = [], 0
    for k in every:
        out.append(exchange.pack(0, **exchange.pack_sorted(k[shared[at : at + len(k)]])))
        at += len(k)
    return out


def send_classes(n: int):
    def finish(table: pa.Table, found: dict[int, dict[str, np.ndarray]]) -> pa.Table:
        shared = np.concatenate([exchange.unpack_sorted(found[r]) for r in sorted(found)]) if found else np.zeros(0, np.uint64)
        block = table["block"][0].as_py() if table.num_rows else 0
        if not len(shared) or not table.num_rows:
            return exchange.sent(block, iter(()))
        h, row = _entries(table)
        keep = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h
        h, row = h[keep], row[keep]
        cls, size = table["cls"].to_numpy(), table["n"].to_numpy()
        maps = [np.frombuffer(x.as_py(), "<u8") for x in table["bits"]]
        at = exchange.cut(h, n)

        def made() -> Iterator[tuple[int, bytes]]:
            for r in range(n):
                a, b = at[r], at[r + 1]
                if a < b:
                    used, index = np.unique(row[a:b], return_inverse=True)  # a class's bitmap goes to a range once
                    yield r, exchange.pack(1, **exchange.pack_sorted(h[a:b]), i=index.astype(np.int32), cls=cls[used], n=size[used], w=np.array([len(maps[k]) for k in used]), bits=np.concatenate([maps[k] for k in used]))

        return exchange.sent(block, made())

    return finish


def candidates(share: tuple[int, int]):
    """Links of a range between classes that share a prefix shingle and may be similar: a star for each group of them."""

    def run(table: pa.Table) -> pa.Table:
        values = [exchange.unpack(d.as_py()) for d in table["data"]]
        h = np.concatenate([exchange.unpack_sorted(v) for v in values])
        base = np.cumsum([0, *(len(v["cls"]) for v in values)])
        index = np.concatenate([v["i"].astype(np.int64) + base[k] for k, v in enumerate(values)])
        cls, n, w = (np.concatenate([v[x] for v in values]) for x in ("cls", "n", "w"))
        bits = np.concatenate([v["bits"] for v in values])
        place = np.cumsum(w) - w
        by = np.lexsort((cls[index], n[index], h))
        h, index = h[by], index[by]
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        links: list[np.ndarray] = []
        for a, b in zip(edge, np.r_[edge[1:], len(h)], strict=True):
            if b - a < 2:
                continue
            mine = index[a:b]
            group = linked(n[mine], w[mine], place[mine], bits, share)
            root = np.full(b - a, np.iinfo(np.int64).max)
            np.minimum.at(root, group, cls[mine])
            root = root[group]
            other = root != cls[mine]
            if other.any():
                links.append(np.stack([cls[mine][other], root[other]]))
        pairs = np.unique(np.concatenate(links, axis=1), axis=1) if links else np.zeros((2, 0), np.int64)
        return pa.table({"u": pa.array(pairs[0]), "v": pa.array(pairs[1])})

    return run


def linked(n: np.ndarray, w: np.ndarray, place: np.ndarray, bits: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """A group number for each class (sizes ascending), joined where sizes and bitmaps allow the similarity.

    A class is held against the newest members of each group first, and against the others only of groups that it has
    not joined by then.
    """
    m = len(n)
    group = np.arange(m)
    newest = np.ones(m, bool)
    members: dict[int, list[int]] = {0: [0]}

    def near(k: int, others: np.ndarray) -> np.ndarray:
        hits = []
        for width in np.unique(w[others]).tolist():  # widths grow with sizes
            same = others[w[others] == width]
            mine = fold(bits[place[k] : place[k] + w[k]][None, :], width)
            apart = np.bitwise_count(bits[place[same][:, None] + np.arange(width)] ^ mine).sum(1)
            hits.append(same[apart <= differ(n[same] + n[k], share)])
        return np.concatenate(hits) if hits else others

    least = needed(n, share)
    for k in range(1, m):
        low = int(np.searchsorted(n, least[k]))
        joined: set[int] = set()
        if low < k:
            joined.update(group[near(k, low + np.flatnonzero(newest[low:k]))].tolist())
            if len(joined) < len(members):
                old = low + np.flatnonzero(~newest[low:k])
                old = old[~np.isin(group[old], list(joined))]
                if len(old):
                    joined.update(group[near(k, old)].tolist())
        if not joined:
            members[k] = [k]
            continue
        first, *others = sorted(joined, key=lambda g: -len(members[g]))
        newest[members[first][-_NEWEST:]] = False
        for g in others:
            gone = members.pop(g)
            newest[gone[-_NEWEST:]] = False
            group[gone] = first
            members[first] = sorted([*members[first], *gone])
        group[k] = first
        members[first].append(k)
        newest[members[first][-_NEWEST:]] = True
    return group


def search(sets_: list[np.ndarray], share: tuple[int, int], sides: np.ndarray | None = None) -> np.ndarray:
    """A group number for each set, joined where two sets are similar.

    T-occurrence search: sets ascend by size, and each asks for smaller ones that share at least T shingles.
    With ``sides``, only sets of different sides are compared.
    """
    m = len(sets_)
    size = np.array([len(s) for s in sets_], np.int64)
    by = np.argsort(size, kind="stable")
    tokens, inverse = np.unique(np.concatenate([sets_[k] for k in by]), return_inverse=True)
    ends = np.cumsum(size[by])
    owner = np.repeat(np.arange(m), size[by])
    order = np.lexsort((owner, inverse))
    lists = owner[order]  # the inverted lists, one after another, each ascending
    begin = np.searchsorted(inverse[order], np.arange(len(tokens) + 1))
    keys = inverse[order] * np.int64(m) + lists
    plain, edge = lists.tolist(), begin.tolist()
    group = np.arange(m)
    sorted_size = size[by]
    side = sides[by] if sides is not None else None
    for k in range(1, m):
        n = int(sorted_size[k])
        least = int(needed(np.int64(n), share))
        low = int(np.searchsorted(sorted_size, least))
        if low >= k or (group[low:k] == group[k]).all():
            continue
        own = inverse[ends[k] - n : ends[k]]
        count = begin[own + 1] - begin[own]
        t = -(-share[0] * (n + least) // (share[0] + share[1]))  # overlap with the smallest partner
        own = own[np.argsort(count, kind="stable")]
        long_ = min(t - 1, int(t / (_MU * np.log2(max(2, int(count.max()))) + 1)))
        short, rest = own[: n - long_], own[n - long_ :]
        inside = [plain[bisect_left(plain, low, edge[x], edge[x + 1]) : bisect_left(plain, k, edge[x], edge[x + 1])] for x in short.tolist()]
        met = [(x, sum(1 for _ in same)) for x, same in groupby(heapq.merge(*[x for x in inside if x]))]
        if not met:
            continue
        found, times = np.array(met, np.int64).T
        keep = (times >= t - long_) & (group[found] != group[k])
        if side is not None:
            keep &= side[found] != side[k]
        found, times = found[keep], times[keep]
        if not len(found):
            continue
        if len(rest):
            probe = (rest[:, None] * np.int64(m) + found[None, :]).ravel()
            where = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            times = times + (keys[where] == probe).reshape(len(rest), len(found)).sum(0)
        hit = found[share[1] * times >= share[0] * (n + sorted_size[found] - times)]
        if len(hit):
            joined = np.unique(np.append(group[hit], group[k]))
            group[np.isin(group, joined)] = joined[0]
    out = np.empty(m, np.int64)
    out[by] = group
    return out


def _members(links: DataFrame, classes: DataFrame) -> DataFrame:
    """``cls, id, n, root, more, chunk, leader`` of every class of a cluster."""
    roots = components(links)
    member = roots.select(F.col("node").alias("cls"), "root").union(roots.select(F.col("root").alias("cls"), "root").distinct())
    member = member.join(classes.select("cls", "id", "n"), "cls")
    sizes = member.groupBy("root").agg((F.sum("n") / CLUSTER).cast("int").alias("more"), F.count("*").alias("_sets"))
    leader = (F.col("more") > 0) & (F.pmod(F.xxhash64("cls", F.lit(1)), F.col("_sets")) < LEADERS)
    return kept(member.join(sizes, "root").select("cls", "id", "n", "root", "more", F.pmod(F.xxhash64("cls"), F.col("more") + 1).cast("int").alias("chunk"), leader.alias("leader")), "clusters")


def link_clusters(df: DataFrame, classes: DataFrame, links: DataFrame, words: int, share: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """Edges ``u, v`` that join the classes of a cluster that similar sets connect."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts = column(batch["text"])
            out: list[bytes] = []
            for a, b in slices(starts):
                h, row = word_hashes(buf[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                s, row = shingles(h, row, words)
                edge = np.searchsorted(row, np.arange(b - a + 1))
                out += [s[edge[k] : edge[k + 1]].tobytes() for k in range(b - a)]
            right = pa.array([cls_of(np.frombuffer(s, np.uint64)) == c for s, c in zip(out, batch["cls"].to_pylist(), strict=True)], pa.bool_())  # an id can stand in several rows
            yield pa.RecordBatch.from_arrays([batch["visits"], batch["cls"], pa.array(out, pa.binary())], ["visits", "cls", "s"]).filter(right)

    def join(table: pa.Table) -> pa.Table:
        cls, side = table["cls"].to_numpy(), table["side"].to_numpy()
        full = np.unique(np.stack([cls, side]), axis=1, return_index=True)[1].tolist()
        own = [np.frombuffer(table["s"][k].as_py(), np.uint64) for k in full]
        names = cls[full]
        group = search(own, share, side[full] if side.any() else None) if len(own) > 1 else np.zeros(len(own), np.int64)
        root = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(root, group, names)
        root = root[group]
        other = root != names
        return pa.table({"u": pa.array(names[other]), "v": pa.array(root[other])})

    def met(visits: DataFrame) -> DataFrame:
        """The links in each place (root, lo, hi) that classes visit; ``visits``: cls, id and an array of places with a side."""
        sets_ = texts.join(visits, "id").select("visits", "cls", "text").mapInArrow(digest, f"visits {visits.schema['visits'].dataType.simpleString()}, cls long, s binary")
        return sets_.select(F.explode("visits").alias("at"), "cls", "s").select("at.*", "cls", "s").groupBy("root", "lo", "hi").applyInArrow(join, "u long, v long")

    member = _members(links, classes)
    place = lambda lo, hi, side: F.struct("root", lo.alias("lo"), hi.alias("hi"), F.lit(side).alias("side"))
    every = lambda n: F.sequence(F.lit(0), n)
    own = F.when(F.col("leader"), every(F.col("more"))).otherwise(F.array("chunk"))
    first = kept(met(member.select("id", "cls", F.transform(own, lambda c: place(c, F.lit(0), 0)).alias("visits"))), "links")
    # sets of cut clusters that are not in the cluster's largest component so far
    joined = components(first)
    stars = joined.select(F.col("node").alias("u"), F.col("root").alias("v"))
    cut = member.where("more > 0").join(joined.select(F.col("node").alias("cls"), F.col("root").alias("part")), "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    largest = cut.groupBy("root", "part").agg(F.count("*").alias("_n")).groupBy("root").agg(F.max_by("part", F.struct("_n", "part")).alias("most"))
    minor = kept(cut.join(largest, "root").where("part <> most").select("root", "cls", "id", "n", "more"), "minor")
    if minor.isEmpty():
        return stars
    sizes = minor.groupBy("root").agg((F.sum("n") / CLUSTER).cast("int").alias("parts"))
    asking = minor.join(sizes, "root").withColumn("_hi", F.pmod(F.xxhash64("cls", F.lit(2)), F.col("parts") + 1).cast("int"))
    asking = asking.select("id", "cls", F.transform(every(F.col("more")), lambda c: place(c, F.col("_hi"), 1)).alias("visits"))
    asked = member.join(sizes, "root").select("id", "cls", F.transform(every(F.col("parts")), lambda h: place(F.col("chunk"), h, 0)).alias("visits"))
    return stars.union(met(asking.union(asked)))


def cls_of(s: np.ndarray) -> int:
    return int((mix(s).sum() * np.uint64(2) + np.uint64(len(s))).view(np.int64))


def similar_components(df: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id``: the least id that links reach, of every row.

    Two documents link when share[1] * |intersection| >= share[0] * |union| of their shingle sets.
    """
    made = kept(sets(df, words, share, sketch(df, words, text_col), id_col, text_col), "sets")
    some = made.where("cls is not null and id is not null")
    classes = kept(some.groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "classes")
    total = classes.agg(F.sum(F.octet_length("prefix") + F.octet_length("bits"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // (1 << 20)))
    n = exchange.ranges(n_blocks, 12)  # few: a class sends its bitmap to each range that it shares a shingle in
    dealt = classes.select(F.pmod("cls", F.lit(n_blocks)).cast("int").alias("block"), "cls", "n", "prefix", "bits")
    shared = exchange.answer(exchange.ask(dealt, ask_prefixes(n)), reply_prefixes)
    sent = exchange.told(dealt, shared, send_classes(n), exchange.SENT)
    links = sent.groupBy("range").applyInArrow(candidates(share), "u long, v long")
    roots = components(link_clusters(df, classes, links, words, share, id_col, text_col))
    least = classes.select("cls", "id").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    least = least.select("cls", "id", F.coalesce("root", "cls").alias("root"))
    of_root = least.groupBy("root").agg(F.min("id").alias("component_id"))
    answer = least.join(of_root, "root").select("cls", "component_id")
    out = made.select("id", "n", "cls").join(answer, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
