"""What rules ask of the lines of a file in their order, for all files in one pass.

Lines repeat. Spark asks its patterns of each line once for the files of a batch (``KINDS``: expressions over lang and text), and
hands on what they gave with the line's places. From that numpy has a number for each line of the batch in order: depths are
running sums, where a function ends is a search among lines of one depth, and what a function's lines add up to is a difference
of sums. No row is shuffled, and no text leaves its batch but a function's that is asked for as text, once for all its places.

Every kind gives rows of ``SCHEMA`` under its name; ``VIEWS`` are the tables that rules read. ``spans`` finds the same spans in
Spark's own expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lintlake.functions.dialect import SPARK as D
from lintlake.functions.dialect import Ordered
from lintlake.model import CODE, JS, Settings
from lintlake.operators import context_rules, cross_rules
from lintlake.operators import function_rules as fns
from lintlake.sources import repeats

#: How much larger the batches are here than those of ``repeats``: many more patterns are asked of each line, and places are numbers.
_PIECES = 3
#: Rows of keys of blocks that one row holds.
_CHUNK = 4096
_FILE = pa.struct([("path", pa.string()), ("name", pa.string()), ("lang", pa.string()), ("n_lines", pa.int64()), ("rank", pa.int64()), ("wide", pa.bool_())])
_KEY = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("first_place", pa.int64()), ("last_rank", pa.int64())])
_PLACE = pa.struct([("path", pa.string()), ("name", pa.string()), ("line", pa.int64())])
_TOLD = pa.schema([("head", pa.list_(_FILE)), ("n", pa.int64()), ("lang", pa.string()), ("text", pa.string()), ("at", pa.list_(pa.int32()))])
_OUT = pa.schema([
    ("kind", pa.string()), ("path", pa.string()), ("file_name", pa.string()), ("lang", pa.string()), ("n_lines", pa.int64()), ("name", pa.string()), ("sig", pa.string()), ("params", pa.int64()),
    ("line", pa.int64()), ("tail", pa.int64()), ("n", pa.int64()), ("body", pa.list_(pa.string())), ("places", pa.list_(_PLACE)), ("keys", pa.list_(_KEY)),
])
SCHEMA = "kind string, path string, file_name string, lang string, n_lines long, name string, sig string, params long, line long, tail long, n long, body array<string>, places array<struct<path: string, name: string, line: long>>, keys array<struct<a: long, b: long, first_place: long, last_rank: long>>"
_FILES_DDL = "head array<struct<path: string, name: string, lang: string, n_lines: long, rank: long, wide: boolean>>, n long, lang string, text string, at array<int>"


def _told(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For some files (path, name, lang, n_lines, rank, content) at a time: a row of the files, and a row for each line of a language with its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in repeats.pieces(batch, most):
                x = repeats.Lines(piece, piece["lang"])
                files = pa.StructArray.from_arrays([piece[f.name].cast(f.type) for f in _FILE], fields=list(_FILE))
                told = pa.ListArray.from_arrays(pa.array([0, len(files)], pa.int32()), files)
                n = len(x.counts)
                yield pa.RecordBatch.from_arrays([told, pa.array([n], pa.int64()), *(pa.nulls(1, f.type) for f in list(_TOLD)[2:])], schema=_TOLD)
                at = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(x.counts)].astype(np.int32)), pa.array(x.order.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.nulls(n, _TOLD.field("head").type), pa.nulls(n, pa.int64()), piece["lang"].take(pa.array(x.file[x.first])), x.text.take(pa.array(x.first)), at], schema=_TOLD)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """Rows of ``_told`` with marks, put together again: the files of a piece and all of its lines."""
    left, held, files = 0, [], None
    for batch in batches:
        begin = 0
        while begin < batch.num_rows:
            if not left:
                files, left, held = batch["head"].slice(begin, 1).flatten(), batch["n"][begin].as_py(), []
                begin += 1
                continue
            end = min(begin + left, batch.num_rows)
            held.append(batch.slice(begin, end - begin))
            left, begin = left - (end - begin), end
            if not left:
                yield Piece(files, pa.Table.from_batches(held).combine_chunks())


class Piece:
    """Some files' lines in order. A place counts lines from 0 on through all of the files; ``said`` has a row for each line of a language."""

    def __init__(self, files: pa.StructArray, said: pa.Table) -> None:
        self.path, self.name, self.lang, n_lines, rank, wide = (files.field(k) for k in range(6))
        self.wide = wide.to_numpy(zero_copy_only=False)
        self.n_lines, self.rank = n_lines.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        self.stop = np.cumsum(self.n_lines)
        self.start = self.stop - self.n_lines
        self.size = int(self.stop[-1])
        self.file = np.repeat(np.arange(len(files)), self.n_lines)
        self.said = said
        at = self.column("at")
        self.uid = np.empty(self.size, np.int64)
        self.uid[at.flatten().to_numpy()] = np.repeat(np.arange(said.num_rows), pc.list_value_length(at).to_numpy(zero_copy_only=False))
        self._levels: tuple | None = None

    def column(self, name: str) -> pa.Array:
        found = self.said[name].combine_chunks()
        return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found

    def marks(self, name: str, null: int | bool = 0) -> np.ndarray:
        """A column of the distinct lines as numbers."""
        return pc.fill_null(self.column(name), null).to_numpy(zero_copy_only=False)

    def lines(self, name: str, null: int | bool = 0) -> np.ndarray:
        """A column for each line in order."""
        return self.marks(name, null)[self.uid]

    def where(self, name: str) -> np.ndarray:
        """The places of the lines that have a mark."""
        return np.flatnonzero(self.lines(name, False))

    def of_langs(self, langs: tuple[str, ...]) -> np.ndarray:
        """Whether each file is of one of some languages."""
        return pc.fill_null(pc.is_in(self.lang, pa.array(langs)), False).to_numpy(zero_copy_only=False)

    def line(self, place: np.ndarray) -> np.ndarray:
        """The number of a line in its file, from 1 on."""
        return place - self.start[self.file[place]] + 1

    def at_level(self, file: np.ndarray, level: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The first place from ``begin`` on in a file behind which the running sum of braces is ``level``; ``size`` where there is none."""
        if self._levels is None:
            depth = self.depth
            low = int(depth.min())
            span = int(depth.max()) - low + 1
            keys, group = np.unique(self.file * span + (depth - low), return_inverse=True)
            self._levels = low, span, keys, np.sort(group.reshape(-1) * self.size + np.arange(self.size))
        low, span, keys, order = self._levels
        wanted = file * span + (level - low)
        group = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        good = (level >= low) & (level < low + span) & (keys[group] == wanted)
        nth = np.searchsorted(order, group * self.size + np.minimum(begin, self.size - 1))
        found = order[np.minimum(nth, len(order) - 1)]
        good &= (nth < len(order)) & (found // self.size == group) & (begin < self.size)
        return np.where(good, found % self.size, self.size)

    @property
    def depth(self) -> np.ndarray:
        if not hasattr(self, "_depth"):
            self.net = self.lines("opens").astype(np.int64) - self.lines("closes")
            self._depth = np.cumsum(self.net)
        return self._depth

    def words(self, name: str, known: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of lists of words of lines, those that are known: which of ``places`` each is at, and its number among the known."""
        lists = self.column(name)
        number = pc.fill_null(pc.index_in(lists.flatten(), known), -1).to_numpy(zero_copy_only=False)
        of_line = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))[number >= 0]
        number = number[number >= 0]
        lengths = np.bincount(of_line, minlength=len(lists))
        begins = np.cumsum(lengths) - lengths
        u = self.uid[places]
        some = np.flatnonzero(lengths[u])
        u, places = u[some], places[some]
        each = lengths[u]
        nth = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begins[u], each)
        return np.repeat(places, each), number[nth]

    def places(self, every: np.ndarray, counts) -> pa.ListArray:
        """Lists of some places that follow each other."""
        file = pa.array(self.file[every])
        place = pa.StructArray.from_arrays([self.path.take(file), self.name.take(file), pa.array(self.line(every))], fields=list(_PLACE))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), place)

    def named(self, column: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The places of the lines that have a name, the numbers of the names, and the names."""
        names = self.column(column).dictionary_encode()
        number = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)[self.uid]
        at = np.flatnonzero(number >= 0)
        return at, number[at].astype(np.int64), names.dictionary

    def rows(self, kind: str, size: int, /, **columns) -> pa.RecordBatch:
        made = {k: v if isinstance(v, pa.Array) else pa.array(np.asarray(v).astype(np.int64)) for k, v in columns.items()} | {"kind": pa.repeat(pa.scalar(kind), size)}
        return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(size, f.type) for f in _OUT], schema=_OUT)

    def at_places(self, kind: str, places: np.ndarray, /, **columns) -> pa.RecordBatch:
        return self.rows(kind, len(places), path=self.path.take(pa.array(self.file[places])), line=self.line(places), **columns)


# -- functions ---------------------------------------------------------------------------------------------


def _greedy(heads: np.ndarray, tails: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which spans count: long enough, and not begun in the last that counts."""
    out, last = [], -1
    for k, (head, tail, n) in enumerate(zip(heads.tolist(), tails.tolist(), least.tolist())):
        if head > last and tail - head >= n:
            out.append(k)
            last = tail
    return np.array(out, np.int64)


def spans(p: Piece, table: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the functions that an extractor takes, in order."""
    x = fns.EXTRACTORS[table]
    heads = p.where(f"is_{table}")
    file = p.file[heads]
    stop, python = p.stop[file], p.of_langs(("py",))[file]
    depth = p.depth
    opened = np.flatnonzero(p.lines("opens") > 0)
    nth = np.searchsorted(opened, heads)
    first = np.append(opened, p.size)[nth]
    reach = np.minimum(heads + x.reach, stop)
    close = p.at_level(file, depth[heads] - p.net[heads], first)
    tails = np.where((first < reach) & (close < reach), close, np.minimum(stop - 1, heads + x.fallback))
    if python.any():
        at = np.flatnonzero(p.of_langs(("py",))[p.file] & p.lines("said", False))
        indent = p.lines("indent")[at]
        mine = p.lines("indent")[heads]
        low = np.full(len(heads), p.size)
        for level in np.unique(mine[python]):
            some = np.flatnonzero(python & (mine == level))
            places = np.append(at[indent <= level], p.size)
            low[some] = places[np.searchsorted(places, heads[some], "right")]
        last = stop - 1
        if not x.blanks:  # the last line with text; a head is one
            last = at[np.maximum(np.searchsorted(at, stop) - 1, 0)] if len(at) else last
        tails = np.where(python, np.where(low < stop, low - 1, last), tails)
    least = np.where(p.of_langs(fns._CLIKE)[file], 1, 0) if x.nested else np.full(len(heads), x.beyond)
    if x.nested:
        flat = np.flatnonzero(~python)
        taken = np.sort(np.r_[flat[_greedy(heads[flat], tails[flat], least[flat])], np.flatnonzero(python & (tails - heads >= least))])
    else:
        taken = _greedy(heads, tails, least)
    return heads[taken], tails[taken]


def _spans_rows(p: Piece, kind: str, heads: np.ndarray, tails: np.ndarray, **columns) -> pa.RecordBatch:
    file, u = pa.array(p.file[heads]), pa.array(p.uid[heads])
    return p.at_places(kind, heads, tail=p.line(tails), lang=p.lang.take(file), file_name=p.name.take(file), n_lines=p.n_lines[p.file[heads]], name=p.column(f"name_{kind}").take(u), **columns)


def _sums(marks: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(marks, dtype=np.int64)]
    return total[tails + 1] - total[heads]


def _smell(p: Piece, s: Settings) -> Iterator[pa.RecordBatch]:
    heads, tails = spans(p, "fn_smell")
    yield _spans_rows(p, "fn_smell", heads, tails, params=p.marks("params")[p.uid[heads]])


def _cyclomatic(p: Piece, s: Settings) -> Iterator[pa.RecordBatch]:
    heads, tails = spans(p, "fn_cc")
    n = 1 + _sums(p.lines("decisions"), heads, tails)
    some = n >= s.cc_limit
    yield _spans_rows(p, "fn_cc", heads[some], tails[some], n=n[some])


def _cognitive(p: Piece, s: Settings) -> Iterator[pa.RecordBatch]:
    heads, tails = spans(p, "fn_cog")
    nests, fall, adds = p.lines("nests", False), p.lines("fall"), p.lines("adds")
    at = np.flatnonzero(nests | (fall > 0) | (adds > 0))
    begin, end = np.searchsorted(at, heads).tolist(), np.searchsorted(at, tails, "right").tolist()
    nests, fall, adds = nests[at].tolist(), fall[at].tolist(), adds[at].tolist()
    n = []
    for a, b in zip(begin, end):
        score = depth = 0
        for k in range(a, b):
            score += adds[k]
            if nests[k]:
                score += 1 + depth
                depth += 1
            depth = depth - fall[k] if depth > fall[k] else 0
        n.append(score)
    n = np.array(n, np.int64)
    yield _spans_rows(p, "fn_cog", heads[n >= 10], tails[n >= 10], n=n[n >= 10])


def _bodies(p: Piece, kind: str, heads: np.ndarray, tails: np.ndarray, **columns: str) -> Iterator[pa.RecordBatch]:
    """A row for each text of functions, with its places. ``columns``: of the first line, by name."""
    met: dict[bytes, list[int]] = {}
    for k, (head, tail) in enumerate(zip(heads.tolist(), tails.tolist())):
        met.setdefault(p.uid[head : tail + 1].tobytes(), []).append(k)
    if not met:
        return
    one = np.array([ks[0] for ks in met.values()])
    every = heads[np.concatenate([np.array(ks) for ks in met.values()])]
    lengths = tails[one] - heads[one] + 1
    offsets = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(heads[one] - offsets, lengths)
    body = pa.ListArray.from_arrays(pa.array(np.r_[offsets, lengths.sum()].astype(np.int32)), p.column("text").take(pa.array(p.uid[at])))
    places = p.places(every, [len(ks) for ks in met.values()])
    u = pa.array(p.uid[heads[one]])
    yield p.rows(kind, len(one), lang=p.lang.take(pa.array(p.file[heads[one]])), body=body, places=places, **{k: p.column(c).take(u) for k, c in columns.items()})


def _shapes(p: Piece, s: Settings) -> Iterator[pa.RecordBatch]:
    heads, tails = spans(p, "fn_body")
    some = p.n_lines[p.file[heads]] > 10
    yield from _bodies(p, "fn_body", heads[some], tails[some], name="name_fn_body")


def _split(p: Piece, s: Settings) -> Iterator[pa.RecordBatch]:
    """Names of functions by file, the texts of those that are long, and the files with groups that never call each other."""
    heads, tails = spans(p, "fn_split")
    file = p.file[heads]
    big = p.n_lines[file] >= 60
    heads, tails, file = heads[big], tails[big], file[big]
    long = tails - heads + 1 >= s.fn_lines
    yield from _bodies(p, "fn_long", heads[long], tails[long], name="name_fn_split", sig="sig")
    keys, first, n = np.unique(file * len(p.said) + p.uid[heads], return_index=True, return_counts=True)
    of, u = pa.array(file[first]), pa.array(p.uid[heads[first]])
    yield p.rows("fn_split", len(keys), path=p.path.take(of), file_name=p.name.take(of), n_lines=p.n_lines[file[first]], name=p.column("name_fn_split").take(u), n=n)
    lone = _isolated(p, heads, tails, file)
    yield p.rows("isolated", len(lone), path=p.path.take(pa.array(lone)), file_name=p.name.take(pa.array(lone)))


def _isolated(p: Piece, heads: np.ndarray, tails: np.ndarray, file: np.ndarray) -> np.ndarray:
    """Files of six functions or more whose calls join them to two groups or more."""
    many = np.bincount(file, minlength=len(p.path))[file] >= 6
    heads, tails, file = heads[many], tails[many], file[many]
    if not len(heads):
        return np.array([], np.int64)
    names = p.column("name_fn_split")
    known = pc.drop_null(pc.unique(names))
    mine = pc.fill_null(pc.index_in(names, known), -1).to_numpy(zero_copy_only=False)[p.uid[heads]]
    owner = np.zeros(p.size + 1, np.int64)
    owner[heads] += np.arange(len(heads)) + 1
    np.subtract.at(owner, tails + 1, np.arange(len(heads)) + 1)
    owner = np.cumsum(owner)[:-1] - 1  # which function a line is in
    at, called = p.words("calls", known, np.flatnonzero(owner >= 0))
    there = np.unique(file * len(known) + mine)
    key = p.file[at] * len(known) + called
    good = (there[np.minimum(np.searchsorted(there, key), len(there) - 1)] == key) & (mine[owner[at]] != called)
    edges = np.unique(np.stack([p.file[at], mine[owner[at]], called], 1)[good], axis=0)
    out = []
    for f in np.unique(edges[:, 0]):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in edges[edges[:, 0].searchsorted(f) : edges[:, 0].searchsorted(f, "right"), 1:].tolist():
            parent[root(a)] = root(b)
        if sum(root(x) == x for x in list(parent)) >= 2:
            out.append(f)
    return np.array(out, np.int64)


# -- the order of events -----------------------------------------------------------------------------------


def _queries_in_loops(p: Piece, s: Settings) -> Iterator[pa.RecordBatch]:
    """Queries behind a loop's own line while its brackets are open."""
    starts, asks = p.where("loops"), p.where("queries")
    asks = asks[~p.lines("loops", False)[asks]]
    of = np.searchsorted(starts, asks) - 1
    good = of >= 0
    good[good] &= starts[of[good]] >= p.start[p.file[asks[good]]]
    asks, of = asks[good], of[good]
    net = p.lines("brackets").astype(np.int64)
    balance = np.cumsum(net)
    out = []
    for k in np.unique(of):
        mine = asks[of.searchsorted(k) : of.searchsorted(k, "right")]
        start = starts[k]
        begin = max(start, p.start[p.file[start]] + 1)  # a file's first line ends no loop
        ended = np.flatnonzero(balance[begin : mine[-1] + 1] <= balance[start] - net[start])
        out.append(mine if not len(ended) else mine[mine < begin + ended[0]])
    yield p.at_places("n_plus_one", np.concatenate(out) if out else asks)


def _logged_only(p: Piece, s: Settings) -> Iterator[pa.RecordBatch]:
    """Catch clauses whose lines, up to the first balanced one two lines or more behind, log and do nothing else."""
    starts = p.where("catches")
    file = p.file[starts]
    end = np.minimum(np.append(starts[1:], p.size)[: len(starts)], p.stop[file])
    close = p.at_level(file, p.depth[starts] - p.net[starts], starts + 2)
    good = close < end
    starts, close = starts[good], close[good]
    good = (_sums(p.lines("logs", False), starts + 1, close) > 0) & (_sums(p.lines("acts", False), starts + 1, close) == 0)
    yield p.at_places("catch_logs", starts[good])


def _todos(p: Piece, s: Settings) -> Iterator[pa.RecordBatch]:
    n = np.bincount(p.file, p.lines("todo", False), len(p.path))
    yield p.rows("todo", len(p.path), path=p.path, n=n, n_lines=p.n_lines)


def _walked(marks: str) -> tuple[int, int, int, int]:
    """What braces do to a depth d that never falls below 0: it ends as max(d + a, b), and gets as high as max(d + c, e)."""
    total = least = high = top = 0
    for c in marks:
        total += 1 if c == "{" else -1
        least = min(least, total)
        high, top = max(high, total), max(top, total - least)
    return total, total - least, high, top


def _nesting(p: Piece, s: Settings) -> Iterator[pa.RecordBatch]:
    """The first of the deepest lines of each file."""
    indents = p.lines("deep", -1)
    most = np.maximum.reduceat(indents, p.start)
    hit = np.flatnonzero((indents == most[p.file]) & (indents >= 0))
    files, first = np.unique(p.file[hit], return_index=True)
    yield p.at_places("nesting", hit[first], n=indents[hit[first]])
    told = {m: _walked(m) for m in pc.unique(p.column("braces")).to_pylist() if m}
    steps = [told.get(m) for m in p.column("braces").to_pylist()]
    at = np.flatnonzero(np.array([x is not None for x in steps])[p.uid])
    found: dict[int, tuple[int, int]] = {}
    now, depth, top = -1, 0, 0
    for place, f, u in zip(at.tolist(), p.file[at].tolist(), p.uid[at].tolist()):
        if f != now:
            now, depth, top = f, 0, 0
        a, b, c, e = steps[u]
        high = max(depth + c, e)
        if high > top:
            top = high
            found[f] = place, top
        depth = max(depth + a, b)
    yield p.at_places("nesting", np.array([x for x, _ in found.values()], np.int64), n=np.array([x for _, x in found.values()], np.int64))


# -- names that a file says again, and blocks that another file has --------------------------------------------


def _unused(p: Piece, s: Settings) -> Iterator[pa.RecordBatch]:
    kinds = {k: p.column(f"names_{k}") for k in UNUSED}
    known = pc.drop_null(pc.unique(pa.concat_arrays([c.flatten() for c in kinds.values()])))
    if not len(known):
        return
    at, word = p.words("words", known, np.flatnonzero(p.of_langs((*JS, "py"))[p.file]))
    key = p.file[at] * len(known) + word
    order = np.argsort(key, kind="stable")
    keys, first, n = np.unique(key[order], return_index=True, return_counts=True)
    begin, end = at[order[first]], at[order[first + n - 1]]
    for kind in UNUSED:
        places, name = p.words(f"names_{kind}", known, np.flatnonzero(pc.fill_null(pc.list_value_length(kinds[kind]), 0).to_numpy(zero_copy_only=False)[p.uid]))
        asked = p.file[places] * len(known) + name
        nth = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
        met = keys[nth] == asked if len(keys) else np.zeros(len(asked), bool)
        if kind == "var":
            dead = ~met | (n[nth] == 1) if len(keys) else ~met
        elif cross_rules.IMPORTS[kind][3]:
            dead = ~(met & ((begin[nth] != places) | (end[nth] != places))) if len(keys) else ~met
        else:
            dead = ~(met & (end[nth] > places)) if len(keys) else ~met
        places, name = places[dead], name[dead]
        file = p.file[places]
        nth = np.arange(len(places)) - np.searchsorted(file, file) + 1
        yield p.at_places(f"unused_{kind}", places, name=known.take(pa.array(name)), n=nth)


def _blocks(p: Piece, s: Settings) -> Iterator[pa.RecordBatch]:
    """A key for each text of some lines that follow each other, of which 4 are neither blank nor comments: its first place, and the last path that has it."""
    n = s.dup_window
    begin = np.arange(p.size - n + 1)
    if not len(begin):
        return
    good = p.of_langs(CODE) & (p.n_lines > 10)
    said = np.r_[0, np.cumsum(p.lines("code", False), dtype=np.int64)]
    begin = begin[good[p.file[begin]] & (p.file[begin] == p.file[begin + n - 1]) & (said[begin + n] - said[begin] >= 4)]
    if not len(begin):
        return
    halves = np.frombuffer(b"".join(p.column("digest").to_pylist()), "<u8").reshape(-1, 2)
    keys = []
    for half, step in ((0, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F)):
        values, key = halves[:, half][p.uid], np.zeros(len(begin), np.uint64)
        for k in range(n):
            key = key * np.uint64(step) + values[begin + k]
        keys.append(key.view(np.int64))
    rank, line = p.rank[p.file[begin]], p.line(begin)
    place = (rank << 32) + line
    order = np.lexsort((place, keys[1], keys[0]))
    a, b, place, rank = keys[0][order], keys[1][order], place[order], rank[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    last = np.r_[first[1:], len(a)] - 1
    every = pa.StructArray.from_arrays([pa.array(x) for x in (a[first], b[first], place[first], rank[last])], fields=list(_KEY))
    ends = np.r_[np.arange(0, len(first), _CHUNK), len(first)].astype(np.int32)
    yield p.rows("blocks", len(ends) - 1, keys=pa.ListArray.from_arrays(pa.array(ends), every))


# -- what rules ask for with ``Ordered.ask`` ----------------------------------------------------------------------


def _beside(p: Piece, kind: str, marks: dict[str, str], blocks: tuple[tuple[int, int], ...]) -> Iterator[pa.RecordBatch]:
    """Lines with the texts of the lines from ``first`` to ``last`` behind them: a row for each of these texts, with its places."""
    hits = p.where(marks["hit"])
    if not len(hits):
        return
    file = p.file[hits]
    bounds = [(np.maximum(hits + a, p.start[file]).tolist(), np.minimum(hits + b + 1, p.stop[file]).tolist()) for a, b in blocks]
    met: dict[tuple, list[int]] = {}
    for k, hit in enumerate(hits.tolist()):
        met.setdefault((p.uid[hit], *(p.uid[begin[k] : max(end[k], begin[k])].tobytes() for begin, end in bounds)), []).append(k)
    if not hasattr(p, "texts"):
        p.texts = p.column("text").to_pylist()
    bodies = [[p.texts[key[0]], *("\n".join([p.texts[u] for u in np.frombuffer(x, np.int64).tolist()]) for x in key[1:])] for key in met]
    every = hits[np.concatenate([np.array(ks) for ks in met.values()])]
    first = np.array([ks[0] for ks in met.values()])
    yield p.rows(kind, len(bodies), lang=p.lang.take(pa.array(file[first])), body=pa.array(bodies, pa.list_(pa.string())), places=p.places(every, [len(ks) for ks in met.values()]))


def _in_loop(p: Piece, kind: str, marks: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The first hit of each loop: a loop opens, and closes at what closes it or a hit."""
    opens, hits, closes = (p.lines(marks[n], False) for n in ("opens", "hits", "closes"))
    at = np.flatnonzero(opens | hits | closes)
    inside = ~(hits | closes)[at]
    before = np.r_[False, inside[:-1] & (p.file[at[1:]] == p.file[at[:-1]])] if len(at) else inside
    yield p.at_places(kind, at[hits[at] & (opens[at] | before)])


def _last_before(p: Piece, places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last of ``places`` before each place, in its file; -1 where there is none."""
    found = np.r_[-1, places][np.searchsorted(places, at)]
    return np.where(found >= p.start[p.file[at]], found, -1)


def _soon_after(p: Piece, kind: str, marks: dict[str, str], most: int) -> Iterator[pa.RecordBatch]:
    """Hits whose last line before is a named one, and at most some lines before."""
    hits = p.where(marks["hits"])
    last = _last_before(p, p.where(marks["before"]), hits)
    yield p.at_places(kind, hits[(last >= 0) & p.lines(marks["named"], False)[last] & (hits - last <= most)])


def _behind(p: Piece, kind: str, marks: dict[str, str]) -> Iterator[pa.RecordBatch]:
    hits = p.where(marks["hits"])
    yield p.at_places(kind, hits[_last_before(p, p.where(marks["before"]), hits) >= 0])


def _until(p: Piece, kind: str, marks: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Hits before the first line of their file that ends them, with their names."""
    hits = p.where(marks["hits"])
    hits = hits[(_last_before(p, p.where(marks["until"]), hits) < 0) & ~p.lines(marks["until"], False)[hits]]
    yield p.at_places(kind, hits, name=p.column(marks["name"]).take(pa.array(p.uid[hits])))


def _again(p: Piece, kind: str, marks: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Lines with a name that an earlier line of their file has."""
    at, name, names = p.named(marks["name"])
    _, first = np.unique(p.file[at] * max(len(names), 1) + name, return_index=True)
    more = np.ones(len(at), bool)
    more[first] = False
    yield p.at_places(kind, at[more], name=names.take(pa.array(name[more])))


def _runs(p: Piece, kind: str, marks: dict[str, str], least: int) -> Iterator[pa.RecordBatch]:
    """The first lines of runs of some hits or more."""
    at = p.where(marks["hits"])
    begins = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (p.file[at[1:]] != p.file[at[:-1]])]) if len(at) else at
    yield p.at_places(kind, at[begins[np.diff(np.r_[begins, len(at)]) >= least]])


def _counts(p: Piece, kind: str, marks: dict[str, str]) -> Iterator[pa.RecordBatch]:
    at = p.where(marks["hits"])
    _, first, n = np.unique(p.file[at], return_index=True, return_counts=True)
    yield p.at_places(kind, at[first], n=n)


def _every(p: Piece, kind: str, marks: dict[str, str], narrow: bool = False) -> Iterator[pa.RecordBatch]:
    """Hits, numbered in their file, of files that have a line ``also`` and none ``unless``; ``narrow``: and no very long lines."""
    good = ~p.wide if narrow else np.ones(len(p.path), bool)
    for mark, yes in (("also", True), ("unless", False)):
        if mark in marks:
            has = np.zeros(len(p.path), bool)
            has[p.file[p.where(marks[mark])]] = True
            good = good & (has == yes)
    at = p.where(marks["hits"])
    at = at[good[p.file[at]]]
    yield p.at_places(kind, at, n=np.arange(len(at)) - np.searchsorted(p.file[at], p.file[at]) + 1)


def _first(p: Piece, kind: str, marks: dict[str, str], narrow: bool = False) -> Iterator[pa.RecordBatch]:
    for rows in _every(p, kind, marks, narrow):
        yield rows.filter(pc.equal(rows["n"], 1))


def _named(p: Piece, kind: str, marks: dict[str, str]) -> Iterator[pa.RecordBatch]:
    at, name, names = p.named(marks["name"])
    yield p.at_places(kind, at, name=names.take(pa.array(name)), file_name=p.name.take(pa.array(p.file[at])))


def _first_places(p: Piece, kind: str, marks: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Each name once, where it is first in the order of paths and lines."""
    at, name, names = p.named(marks["name"])
    order = np.lexsort((at, p.rank[p.file[at]], name))
    _, first = np.unique(name[order], return_index=True)
    some = order[first]
    yield p.at_places(kind, at[some], name=names.take(pa.array(name[some])))


def _places(p: Piece, kind: str, marks: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Each name once, with its places."""
    at, name, names = p.named(marks["name"])
    order = np.argsort(name, kind="stable")
    met, n = np.unique(name, return_counts=True)
    yield p.rows(kind, len(met), name=names.take(pa.array(met)), places=p.places(at[order], n))


def _distinct(p: Piece, kind: str, marks: dict[str, str]) -> Iterator[pa.RecordBatch]:
    words = pc.drop_null(pc.unique(p.column(marks["words"]).flatten()))
    yield p.rows(kind, len(words), name=words)


def _values(p: Piece, kind: str, marks: dict[str, str], beyond: int = 0) -> Iterator[pa.RecordBatch]:
    """The words of files of more than some lines, each once for a file: how often it is there, and on which line first."""
    known = pc.drop_null(pc.unique(p.column(marks["words"]).flatten()))
    at, word = p.words(marks["words"], known, np.flatnonzero((p.n_lines > beyond)[p.file]))
    _, first, n = np.unique(p.file[at] * max(len(known), 1) + word, return_index=True, return_counts=True)
    yield p.at_places(kind, at[first], name=known.take(pa.array(word[first])), n=n, lang=p.lang.take(pa.array(p.file[at[first]])))


#: How rows are found.
WAYS = {
    "beside": _beside, "in_loop": _in_loop, "soon_after": _soon_after, "behind": _behind, "until": _until, "again": _again, "runs": _runs, "counts": _counts, "every": _every, "first": _first,
    "named": _named, "first_places": _first_places, "places": _places, "distinct": _distinct, "values": _values, "of_files": _values,
}


# -- the pass ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Kind:
    """A category's rows: SQL over ``lang`` and ``text`` for what is asked of a line, and what is made of it."""

    category: str
    marks: dict[str, str]
    made: Callable[[Piece, Settings], Iterator[pa.RecordBatch]]


def _number(mark: str) -> str:
    return f"length(text) - length(replace(text, '{mark}', ''))"


_BRACES = {"opens": f"CAST({_number('{')} AS INT)", "closes": f"CAST({_number('}')} AS INT)"}
_SPACES = f"length(text) - length({D.replace('text', r'^\s+', '')})"
_SAID = D.match("text", r"\S")
_HEADS = _BRACES | {"said": _SAID, "indent": f"CASE WHEN lang = 'py' AND text < '!' AND {_SAID} THEN {_SPACES} ELSE 0 END"}


def _function(table: str, **more: str) -> dict[str, str]:
    x = fns.EXTRACTORS[table]
    head = f"({D.any_of('lang', x.langs)} AND {fns.begins(x, 'text')})"
    return _HEADS | {f"is_{table}": head, f"name_{table}": f"CASE WHEN {head} THEN {fns._name(D, x, 'text')} END"} | {k: f"CASE WHEN {head} THEN {v} END" for k, v in more.items()}


def _unused_marks() -> dict[str, str]:
    pick = lambda langs, pattern, names, keep: f"WHEN {langs} AND {D.match('text', pattern)} THEN filter({names('text')}, x -> {keep})"
    one = {f"names_{k}": f"CASE {pick(D.any_of('lang', langs), pattern, names(D), cross_rules._IS_NAME)} END" for k, (langs, pattern, names, _) in cross_rules.IMPORTS.items()}
    var = " ".join(pick(*kind, cross_rules.is_variable(D)) for kind in cross_rules.variables(D))
    return one | {"names_var": f"CASE {var} END", "words": f"CASE WHEN {D.any_of('lang', (*JS, 'py'))} THEN {D.extract_all('text', cross_rules._WORDS)} END"}


UNUSED = (*cross_rules.IMPORTS, "var")
_COUNTS = f"({_SAID} AND NOT {D.match('text', fns._SKIPPED)})"
_NESTS = f"({_COUNTS} AND lang <> 'py' AND {D.match('text', fns._NEST)})"


def _adds() -> str:
    py, joins = fns.python_nesting(D, "text"), f"CASE WHEN {D.match('text', '&&|[|][|]')} THEN 1 ELSE 0 END"
    other = f"{joins} + CASE WHEN NOT {_NESTS} AND {D.match('text', r'\belse\b')} THEN 1 ELSE 0 END"
    return f"CAST(CASE WHEN NOT {_COUNTS} THEN 0 WHEN lang = 'py' THEN {py} ELSE {other} END AS INT)"


def _asked(how: str, kind: str, names: dict[str, str], more: dict, p: Piece, s: Settings) -> Iterator[pa.RecordBatch]:
    return WAYS[how](p, kind, names, **more)


def kinds(rules: dict[str, Callable[[Ordered], str]], wants: Callable[[str], bool]) -> list[Kind]:
    """The kinds of rows of the categories that are wanted, and those that ``rules`` ask for."""
    d = Ordered()
    for select in rules.values():
        select(d)
    asked = []
    for kind, (how, marks, more) in d.asked.items():
        names = {n: f"{kind}_{n}" for n in marks}
        asked.append(Kind("", {names[n]: v for n, v in marks.items()}, partial(_asked, how, kind, names, more)))
    return [k for k in _own() if wants(k.category)] + asked


def _own() -> list[Kind]:
    cc, cog = fns.EXTRACTORS["fn_cc"], fns.EXTRACTORS["fn_cog"]
    plist = fns._plist(D, fns.EXTRACTORS["fn_smell"], "text")
    return [
        Kind("smells", _function("fn_smell", plist=plist), _smell),
        Kind("smells", {"deep": f"CASE WHEN lang = 'py' AND {_SAID} AND NOT {D.match('text', r'^\s*#')} THEN ({_SPACES}) div 4 END", "braces": f"CASE WHEN lang <> 'py' AND (contains(text, '{{') OR contains(text, '}}')) AND NOT {D.match('text', r'^\s*//|^\s*\*')} THEN {D.replace('text', r'[^{}]', '')} END"}, _nesting),
        Kind("cyclomatic", _function("fn_cc") | {"decisions": f"CASE WHEN {D.any_of('lang', cc.langs)} THEN {fns._decisions(D, 'text')} END"}, _cyclomatic),
        Kind("cognitive", _function("fn_cog") | {"nests": _NESTS, "adds": _adds(), "fall": f"CAST(CASE WHEN {_COUNTS} AND lang <> 'py' AND {D.any_of('lang', cog.langs)} THEN greatest(0, {_number('}')} - ({_number('{')})) ELSE 0 END AS INT)"}, _cognitive),
        Kind("duplicates", _function("fn_body"), _shapes),
        Kind("duplicates", {"code": f"({cross_rules.is_code(D, 'text')})", "digest": "unhex(md5(text))"}, _blocks),
        Kind("split", _function("fn_split", sig=f"substring({D.trim('text')}, 1, 80)") | {"calls": f"CASE WHEN contains(text, '(') THEN array_distinct({D.extract_all('text', r'\b(\w+)\s*[(]')}) END"}, _split),
        Kind("patterns", {"loops": D.match("text", fns._LOOPS), "queries": D.match("text", fns._ORM), "brackets": "CAST(length(translate(text, '})', '')) - length(translate(text, '{(', '')) AS INT)"}, _queries_in_loops),
        Kind("patterns", {"todo": D.match("text", context_rules.MARKED)}, _todos),
        Kind("errors", _BRACES | {"catches": f"({D.any_of('lang', JS)} AND {D.match('text', fns._CATCH)})", "logs": D.match("text", fns._LOGS), "acts": D.match("text", fns._ACTS)}, _logged_only),
        Kind("dead", _unused_marks(), _unused),
    ]


def _found(made: list[Callable], s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for piece in _gathered(batches):
                for make in made:
                    for rows in make(piece, s):
                        if rows.num_rows:
                            yield rows

    return run


def found(spark: SparkSession, files: str, s: Settings, wanted: list[Kind]) -> DataFrame:
    """Rows of ``SCHEMA``. ``files``: SQL of path, name, lang, n_lines, rank (paths in order) and content."""
    told = f"told_{repeats.fresh()}"
    spark.sql(files).mapInArrow(_told(_PIECES * repeats.PIECE_BYTES), _FILES_DDL).createOrReplaceTempView(told)
    marks = {k: v for kind in wanted for k, v in kind.marks.items()}
    rows = f"SELECT head, n, lang, text, at, {', '.join(f'{v} AS {k}' for k, v in marks.items())} FROM (SELECT *, false AS wide, lower(text) AS low FROM {told})"
    if "plist" in marks:
        rows = f"SELECT *, {fns._n_params(D)} AS params FROM ({rows})"
    return spark.sql(rows).mapInArrow(_found([k.made for k in wanted], s), SCHEMA)


#: The tables that rules read, over the rows.
VIEWS = {
    "functions_smell": "SELECT path, lang, name, params, line AS head, tail, file_name, n_lines FROM {rows} WHERE kind = 'fn_smell'",
    "functions_cc": "SELECT path, lang, name, line AS head, tail, n FROM {rows} WHERE kind = 'fn_cc'",
    "functions_cog": "SELECT path, lang, name, line AS head, tail, n AS score FROM {rows} WHERE kind = 'fn_cog'",
    "functions_split": "SELECT path, name, file_name, n_lines, n FROM {rows} WHERE kind = 'fn_split'",
    "functions_long": "SELECT lang, name, sig, body, places FROM {rows} WHERE kind = 'fn_long'",
    "functions_body": "SELECT lang, name, body, places FROM {rows} WHERE kind = 'fn_body'",
    "ordered": "SELECT kind, path, file_name, lang, name, line, n, n_lines, body, places, keys FROM {rows}",
}
