"""Bounded-space online packing of token sequences, in the order in which tasks read them.

A task keeps at most ``OPEN`` windows open. What a text has beyond whole windows goes into the open window that it fills
best. When it fits none and no further window may be opened, the fullest is emitted, after taking the head of the text
for what it still lacks; the tail is placed anew. A window that is full is emitted at once. So every emitted window is
whole, and a text is cut only where it is longer than a window or tops one up.

The windows that are open at the end of a task are merged in rounds: ``FAN`` tasks make a group, whose pieces are packed
in the same way, then laid end to end; what is left, less than a window, goes on to the next round as one of ``FAN`` again,
and a round has as many rows in a group however large the input is. The last rest is cut at powers of two, the
lengths that need no padding.

Ids come from the tokenizers library for each distinct stretch, once. Stretches end at ASCII white space and where an
ASCII letter, digit or other mark stands next to one of another kind (or a digit next to a digit), but not behind an
apostrophe. The tokenizer file must be one that drops white space, lower-cases, and looks at nothing across such places
(``WordCodec`` checks that on a sample of texts).

Cases: a null or empty text is one piece, its end; repeated rows and ids are packed each on their own; ties in fit go to
the window opened first; texts of any length are handled whole; an empty table gives an empty table; columns besides the
id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lintlake.llm.bytesets import LOWER, SPACE, column, slices
from lintlake.llm.periodic import numbered
from lintlake.llm.storage import bounded, kept

#: Windows that a task keeps open, and tasks whose open windows are merged at once.
OPEN, FAN = 32, 16
#: Stretches whose ids are remembered, and the bytes of the longest; words that are encoded in one line.
SEEN, LONGEST, LINE = 1 << 18, 64, 512
#: Bytes of text whose stretches are numbered at once, about.
STEP_BYTES = 1 << 22
#: What is one word to any tokenizer that keeps letters together: letters of ASCII and Latin-1, each one character.
_WORD = re.compile(r"[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


#: Kinds of bytes: 1 letters, 2 digits, 3 other ASCII, 0 what is not ASCII.
KIND = np.array([1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(128)] + [0] * 128, np.uint8)


def stretches(buf: np.ndarray, starts: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all stretches end to end, their sizes, and where each row's begin; ``whole``: ended by white space alone.

    A letter A-Z is lower-cased unless a byte that is not ASCII follows, which might compose with it.
    """
    solid, kind = ~SPACE[buf], KIND[buf]
    after = np.zeros(len(buf), bool)
    after[:-1] = kind[1:] == 0
    after[starts[1:][starts[1:] > 0] - 1] = False  # what follows a row's last byte is another row
    low = np.where(after, buf, LOWER[buf])
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    if not whole:
        a, b = kind[:-1], kind[1:]
        begin[1:] |= solid[1:] & solid[:-1] & (a > 0) & (b > 0) & ((a != b) | (b == 2)) & (buf[:-1] != ord("'"))
    edge = starts[:-1][starts[:-1] < len(buf)]
    begin[edge] = solid[edge]
    place = np.flatnonzero(begin)
    inside = np.r_[0, np.cumsum(solid)]
    return low[solid], np.diff(np.r_[inside[place], inside[-1]]), np.searchsorted(place, starts)


class WordCodec:
    """Ids of texts by a tokenizer that drops white space: those of each stretch, one after another."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.seen: dict[bytes, list[int]] = {}
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix") or "\n"
        self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(suffix)]] = True
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        sample = "It's DON'T\t15.5x (a_b)--c\n 'tis \"'s 2nd E\u0301H\u0331 stra\u00dfe9, x"
        ids, _ = self.encode(np.frombuffer(sample.encode(), np.uint8), np.array([0, len(sample.encode())]))
        if ids.tolist() != self.library.encode(sample, add_special_tokens=False).ids:
            raise ValueError("the ids of a text are not those of its stretches with this tokenizer")

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of each of some stretches. Plain words go to the library in lines, whose ids are parted at word ends."""
        batch = functools.partial(self.library.encode_batch_fast, add_special_tokens=False)
        out: list[list[int] | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if _WORD.fullmatch(t)]
        lines = [plain[at : at + LINE] for at in range(0, len(plain), LINE)]
        for some, line in zip(lines, batch([" ".join([texts[k] for k in some]) for some in lines]), strict=True):
            ids = line.ids
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(some) and ends[-1] == len(ids):  # else they are encoded one by one
                for k, a, b in zip(some, [0, *ends], ends, strict=False):
                    out[k] = ids[a:b]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, batch([texts[k] for k in rest]), strict=True):
            out[k] = e.ids
        return out

    def encode(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's begin."""
        data = buf.tobytes()
        solid, sizes, first = stretches(buf, starts, any(x in data for x in self.special))
        codes, names = numbered(solid, sizes)
        found = [self.seen.get(x) for x in names]
        missing = [k for k, x in enumerate(found) if x is None]
        for k, ids in zip(missing, self._ids([names[k].decode() for k in missing]), strict=True):
            found[k] = ids
            if len(names[k]) <= LONGEST:
                self.seen[names[k]] = ids
        if len(self.seen) > SEEN:
            self.seen.clear()
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum()))
        n = size[codes]
        ends = np.r_[0, np.cumsum(n)]
        begin = (np.cumsum(size) - size)[codes]
        return flat[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])], ends[first]


@functools.lru_cache(2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


@dataclass(eq=False)
class Piece:
    owner: object
    start: int
    ids: np.ndarray
    #: Ids of the whole document.
    whole: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.owner, self.start, self.ids[:at], self.whole), Piece(self.owner, self.start + at, self.ids[at:], self.whole)


@dataclass(eq=False)
class Window:
    pieces: list[Piece] = field(default_factory=list)
    used: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += len(piece.ids)


class Windows:
    """At most ``most`` open windows of ``size`` tokens."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.open: list[Window] = []

    def put(self, piece: Piece) -> Iterator[Window]:
        """Place a piece; the windows that are full by it."""
        while len(piece.ids) >= self.size:
            head, piece = piece.cut(self.size)
            yield Window([head], self.size)
        while len(piece.ids):
            n = len(piece.ids)
            fits = [w for w in self.open if w.used + n <= self.size]
            if fits:
                best = max(fits, key=lambda w: w.used)
                best.add(piece)
                if best.used == self.size:
                    self.open.remove(best)
                    yield best
                return
            if len(self.open) < self.most:
                self.open.append(Window([piece], n))
                return
            fullest = max(self.open, key=lambda w: w.used)
            head, piece = piece.cut(self.size - fullest.used)
            fullest.add(head)
            self.open.remove(fullest)
            yield fullest

    def rest(self) -> Iterator[Window]:
        """All that is open laid end to end, the fullest first; the last window may not be full."""
        last = Window()
        for piece in [p for w in sorted(self.open, key=lambda w: -w.used) for p in w.pieces]:
            while last.used + len(piece.ids) >= self.size:
                head, piece = piece.cut(self.size - last.used)
                last.add(head)
                yield last
                last = Window()
            if len(piece.ids):
                last.add(piece)
        self.open = []
        if last.used:
            yield last


def powers(window: Window) -> Iterator[Window]:
    """A window as windows whose lengths are powers of two, the largest first."""
    pieces = window.pieces[::-1]
    left = window.used
    while left:
        size = 1 << (left.bit_length() - 1)
        out = Window()
        while out.used < size:
            piece = pieces.pop()
            if out.used + len(piece.ids) > size:
                piece, tail = piece.cut(size - out.used)
                pieces.append(tail)
            out.add(piece)
        yield out
        left -= size


NAMES = ("owner", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "unit", "ids")


def _rows(windows: list[tuple[Window, int | None]], unit: int, kind: pa.DataType) -> list[pa.Array]:
    """The pieces of windows with their sequences; those of a window without a sequence keep their ids."""
    flat = [(p, s, at) for w, s in windows for p, at in zip(w.pieces, np.cumsum([0, *(len(p.ids) for p in w.pieces)]).tolist(), strict=False)]
    data = [np.ascontiguousarray(p.ids, "<u4").tobytes() for p, _, _ in flat]
    longs = [p.start for p, _, _ in flat], [len(p.ids) for p, _, _ in flat], [zlib.crc32(d) for d in data], [p.whole for p, _, _ in flat], [s for _, s, _ in flat], [at for _, _, at in flat], [unit] * len(flat)
    return [pa.array([p.owner for p, _, _ in flat], kind), *(pa.array(x, pa.int64()) for x in longs), pa.array([d if s is None else None for d, (_, s, _) in zip(data, flat, strict=True)], pa.binary())]


def _read(tokenizer: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, windows, task = word_codec(tokenizer), Windows(size, OPEN), TaskContext.get().partitionId()
        made, kind = 0, None
        for batch in batches:
            kind = batch["owner"].type
            buf, starts = column(batch["text"])
            for a, b in slices(starts, STEP_BYTES):
                ids, first = coder.encode(buf[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                full: list[tuple[Window, int | None]] = []
                for k, owner in enumerate(batch["owner"].slice(a, b - a).to_pylist()):
                    mine = np.append(ids[first[k] : first[k + 1]], np.uint32(end_id))
                    for w in windows.put(Piece(owner, 0, mine, len(mine))):
                        full.append((w, (task << 32) + made))
                        made += 1
                yield pa.RecordBatch.from_arrays(_rows(full, task, kind), list(NAMES))
        if kind is not None:
            yield pa.RecordBatch.from_arrays(_rows([(w, None) for w in windows.open], task, kind), list(NAMES))

    return run


def _merge(size: int, stage: int, last: bool):
    """Pieces of the open windows of some units as full windows, and one rest for the next round."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("unit", "ascending")])  # rows of a unit stay as they are: any order packs as well
        group = table["unit"][0].as_py() // FAN
        windows = Windows(size, OPEN)
        full: list[Window] = []
        for owner, start, whole, ids in zip(*(table[c].to_pylist() for c in ("owner", "start", "doc_tokens", "ids")), strict=True):
            full += windows.put(Piece(owner, start, np.frombuffer(ids, "<u4"), whole))
        full += windows.rest()
        rest = full.pop() if full and full[-1].used < size else None
        if rest and last:
            full += powers(rest)
            rest = None
        numbered: list[tuple[Window, int | None]] = [(w, (stage << 56) + (group << 32) + k) for k, w in enumerate(full)]
        return pa.Table.from_arrays(_rows(numbered + ([(rest, None)] if rest else []), group, table["owner"].type), list(NAMES))

    return run


def pack_online(df: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of each piece of every row."""
    source = bounded(df).select(F.col(id_col).alias("owner"), F.col(text_col).alias("text"))
    schema = f"owner {source.schema['owner'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in NAMES[1:-1]) + ", ids binary"
    part = kept(source.mapInArrow(_read(tokenizer, size, end_id), schema), "windows")
    parts, stage = [part], 1
    units = (part.agg(F.max("unit")).first()[0] or 0) + 1
    while True:
        left = part.where("sequence_id IS NULL").groupBy(F.floor(F.col("unit") / FAN).alias("group"))
        part = kept(left.applyInArrow(_merge(size, stage, units <= FAN), schema), "windows")
        parts.append(part)
        if units <= FAN:
            break
        units, stage = -(-units // FAN), stage + 1
    every = functools.reduce(DataFrame.unionByName, [p.where("sequence_id IS NOT NULL").drop("unit", "ids") for p in parts])
    return every.withColumnRenamed("owner", id_col)
