"""Functions of files in one pass: Spark SQL over a file's own array of lines.

A file is one row and stays one. What all extractors share is worked out once for a file (``shaped``): the depth of braces
behind each line, the lines that open one, and in Python the indent of each line with text. A head then asks only for the
first line behind it that closes it, in the next few lines and then in all that are left to look at. For braces, a head
closes at the first line, its own or later, where the depth is again what it was before the head and a brace was opened
since, within ``reach`` lines; else it ends ``fallback`` lines on, or with the file. In Python a head closes before the
next line that is indented no deeper. A fold over the heads leaves out those that begin inside a span that was taken.
Nothing is shuffled and no file is read twice.

Spark copies what a fold has so far at every step. So a fold holds numbers alone: a span is one number, its first line
times 2**32 and its last line; names are read from the lines when the spans are known.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from lintlake.functions.dialect import SPARK as D

if TYPE_CHECKING:
    from lintlake.operators.function_rules import Extractor

_OPEN = "ARRAY<STRUCT<head: BIGINT, level: BIGINT, begun: BOOLEAN>>"


def number(mark: str, text: str = "t") -> str:
    return f"CAST(length({text}) - length(replace({text}, '{mark}', '')) AS BIGINT)"


def _span(head: str, tail: str) -> str:
    return f"(shiftleft(CAST({head} AS BIGINT), 32) + CAST({tail} AS BIGINT))"


def head_of(span: str) -> str:
    return f"shiftright({span}, 32)"


def tail_of(span: str) -> str:
    return f"({span} & 4294967295L)"


def _start(first: str) -> str:
    return f"CAST(named_struct('{first}', 0, 'open', array(), 'done', array()) AS STRUCT<{first}: BIGINT, open: {_OPEN}, done: ARRAY<BIGINT>>)"


def by_braces(events: str, reach: int, otherwise: str) -> str:
    """Spans of all heads of ``events`` (line, opens, closes, fn: whether it is a head). ``otherwise``: the last line of a head p that is not closed in reach."""
    depth = "(a.depth + e.opens - e.closes)"
    open_ = f"(CASE WHEN e.fn THEN concat(a.open, array({D.struct(head='e.line', level='a.depth', begun='false')})) ELSE a.open END)"
    late = f"e.line - p.head >= {reach}"
    gone = f"(({late}) OR ((p.begun OR e.opens > 0) AND p.level = {depth}))"
    stay = D.transform(D.filter(open_, "p", f"NOT {gone}"), "p", D.struct(head="p.head", level="p.level", begun="p.begun OR e.opens > 0"))
    closed = D.transform(D.filter(open_, "p", gone), "p", _span("p.head", f"CASE WHEN {late} THEN {otherwise} ELSE e.line END"))
    after = D.struct(depth=depth, open=stay, done=f"CASE WHEN exists({open_}, p -> {gone}) THEN concat(a.done, {closed}) ELSE a.done END")
    idle = D.struct(depth=depth, open="a.open", done="a.done")
    step = f"CASE WHEN e.fn OR size(a.open) > 0 THEN {after} ELSE {idle} END"
    return f"aggregate({events}, {_start('depth')}, (a, e) -> {step}, a -> concat(a.done, {D.transform('a.open', 'p', _span('p.head', otherwise))}))"


#: Lines that are looked at first for the end of a function, before all others.
_NEAR = 24
#: Lines whose depths are summed in one fold.
_BLOCK = 64


def depths(nets: str) -> str:
    """The running sums of an array of numbers: in blocks, as a fold copies what it has at every step."""
    within = f"transform(sequence(0, (size({nets}) - 1) div {_BLOCK}), b -> aggregate(slice({nets}, b * {_BLOCK} + 1, {_BLOCK}), array(0), (a, x) -> concat(a, array(get(a, size(a) - 1) + x))))"
    before = "aggregate(ws, array(0), (a, w) -> concat(a, array(get(a, size(a) - 1) + get(w, size(w) - 1))))"
    return D.let("ws", within, D.let("bs", before, "flatten(transform(ws, (w, b) -> transform(slice(w, 2, size(w) - 1), x -> x + get(bs, b))))"))


def _place(made: Callable[[str], str], begin: str, most: str) -> str:
    """The place, from 0 on, of what ``made`` finds behind ``begin`` (a place from 1 on) in a stretch of an array; null if it is not in ``most`` places."""
    near = f"nullif({made(f'{begin}, least({_NEAR}, {most})')}, 0)"
    return f"coalesce({near}, CASE WHEN {most} > {_NEAR} THEN nullif({made(f'{begin}, {most}')}, 0) END)"


def _brace_tail(h: str, x: Extractor) -> str:
    """The last line of a head at place h (from 0 on)."""
    left = lambda p: f"least({x.reach} + {h} - {p}, size(ls) - {p})"
    first = f"{h} - 1 + {_place(lambda s: f'array_position(slice(opened, {s}), true)', f'{h} + 1', left(h))}"
    level = f"coalesce(get(depths, {h} - 1), 0)"
    close = f"CAST(f_ + {_place(lambda s: f'array_position(slice(depths, {s}), {level})', 'f_ + 1', left('f_'))} AS BIGINT)"
    return f"coalesce({D.let('f_', f'CAST({first} AS INT)', f'CASE WHEN f_ IS NOT NULL THEN {close} END')}, least(n_lines, {h} + 1 + {x.fallback}))"


def _indent_tail(h: str, x: Extractor) -> str:
    low = lambda s: f"array_position(transform(slice(indents, {s}), y -> y <= get(indents, {h})), true)"
    return f"CAST(coalesce({h} + {_place(low, f'{h} + 2', f'(size(ls) - {h} - 1)')}, {'n_lines' if x.blanks else 'n_said'}) AS BIGINT)"


def found(x: Extractor, begins: str, least: str) -> str:
    """The spans that an extractor takes in a row of ``shaped``, by head; ``begins``: whether a line t is a head."""
    places = f"filter(transform(ls, (t, i) -> CASE WHEN {begins} THEN i END), h -> h IS NOT NULL)"
    tail = f"CASE WHEN lang = 'py' THEN {_indent_tail('h', x)} ELSE {_brace_tail('h', x)} END"
    wanted = f"z - h - 1 >= {least}"
    every = f"filter(transform({places}, h -> {D.let('z', tail, f'CASE WHEN {wanted} THEN {_span("h + 1", "z")} END')}), s -> s IS NOT NULL)"
    taken = D.struct(last="z", taken=f"concat(a.taken, array({_span('h + 1', 'z')}))")
    # a head inside a span that was taken is not asked for its end
    step = f"CASE WHEN h + 1 > a.last THEN {D.let('z', tail, f'CASE WHEN {wanted} THEN {taken} ELSE a END')} ELSE a END"
    disjoint = f"aggregate({places}, CAST(named_struct('last', 0, 'taken', array()) AS STRUCT<last: BIGINT, taken: ARRAY<BIGINT>>), (a, h) -> {step}, a -> a.taken)"
    return f"CASE WHEN lang = 'py' THEN {every} ELSE {disjoint} END" if x.nested else disjoint


def shaped(langs: tuple[str, ...]) -> str:
    """A row for each file with its lines as an array, and what heads are closed by: ``depths`` behind each line and whether
    it ``opened`` a brace; in Python ``indents`` of lines with text and the last one of them, ``n_said``."""
    # a text from '!' on begins with a letter or sign; what comes before that is white space, or a control character
    indent = f"CASE WHEN t >= '!' THEN 0 WHEN {D.match('t', r'\S')} THEN length(t) - length({D.replace('t', r'^\s+', '')}) END"
    net = f"CASE WHEN contains(t, '{{') OR contains(t, '}}') THEN CAST({number('{')} - {number('}')} AS INT) ELSE 0 END"
    split = f"SELECT path, name AS file_name, lang, CAST(lines AS BIGINT) AS n_lines, {D.split_lines('content')} AS ls FROM files WHERE {D.any_of('lang', langs)}"
    counted = f"SELECT *, CASE WHEN lang = 'py' THEN transform(ls, t -> {indent}) END AS indents, CASE WHEN lang <> 'py' THEN transform(ls, t -> {net}) END AS nets, CASE WHEN lang <> 'py' THEN transform(ls, t -> contains(t, '{{')) END AS opened FROM ({split})"
    said = "array_max(transform(indents, (y, i) -> CASE WHEN y IS NOT NULL THEN i + 1 END))"
    return f"(SELECT path, file_name, lang, n_lines, ls, indents, opened, {depths('nets')} AS depths, CAST({said} AS BIGINT) AS n_said FROM ({counted}))"
