"""Texts that every match of a regular expression contains: a cheap test before the expression itself is tried."""

from __future__ import annotations

import re
import warnings

from lintlake.functions.dialect import Dialect

try:
    from re import _constants as op
    from re import _parser as parser
except ImportError:  # without the parser of the standard library no pattern has a test before it
    op = parser = None


def required(pattern: str) -> frozenset[str] | None:
    """Texts in lower case, at least one of which is in every match (in lower case); None where there is none to tell."""
    if parser is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _of(parser.parse(pattern))
    except (re.error, RecursionError):  # what only the engine itself reads
        return None


def _of(items) -> frozenset[str] | None:
    """The best of the texts that the parts of a sequence need: those whose shortest is the longest."""
    found: list[frozenset[str]] = []
    run = ""
    for kind, value in [*items, (None, None)]:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        inner = None
        if kind is op.SUBPATTERN:
            inner = _of(value[-1])
        elif kind is op.BRANCH:
            each = [_of(x) for x in value[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            inner = _of(value[2])
        if inner:
            found.append(inner)
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def needed(d: Dialect, pattern: str, low: str = "low") -> str:
    """SQL for the test on a text in lower case; empty where the pattern has none."""
    texts = required(pattern)
    return f"({' OR '.join(d.contains(low, t) for t in sorted(texts))})" if texts else ""
