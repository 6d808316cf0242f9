"""Rules on functions: where each begins and ends, and what is measured on its lines. SQL in either dialect.

``EXTRACTORS`` names the tables ``fn_*`` that ``with_spans`` puts before a query: path, lang, name, sig, plist, params,
head, tail (lines, both inclusive). Spark finds them, and what is measured on them, in the row of their file (``spans``).

The checking SQL goes another way: a function's last line is found by windows over all lines. For braces, it is the first
line at or behind its first ``{`` whose running depth is the depth before the head (events of one depth, latest first,
carry the least line seen); for Python, the line before the next one that is indented no deeper. Depths that never
fall below zero are running sums less their least value. Which of the heads open a function (one inside the last one
taken does not) is a recursion over the heads of a file.

Null or empty contents have no lines and so no functions; a head without a closing brace ends after a fixed number of
lines or with its file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from lintlake.functions.dialect import SPARK, Dialect, Ordered
from lintlake.functions.literals import needed
from lintlake.model import CODE, COMPLEX, JS, Settings
from lintlake.operators import spans as folds
from lintlake.operators.cross_rules import covered

# How functions begin (name and parameters by group), what counts as a decision, and word lists.
_PY_DEF = r"^\s*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)"
_PY_CLOSED = r"^\s*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)"
_JS_FN = r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(|^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?"
_JS_ANY = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s+(\w+)\s*\(([^)]*)\)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?([^)=]*)\)?\s*=>|(\w+)\s*\(([^)]*)\)\s*\{)"
_JS_CLOSED = r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)"
_C_FN = r"^\s*(?:public|private|protected|static|override|virtual|async|func|fn|def)?\s*\w[\w<>\[\]]*\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+\w+\s*)?\{?\s*$"
_OTHER_CC = r"^\s*(?:public|private|protected|static|override|func|fn|def|fun|sub|procedure)[\w\s<>\[\]*&?]*\s+(\w+)\s*\("
_OTHER_COG = r"^\s*(?:public|private|protected|static|override|func|fn|def|fun)[\w\s<>\[\]*&?]*\s+(\w+)\s*\("
_OTHER_SPLIT = r"^\s*(?:public|private|protected|func|fn|def|fun)\s+(?:[\w<>\[\]?]+\s+)?(\w+)\s*\("
_CALLED = (_C_FN, _OTHER_CC, _OTHER_COG, _OTHER_SPLIT)
_CONTROL = ("if", "for", "while", "switch", "catch", "foreach", "do", "else", "return", "with")
_NOT_C = r"\b(?:if|for|while|switch|catch|foreach)\b"
_DECISION = r"\b(?:if|else\s+if|elif|for|while|do|case|catch|&&|\|\|)"
_KEYWORDS = ("const", "let", "var", "def", "return", "if", "else", "for", "while", "function", "import", "from", "async", "await", "true", "false", "null", "undefined", "self", "this")
_ORM = r"\.filter\s*\(|\.get\s*\(|\.find\s*\(|\.findOne\s*\(|\.query\s*\(|\.execute\s*\(|\.fetch\s*\(|\.select\s*\(|\.objects\.|Model\.|db\.session\."
_LOOPS = r"^\s*for\s|^\s*while\s|\.forEach\s*\(|\.map\s*\(|\.filter\s*\(.*=>"
_NEST = r"\b(?:if|else\s*if|for|while|do|switch|try|catch)\b"
_PY_NEST = r"^\s*(?:if|for|while|with|try|except|elif|else)\b"
_SKIPPED = r"^\s*(?://|#|\*)"
_BRACE_LOOP = r"(?i)^\s*(?:for|while|foreach)\s*[(\s]"
_CATCH, _LOGS, _ACTS = r"\}\s*catch\s*\(", r"console[.](?:log|warn)\s*[(]", "throw|reject|return"
_HEADING = r"\s*(?:step\s*\d*[:.]\s*|phase\s*\d*[:.]\s*|[-─=*]{2,}\s*)?.{4,50}"
_SLASHED = ("js", "ts", "jsx", "tsx", "go", "java", "cs", "kt", "rs")
_CLIKE = ("java", "cs", "kt", "go", "rs", "cpp", "c", "php", "rb")
_LEVELS_CC = ((25, "high", "untestable"), (15, "medium", "complex"), (0, "low", "moderate"))
_LEVELS_COG = ((30, "high", "very hard to understand"), (20, "medium", "hard to understand"), (0, "low", "moderately complex"))


@dataclass(frozen=True)
class Extractor:
    """Patterns of heads by language, how far a closing brace is looked for, and which spans count."""

    langs: tuple[str, ...]
    python: str
    js: str
    other: str
    reach: int
    fallback: int
    #: Lines that a span must go beyond its head; a head with a shorter one opens no function.
    beyond: int
    #: Shortest name.
    letters: int = 1
    #: Whether a Python function that ends with the file has the blank lines there.
    blanks: bool = True
    #: Whether functions inside functions count in Python.
    nested: bool = False


EXTRACTORS = {
    "fn_smell": Extractor((*JS, "py", *_CLIKE), _PY_CLOSED, _JS_ANY, _C_FN, 500, 100, 0, blanks=False, nested=True),
    "fn_cc": Extractor(COMPLEX, _PY_DEF, _JS_FN, _OTHER_CC, 500, 80, 4, 2),
    "fn_cog": Extractor(CODE, _PY_DEF, _JS_FN, _OTHER_COG, 500, 80, 4, 2),
    "fn_split": Extractor(CODE, _PY_DEF, _JS_FN, _OTHER_SPLIT, 400, 80, 0),
    "fn_body": Extractor(CODE, _PY_CLOSED, _JS_CLOSED, _JS_CLOSED, 300, 50, 5, blanks=False),
}


def _first(d: Dialect, pattern: str, groups: tuple[int, ...], col: str = "text") -> str:
    found = [f"nullif({d.extract(col, pattern, g)}, '')" for g in groups]
    return f"coalesce({', '.join([*found, d.lit('')])})"


def _by_lang(d: Dialect, python: str, js: str, other: str) -> str:
    return f"CASE WHEN lang = 'py' THEN {python} WHEN {d.any_of('lang', JS)} THEN {js} ELSE {other} END"


def _braces(d: Dialect, langs: tuple[str, ...]) -> str:
    """Lines with counts of braces, the running depth, and the next line that opens one."""
    counted = f"(SELECT path, lang, line, text, {d.count('text', '[{]')} AS opens, {d.count('text', '[}]')} AS closes FROM lines WHERE {d.any_of('lang', langs)})"
    running = "sum(opens - closes) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"(SELECT *, CAST({running} AS BIGINT) AS depth, {_next_line('opens > 0')} AS first_open FROM {counted})"


def _next_line(condition: str, keys: str = "path", order: str = "line DESC", value: str = "line") -> str:
    """The least line of this row and those behind it that meets a condition."""
    return f"min(CASE WHEN {condition} THEN {value} END) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _closed(heads: str, braces: str, columns: str) -> str:
    """``heads`` (path, line, depth, opens, closes, first_open, ...) with ``close``: where their first brace closes."""
    asked = f"SELECT path, depth - opens + closes AS level, first_open AS spot, 0 AS is_line, line, {columns} FROM {heads}"
    nothing = ", ".join(f"NULL AS {c.strip()}" for c in columns.split(","))
    ends = f"SELECT path, depth AS level, line AS spot, 1 AS is_line, line, {nothing} FROM {braces} WHERE opens + closes > 0"
    seen = _next_line("is_line = 1", "path, level", "spot DESC, is_line DESC", "spot")
    return f"(SELECT path, line, {columns}, close FROM (SELECT *, {seen} AS close FROM ({asked} UNION ALL {ends}) WHERE spot IS NOT NULL) WHERE is_line = 0 UNION ALL SELECT path, line, {columns}, NULL AS close FROM {heads} WHERE first_open IS NULL)"


def heads(d: Dialect, x: Extractor, braces: str) -> str:
    """Lines that may begin a function."""
    name, listed = _name(d, x, "text"), _plist(d, x, "text")
    keep = f"length(name) >= {x.letters}"
    if x.js == _JS_ANY:
        keep += f" AND NOT ({d.any_of('lang', JS)} AND {d.any_of('name', _CONTROL)}) AND NOT ({d.any_of('lang', _CLIKE)} AND {d.match('text', _NOT_C)})"
    indent = f"length(text) - length({d.replace('text', r'^\s+', '')})"
    sig = f"substring({d.trim('text')}, 1, 80)"
    return f"(SELECT path, lang, line, depth, opens, closes, first_open, name, {sig} AS sig, plist, {indent} AS indent FROM (SELECT *, {name} AS name, {listed} AS plist FROM {braces}) WHERE {keep})"


def _n_params(d: Dialect) -> str:
    """Pieces of plist between commas that are not blank; in Python neither self, cls nor starred."""
    pieces = d.count("plist", r"[^,\s][^,]*")
    bare = f"concat(',', replace({d.replace('plist', r'\s+', '')}, ',', ',,'), ',')"
    return f"CAST({pieces} - CASE WHEN lang = 'py' THEN {d.count(bare, r',(?:self|cls|[*][^,]*),')} ELSE 0 END AS BIGINT)"


def _least(d: Dialect, x: Extractor) -> str:
    return f"CASE WHEN {d.any_of('lang', _CLIKE)} THEN 1 ELSE 0 END" if x.nested else str(x.beyond)


def _name(d: Dialect, x: Extractor, t: str) -> str:
    return _by_lang(d, d.extract(t, x.python), _first(d, x.js, (1, 3, 5) if x.js == _JS_ANY else (1, 2) if x.js == _JS_FN else (1,), t), d.extract(t, x.other))


def _plist(d: Dialect, x: Extractor, t: str) -> str:
    return _by_lang(d, d.extract(t, x.python, 2), _first(d, x.js, (2, 4, 6), t) if x.js == _JS_ANY else d.lit(""), d.extract(t, x.other, 2) if x.other == _C_FN else d.lit(""))


def _line(n: str) -> str:
    return f"element_at(ls, CAST({n} AS INT))"


def begins(x: Extractor, t: str) -> str:
    """Spark: whether a line t is a head."""
    d, name = SPARK, _name(SPARK, x, t)
    named = f"length({name}) >= {x.letters}"
    if x.js == _JS_ANY:
        named += f" AND NOT ({d.any_of('lang', JS)} AND {d.any_of(name, _CONTROL)}) AND NOT ({d.any_of('lang', _CLIKE)} AND {d.match(t, _NOT_C)})"
    # a text that every match has is looked for first; these patterns have no capitals, and "(" alone is quicker than many words
    head = lambda p: f"{d.contains(t, '(') if p in _CALLED else needed(d, p, t)} AND {d.match(t, p)}"
    return f"{_by_lang(d, *map(head, (x.python, x.js, x.other)))} AND {named}"


def found_in(x: Extractor) -> str:
    """Spark: the spans of an extractor in a row of ``folds.shaped``, as an array of numbers."""
    return folds.found(x, begins(x, "t"), _least(SPARK, x))


def spans(d: Dialect, x: Extractor) -> str:
    """path, lang, name, sig, plist, params, head, tail of the functions that an extractor finds.

    In Spark also file_name, n_lines (of the file) and, where functions do not nest, body (the lines of the function).
    """
    if d.name == "spark":
        # rows of functions have their own lines with them, not those of the whole file
        head, tail = folds.head_of("f"), folds.tail_of("f")
        cut = {} if x.nested else {"body": f"slice(ls, CAST({head} AS INT), CAST({tail} - {head} + 1 AS INT))"}
        each = f"SELECT path, file_name, lang, n_lines, explode({d.transform(found_in(x), 'f', d.struct(head=head, tail=tail, text=_line(head), **cut))}) AS r FROM {folds.shaped(x.langs)}"
        placed = f"SELECT path, file_name, lang, n_lines, r.* FROM ({each})"
        body = "" if x.nested else ", body"
        named = f"SELECT path, lang, {_name(d, x, 'text')} AS name, substring({d.trim('text')}, 1, 80) AS sig, {_plist(d, x, 'text')} AS plist, head, tail, file_name, n_lines{body} FROM ({placed})"
        return f"SELECT path, lang, name, sig, plist, {_n_params(d)} AS params, head, tail, file_name, n_lines{body} FROM ({named})"
    braces = f"(SELECT * FROM {_braces(d, x.langs)})"
    begun = heads(d, x, braces)
    columns = "lang, name, sig, plist, indent"
    size = f"(SELECT path AS p, max(line) AS n, max(CASE WHEN {d.trim('text')} <> '' THEN line END) AS n_text FROM lines GROUP BY path)"
    braced = _closed(f"(SELECT * FROM {begun} WHERE lang <> 'py')", f"(SELECT * FROM {braces} WHERE lang <> 'py')", columns)
    by_brace = f"SELECT path, {columns}, line AS head, CASE WHEN close - line < {x.reach} THEN close ELSE least(n, line + {x.fallback}) END AS tail FROM {braced} JOIN {size} AS z ON path = p"
    levels = f"(SELECT path AS q, indent AS level FROM {begun} WHERE lang = 'py' GROUP BY path, indent)"
    indent = f"length(text) - length({d.replace('text', r'^\s+', '')})"
    python = f"(SELECT path, line, level, {indent} AS indent, CASE WHEN {indent} <= level THEN line END AS low FROM lines JOIN {levels} ON path = q WHERE lang = 'py' AND {d.trim('text')} <> '')"
    after = f"(SELECT path AS q, line AS at_, level, min(low) OVER (PARTITION BY path, level ORDER BY line DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM {python})"
    by_indent = f"SELECT path, {columns}, line AS head, coalesce(low - 1, {'n' if x.blanks else 'n_text'}) AS tail FROM {begun} JOIN {after} ON path = q AND line = at_ AND indent = level JOIN {size} AS z ON path = p WHERE lang = 'py'"
    found = f"SELECT path, lang, name, sig, plist, head, tail FROM ({by_brace} UNION ALL {by_indent})"
    wanted = f"SELECT * FROM ({found}) WHERE tail - head >= {_least(d, x)}"
    if x.nested:
        flat = d.disjoint(f"SELECT * FROM ({wanted}) WHERE lang <> 'py'", ("lang", "name", "sig", "plist"))
        taken = f"SELECT path, lang, name, sig, plist, head, tail FROM ({wanted}) WHERE lang = 'py' UNION ALL SELECT path, lang, name, sig, plist, head, tail FROM ({flat})"
    else:
        taken = d.disjoint(wanted, ("lang", "name", "sig", "plist"))
    return f"SELECT path, lang, name, sig, plist, {_n_params(d)} AS params, CAST(head AS BIGINT) AS head, CAST(tail AS BIGINT) AS tail FROM ({taken})"


def with_spans(d: Dialect, names: tuple[str, ...]) -> str:
    """The tables of extractors, to go behind ``files`` and ``lines`` in a WITH clause."""
    return "".join(f", {n} AS ({spans(d, EXTRACTORS[n])})" for n in names)


def inside(d: Dialect, table: str) -> str:
    """Lines with the head and tail of the function that they are in; ``table`` must hold disjoint spans. In Spark, with all that the table has."""
    if d.name == "spark":
        return f"(SELECT *, head + pos AS line FROM (SELECT *, posexplode(body) AS (pos, text) FROM {table}))"
    both = f"SELECT path, lang, line, text, CAST(NULL AS BIGINT) AS h, CAST(NULL AS BIGINT) AS t, 1 AS is_line FROM lines UNION ALL SELECT path, lang, head, NULL, head, tail, 0 FROM {table}"
    over = "OVER (PARTITION BY path ORDER BY line, is_line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"(SELECT path, lang, line, text, head, tail FROM (SELECT *, max(h) {over} AS head, max(t) {over} AS tail FROM ({both})) WHERE is_line = 1 AND line <= tail)"


def _level(d: Dialect, levels: tuple, k: int) -> str:
    return "CASE " + " ".join(f"WHEN n >= {x[0]} THEN {d.lit(x[k])}" for x in levels) + " END"


# -- smells ------------------------------------------------------------------------------------------------


def _smelly(d: Dialect, select: str) -> str:
    if d.name == "spark":
        return f"SELECT path AS file, {select} FROM {'functions_smell' if isinstance(d, Ordered) else 'fn_smell'} WHERE n_lines >= 5"
    return f"SELECT path AS file, {select} FROM fn_smell JOIN (SELECT path AS p, max(line) AS n_lines FROM lines GROUP BY path) AS z ON path = p WHERE n_lines >= 5"


def long_function(d: Dialect, s: Settings) -> str:
    n = "(tail - head + 1)"
    return _smelly(d, f"head AS line, tail AS line_end, CASE WHEN {n} > {2 * s.fn_lines} THEN 'high' ELSE 'medium' END AS severity, concat('Long function: ', name, ' (', CAST({n} AS STRING), ' lines)') AS title") + f" AND {n} > {s.fn_lines}"


def many_params(d: Dialect, s: Settings) -> str:
    return _smelly(d, "head AS line, tail AS line_end, 'medium' AS severity, concat('Too many parameters: ', name, ' (', CAST(params AS STRING), ')') AS title") + f" AND params > {s.fn_params}"


def god_file(d: Dialect, s: Settings) -> str:
    counted = _smelly(d, "CAST(1 AS BIGINT) AS line, max(n_lines) AS line_end, 'medium' AS severity, concat('God file — ', CAST(count(*) AS STRING), ' functions in one file') AS title")
    return f"{counted} GROUP BY path HAVING count(*) > 20"


# -- complexity ----------------------------------------------------------------------------------------------


def _decisions(d: Dialect, text: str) -> str:
    """A conditional's question mark follows a word and is single; Java's expressions can look ahead, and count all in one pass."""
    if d.name == "spark":
        return d.count(text, _DECISION[:-1] + r"|\?(?!\?))")
    return f"{d.count(text, _DECISION)} + {d.count(text, r'\w\?')} - {d.count(text, r'\w\?\?')}"


def cyclomatic_scores(d: Dialect) -> str:
    """path, head, tail, n: one more than the decisions. In Spark they are counted in the text of the whole function, with its name."""
    if isinstance(d, Ordered):
        return "SELECT path, head, tail, name, n FROM functions_cc"
    if d.name == "spark":
        return f"SELECT path, head, tail, name, {d.let('b', d.joined('body', chr(10)), f'1 + {_decisions(d, "b")}')} AS n FROM fn_cc"
    return f"SELECT path, head, max(tail) AS tail, CAST(1 + sum({_decisions(d, 'text')}) AS BIGINT) AS n FROM {inside(d, 'fn_cc')} GROUP BY path, head"


def cyclomatic(d: Dialect, s: Settings) -> str:
    title = f"concat(name, ' — CC ', CAST(n AS STRING), ' (', {_level(d, _LEVELS_CC, 2)}, ')')"
    scored = f"({cyclomatic_scores(d)}) AS f" if d.name == "spark" else f"fn_cc AS f JOIN ({cyclomatic_scores(d)}) AS c ON f.path = c.path AND f.head = c.head"
    return f"SELECT f.path AS file, f.head AS line, f.tail AS line_end, {_level(d, _LEVELS_CC, 1)} AS severity, {title} AS title FROM {scored} WHERE n >= {s.cc_limit}"


def cognitive_scores(d: Dialect) -> str:
    """path, lang, name, line, tail, score of every function.

    Python: a nesting keyword adds 1 and its indents of four beyond the first. Elsewhere it adds 1 and the depth of
    keywords before it, a bare else adds 1, a line of more closing than opening braces lowers the depth by the
    difference, and a line with a boolean operator adds 1.
    """
    if isinstance(d, Ordered):
        return "SELECT path, lang, name, head AS line, tail, score FROM functions_cog"
    if d.name == "spark":
        return f"SELECT path, lang, name, head AS line, tail, {_cognitive_fold(d)} AS score FROM fn_cog"
    counts = f"{d.trim('text')} <> '' AND NOT {d.match('text', _SKIPPED)}"
    wide = f"length(replace({d.extract('text', r'^(\s*)')}, chr(9), '    '))"
    py = f"CASE WHEN {d.match('text', _PY_NEST)} THEN 1 + greatest(0, floor({wide} / 4.0) - 1) ELSE 0 END"
    nests = f"CASE WHEN {d.match('text', _NEST)} THEN 1 ELSE 0 END"
    fall = f"greatest(0, {d.count('text', '[}]')} - {d.count('text', '[{]')})"
    plain = f"CASE WHEN {d.match('text', r'\belse\b')} THEN 1 ELSE 0 END"
    marked = f"(SELECT path, lang, head, tail, line, {py} AS py, {nests} AS nests, {fall} AS fall, {plain} AS plain, CASE WHEN {d.match('text', '&&|[|][|]')} THEN 1 ELSE 0 END AS joins FROM {inside(d, 'fn_cog')} WHERE {counts})"
    over = "OVER (PARTITION BY path, head ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    summed = f"(SELECT *, sum(nests - fall) {over} AS total FROM {marked})"
    lowest = f"(SELECT *, total - least(0, min(total) {over}) AS depth FROM {summed})"
    before = f"(SELECT *, coalesce(lag(depth) OVER (PARTITION BY path, head ORDER BY line), 0) AS outer_ FROM {lowest})"
    each = "CASE WHEN lang = 'py' THEN py WHEN nests = 1 THEN 1 + outer_ + joins ELSE plain + joins END"
    scored = f"(SELECT path AS p, head AS h, CAST(sum({each}) AS BIGINT) AS score FROM {before} GROUP BY path, head)"
    return f"SELECT path, lang, name, head AS line, tail, coalesce(score, 0) AS score FROM fn_cog LEFT JOIN {scored} ON path = p AND head = h"


def python_nesting(d: Dialect, t: str) -> str:
    """Spark: what a line of Python adds to a score."""
    wide = f"length(replace({d.extract(t, r'^(\s*)')}, chr(9), '    '))"
    return f"CASE WHEN {d.match(t, _PY_NEST)} THEN 1 + greatest(0, {wide} div 4 - 1) ELSE 0 END"


def _cognitive_fold(d: Dialect) -> str:
    """The score of a body, line by line: the depth of keywords so far goes from one to the next."""
    state = "STRUCT<depth: BIGINT, score: BIGINT>"
    py = python_nesting(d, "t")
    joins = f"CASE WHEN {d.match('t', '&&|[|][|]')} THEN 1 ELSE 0 END"
    fall = f"greatest(0, {folds.number('}')} - {folds.number('{')})"
    made = d.struct(depth=f"greatest(0L, a.depth + 1 - {fall})", score=f"a.score + 1 + a.depth + {joins}")
    plain = d.struct(depth=f"greatest(0L, a.depth - {fall})", score=f"a.score + CASE WHEN {d.match('t', r'\belse\b')} THEN 1 ELSE 0 END + {joins}")
    step = f"CASE WHEN NOT {d.match('t', r'\S')} OR {d.match('t', _SKIPPED)} THEN a WHEN lang = 'py' THEN {d.struct(depth='0L', score=f'a.score + {py}')} WHEN {d.match('t', _NEST)} THEN {made} ELSE {plain} END"
    return f"aggregate(body, CAST(named_struct('depth', 0, 'score', 0) AS {state}), (a, t) -> {step}, a -> a.score)"


def cognitive(d: Dialect, s: Settings) -> str:
    title = f"concat(name, ' — Cognitive Complexity ', CAST(n AS STRING), ' (', {_level(d, _LEVELS_COG, 2)}, ')')"
    return f"SELECT path AS file, line, tail AS line_end, {_level(d, _LEVELS_COG, 1)} AS severity, {title} AS title FROM (SELECT *, score AS n FROM ({cognitive_scores(d)})) WHERE n >= 10"


def _scores_of(python: bool) -> Callable[[Dialect, Settings], str]:
    return lambda d, s: f"SELECT path, name, line, score FROM ({cognitive_scores(d)}) WHERE lang {'=' if python else '<>'} 'py'"


# -- stretches of lines that an event begins and a balance ends ------------------------------------------------


def _stretch(d: Dialect, start: str, net: str, where: str) -> str:
    """Lines behind the last start, with ``begin`` (its line) and the running balance since it."""
    marked = f"(SELECT path, line, text, CASE WHEN {d.match('text', start)} THEN 1 ELSE 0 END AS starts, {net} AS net FROM lines WHERE {where})"
    parts = f"(SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM {marked})"
    over = "OVER (PARTITION BY path, part ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"(SELECT *, min(line) {over} AS begin_, sum(net) {over} AS balance FROM {parts} WHERE part > 0)"


def _stretch_rows(d: Dialect, start: str, where: str) -> str:
    """Spark: a row for each stretch, with its lines ``ls`` from the start on and ``at_``, the place of the start from 0 on."""
    starts = f"filter(transform(ls, (t, i) -> CASE WHEN {d.match('t', start)} THEN i END), i -> i IS NOT NULL)"
    body = "slice(ls, x + 1, coalesce(get(starts, k + 1), size(ls)) - x)"
    each = f"transform(starts, (x, k) -> {d.struct(at_='x', ls=body)})"
    return f"(SELECT path, r.* FROM (SELECT path, explode({d.let('starts', starts, each)}) AS r FROM (SELECT path, {d.split_lines('content')} AS ls FROM files WHERE {where})))"


def _open_queries(d: Dialect) -> str:
    """Spark: the lines (from 0 on, behind the start) of a stretch that query while its brackets are open."""
    balance = "a.balance + length(translate(t, '})', '')) - length(translate(t, '{(', ''))"
    ended = "(z <= 0 AND at_ + a.n > 0)"
    hits = f"CASE WHEN NOT {ended} AND a.n > 0 AND {d.match('t', _ORM)} THEN concat(a.hits, array(a.n)) ELSE a.hits END"
    step = f"CASE WHEN a.over THEN a ELSE {d.let('z', balance, d.struct(n='a.n + 1', balance='z', over=ended, hits=hits))} END"
    zero = "CAST(named_struct('n', 0, 'balance', 0, 'over', false, 'hits', array()) AS STRUCT<n: INT, balance: INT, over: BOOLEAN, hits: ARRAY<INT>>)"
    return f"aggregate(ls, {zero}, (a, t) -> {step}, a -> a.hits)"


def _logged_only(d: Dialect) -> str:
    """Spark: whether the lines behind a catch clause, up to its end, log and do nothing else."""
    balance = "a.balance + length(replace(t, '}', '')) - length(replace(t, '{', ''))"
    logs, acts = (f"a.{n} OR (a.n > 0 AND {d.match('t', p)})" for n, p in (("logs", _LOGS), ("acts", _ACTS)))
    step = f"CASE WHEN a.done THEN a ELSE {d.let('z', balance, d.struct(n='a.n + 1', balance='z', done='z = 0 AND a.n >= 2', logs=logs, acts=acts))} END"
    zero = d.struct(n="0", balance="0", done="false", logs="false", acts="false")
    return f"aggregate(ls, {zero}, (a, t) -> {step}, a -> a.done AND a.logs AND NOT a.acts)"


def n_plus_one(d: Dialect, s: Settings) -> str:
    """Queries on a line behind a loop's own while its brackets are open."""
    if isinstance(d, Ordered):
        return f"SELECT path AS file, line, CAST(NULL AS BIGINT) AS line_end, 'high' AS severity, {d.lit('Possible N+1 query — DB query inside a loop')} AS title FROM ordered WHERE kind = 'n_plus_one'"
    if d.name == "spark":
        found = f"(SELECT path, at_, explode({_open_queries(d)}) AS hit FROM {_stretch_rows(d, _LOOPS, 'TRUE')})"
        return f"SELECT path AS file, CAST(at_ + hit + 1 AS BIGINT) AS line, CAST(NULL AS BIGINT) AS line_end, 'high' AS severity, {d.lit('Possible N+1 query — DB query inside a loop')} AS title FROM {found}"
    lines = _stretch(d, _LOOPS, f"({d.count('text', '[{(]')} - {d.count('text', '[})]')})", "TRUE")
    ended = f"(SELECT *, max(CASE WHEN balance <= 0 AND line > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path, part ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS over_ FROM {lines})"
    return f"SELECT path AS file, line, CAST(NULL AS BIGINT) AS line_end, 'high' AS severity, {d.lit('Possible N+1 query — DB query inside a loop')} AS title FROM {ended} WHERE over_ = 0 AND starts = 0 AND {d.match('text', _ORM)}"


def catch_logs(d: Dialect, s: Settings) -> str:
    """Catch clauses whose lines, up to the first balanced one two lines or more behind, log and do nothing else."""
    if isinstance(d, Ordered):
        return f"SELECT path AS file, line, CAST(NULL AS BIGINT) AS line_end, 'low' AS severity, {d.lit('Catch only logs — error not propagated')} AS title FROM ordered WHERE kind = 'catch_logs'"
    if d.name == "spark":
        return f"SELECT path AS file, CAST(at_ + 1 AS BIGINT) AS line, CAST(NULL AS BIGINT) AS line_end, 'low' AS severity, {d.lit('Catch only logs — error not propagated')} AS title FROM {_stretch_rows(d, r'\}\s*catch\s*\(', d.any_of('lang', JS))} WHERE {_logged_only(d)}"
    lines = _stretch(d, r"\}\s*catch\s*\(", f"({d.count('text', '[{]')} - {d.count('text', '[}]')})", d.any_of("lang", JS))
    stop = f"(SELECT *, min(CASE WHEN balance = 0 AND line >= begin_ + 2 THEN line END) OVER (PARTITION BY path, part) AS stop FROM {lines})"
    has = lambda p: f"max(CASE WHEN {d.match('text', p)} THEN 1 ELSE 0 END)"
    return f"SELECT path AS file, begin_ AS line, CAST(NULL AS BIGINT) AS line_end, 'low' AS severity, {d.lit('Catch only logs — error not propagated')} AS title FROM {stop} WHERE line > begin_ AND line <= stop GROUP BY path, begin_ HAVING {has(r'console[.](?:log|warn)\s*[(]')} = 1 AND {has('throw|reject|return')} = 0"


# -- suggestions to split ------------------------------------------------------------------------------------

_BIG = "(SELECT path AS bp, lines AS n_lines, name AS file_name FROM files WHERE lines >= 60)"


def _long(d: Dialect, s: Settings) -> str:
    """Spark: the functions that are long enough to be split, in files that are. Where each text is told once, ``path`` has its places, and its lines count from 1 on."""
    if isinstance(d, Ordered):
        return "(SELECT places AS path, lang, name, body, 1L AS head, CAST(size(body) AS BIGINT) AS tail FROM functions_long)"
    return f"(SELECT * FROM fn_split WHERE n_lines >= 60 AND tail - head + 1 >= {s.fn_lines})"


def _everywhere(d: Dialect, select: str) -> str:
    """The issues of functions ``_long`` at all of their places."""
    if not isinstance(d, Ordered):
        return select
    return f"SELECT place.path AS file, place.line + line - 1 AS line, place.line + line_end - 1 AS line_end, severity, title FROM (SELECT *, explode(file) AS place FROM ({select}))"


def _long_lines(d: Dialect, s: Settings) -> str:
    """The lines of functions that are long enough to be split, in files that are; where each text is told once, at its first place."""
    if isinstance(d, Ordered):
        return inside(d, "(SELECT places[0].path AS path, places[0].line AS head, lang, name, sig, body FROM functions_long)")
    if d.name == "spark":
        return inside(d, _long(d, s))
    return f"(SELECT path, lang, line, text, head, tail FROM {inside(d, 'fn_split')} JOIN {_BIG} ON path = bp WHERE tail - head + 1 >= {s.fn_lines})"


def _block_fold(d: Dialect, kinds: str) -> str:
    """How many blocks the lines of a body make: h a section comment, b blank, n other. What is too short for a block is held over two blank lines."""
    state = "STRUCT<at: BIGINT, last: STRING, before: STRING, n: BIGINT, held: BIGINT, made: BIGINT>"
    stop = "CASE WHEN k = 'h' THEN 'h' WHEN k = 'b' AND a.last = 'b' AND a.before <> 'b' AND size(body) - a.at > 4 THEN 'c' WHEN a.at = size(body) - 1 THEN 'e' END"
    now = d.struct(stop=stop, n="a.n + CASE WHEN k = 'n' THEN 1 ELSE 0 END")
    most = "(CASE WHEN z.stop = 'c' THEN 4 ELSE 3 END)"
    after = d.struct(at="a.at + 1", last="k", before="a.last", n="CASE WHEN z.stop IS NULL THEN z.n ELSE 0L END", held=f"CASE WHEN z.stop IS NULL THEN a.held WHEN a.held + z.n > {most} OR z.stop <> 'c' THEN 0L ELSE a.held + z.n END", made=f"a.made + CASE WHEN z.stop IS NOT NULL AND a.held + z.n > {most} THEN 1 ELSE 0 END")
    zero = d.struct(at="0", last="'n'", before="'n'", n="0", held="0", made="0")
    return f"aggregate({kinds}, CAST({zero} AS {state}), (a, k) -> {d.let('z', now, after)}, a -> a.made)"


def blocks(d: Dialect, s: Settings) -> str:
    """Two blocks or more: ended by a section comment after more than 3 lines, by two blank lines after more than 4, or by the end."""
    slashed = f"({d.match('bare', '(?i)^//' + _HEADING)} OR {d.match('bare', r'^/[*][*]?\s*.{4,50}\s*[*]?/')})"
    heading = f"(line - head > 2 AND (({d.any_of('lang', _SLASHED)} AND {slashed}) OR (lang = 'py' AND {d.match('bare', '(?i)^#' + _HEADING)})))"
    if d.name == "spark":
        where = heading.replace("line - head > 2", "i > 2")
        kinds = f"transform(body, (t, i) -> {d.let('bare', d.trim('t'), f"CASE WHEN {where} THEN 'h' WHEN bare = '' THEN 'b' ELSE 'n' END")})"
        title = "concat('Split suggestion: ', name, ' (', CAST(tail - head + 1 AS STRING), ' lines, ', CAST(n AS STRING), ' natural blocks)')"
        return _everywhere(d, f"SELECT path AS file, head AS line, tail AS line_end, 'low' AS severity, {title} AS title FROM (SELECT path, head, tail, name, {_block_fold(d, kinds)} AS n FROM {_long(d, s)}) WHERE n >= 2")
    bare = f"(SELECT path, lang, line, head, tail, {d.trim('text')} AS bare FROM {_long_lines(d, s)})"
    kind = f"(SELECT path, line, head, tail, CASE WHEN {heading} THEN 'h' WHEN bare = '' THEN 'b' ELSE 'n' END AS kind FROM {bare})"
    back = lambda k: f"coalesce(lag(kind, {k}) OVER (PARTITION BY path, head ORDER BY line), 'n')"
    stops = f"(SELECT *, CASE WHEN kind = 'h' THEN 'h' WHEN kind = 'b' AND {back(1)} = 'b' AND {back(2)} <> 'b' AND tail - line > 3 THEN 'c' WHEN line = tail THEN 'e' END AS stop FROM {kind})"
    # what a stop ends: the lines of code since the stop before it
    part = "count(stop) OVER (PARTITION BY path, head ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    chunks = f"(SELECT path, head, tail, coalesce({part}, 0) AS part, line, kind, stop FROM {stops})"
    sizes = f"(SELECT path, head, tail, part, coalesce(max(stop), 'e') AS stop, CAST(sum(CASE WHEN kind = 'n' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM {chunks} GROUP BY path, head, tail, part)"
    each = d.struct(part="CAST(part AS BIGINT)", stop="stop", n="n", held="CAST(0 AS BIGINT)", made="CAST(0 AS BIGINT)")
    grown, most = "(a.held + x.n)", "(CASE WHEN x.stop = 'c' THEN 4 ELSE 3 END)"
    step = d.struct(part="x.part", stop="x.stop", n="x.n", held=f"CASE WHEN {grown} > {most} OR x.stop <> 'c' THEN CAST(0 AS BIGINT) ELSE {grown} END", made=f"a.made + CASE WHEN {grown} > {most} THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END")
    zero = d.struct(part="CAST(0 AS BIGINT)", stop="'c'", n="CAST(0 AS BIGINT)", held="CAST(0 AS BIGINT)", made="CAST(0 AS BIGINT)")
    folded = f"(SELECT path, head, tail, {d.fold(d.sorted_list(each), zero, step)}.made AS n FROM {sizes} GROUP BY path, head, tail)"
    title = "concat('Split suggestion: ', f.name, ' (', CAST(f.tail - f.head + 1 AS STRING), ' lines, ', CAST(n AS STRING), ' natural blocks)')"
    return f"SELECT f.path AS file, f.head AS line, f.tail AS line_end, 'low' AS severity, {title} AS title FROM fn_split AS f JOIN {folded} AS b ON f.path = b.path AND f.head = b.head WHERE n >= 2"


def section_labels(d: Dialect, s: Settings) -> str:
    """``path, line, label, fn``: comments that head a part of a long function, and the name of a function to put it into."""
    behind = r"\s*(?:step\s*\d*[:.]\s*|phase\s*\d*[:.]\s*|[-─=*]{2,}\s*)?(.{4,50})"
    bare = f"(SELECT path, lang, line, head, {d.trim('text')} AS bare FROM {_long_lines(d, s)})"
    slashed = _first(d, "(?i)^//" + behind, (1,), "bare"), _first(d, r"^/[*][*]?\s*(.{4,50})\s*[*]?/", (1,), "bare")
    found = f"CASE WHEN lang = 'py' THEN {_first(d, '(?i)^#' + behind, (1,), 'bare')} WHEN {d.any_of('lang', _SLASHED)} THEN coalesce(nullif({slashed[0]}, ''), {slashed[1]}) ELSE '' END"
    label = f"substring({d.trim('found')}, 1, 40)"
    name = f"substring({d.replace(d.trim(d.replace('lower(label)', r'[^a-z0-9\s]', '')), r'\s+', '_')}, 1, 30)"
    return f"SELECT path, line, label, {name} AS fn FROM (SELECT path, line, {label} AS label FROM (SELECT path, line, {found} AS found FROM {bare} WHERE line - head > 2)) WHERE label <> ''"


def param_subset(d: Dialect, s: Settings) -> str:
    """The first block between blank lines, of more than 4 lines, that names one or two of more than three parameters."""
    signature = d.extract("sig", r"\(([^)]*)\)")
    word = d.trim(d.replace(d.replace(d.trim("p"), r"[*:=].*", ""), r"^\w+\s+", ""))
    plain = d.filter(d.transform(d.split("listed", ","), "p", word), "p", f"length(p) > 1 AND NOT {d.any_of('p', ('self', 'cls', 'this'))}")
    text = f"CASE WHEN {d.trim('text')} = '' THEN 1 ELSE 0 END"
    owners = f"(SELECT path AS op, head AS oh, name, listed, {plain} AS names FROM (SELECT path, head, name, {signature} AS listed FROM fn_split))"
    own, owned = ("name, sig, ", "max(name) AS name, max(sig) AS sig, ") if d.name == "spark" else ("", "")
    parts = f"(SELECT path, head, {own}line, text, {text} AS blank, sum({text}) OVER (PARTITION BY path, head ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part, sum({text}) OVER (PARTITION BY path, head) AS n_parts FROM {_long_lines(d, s)})"
    runs = f"(SELECT path, head, part, {owned}min(line) AS a, max(line) AS b, {d.listed('text', 'line', chr(10))} AS body FROM {parts} WHERE blank = 0 AND part < n_parts GROUP BY path, head, part HAVING count(*) > 4)"
    met = f"{runs} JOIN {owners} ON path = op AND head = oh"
    if d.name == "spark":  # a block has its function's signature with it
        met = f"(SELECT path, head, a, b, body, name, listed, {plain} AS names FROM (SELECT *, {signature} AS listed FROM {runs}))"
    named = d.filter("names", "p", f"array_contains({d.extract_all('body', r'(\w+)')}, p)")
    used = f"(SELECT path, head, a, b, name, listed, {named} AS used FROM {met} WHERE {d.size('names')} > 3)"
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY path, head ORDER BY a) AS nth FROM {used} WHERE {d.size('used')} BETWEEN 1 AND 2)"
    title = f"concat('Extractable block in ', name, ': uses only ', {d.joined('used', ', ')}, ' of ', CAST({d.size(d.split('listed', ','))} AS STRING), ' params')"
    if isinstance(d, Ordered):
        each = f"(SELECT *, explode(places) AS place FROM {ranked} JOIN (SELECT places, places[0].path AS p_, places[0].line AS h_ FROM functions_long) ON path = p_ AND head = h_ WHERE nth = 1)"
        return f"SELECT place.path AS file, place.line + a - head AS line, place.line + b - head AS line_end, 'low' AS severity, {title} AS title FROM {each}"
    return f"SELECT path AS file, a AS line, b AS line_end, 'low' AS severity, {title} AS title FROM {ranked} WHERE nth = 1"


def loop_body(d: Dialect, s: Settings) -> str:
    """The first two loops of a long function whose braces hold more than 10 lines."""
    if d.name == "spark":
        fn = f"CASE WHEN head + i <= tail - 10 AND {d.match('t', _BRACE_LOOP)} THEN true ELSE false END"
        events = d.filter(f"transform(body, (t, i) -> {d.struct(line='head + i', opens=folds.number('{'), closes=folds.number('}'), fn=fn)})", "e", "e.opens + e.closes > 0 OR e.fn")
        held = d.filter(f"array_sort({folds.by_braces(events, 200, '0')})", "f", f"{folds.tail_of('f')} - {folds.head_of('f')} > 10")
        title = "concat('Long loop body in ', name, ' (', CAST(line_end - line AS STRING), ' lines)')"
        both = f"SELECT path, name, {folds.head_of('f')} AS line, {folds.tail_of('f')} AS line_end FROM (SELECT path, name, explode(slice({held}, 1, 2)) AS f FROM {_long(d, s)})"
        return _everywhere(d, f"SELECT path AS file, line, line_end, 'low' AS severity, {title} AS title FROM ({both})")
    braces = f"(SELECT * FROM {_braces(d, CODE)})"
    starts = f"(SELECT * FROM {braces} WHERE {d.match('text', _BRACE_LOOP)})"
    closed = f"(SELECT path AS cp, line AS at_, close FROM {_closed(starts, braces, 'lang')})"
    held = f"(SELECT path, head, line, close, row_number() OVER (PARTITION BY path, head ORDER BY line) AS nth FROM {_long_lines(d, s)} JOIN {closed} ON path = cp AND line = at_ WHERE line <= tail - 10 AND close <= tail AND close - line > 10 AND close - line < 200)"
    title = "concat('Long loop body in ', f.name, ' (', CAST(close - line AS STRING), ' lines)')"
    return f"SELECT f.path AS file, line, close AS line_end, 'low' AS severity, {title} AS title FROM {held} AS h JOIN fn_split AS f ON f.path = h.path AND f.head = h.head WHERE nth <= 2"


def file_nouns(d: Dialect, s: Settings) -> str:
    """Long files whose functions share last words."""
    parts = f"CASE WHEN contains(name, '_') THEN name ELSE {d.replace('name', '([a-z])([A-Z])', '$1_$2')} END"
    last = f"lower({d.extract(f'({parts})', r'[^_]_+([^_]{3,})_*$')})"
    own = ", max(file_name) AS file_name, max(n_lines) AS n_lines" if d.name == "spark" else ""
    counted = "sum(n) AS n{} FROM functions_split" if isinstance(d, Ordered) else "count(*) AS n{} FROM fn_split"
    words = f"(SELECT path, {last} AS noun, {counted.format(own)} GROUP BY path, {last})"
    groups = f"(SELECT path{own}, sum(n) AS n_fns, sum(CASE WHEN noun <> '' AND n >= 3 THEN 1 ELSE 0 END) AS shared FROM {words} GROUP BY path)"
    title = "concat('Split file: ', file_name, ' (', CAST(n_lines AS STRING), ' lines, ', CAST(n_fns AS STRING), ' fns)')"
    return f"SELECT path AS file, CAST(1 AS BIGINT) AS line, CAST(NULL AS BIGINT) AS line_end, 'low' AS severity, {title} AS title FROM {groups}{'' if own else f' JOIN {_BIG} ON path = bp'} WHERE n_lines > 300 AND n_fns > 10 AND shared >= 2"


def call_isolated(d: Dialect, s: Settings) -> str:
    """Files of six functions or more with two groups that never call each other."""
    title = "concat('Call-isolated groups in ', file_name, ' — functions that never call each other')"
    if isinstance(d, Ordered):
        return f"SELECT path AS file, CAST(1 AS BIGINT) AS line, CAST(NULL AS BIGINT) AS line_end, 'low' AS severity, {title} AS title FROM ordered WHERE kind = 'isolated'"
    if d.name == "spark":
        calls = f"array_distinct({d.extract_all(d.joined('body', chr(10)), r'\b(\w+)\s*[(]')})"
        found = f"(SELECT path, max(file_name) AS file_name, collect_set(name) AS known, flatten(collect_list({d.transform(calls, 'c', d.struct(a='name', b='c'))})) AS calls FROM fn_split WHERE n_lines >= 60 GROUP BY path HAVING count(*) >= 6)"
        edges = f"(SELECT path, file_name, array_distinct({d.filter('calls', 'x', 'x.a <> x.b AND array_contains(known, x.b)')}) AS edges FROM {found})"
        return f"SELECT path AS file, CAST(1 AS BIGINT) AS line, CAST(NULL AS BIGINT) AS line_end, 'low' AS severity, {title} AS title FROM {edges} WHERE size({d.groups_of('edges')}) >= 2"
    some = "(SELECT path FROM fn_split GROUP BY path HAVING count(*) >= 6)"
    calls = d.unnest(f"(SELECT path, head, {d.extract_all('text', r'\b(\w+)\s*[(]')} AS found FROM {inside(d, 'fn_split')})", "found", "callee", "path, head")
    names = "(SELECT DISTINCT path AS np, name AS known FROM fn_split)"
    edges = f"SELECT DISTINCT f.path, f.name AS a, callee AS b FROM ({calls}) AS c JOIN fn_split AS f ON c.path = f.path AND c.head = f.head JOIN {names} ON c.path = np AND callee = known WHERE f.name <> callee"
    grouped = d.group_counts(edges)
    return f"SELECT g.path AS file, CAST(1 AS BIGINT) AS line, CAST(NULL AS BIGINT) AS line_end, 'low' AS severity, {title} AS title FROM ({grouped}) AS g JOIN {some} AS z ON g.path = z.path JOIN {_BIG} ON g.path = bp WHERE n_groups >= 2"


# -- functions of equal shape --------------------------------------------------------------------------------


def shapes(d: Dialect) -> str:
    """path, head, name, shape: bodies whose names are numbered in the order of their first appearance, white space collapsed."""
    spark = d.name == "spark"
    text = d.joined("body", chr(10)) if spark else "body"
    source = "fn_body" if spark else f"(SELECT path, head, {d.listed('text', 'line', chr(10))} AS body FROM {inside(d, 'fn_body')} GROUP BY path, head)"
    own = "name, places, " if isinstance(d, Ordered) else "tail, name, n_lines, " if spark else ""
    if isinstance(d, Ordered):  # each text once
        source = "(SELECT 0 AS path, 0 AS head, name, places, body FROM functions_body)"
    words = f"(SELECT path, head, {own}{d.extract_all(text, r'(\w+|\W+)')} AS words FROM {source})"
    names = d.first_of_each(d.filter("words", "w", f"{d.match('w', '^[a-z_][a-zA-Z0-9_]{2,}$')} AND NOT {d.any_of('w', _KEYWORDS)}"))
    place = "coalesce(array_position(ns, w), 0)"
    renamed = d.let("ns", names, d.joined(d.transform("words", "w", f"CASE WHEN {place} > 0 THEN concat('$', CAST({place} - 1 AS STRING)) ELSE w END"), ""))
    shape = d.trim(d.replace("renamed", r"\s+", " "))
    if isinstance(d, Ordered):
        return f"SELECT place.path AS path, place.line AS head, name, shape FROM (SELECT name, md5(shape) AS shape, explode(places) AS place FROM (SELECT name, places, {shape} AS shape FROM (SELECT name, places, {renamed} AS renamed FROM {words})) WHERE length(shape) > 50)"
    if spark:
        return f"SELECT path, head, tail, name, n_lines, md5(shape) AS shape FROM (SELECT path, head, {own}{shape} AS shape FROM (SELECT path, head, {own}{renamed} AS renamed FROM {words})) WHERE length(shape) > 50"
    made = f"(SELECT path AS sp, head AS sh, {shape} AS shape FROM (SELECT path, head, {renamed} AS renamed FROM {words}))"
    return f"SELECT path, head, tail, name, md5(shape) AS shape FROM fn_body JOIN {made} ON path = sp AND head = sh WHERE length(shape) > 50"


def structural_duplicates(d: Dialect, s: Settings) -> str:
    """One issue for each shape that two files have: at the first file's first such function."""
    key = f"concat({d.at('path', 'head')}, chr(1), name)"
    if d.name == "spark":
        each = f"(SELECT shape, path, min({key}) AS f FROM ({shapes(d)}){'' if isinstance(d, Ordered) else ' WHERE n_lines > 10'} GROUP BY shape, path)"
        two = f"(SELECT shape, f, row_number() OVER (PARTITION BY shape ORDER BY f) AS nth FROM {each})"
        both = f"(SELECT shape, min(f) AS a, max(f) AS b FROM {two} WHERE nth <= 2 GROUP BY shape HAVING count(*) = 2)"
    else:
        both = _first_two(d, key)
    name = lambda c: f"split_part({c}, chr(1), 3)"
    return f"SELECT {d.file_of('a')} AS file, {d.line_of('a')} AS line, CAST(NULL AS BIGINT) AS line_end, 'medium' AS severity, concat('Structurally similar functions: ', {name('a')}, ' ↔ ', {name('b')}) AS title FROM {both}"


def _first_two(d: Dialect, key: str) -> str:
    """The checking SQL's way to the first functions of a shape in two files."""
    each = f"(SELECT shape, path, min({key}) AS f FROM (SELECT x.* FROM ({shapes(d)}) AS x JOIN (SELECT path AS lp FROM files WHERE lines > 10) ON path = lp) GROUP BY shape, path)"
    first = f"(SELECT shape, min(f) AS a FROM {each} GROUP BY shape HAVING count(*) > 1)"
    return f"(SELECT e.shape, min(a) AS a, min(f) AS b FROM {each} AS e JOIN {first} AS g ON e.shape = g.shape WHERE f <> a GROUP BY e.shape)"


Select = Callable[[Dialect, Settings], str]
#: key -> (category, tables it reads, SQL)
RULES: dict[str, tuple[str, tuple[str, ...], Select]] = {
    "smell_long_function": ("smells", ("fn_smell",), long_function),
    "smell_many_params": ("smells", ("fn_smell",), many_params),
    "smell_god_file": ("smells", ("fn_smell",), god_file),
    "cc_function": ("cyclomatic", ("fn_cc",), cyclomatic),
    "cog_function": ("cognitive", ("fn_cog",), cognitive),
    "err_js_catch_logs": ("errors", (), catch_logs),
    "pat_n_plus_one": ("patterns", (), n_plus_one),
    "split_blocks": ("split", ("fn_split",), blocks),
    "split_param_subset": ("split", ("fn_split",), param_subset),
    "split_loop_body": ("split", ("fn_split",), loop_body),
    "split_file_nouns": ("split", ("fn_split",), file_nouns),
    "split_call_isolated": ("split", ("fn_split",), call_isolated),
    "dup_structural_fn": ("duplicates", ("fn_body",), structural_duplicates),
}


def _spans_of(table: str, langs: tuple[str, ...]) -> Select:
    return lambda d, s: f"SELECT path, name, head, tail, params FROM {table} WHERE {d.any_of('lang', langs)}"


def _bodies(d: Dialect, s: Settings) -> str:
    return f"SELECT path, name, head, tail, shape FROM ({shapes(d)})"


def _every(d: Dialect, s: Settings) -> str:
    if d.name == "spark":  # all of them in the row of a file
        each = ", ".join(f"CASE WHEN {d.any_of('lang', x.langs)} THEN {d.transform(found_in(x), 'f', d.struct(extractor=d.lit(k), head=folds.head_of('f'), tail=folds.tail_of('f'), text=_line(folds.head_of('f'))))} END" for k, x in EXTRACTORS.items())
        placed = f"SELECT path, lang, r.* FROM (SELECT path, lang, explode(flatten(filter(array({each}), x -> x IS NOT NULL))) AS r FROM {folds.shaped(COMPLEX)})"
        by = lambda f: "CASE extractor " + " ".join(f"WHEN {d.lit(k)} THEN {f(d, x, 'text')}" for k, x in EXTRACTORS.items()) + " END"
        return f"SELECT path, extractor, name, head, tail, {_n_params(d)} AS params FROM (SELECT path, lang, extractor, head, tail, {by(_name)} AS name, {by(_plist)} AS plist FROM ({placed}))"
    return " UNION ALL ".join(f"SELECT path, {d.lit(k)} AS extractor, name, head, tail, params FROM {k}" for k in EXTRACTORS)


def metrics(d: Dialect, s: Settings) -> str:
    """Mean and largest complexity of the functions that cc_function reports, and the share of functions with tests."""
    found = f"(SELECT n FROM ({cyclomatic_scores(d)}) WHERE n >= {s.cc_limit})"
    if d.name == "spark":
        found = f"(SELECT CAST(floor(avg(n) + 0.5) AS BIGINT) AS avg_cc, max(n) AS max_cc FROM {found})"
    tested = f"(SELECT CAST(floor(100.0 * sum(hit) / count(*) + 0.5) AS BIGINT) AS pct FROM {covered(d)})"
    if d.name == "spark":
        return f"SELECT avg_cc, max_cc, (SELECT pct FROM {tested}) AS fn_coverage FROM {found}"
    return f"SELECT (SELECT CAST(floor(avg(n) + 0.5) AS BIGINT) FROM {found}) AS avg_cc, (SELECT max(n) FROM {found}) AS max_cc, (SELECT pct FROM {tested}) AS fn_coverage"


def _worst(score: str, scores: Callable[[Dialect], str]) -> Select:
    """All functions, the highest score first."""
    return lambda d, s: f"SELECT path, head, {score} AS score FROM ({scores(d)}) ORDER BY {score} DESC, path, head"


#: key -> (tables it reads, SQL)
QUERIES: dict[str, tuple[tuple[str, ...], Select]] = {
    "fn_spans": (tuple(EXTRACTORS), _every),
    "fn_spans_js": (("fn_smell",), _spans_of("fn_smell", JS)),
    "fn_spans_py": (("fn_smell",), _spans_of("fn_smell", ("py",))),
    "fn_spans_clike": (("fn_smell",), _spans_of("fn_smell", _CLIKE)),
    "fn_spans_cc": (("fn_cc",), _spans_of("fn_cc", COMPLEX)),
    "fn_spans_split": (("fn_split",), _spans_of("fn_split", CODE)),
    "fn_bodies": (("fn_body",), _bodies),
    "section_labels": (("fn_split",), section_labels),
    "agg_metrics_cc": (("fn_cc",), metrics),
    "sort_cc_desc": (("fn_cc",), _worst("n", cyclomatic_scores)),
    "sort_cog_desc": (("fn_cog",), _worst("score", lambda d: f"SELECT path, line AS head, score FROM ({cognitive_scores(d)})")),
    "cog_score_py": (("fn_cog",), _scores_of(True)),
    "cog_score_brace": (("fn_cog",), _scores_of(False)),
}
