"""Rules and extractors that relate lines or files to each other: joins, anti-joins, groups.

Each function gives SQL over ``files`` (path, name, lang, content, lines, wide) and ``lines``.
"""

from __future__ import annotations

from collections.abc import Callable

from lintlake.functions.dialect import Dialect, Ordered, Told
from lintlake.functions.literals import needed
from lintlake.functions.versions import version_key
from lintlake.model import CODE, IMPORTING, JS, PY

_TEST = r"(?i)test|spec|__tests__"
# File names that need no importer, names that are called from outside, and other word lists.
ENTRY_NAMES = (
    "index", "main", "app", "server", "client", "entry", "start", "init", "__init__", "__main__", "program", "manage",
    "wsgi", "asgi",
)
CALLED_OUTSIDE = (
    "constructor", "render", "toString", "main", "init", "setup", "teardown", "setUp", "tearDown", "beforeEach",
    "afterEach", "beforeAll", "afterAll", "componentDidMount", "componentWillUnmount", "componentDidUpdate",
    "getServerSideProps", "getStaticProps", "getStaticPaths", "handler", "middleware", "resolver", "loader", "action",
    "on", "off", "emit", "next", "done", "callback", "cb", "open", "close", "connect", "disconnect", "start", "stop",
    "get", "post", "put", "patch", "delete", "head", "options",
)
CALLED_PATTERN = r"^(?:on|handle|render|use|get|set|is|has)[A-Z]"
KNOWN_JS = (
    "React", "exports", "module", "require", "process", "global", "window", "document", "console", "Promise", "Error",
    "Object", "Array", "String", "Number", "Boolean", "Map", "Set", "Date", "Math", "JSON", "Symbol", "undefined",
    "null", "Infinity", "NaN",
)
KNOWN_PY = (
    "self", "cls", "i", "j", "k", "n", "e", "x", "y", "_", "result", "response", "error", "err", "data", "args",
    "kwargs", "config", "settings", "logger", "app", "db", "conn", "cursor", "session", "client", "api",
)
BORING = (
    "true", "false", "null", "undefined", "get", "set", "post", "put", "delete", "id", "name", "type", "value", "error",
    "message", "data", "result", "status", "ok", "yes", "no", "none", "text", "html", "json", "utf-8", "utf8", "ltr",
    "rtl",
)
BORING_NUMBERS = ("100", "200", "404", "500", "1000")
NOT_NAMES = ("constructor", "render", "toString", "valueOf", "main", "init")
NOT_TESTED = ("main", "init", "setUp", "tearDown", "constructor", "render", "toString")
# Verbs that mean the same; of a verb listed twice the later entry holds.
SYNONYMS = {
    "get": ("fetch", "load", "retrieve", "read", "find", "query", "obtain", "pull"),
    "set": ("update", "save", "put", "write", "store", "persist", "assign", "patch"),
    "delete": ("remove", "destroy", "clear", "drop", "purge", "erase", "wipe"),
    "create": ("make", "add", "new", "insert", "build", "construct", "init", "generate", "produce"),
    "check": ("validate", "verify", "is", "has", "can", "test", "assert", "ensure"),
    "handle": ("process", "manage", "deal", "treat", "respond", "on"),
    "send": ("emit", "dispatch", "publish", "broadcast", "post", "push", "notify"),
    "show": ("display", "render", "draw", "paint", "present", "open", "reveal"),
    "hide": ("close", "dismiss", "remove", "collapse", "toggle", "mask"),
    "start": ("begin", "launch", "run", "execute", "boot", "activate", "open"),
    "stop": ("end", "halt", "abort", "cancel", "kill", "terminate", "deactivate", "close"),
    "convert": ("transform", "parse", "format", "serialize", "encode", "decode", "translate"),
    "filter": ("search", "select", "query", "find", "match", "pick", "sort"),
    "calculate": ("compute", "evaluate", "measure", "count", "sum", "aggregate"),
}
# How functions are declared, by language.
_ARROW = r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?[^)]*\)?\s*=>"
NAME_PATTERNS = {
    "js": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)",
    "py": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    "go": r"^\s*func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(",
    "java": r"^\s*(?:public|private|protected|static)[\w\s<>\[\]]*\s+(\w+)\s*\(",
    "cs": r"^\s*(?:public|private|protected|static|override|virtual|async)[\w\s<>\[\]?]*\s+(\w+)\s*\(",
    "kt": r"^\s*(?:suspend\s+)?fun\s+(\w+)\s*\(",
    "rs": r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*\(",
    "rb": r"^\s*def\s+(\w+)",
    "php": r"^\s*(?:public|private|protected|static)?\s*function\s+(\w+)\s*\(",
}
TESTED_PATTERNS = NAME_PATTERNS | {
    "js": r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(",
    "go": r"^\s*func\s+(?:\(\w+[^)]*\)\s+)?(\w+)\s*\(",
    "cs": r"^\s*(?:public|private|protected|static|override)[\w\s<>\[\]?]*\s+(\w+)\s*\(",
}
_TESTED_OTHER = ("rs", "php")  # read with the pattern of js there
USED_PATTERNS = {
    **{x: r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(" for x in JS},
    "py": NAME_PATTERNS["py"],
    "go": r"^\s*func\s+(?:\(\w+[^)]*\)\s+)?(\w+)\s*\(",
    **{x: r"^\s*(?:public|private|protected|static|override)[\w\s<>\[\]]*\s+(\w+)\s*\(" for x in ("java", "cs", "kt")},
}
TEST_NAME_PATTERNS = [r"\btest[_\s]+(\w+)", r"""\bit\s*\(\s*['"`]([^'"`]+)""", r"""\btest\s*\(\s*['"`]([^'"`]+)""", r"""\bdescribe\s*\(\s*['"`]([^'"`]+)""", r"\bdef\s+test_(\w+)", r"\bfunc\s+Test(\w+)", r"\bfun\s+test(\w+)"]


def _out(d: Dialect, severity: str, title: str, source: str, where: str = "TRUE", file: str = "path", line: str = "line") -> str:
    level = severity if severity.startswith("(") else d.lit(severity)
    return f"SELECT {file} AS file, CAST({line} AS BIGINT) AS line, {level} AS severity, {title} AS title FROM {source} WHERE {where}"


def _by_lang(d: Dialect, patterns: dict[str, str], other: str) -> str:
    cases = " ".join(f"WHEN lang = {d.lit(k)} THEN {d.extract('text', p)}" for k, p in patterns.items())
    return f"CASE {cases} ELSE {other} END"


# -- dead code -------------------------------------------------------------------------------------------


def import_sources(d: Dialect) -> str:
    """``path, base``: what each file imports, as a file name without directories and extension."""
    js = (*JS, "vue", "svelte")
    rows = [
        (d.any_of("lang", js), r"""from\s+['"]([^'"]+)['"]"""),
        (d.any_of("lang", js), r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""),
        ("lang = 'py'", r"^from\s+([\w.]+)\s+import"),
        ("lang = 'py'", r"^import\s+([\w.]+)"),
        ("lang = 'go'", r'"([^"]+)"'),
        (d.any_of("lang", ("java", "cs")), r"^(?:import|using)\s+([\w.]+)"),
    ]
    found = d.array([f"CASE WHEN {c} AND {d.match('text', p)} THEN {d.extract('text', p)} END" for c, p in rows])
    if isinstance(d, Ordered):
        told = d.ask("of_files", {"words": f"CASE WHEN {d.any_of('lang', (*js, 'py', 'go', 'java', 'cs'))} THEN {d.filter(found, 'x', 'x IS NOT NULL')} END"}, "path, name AS source")
        return f"SELECT DISTINCT path, lower(split_part({d.replace('source', r'^.*/', '')}, '.', 1)) AS base FROM {told}"
    union = d.unnest(f"(SELECT path, {d.filter(found, 'x', 'x IS NOT NULL')} AS found FROM lines WHERE {d.any_of('lang', (*js, 'py', 'go', 'java', 'cs'))})", "found", "source", "path")
    base = f"lower(split_part({d.replace('source', r'^.*/', '')}, '.', 1))"
    return f"SELECT DISTINCT path, {base} AS base FROM ({union})"


def _file_base(d: Dialect, name: str = "name") -> str:
    return f"lower({d.replace(name, r'\.[^.]+$', '')})"


def unused_file(d: Dialect) -> str:
    base = _file_base(d)
    source = f"(SELECT path, {base} AS base FROM files WHERE {d.any_of('lang', CODE)} AND NOT {d.any_of(base, ENTRY_NAMES)}) AS f"
    return _out(d, "low", d.lit("Possibly unused file"), source, f"NOT EXISTS (SELECT 1 FROM ({import_sources(d)}) AS i WHERE i.base = f.base)", line="1")


_WORDS = "([A-Za-z0-9_]+)"


def _uses(d: Dialect, names: str) -> str:
    """The checking SQL's ``path, seen, word, times``: how often a line has each of its file's ``names`` (path, name), as a whole word."""
    wanted = f"(SELECT path AS wp, {d.sorted_list('name')} AS names FROM (SELECT DISTINCT path, name FROM ({names}) WHERE name <> '') GROUP BY path)"
    count = d.struct(word="x", n=f"CAST({d.size(d.filter('ws', 'w', 'w = x'))} AS BIGINT)")
    met = d.let("ws", d.extract_all("text", _WORDS), d.transform(d.filter("names", "x", "array_contains(ws, x)"), "x", count))
    found = d.unnest(f"(SELECT path, line AS seen, {met} AS hits FROM lines JOIN {wanted} ON path = wp)", "hits", "hit", "path, seen")
    return f"SELECT path, seen, hit.word AS word, hit.n AS times FROM ({found})"


def _named(d: Dialect, langs: str, pattern: str, pick: Callable[[str], str]) -> str:
    """``path, line, name``: what the lines of some languages that match a pattern name; ``pick`` makes an array of names of a text."""
    return d.unnest(f"(SELECT path, line, {pick('text')} AS found FROM lines WHERE {langs} AND {d.match('text', pattern)})", "found", "name", "path, line")


def _indexed(d: Dialect, kinds: list[tuple[str, str, Callable[[str], str]]], keep: str) -> str:
    """Spark: a row for each file with ``names`` (line, name) that its lines introduce, and ``hits`` (line, name): an index of one
    pass over its words that are such names, in order. ``keep``: which names x count. No row leaves its file."""
    langs = " OR ".join(k for k, _, _ in kinds)
    picked = "CASE " + " ".join(f"WHEN {k} AND {d.match('t', p)} THEN {f('t')}" for k, p, f in kinds) + " END"
    files = f"(SELECT path, lang, {d.split_lines('content')} AS ls FROM files WHERE {langs})"
    placed = d.struct(line="CAST(i + 1 AS BIGINT)", name="x")
    named = f"(SELECT path, ls, flatten(filter(transform(ls, (t, i) -> transform(filter({picked}, x -> {keep}), x -> {placed})), a -> size(a) > 0)) AS names FROM {files})"
    known = "array_distinct(transform(names, n -> n.name))"
    hits = f"transform(ls, (t, i) -> transform(filter({d.extract_all('t', _WORDS)}, x -> array_contains(known, x)), x -> {placed}))"
    found = d.let("known", known, f"flatten(filter({hits}, a -> size(a) > 0))")
    return f"(SELECT path, names, {found} AS hits FROM {named} WHERE size(names) > 0)"


def _by_place(d: Dialect, then: str) -> str:
    """``then`` with the index of a file at hand; bound as variables, which an optimizer does not work out again for every name."""
    return d.let("words", "hits.name", d.let("back", "reverse(words)", d.let("at_", "hits.line", then)))


_FIRST_PLACE, _LAST_PLACE = "array_position(words, n.name)", "size(back) + 1 - array_position(back, n.name)"


def _unused_import(d: Dialect, kind: str) -> str:
    if isinstance(d, Ordered):
        return _out(d, "low", "concat('Unused import: ', name)", f"(SELECT path, line, name FROM ordered WHERE kind = 'unused_{kind}')")
    of_langs, pattern, names_of, anywhere = IMPORTS[kind]
    langs, pick = d.any_of("lang", of_langs), names_of(d)
    if d.name == "spark":
        line = lambda place: f"get(at_, CAST({place} AS INT) - 1)"
        elsewhere = f"{line(_FIRST_PLACE)} <> n.line OR {line(_LAST_PLACE)} <> n.line" if anywhere else f"{line(_LAST_PLACE)} > n.line"
        dead = f"filter(names, n -> NOT array_contains(words, n.name) OR NOT ({elsewhere}))"
        rows = f"(SELECT path, n.line, n.name FROM (SELECT path, explode({_by_place(d, dead)}) AS n FROM {_indexed(d, [(langs, pattern, pick)], _IS_NAME)}))"
        return _out(d, "low", "concat('Unused import: ', name)", rows)
    later = "t.seen <> n.line" if anywhere else "t.seen > n.line"
    names = _named(d, langs, pattern, pick)
    return _out(d, "low", "concat('Unused import: ', name)", f"({names}) AS n", f"name <> '' AND name <> '*' AND NOT EXISTS (SELECT 1 FROM ({_uses(d, names)}) AS t WHERE t.path = n.path AND t.word = n.name AND {later})")


_IS_NAME = "x <> '' AND x <> '*'"


def _listed(d: Dialect, pattern: str) -> Callable[[str], str]:
    """Names of a comma-separated import list; with an alias, the alias."""
    return lambda t: d.transform(d.split(d.extract(t, pattern), ","), "p", d.trim(d.replace(d.trim("p"), r"^.*\s+as\s+", "")))


_JS_NAMED, _JS_DEFAULT = r"^import\s+\{([^}]+)\}\s+from", r"^import\s+(\w+)\s+from"
_PY_FROM, _PY_ALIAS = r"^from\s+\S+\s+import\s+(.+)", r"^import\s+\S+\s+as\s+(\w+)"


def _default(d: Dialect) -> Callable[[str], str]:
    said = lambda t: f"CASE WHEN NOT contains({t}, '{{{{') AND {d.extract(t, _JS_DEFAULT)} <> '_' THEN {d.extract(t, _JS_DEFAULT)} ELSE '' END"
    return lambda t: d.array([said(t)])


#: kind -> languages, the lines that import, the names that such a line has, and whether a use on any other line counts or only on a later one.
IMPORTS: dict[str, tuple[tuple[str, ...], str, Callable[[Dialect], Callable[[str], str]], bool]] = {
    "js_named": (JS, _JS_NAMED, lambda d: _listed(d, _JS_NAMED), True),
    "js_default": (JS, _JS_DEFAULT, _default, False),
    "py_from": (PY, _PY_FROM, lambda d: _listed(d, _PY_FROM), False),
    "py_alias": (PY, _PY_ALIAS, lambda d: lambda t: d.array([d.extract(t, _PY_ALIAS)]), False),
}


def unused_named(d: Dialect) -> str:
    return _unused_import(d, "js_named")


def unused_default(d: Dialect) -> str:
    return _unused_import(d, "js_default")


def unused_from(d: Dialect) -> str:
    return _unused_import(d, "py_from")


def unused_alias(d: Dialect) -> str:
    return _unused_import(d, "py_alias")


def _first(most: int | None) -> str:
    return "TRUE" if most is None else f"nth <= {most}"


def _limit(most: int | None) -> str:
    return "" if most is None else f"ORDER BY path, line LIMIT {most}"


def variables(d: Dialect) -> list[tuple[str, str, Callable[[str], str]]]:
    """Languages, the lines that name a variable, and its name as an array."""
    js, py = r"^\s*(?:const|let)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=(?:[^=]|$)", r"^([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"
    return [
        (d.any_of("lang", JS), js, lambda t: d.array([f"CASE WHEN {d.any_of(d.extract(t, js), KNOWN_JS)} THEN '' ELSE {d.extract(t, js)} END"])),
        ("lang = 'py'", py, lambda t: d.array([f"CASE WHEN {d.match(t, '^[^=]*,')} OR {d.any_of(d.extract(t, py), KNOWN_PY)} THEN '' ELSE {d.extract(t, py)} END"])),
    ]


def is_variable(d: Dialect) -> str:
    return f"length(x) > 1 AND NOT {d.match('x', '^_')}"


def unused_var(d: Dialect, most: int | None = 4) -> str:
    """Names that their file never says again; the first ``most`` of each file, or all."""
    if isinstance(d, Ordered):
        return _out(d, "low", "concat('Unused variable: ', name)", f"(SELECT path, line, name, n AS nth FROM ordered WHERE kind = 'unused_var' AND NOT {d.match('path', _TEST)})", _first(most))
    kinds = variables(d)
    if d.name == "spark":
        index = f"(SELECT * FROM {_indexed(d, kinds, is_variable(d))} WHERE NOT {d.match('path', _TEST)})"
        once = _by_place(d, f"array_sort(filter(names, n -> NOT array_contains(words, n.name) OR {_FIRST_PLACE} = {_LAST_PLACE}))")
        shown = once if most is None else f"slice({once}, 1, {most})"
        return _out(d, "low", "concat('Unused variable: ', name)", f"(SELECT path, n.line, n.name FROM (SELECT path, explode({shown}) AS n FROM {index}))")
    both = " UNION ALL ".join(f"SELECT * FROM ({_named(d, *k)})" for k in kinds)
    names = f"(SELECT * FROM ({both}) WHERE NOT {d.match('path', _TEST)} AND length(name) > 1 AND NOT {d.match('name', '^_')})"
    counts = f"(SELECT path, word, sum(times) AS n FROM ({_uses(d, names)}) GROUP BY path, word)"
    kept = f"(SELECT v.path, v.line, v.name, row_number() OVER (PARTITION BY v.path ORDER BY v.line) AS nth FROM {names} AS v JOIN {counts} AS c ON v.path = c.path AND v.name = c.word WHERE c.n <= 1)"
    return _out(d, "low", "concat('Unused variable: ', name)", kept, _first(most))


def dead_export(d: Dialect, most: int | None = 8) -> str:
    """Exports that no other file imports; the first ``most`` of each file, or all."""
    pattern = r"^export\s+(?:default\s+)?(?:function|const|let|var|class)\s+(\w+)"
    lists = d.unnest(f"(SELECT path, {d.extract_all('content', r'import\s+\{([^}]+)\}\s+from')} AS lists FROM files)", "lists", "names", "path")
    parts = d.unnest(f"(SELECT path, {d.split('names', ',')} AS parts FROM ({lists}))", "parts", "part", "path")
    imported = f"SELECT path, {d.trim(d.replace(d.trim('part'), r'\s+as\s+.*$', ''))} AS name FROM ({parts})"
    if d.name == "spark":  # whether another file has a name is told by the first and the last that have it
        imported = f"SELECT name, explode(array(a, b)) AS path FROM (SELECT name, min(path) AS a, max(path) AS b FROM ({imported}) GROUP BY name)"
    exports = f"(SELECT path, line, {d.extract('text', pattern)} AS name FROM lines WHERE {d.any_of('lang', JS)} AND {d.match('text', pattern)}) AS e"
    dead = f"(SELECT path, line, name, row_number() OVER (PARTITION BY path ORDER BY line) AS nth FROM {exports} WHERE name <> 'default' AND NOT EXISTS (SELECT 1 FROM ({imported}) AS i WHERE i.name = e.name AND i.path <> e.path))"
    return _out(d, "low", "concat('Exported symbol never imported: ', name)", dead, _first(most))


def _definition(d: Dialect) -> str:
    """The name of the function that a line begins, if it is one to look at; else nothing."""
    arrow = r"^\s*(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\(?[^)]*\)?\s*=>"
    plain = _by_lang(d, USED_PATTERNS, "''")
    name = f"CASE WHEN {plain} = '' AND {d.any_of('lang', JS)} THEN {d.extract('text', arrow)} ELSE {plain} END"
    return d.let("f", name, f"CASE WHEN length(f) > 2 AND NOT {d.match('f', '^_')} THEN f ELSE '' END")


def unused_function(d: Dialect, most: int | None = 20) -> str:
    """Functions that nothing calls; a definition is no call. In all files together, the first ``most``, or all."""
    words = d.extract_all("text", r"\b([a-zA-Z_][a-zA-Z0-9_]{2,})\s*\(")
    own = f"CASE WHEN {d.any_of('lang', tuple(USED_PATTERNS))} THEN {_definition(d)} ELSE '' END"
    looked = lambda name: f"{name} <> '' AND NOT {d.any_of(name, CALLED_OUTSIDE)} AND NOT {d.match(name, CALLED_PATTERN)} AND NOT contains(text, 'export')"
    if isinstance(d, Ordered):
        calls = d.ask("distinct", {"words": f"CASE WHEN {d.any_of('lang', CODE)} AND contains(text, '(') THEN {d.let('own', own, d.filter(words, 'w', 'w <> own'))} END"}, "name")
        told = d.ask("places", {"name": f"CASE WHEN {d.any_of('lang', tuple(USED_PATTERNS))} THEN {d.let('own', _definition(d), f'CASE WHEN {looked("own")} THEN own END')} END"}, "name, places")
        free = f"(SELECT path, line, name FROM (SELECT name, inline(places) AS (path, file_name, line) FROM {told} AS f WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT name FROM {calls}) AS k WHERE k.name = f.name)) {_limit(most)})"
        return _out(d, "low", "concat('Unused function: ', name)", free)
    calls = d.unnest(f"(SELECT {d.let('own', own, d.filter(words, 'w', 'w <> own'))} AS words FROM {d.texts()} WHERE {d.any_of('lang', CODE)} AND contains(text, '('))", "words", "name", "1 AS one")
    defined = f"(SELECT path, line, text, {_definition(d)} AS name FROM lines WHERE {d.any_of('lang', tuple(USED_PATTERNS))})"
    free = f"(SELECT path, line, name FROM {defined} AS f WHERE {looked('name')} AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT name FROM ({calls})) AS k WHERE k.name = f.name) {_limit(most)})"
    return _out(d, "low", "concat('Unused function: ', name)", free)


# -- duplicates ------------------------------------------------------------------------------------------


def is_code(d: Dialect, t: str) -> str:
    """Whether a line is neither blank nor a comment."""
    return f"{d.trim(t)} <> '' AND NOT {d.match(t, r'^\s*(?://|#)')}"


def _blocks(d: Dialect, n: int) -> str:
    """``path, line, k``: a key for the text of each n lines that follow each other, of which 4 are neither blank nor comments.

    Spark makes them in the row of a file, and no text leaves it; the checking SQL takes windows over lines.
    """
    said = lambda t: f"CASE WHEN {is_code(d, t)} THEN 1 ELSE 0 END"
    if d.name == "spark":
        files = f"(SELECT path, ls, {d.transform('ls', 't', said('t'))} AS said FROM (SELECT path, {d.split_lines('content')} AS ls FROM files WHERE lines > 10 AND {d.any_of('lang', CODE)}) WHERE size(ls) >= {n})"
        key = f"CASE WHEN aggregate(slice(said, i + 1, {n}), 0, (a, x) -> a + x) >= 4 THEN unhex(md5({d.joined(f'slice(ls, i + 1, {n})', chr(10))})) END"
        each = d.filter(d.transform(f"sequence(0, size(ls) - {n})", "i", d.struct(line="CAST(i + 1 AS BIGINT)", k=key)), "x", "x.k IS NOT NULL")
        return f"(SELECT path, x.line, x.k FROM (SELECT path, explode({each}) AS x FROM {files}))"
    frame = f"OVER (PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    some = f"(SELECT path FROM files WHERE lines > 10 AND {d.any_of('lang', CODE)})"
    framed = f"(SELECT path, line, {d.block(0, n - 1)} AS body, sum(said) {frame} AS said, count(*) {frame} AS n FROM (SELECT path, line, text, {said('text')} AS said FROM lines WHERE path IN {some}))"
    return f"(SELECT path, line, md5(body) AS k FROM {framed} WHERE n = {n} AND said >= 4)"


def exact_block(d: Dialect, n: int = 6) -> str:
    if isinstance(d, Ordered):  # a place is the rank of a path and a line, as one number
        every = "SELECT min(first_place) AS place FROM (SELECT inline(keys) FROM ordered WHERE kind = 'blocks') GROUP BY a, b HAVING max(last_rank) <> shiftright(min(first_place), 32)"
        return _out(d, "medium", d.lit(f"Duplicate code block ({n} lines)"), f"({every}) JOIN ranks ON rank = shiftright(place, 32)", line="place & 4294967295L")
    grouped = f"(SELECT min({d.at()}) AS place FROM {_blocks(d, n)} GROUP BY k HAVING min(path) <> max(path))"
    return _out(d, "medium", d.lit(f"Duplicate code block ({n} lines)"), grouped, file=d.file_of("place"), line=d.line_of("place"))


def block_pairs(d: Dialect, n: int = 6) -> str:
    """``file, line, file_b, line_b, suggestion``: the first place of each repeated block, and its first place in another file."""
    each = f"(SELECT k, path, min({d.at()}) AS place FROM {_blocks(d, n)} GROUP BY k, path)"
    two = f"(SELECT k, place, row_number() OVER (PARTITION BY k ORDER BY place) AS nth FROM {each})"
    both = f"(SELECT min(place) AS a, max(place) AS b FROM {two} WHERE nth <= 2 GROUP BY k HAVING count(*) = 2)"
    said = f"concat('Same block found in ', {d.file_of('b')}, ':', CAST({d.line_of('b')} AS STRING), ' — extract to a shared function')"
    return f"SELECT {d.file_of('a')} AS file, {d.line_of('a')} AS line, {d.file_of('b')} AS file_b, {d.line_of('b')} AS line_b, {said} AS suggestion FROM {both}"


def _long_files(d: Dialect) -> str:
    """``path, line, text`` of the files of code with more than 10 lines."""
    where = f"lines > 10 AND {d.any_of('lang', CODE)}"
    if d.name == "spark":
        return f"(SELECT path, CAST(pos + 1 AS BIGINT) AS line, text FROM (SELECT path, posexplode({d.split_lines('content')}) AS (pos, text) FROM files WHERE {where}))"
    return f"(SELECT path, line, text FROM lines WHERE path IN (SELECT path FROM files WHERE {where}))"


def magic_value(d: Dialect) -> str:
    quoted = r"""('[a-zA-Z0-9_\-./]{6,}'|"[a-zA-Z0-9_\-./]{6,}"|`[a-zA-Z0-9_\-./]{6,}`)"""
    bare, marks = "substring(v, 2, length(v) - 2)", d.lit('"')
    texts = d.transform(d.filter(d.extract_all("text", quoted), "v", f"length(v) <= 62 AND NOT {d.any_of(f'lower({bare})', BORING)}"), "v", f"concat({marks}, {bare}, {marks})")
    numbers = d.transform(d.filter(d.extract_all("text", r"\b(\d{3,})\b"), "v", f"NOT {d.any_of('v', BORING_NUMBERS)}"), "v", "concat('#', v)")
    said = d.concat([texts, numbers])
    if isinstance(d, Ordered):
        told = d.ask("values", {"words": f"CASE WHEN {d.any_of('lang', CODE)} THEN {said} END"}, "path, line, name AS v, n", beyond=10)
        grouped = f"(SELECT v, sum(n) AS n, count(DISTINCT path) AS f, min({d.at()}) AS place FROM {told} GROUP BY v HAVING sum(n) >= 5 AND count(DISTINCT path) >= 2)"
        return _out(d, "low", "concat('Magic value repeated ', CAST(n AS STRING), '× across ', CAST(f AS STRING), ' files: ', v)", grouped, file=d.file_of("place"), line=d.line_of("place"))
    some = d.on_lines(f"long AND {d.any_of('lang', CODE)} AND {d.size(said)} > 0", found=said) if isinstance(d, Told) else f"(SELECT path, line, {said} AS found FROM {_long_files(d)})"
    each = d.unnest(some, "found", "v", "path, line")
    grouped = f"(SELECT v, count(*) AS n, count(DISTINCT path) AS f, min({d.at()}) AS place FROM ({each}) GROUP BY v HAVING count(*) >= 5 AND count(DISTINCT path) >= 2)"
    return _out(d, "low", "concat('Magic value repeated ', CAST(n AS STRING), '× across ', CAST(f AS STRING), ' files: ', v)", grouped, file=d.file_of("place"), line=d.line_of("place"))


# -- names -----------------------------------------------------------------------------------------------


def fn_names(d: Dialect) -> str:
    plain = _by_lang(d, NAME_PATTERNS, d.extract("text", NAME_PATTERNS["js"]))
    family = d.any_of("lang", tuple(x for x in CODE if x not in NAME_PATTERNS or x == "js"))
    name = f"CASE WHEN {plain} = '' AND {family} THEN {d.extract('text', _ARROW)} ELSE {plain} END"
    if isinstance(d, Ordered):  # where each is first
        return f"SELECT path, line, name FROM {d.ask('first_places', {'name': f'CASE WHEN {d.any_of("lang", CODE)} THEN {d.let("own", name, f"CASE WHEN length(own) >= 2 AND NOT {d.any_of("own", NOT_NAMES)} THEN own END")} END'}, 'path, line, name')}"
    if d.name == "spark":
        return f"SELECT path, line, fn AS name FROM {d.on_lines(f'{d.any_of("lang", CODE)} AND length({name}) >= 2 AND NOT {d.any_of(name, NOT_NAMES)}', fn=name)}"
    return f"SELECT path, line, name FROM (SELECT path, line, {name} AS name FROM lines WHERE {d.any_of('lang', CODE)}) WHERE length(name) >= 2 AND NOT {d.any_of('name', NOT_NAMES)}"


def _spellings(d: Dialect, keyed: str, title: str, sep: str) -> str:
    """One issue for a key with several spellings, at the first place; the spellings in the order of their first places."""
    each = f"(SELECT k, name, min({d.at()}) AS place FROM ({keyed}) GROUP BY k, name)"
    grouped = f"(SELECT k, min(place) AS first_place, {d.listed('name', 'place', sep)} AS names FROM {each} GROUP BY k HAVING count(*) >= 2)"
    return _out(d, "low", f"concat({d.lit(title)}, names)", grouped, file=d.file_of("first_place"), line=d.line_of("first_place"))


def convention_conflict(d: Dialect) -> str:
    key = "lower(replace(name, '_', ''))"
    return _spellings(d, f"SELECT path, line, name, {key} AS k FROM ({fn_names(d)}) WHERE length({key}) >= 3", "Naming conflict: ", " / ")


def split_name(d: Dialect, name: str = "name") -> str:
    """The words of a name, separated by blanks."""
    snake = d.trim(d.replace(name, "_+", " "))
    camel = d.replace(d.replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return f"CASE WHEN contains({name}, '_') THEN {snake} ELSE {camel} END"


def verb_synonym(d: Dialect) -> str:
    canonical: dict[str, str] = {}
    for verb, others in SYNONYMS.items():
        canonical |= {w: verb for w in (verb, *others)}
    verbs = d.values(sorted(canonical.items()), "verb, means")
    parts = f"(SELECT path, line, name, lower(split_part(said, ' ', 1)) AS verb, lower(replace({d.replace('said', '^[^ ]* ?', '')}, ' ', '')) AS noun FROM (SELECT path, line, name, {split_name(d)} AS said FROM ({fn_names(d)})))"
    return _spellings(d, f"SELECT path, line, name, concat(means, ':', noun) AS k FROM {parts} AS p JOIN {verbs} AS v ON p.verb = v.verb WHERE length(noun) >= 3", "Synonym functions for same concept: ", " + ")


# -- imports as a graph ----------------------------------------------------------------------------------


def import_edges(d: Dialect) -> str:
    """``src, dst``: files that import each other, a name going to the first file of that name."""
    js = (*JS, "vue", "svelte")
    dots = lambda x: f"replace({x}, '.', '/')"
    first = lambda a, b: f"CASE WHEN {d.match('text', a)} THEN {d.extract('text', a)} ELSE {d.extract('text', b)} END"
    js_source = first(r"""from\s+['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""")
    py_source = dots(first(r"^from\s+([\w.]+)\s+import", r"^import\s+([\w.]+)"))
    go_source = d.extract("text", '"([^"]+)"')
    java_source = dots(d.extract("text", r"^(?:import|using)\s+([\w.]+)"))
    source = f"CASE WHEN {d.any_of('lang', js)} THEN {js_source} WHEN lang = 'py' THEN {py_source} WHEN lang = 'go' THEN {go_source} WHEN {d.any_of('lang', ('java', 'cs'))} THEN {java_source} ELSE '' END"
    refs = f"(SELECT path, lang, {source} AS source FROM lines WHERE {d.any_of('lang', IMPORTING)})"
    if isinstance(d, Ordered):
        refs = d.ask("of_files", {"words": f"CASE WHEN {d.any_of('lang', IMPORTING)} THEN filter(array({source}), x -> x <> '') END"}, "path, lang, name AS source")
    local = f"({d.match('source', '^[.]')} OR (NOT {d.match('source', '^@')} AND contains(source, '/')) OR {d.any_of('lang', ('py', 'go', 'java', 'cs'))})"
    named = f"(SELECT DISTINCT path AS src, {d.replace(f'lower({d.replace("source", "^.*/", "")})', r'\.[^.]+$', '')} AS base FROM {refs} WHERE source <> '' AND {local})"
    known = f"(SELECT path AS dst, {_file_base(d)} AS base FROM files WHERE {d.any_of('lang', IMPORTING)})"
    return f"SELECT DISTINCT src, dst FROM (SELECT src, n.base, min(dst) AS dst FROM {named} AS n JOIN {known} AS k ON n.base = k.base AND n.src <> k.dst GROUP BY src, n.base)"


# -- tests -----------------------------------------------------------------------------------------------


def _is_test(d: Dialect) -> str:
    return f"({d.match('lower(path)', 'test|spec|__tests__')} OR {d.match('lower(name)', r'^test_|_test\.(?:py|go|kt|java|cs|rb)$|\.(?:test|spec)\.(?:js|ts|jsx|tsx)$')})"


def is_test_file(d: Dialect) -> str:
    return f"SELECT path, CAST(CASE WHEN {_is_test(d)} THEN 1 ELSE 0 END AS BIGINT) AS is_test FROM files"


def test_names(d: Dialect) -> str:
    """The words of the names of tests."""
    every = d.concat([d.extract_all("content", "(?i)" + p) for p in TEST_NAME_PATTERNS])
    found = d.unnest(f"(SELECT path, {every} AS found FROM files WHERE {_is_test(d)})", "found", "raw", "path")
    said = d.replace("lower(raw)", r"^(?:test|should|it|when|given|can)\s+", "")
    words = d.unnest(f"(SELECT {d.split_on(said, r'[\s_]+')} AS words FROM ({found}))", "words", "word", "1 AS one")
    return f"SELECT DISTINCT word FROM ({words}) WHERE length(word) > 2"


def source_fns(d: Dialect) -> str:
    """Functions outside test files."""
    patterns = {k: v for k, v in TESTED_PATTERNS.items() if k not in _TESTED_OTHER}
    name = _by_lang(d, patterns, d.extract("text", TESTED_PATTERNS["js"]))
    if isinstance(d, Ordered):
        told = d.ask("named", {"name": f"CASE WHEN {d.any_of('lang', CODE)} THEN {d.let('own', name, f'CASE WHEN length(own) >= 3 AND NOT {d.any_of("own", NOT_TESTED)} THEN own END')} END"}, "path, file_name AS name, line, name AS fn")
        return f"SELECT path, line, fn FROM {told} WHERE NOT {_is_test(d)}"
    if d.name == "spark":
        said = d.on_lines(f"{d.any_of('lang', CODE)} AND length({name}) >= 3 AND NOT {d.any_of(name, NOT_TESTED)}", fn=name)
        return f"SELECT path, line, fn FROM {said} WHERE NOT {_is_test(d)}"
    return f"SELECT path, line, fn FROM (SELECT path, name, line, {name} AS fn FROM lines WHERE {d.any_of('lang', CODE)}) WHERE NOT {_is_test(d)} AND length(fn) >= 3 AND NOT {d.any_of('fn', NOT_TESTED)}"


def covered(d: Dialect) -> str:
    parts = d.split_on(d.trim("lower(" + d.replace("fn", "([A-Z])", " $1") + ")"), r"\s+")
    words = d.concat([d.filter(parts, "w", "length(w) > 3"), d.array(["lower(replace(fn, '_', ''))"])])
    if d.name == "spark":  # whether a name is tested is asked once for all that share it
        named = d.unnest(f"(SELECT fn, {words} AS words FROM (SELECT DISTINCT fn FROM ({source_fns(d)})))", "words", "word", "fn")
        told = f"(SELECT k.fn AS told, max(CASE WHEN t.word IS NULL THEN 0 ELSE 1 END) AS hit FROM ({named}) AS k LEFT JOIN ({test_names(d)}) AS t ON k.word = t.word GROUP BY k.fn)"
        return f"(SELECT DISTINCT path, line, fn, hit FROM ({source_fns(d)}) JOIN {told} ON fn = told)"
    keys = d.unnest(f"(SELECT path, line, fn, {words} AS words FROM ({source_fns(d)}))", "words", "word", "path, line, fn")
    return f"(SELECT k.path, k.line, k.fn, max(CASE WHEN t.word IS NULL THEN 0 ELSE 1 END) AS hit FROM ({keys}) AS k LEFT JOIN ({test_names(d)}) AS t ON k.word = t.word GROUP BY k.path, k.line, k.fn)"


def no_tests(d: Dialect) -> str:
    source = f"(SELECT min(CASE WHEN NOT {_is_test(d)} AND {d.any_of('lang', CODE)} THEN path END) AS path, sum(CASE WHEN {_is_test(d)} THEN 1 ELSE 0 END) AS tests, sum(CASE WHEN NOT {_is_test(d)} AND {d.any_of('lang', CODE)} THEN 1 ELSE 0 END) AS n FROM files)"
    return _out(d, "high", d.lit("No test files found"), source, "tests = 0 AND n > 5", line="1")


def coverage(d: Dialect) -> str:
    source = f"(SELECT sum(hit) AS c, count(*) AS n, CAST(floor(100.0 * sum(hit) / count(*) + 0.5) AS BIGINT) AS pct FROM {covered(d)}) AS x CROSS JOIN (SELECT min(path) AS path FROM files WHERE {_is_test(d)}) AS t"
    title = "concat('Test coverage: ~', CAST(pct AS STRING), '% (', CAST(c AS STRING), '/', CAST(n AS STRING), ' functions have matching tests)')"
    return _out(d, "(CASE WHEN pct < 30 THEN 'high' WHEN pct < 60 THEN 'medium' ELSE 'low' END)", title, source, "n > 0 AND path IS NOT NULL", line="1")


def uncovered(d: Dialect, most: int | None = 10) -> str:
    source = f"(SELECT path, line, fn FROM {covered(d)} WHERE hit = 0 AND length(fn) > 3 AND NOT {d.match('fn', '^_')} AND EXISTS (SELECT 1 FROM files WHERE {_is_test(d)}) {_limit(most)})"
    return _out(d, "low", "concat('No test found for: ', fn, '()')", source)


# -- dependencies ----------------------------------------------------------------------------------------


#: A manifest belongs to a project. Files of one project (the default) have its first package.json and go.mod read, as all
#: requirement files are; a corpus of projects tells them apart by an expression on ``path``.
ONE_PROJECT = "''"


def _first_manifest(d: Dialect, where: str, project: str) -> str:
    """``path, content`` of the first file of each project that meets a condition."""
    return f"(SELECT path, content FROM (SELECT path, content, row_number() OVER (PARTITION BY {project} ORDER BY path) AS nth FROM files WHERE {where}) WHERE nth = 1)"


def npm(d: Dialect, project: str = ONE_PROJECT) -> str:
    """``ecosystem, name, version, file`` of the first package.json; a name in both lists has the version of the second."""
    first = _first_manifest(d, "name = 'package.json' AND NOT contains(path, 'node_modules')", project)
    if d.name == "spark":
        shape = "'dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>'"
        lists = f"SELECT path, coalesce(j.dependencies, map()) AS dep, coalesce(j.devDependencies, map()) AS dev FROM (SELECT path, from_json(content, {shape}) AS j FROM {first})"
        both = f"SELECT path, explode(map_concat(map_filter(dep, (k, v) -> NOT map_contains_key(dev, k)), dev)) AS (dep, said) FROM ({lists})"
    else:
        each = "SELECT f.path, j.key AS dep, json_extract_string(j.value, '$') AS said FROM {first} AS f, json_each(f.content, '$.{part}') AS j"
        dev = each.format(first=first, part="devDependencies")
        both = f"{dev} UNION ALL SELECT path, dep, said FROM ({each.format(first=first, part='dependencies')}) AS o WHERE NOT EXISTS (SELECT 1 FROM ({dev}) AS v WHERE v.path = o.path AND v.dep = o.dep)"
    clean = f"split_part({d.replace('said', '[~^>=<]', '')}, ' ', 1)"
    return f"SELECT 'npm' AS ecosystem, dep AS name, {clean} AS version, path AS file FROM ({both}) WHERE {d.match(clean, '^[0-9]')}"


def pypi(d: Dialect, project: str = ONE_PROJECT) -> str:
    text = d.trim("text")
    pattern = r"^([a-zA-Z0-9_\-]+)\s*(?:[><=!]+\s*([\d.]+))?"
    source = f"({d.unnest(f'(SELECT path, name AS file_name, {d.split_lines("content")} AS ls FROM files)', 'ls', 'text', 'path, file_name AS name')})" if d.name == "spark" else "lines"
    return f"SELECT 'PyPI' AS ecosystem, {d.extract(text, pattern, 1)} AS name, {d.extract(text, pattern, 2)} AS version, path AS file FROM {source} WHERE name IN ('requirements.txt', 'Pipfile', 'pyproject.toml') AND {d.match(text, pattern)}"


def go_modules(d: Dialect, project: str = ONE_PROJECT) -> str:
    text = d.trim("text")
    pattern = r"^require\s+(\S+)\s+v([\d.]+)"
    said = d.unnest(f"(SELECT path, {d.split_lines('content')} AS ls FROM {_first_manifest(d, _GO_MOD, project)})", "ls", "text", "path")
    return f"SELECT 'Go' AS ecosystem, {d.extract(text, pattern, 1)} AS name, {d.extract(text, pattern, 2)} AS version, path AS file FROM ({said}) WHERE {d.match(text, pattern)}"


_GO_MOD = "name = 'go.mod'"
#: Columns of advisories: a version is affected from ``introduced`` on, before ``until`` and up to ``last`` where they are not empty; several rows make up an advisory.
ADVISORY = "id, eco, package, introduced, until, last, alias, summary, level, cvss, fixed"
#: Advisories that stand in for the service where no table is given.
ADVISORIES = [
    ("ADV-1", "npm", "lodash", "4.17.21", "", "4.17.21", "CVE-X-1", "Prototype pollution", "HIGH", "7.4", "4.17.22"),
    ("ADV-2", "npm", "left-pad", "1.3.0", "", "1.3.0", "CVE-X-2", "Denial of service", "", "9.1", ""),
    ("ADV-3", "PyPI", "requests", "0", "2.20.0", "", "CVE-X-3", "Header leak", "MODERATE", "", "2.20.0"),
    ("ADV-4", "PyPI", "flask", "1.0", "1.1", "", "CVE-X-4", "Memory use", "", "3.1", "1.1"),
    ("ADV-5", "Go", "github.com/gin-gonic/gin", "1.0.0-rc.1", "1.7.7", "", "CVE-X-5", "Log injection", "CRITICAL", "", "1.7.7"),
]


def dependencies(d: Dialect, project: str = ONE_PROJECT) -> str:
    return f"{npm(d, project)} UNION ALL {pypi(d, project)} UNION ALL {go_modules(d, project)}"


def advisory_severity(d: Dialect) -> str:
    score = "TRY_CAST(NULLIF(cvss, '') AS DOUBLE)"
    return f"CASE WHEN contains(lower(level), 'critical') THEN 'critical' WHEN contains(lower(level), 'high') THEN 'high' WHEN contains(lower(level), 'medium') OR contains(lower(level), 'moderate') THEN 'medium' WHEN {score} >= 9 THEN 'critical' WHEN {score} >= 7 THEN 'high' WHEN {score} >= 4 THEN 'medium' ELSE 'low' END"


def upgrade_hint(d: Dialect) -> str:
    """What to run, by ecosystem, with the first fixed version if one is known."""
    return (
        "CASE WHEN ecosystem = 'npm' THEN CASE WHEN fixed <> '' THEN concat('Upgrade to ', name, '@', fixed, ' — run: npm install ', name, '@', fixed) ELSE concat('Upgrade ', name, ' to the latest version — run: npm update ', name) END"
        " WHEN ecosystem = 'PyPI' THEN CASE WHEN fixed <> '' THEN concat('Upgrade to ', name, '==', fixed, ' — run: pip install ', name, '==', fixed) ELSE concat('Upgrade ', name, ' — run: pip install --upgrade ', name) END"
        " WHEN ecosystem = 'Go' THEN CASE WHEN fixed <> '' THEN concat('Upgrade to v', fixed, ' — run: go get ', name, '@v', fixed) ELSE concat('Upgrade ', name, ' — run: go get -u ', name) END"
        " ELSE concat('Upgrade ', name, ' to the latest patched version') END"
    )


def _vulnerable(d: Dialect, table: str = "", project: str = ONE_PROJECT) -> str:
    """Dependencies with their advisories, from a table of the columns ADVISORY or else from ADVISORIES; one without a version has all of its package.

    Dependencies meet advisories by ecosystem and package; whether a version lies in a range is a comparison of keys.
    """
    advisories = table or d.values(ADVISORIES, ADVISORY)
    asked = f"(SELECT DISTINCT ecosystem, name, version, file, {version_key(d, 'version', 'ecosystem')} AS at_key FROM ({dependencies(d, project)}))"
    bound = lambda c: version_key(d, c, "eco")
    ranges = f"(SELECT {ADVISORY}, {bound('introduced')} AS low, {bound('until')} AS below, {bound('last')} AS high FROM {advisories})"
    within = "p.version = '' OR (at_key >= low AND (until = '' OR at_key < below) AND (last = '' OR at_key <= high))"
    texts = ", ".join(f"min({c}) AS {c}" for c in ("alias", "summary", "level", "cvss", "fixed"))
    met = f"(SELECT file, ecosystem, name, version, id, {texts} FROM {asked} AS p JOIN {ranges} AS a ON p.ecosystem = a.eco AND p.name = a.package AND ({within}) GROUP BY file, ecosystem, name, version, id)"
    return f"(SELECT *, row_number() OVER (PARTITION BY file, ecosystem, name, version ORDER BY id) AS nth FROM {met})"


def vulnerable(d: Dialect, most: int | None = 3, table: str = "", project: str = ONE_PROJECT) -> str:
    return _out(d, f"({advisory_severity(d)})", "concat('Vulnerable dependency: ', name, '@', version, ' — ', alias)", _vulnerable(d, table, project), _first(most), file="file", line="NULL")


def vulnerable_hints(d: Dialect, table: str = "", project: str = ONE_PROJECT) -> str:
    return f"SELECT file, name, version, id AS cve_id, {upgrade_hint(d)} AS suggestion FROM {_vulnerable(d, table, project)} WHERE nth <= 3"


# -- rules of the user -------------------------------------------------------------------------------------

#: id, title, pattern, severity, languages (empty: all), flags (g has no meaning for lines; i, m and s are the engine's own)
CUSTOM = [("c1", "No TODO", "TODO", "low", "", "gi"), ("c2", "No magic status", "order-status", "medium", "js,py", "g"), ("c3", "Uses db", r"\bdb\.\w+", "info", "", "g"), ("c4", "Not a pattern", "(", "high", "", "gi")]


def usable(d: Dialect, rules: list[tuple[str, str, str, str, str, str]]) -> list[tuple[str, str, str, str, str]]:
    """Rules with their flags put into the pattern; one whose pattern the engine that runs it does not take is passed over, as is an empty one."""
    out = []
    for rid, title, pattern, level, langs, flags in rules:
        inner = "".join(x for x in "ims" if x in flags)
        whole = f"(?{inner}){pattern}" if inner else pattern
        if pattern and d.takes(whole):
            out.append((rid, title, whole, level, langs))
    return out


def custom(d: Dialect, rules: list[tuple[str, str, str, str, str, str]] = CUSTOM) -> str:
    """All rules of the user in one pass over the lines."""
    good = usable(d, rules)
    if not good:
        return _out(d, "low", "text", "lines", "FALSE")
    first = lambda p, langs: " AND ".join([*([d.any_of("lang", langs.split(","))] if langs else []), *filter(None, [needed(d, p) if d.name == "spark" else ""]), d.match("text", p)])
    hits = [f"CASE WHEN {first(p, langs)} THEN {d.lit(rid)} END" for rid, _, p, _, langs in good]
    some = f"(SELECT path, line, {d.filter(d.array(hits), 'r', 'r IS NOT NULL')} AS hits FROM (SELECT *, lower(text) AS low FROM lines))"
    named = d.values([(rid, title, level) for rid, title, _, level, _ in good], "rule_id, rule_title, level")
    return _out(d, "(level)", "rule_title", f"({d.unnest(some, 'hits', 'hit', 'path, line')}) AS h JOIN {named} AS r ON hit = rule_id")


#: rules: key -> (category, SQL); extractors: key -> SQL with columns of their own
RULES = {
    "dead_unused_file": ("dead", unused_file),
    "dead_unused_import_js_named": ("dead", unused_named),
    "dead_unused_import_js_default": ("dead", unused_default),
    "dead_unused_import_py_from": ("dead", unused_from),
    "dead_unused_import_py_alias": ("dead", unused_alias),
    "dead_unused_var": ("dead", unused_var),
    "dead_export": ("dead", dead_export),
    "dead_unused_function": ("dead", unused_function),
    "dup_exact_block": ("duplicates", exact_block),
    "dup_magic_value": ("duplicates", magic_value),
    "name_convention_conflict": ("names", convention_conflict),
    "name_verb_synonym": ("names", verb_synonym),
    "test_no_tests": ("tests", no_tests),
    "test_coverage_pct": ("tests", coverage),
    "test_uncovered_fn": ("tests", uncovered),
    "dep_vulnerable": ("dependencies", vulnerable),
    "custom_rule_match": ("custom", custom),
}
EXTRACTORS = {
    "import_sources": import_sources,
    "dup_block_pairs": block_pairs,
    "fn_names": fn_names,
    "import_edges": import_edges,
    "test_is_test_file": is_test_file,
    "test_names": test_names,
    "test_source_fns": source_fns,
}
#: The rules that show only so many findings, with all of them.
UNCAPPED = {
    "dead_unused_var_uncapped": lambda d: unused_var(d, None),
    "dead_export_uncapped": lambda d: dead_export(d, None),
    "dead_unused_function_uncapped": lambda d: unused_function(d, None),
    "test_uncovered_fn_uncapped": lambda d: uncovered(d, None),
}
#: Over a corpus of projects: key -> SQL with the table of advisories and the project of a path.
DEPENDENCIES = {
    "dep_inventory_npm": lambda d, table, project: npm(d, project),
    "dep_inventory_pypi": lambda d, table, project: pypi(d, project),
    "dep_inventory_go": lambda d, table, project: go_modules(d, project),
    "dep_vulnerable": lambda d, table, project: vulnerable(d, 3, table, project),
    "dep_vulnerable_uncapped": lambda d, table, project: vulnerable(d, None, table, project),
    "upgrade_hint": vulnerable_hints,
}
