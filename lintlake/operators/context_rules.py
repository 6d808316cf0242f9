"""Rules that need more than a line: a window of lines, a whole file, or the order of events in it.

Each function gives SQL over ``lines`` (path, name, lang, wide, line, text) in a dialect, with the columns
file, line, severity and title.
"""

from __future__ import annotations

from collections.abc import Callable

from lintlake.functions.dialect import Dialect, Ordered
from lintlake.model import JS, PY

Select = Callable[[Dialect], str]
_TEST = r"(?i)test|spec|__tests__"


def _out(d: Dialect, severity: str, title: str, source: str, where: str = "TRUE", line: str = "line") -> str:
    """title: SQL; severity: a word, or SQL in parentheses."""
    level = severity if severity.startswith("(") else d.lit(severity)
    return f"SELECT path AS file, CAST({line} AS BIGINT) AS line, {level} AS severity, {title} AS title FROM {source} WHERE {where}"


def _beside(d: Dialect, blocks: dict[str, tuple[int, int]], hit: Callable[[str], str], langs: str = "") -> str:
    """Lines of some languages with the texts of ``blocks`` (name: first and last line behind this one). Spark takes only lines that
    ``hit`` (SQL of a text), in the row of their file: no line is sorted, and no text is joined for a line that has no issue."""
    where = f" WHERE {langs}" if langs else ""
    if isinstance(d, Ordered):  # each line once with each of its surroundings
        texts = "".join(f", body[{k + 1}] AS {n}" for k, n in enumerate(blocks))
        told = d.ask("beside", {"hit": f"{langs or 'TRUE'} AND {hit('text')}"}, f"lang, body[0] AS text{texts}, places", blocks=tuple(blocks.values()))
        return f"(SELECT place.path AS path, place.name AS name, place.line AS line, lang, text{''.join(f', {n}' for n in blocks)} FROM (SELECT *, explode(places) AS place FROM {told}))"
    if d.name != "spark":
        return f"(SELECT *, {', '.join(f'{d.block(*b)} AS {n}' for n, b in blocks.items())} FROM lines{where})"
    text = lambda first, last: f"array_join(slice(ls, greatest(i + 1 + {first}, 1), greatest(i + 1 + {last} - greatest(i + 1 + {first}, 1) + 1, 0)), '\\n')"
    near = {n: text(*b) for n, b in blocks.items()}
    found = f"filter(transform(ls, (t, i) -> CASE WHEN {hit('t')} THEN {d.struct(line='CAST(i + 1 AS BIGINT)', text='t', **near)} END), x -> x IS NOT NULL)"
    return f"(SELECT path, name, lang, wide, x.* FROM (SELECT path, name, lang, wide, explode({d.let('ls', d.split_lines('content'), found)}) AS x FROM files{where}))"


def _events(d: Dialect, lines: str, *any_of: str) -> str:
    """Of ``lines``, in Spark, only those that a window over them asks for: any of some conditions holds."""
    return f"(SELECT * FROM {lines} WHERE {' OR '.join(any_of)})" if d.name == "spark" else lines


# -- windows of lines -------------------------------------------------------------------------------------


def window(langs, here: list[str], first: int, last: int, near: list[tuple[bool, str]], severity: str, title: str, here_not: list[str] = (), path_not: str = "", near_before: tuple[int, int] | None = None) -> Select:
    """A line that matches ``here`` and whose lines first..last after it match (True) or do not match (False) ``near``."""

    def make(d: Dialect) -> str:
        parts = [d.any_of("lang", langs)] + [d.match("text", p) for p in here] + [f"NOT {d.match('text', p)}" for p in here_not]
        parts += [d.match("near", p) if yes else f"NOT {d.match('near', p)}" for yes, p in near]
        if path_not:
            parts.append(f"NOT {d.match('path', path_not)}")
        return _out(d, severity, d.lit(title), _beside(d, {"near": (first, last)}, lambda t: " AND ".join(d.match(t, p) for p in here), parts[0]), " AND ".join(parts[1:]))

    return make


def button_empty(d: Dialect) -> str:
    web = d.any_of("lang", ("html", "jsx", "tsx", "vue", "svelte", "htm"))
    closed = d.match("text", r"(?i)<button\b[^>]*>\s*</button>")
    opened = f"({d.match('text', r'(?i)<button\b[^>]*>')} AND NOT {d.match('text', r'(?i)aria-label\s*=|aria-labelledby\s*=')} AND {d.match('text', r'>\s*$')} AND {d.match('near', '</button>')})"
    said = f"({d.trim('near')} = '</button>' OR {d.match('text', r'(?i)<button[^>]*></button>')})"
    return _out(d, "high", d.lit("<button> has no accessible text"), _beside(d, {"near": (1, 1)}, lambda t: d.match(t, r"(?i)<button\b"), web), f"({closed} OR {opened}) AND {said}")


def swallowed(d: Dialect) -> str:
    return _out(d, "medium", d.lit("Exception silently swallowed (pass)"), _beside(d, {"near": (1, 1)}, lambda t: d.match(t, r"^\s*except\b"), "lang = 'py'"), f"{d.match('text', r'^\s*except\b')} AND {d.trim('near')} IN ('pass', '')")


def async_no_try(d: Dialect) -> str:
    return window(JS, [r"\basync\s+function\s+\w+|const\s+\w+\s*=\s*async"], 0, 39, [(False, r"\btry\s*\{")], "low", "Async function without try/catch")(d)


def regex_long(d: Dialect) -> str:
    pattern = r"/([^/\n]{80,})/[gimsuy]*"
    title = f"concat('Complex regex (', CAST(length({d.extract('text', pattern)}) AS STRING), ' chars) — needs a comment')"
    return _out(d, "low", title, _beside(d, {"near": (-1, -1)}, lambda t: f"length({t}) > 80 AND {d.match(t, pattern)}"), f"{d.match('text', pattern)} AND NOT {d.match('near', '//|#')}")


def restated_doc(d: Dialect) -> str:
    name = d.extract("text", r"^\s*def\s+(\w+)\s*\(")
    after = d.trim("near")
    doc = f"lower({d.trim(d.replace(d.replace(after, '^[\'\"`]{1,3}', ''), '[\'\"`]{1,3}$', ''))})"
    plain = f"lower({d.replace(name, '_', ' ')})"
    same = f"({doc} = {plain} OR {d.replace(doc, r'\s+', '')} = {d.replace(plain, r'\s+', '')})"
    quoted = d.match(after, "^(?:\"\"\"|''')")
    return _out(d, "low", f"concat('Docstring just restates function name: ', {name})", _beside(d, {"near": (1, 1)}, lambda t: d.match(t, r"^\s*def\s+\w+\s*\("), "lang = 'py'"), f"{d.match('text', r'^\s*def\s+\w+\s*\(')} AND {quoted} AND {doc} <> '' AND {same}", "line + 1")


def list_comp(d: Dialect) -> str:
    name = d.extract("text", r"^\s*(\w+)\s*=\s*\[\s*\]")
    # what is appended to in the next four lines, as one text of marked names
    calls = d.replace("near", r"(\w+)\.append\s*\(", "<$1>")
    source = _beside(d, {"near": (1, 4), "after": (1, 1)}, lambda t: d.match(t, r"^\s*\w+\s*=\s*\[\s*\]"), "lang = 'py'")
    where = f"{d.match('text', r'^\s*\w+\s*=\s*\[\s*\]')} AND {d.match('after', r'^\s*for\s')} AND {d.match('near', r'\.append\s*\(')} AND (contains({calls}, concat({name}, '>')))"
    title = f"concat({d.lit("Use list comprehension instead of append loop for '")}, {name}, {d.lit("'")})"
    return _out(d, "low", title, source, where + f" AND NOT {d.match('path', _TEST)}")


def growing_attr(d: Dialect) -> str:
    name = d.extract("text", r"\bself\.(\w+)\s*=\s*(?:\[\s*\]|\{\s*\})")
    source = _beside(d, {"back": (-30, -1), "fore": (1, 79)}, lambda t: d.match(t, r"\bself\.\w+\s*="), "lang = 'py'")
    both = "concat(back, ' ', fore)"
    grows = f"contains({d.replace(both, r'self\.(\w+)\.(?:append|extend|update)\s*\(', '<+$1>')}, concat('<+', {name}, '>'))"
    cleared = f"contains({d.replace(both, r'self\.(\w+)(?:\.(?:clear|pop|remove)\s*\(|\s*=\s*\[)', '<-$1>')}, concat('<-', {name}, '>'))"
    own = d.match("text", r"^\s+self\.\w+\s*=\s*\[\s*\]|\bself\.\w+\s*=\s*\{\s*\}")
    return _out(d, "low", f"concat('self.', {name}, ' grows but is never cleared')", source, f"{own} AND {grows} AND NOT {cleared} AND NOT {d.match('path', _TEST)}")


def use_effect(d: Dialect) -> str:
    return window(JS, [r"useEffect\s*\(\s*(?:async\s*)?\(\s*\)\s*=>"], 0, 24, [(False, r"return\s*\(\s*\)\s*=>|return\s*function"), (True, r"addEventListener|setInterval|setTimeout|subscribe|on\(")], "medium", "useEffect with subscription but no cleanup return")(d)


# -- one event after another ---------------------------------------------------------------------------


def in_loop(langs, start: str, hit: str, reset: str, severity: str, title: str, path_not: str = "") -> Select:
    """The first line of each loop that matches ``hit``: a loop opens at ``start``, and closes at ``reset`` or a hit."""

    def make(d: Dialect) -> str:
        if isinstance(d, Ordered):
            of = d.any_of("lang", langs)
            found = d.ask("in_loop", {n: f"{of} AND {d.match('text', p)}" for n, p in (("opens", start), ("hits", hit), ("closes", reset))})
            return _out(d, severity, d.lit(title), found, f"NOT {d.match('path', path_not)}" if path_not else "TRUE")
        flags = f"(SELECT *, {d.match('text', start)} AS opens, {d.match('text', hit)} AS hits, {d.match('text', reset)} AS closes FROM lines WHERE {d.any_of('lang', langs)})"
        events = f"(SELECT *, CASE WHEN hits OR closes THEN 0 WHEN opens THEN 1 END AS event FROM {_events(d, flags, 'hits', 'closes', 'opens')})"
        seen = f"(SELECT *, {d.last_seen('event')} AS before FROM {events})"
        return _out(d, severity, d.lit(title), seen, "hits AND (opens OR before = 1)" + (f" AND NOT {d.match('path', path_not)}" if path_not else ""))

    return make


def naked_return(d: Dialect) -> str:
    if isinstance(d, Ordered):
        func = f"lang = 'go' AND {d.match('text', r'^func\s')}"
        found = d.ask("soon_after", {"before": func, "named": f"{func} AND {d.match('text', r'\)\s*\(')}", "hits": f"lang = 'go' AND {d.match('text', r'^\s*return\s*$')}"}, most=30)
        return _out(d, "low", d.lit("Naked return — reduces readability"), found)
    marks = f"(SELECT *, CASE WHEN {d.match('text', r'^func\s')} THEN line END AS fn_line, CASE WHEN {d.match('text', r'^func\s')} THEN CASE WHEN {d.match('text', r'\)\s*\(')} THEN 1 ELSE 0 END END AS named FROM {_events(d, 'lines', d.match('text', r'^func\s'), d.match('text', r'^\s*return\s*$'))} WHERE lang = 'go')"
    seen = f"(SELECT *, {d.last_seen('fn_line')} AS fn_at, {d.last_seen('named')} AS fn_named FROM {marks})"
    return _out(d, "low", d.lit("Naked return — reduces readability"), seen, f"{d.match('text', r'^\s*return\s*$')} AND fn_named = 1 AND line - fn_at <= 30")


def module_global(d: Dialect) -> str:
    top = f"min(CASE WHEN {d.match('text', r'^(?:class|def)\s')} THEN line END) OVER (PARTITION BY path)"
    name = d.extract("text", r"^([a-z_]\w*)\s*=")
    said = f"{d.match('text', r'^[a-z_]\w*\s*=\s*.+')} AND NOT {d.match('text', r'^[a-z_]\w*\s*=\s*(?:lambda|None)')} AND {name} NOT IN ('self', 'cls', '__all__')"
    if isinstance(d, Ordered):
        found = d.ask("until", {"until": f"lang = 'py' AND {d.match('text', r'^(?:class|def)\s')}", "hits": f"lang = 'py' AND {said}", "name": f"CASE WHEN lang = 'py' AND {said} THEN {name} END"}, "path, line, name")
        return _out(d, "low", "concat('Module-level mutable variable: ', name)", found)
    where = f"{said} AND (top IS NULL OR line < top)"
    return _out(d, "low", f"concat('Module-level mutable variable: ', {name})", f"(SELECT *, {top} AS top FROM {_events(d, 'lines', d.match('text', r'^(?:class|def)\s'), d.match('text', r'^[a-z_]\w*\s*='))} WHERE lang = 'py')", where)


def buried_import(d: Dialect) -> str:
    if isinstance(d, Ordered):
        of = d.any_of("lang", (*JS, "mjs"))
        found = d.ask("behind", {"before": f"{of} AND {d.match('text', r'^\s*(?:function|class|if|for|while|\{)')}", "hits": f"{of} AND {d.match('text', r'^\s+')} AND {d.match('text', r'\b(?:require|import)\s*\(')}"})
        return _out(d, "low", d.lit("Import buried inside function/block"), found)
    opener = f"max(CASE WHEN {d.match('text', r'^\s*(?:function|class|if|for|while|\{)')} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return _out(d, "low", d.lit("Import buried inside function/block"), f"(SELECT *, {opener} AS inner_ FROM {_events(d, 'lines', d.match('text', r'^\s*(?:function|class|if|for|while|\{)'), d.match('text', r'\b(?:require|import)\s*\('))} WHERE {d.any_of('lang', (*JS, 'mjs'))})", f"{d.match('text', r'^\s+')} AND {d.match('text', r'\b(?:require|import)\s*\(')} AND inner_ = 1")


def repeated_import(langs, pattern: str) -> Select:
    def make(d: Dialect) -> str:
        text = d.trim("text")
        if isinstance(d, Ordered):
            return _out(d, "low", "concat('Duplicate import: ', name)", d.ask("again", {"name": f"CASE WHEN {d.any_of('lang', langs)} AND {d.match(text, pattern)} THEN {d.extract(text, pattern)} END"}, "path, line, name"))
        source = f"(SELECT *, {d.extract(text, pattern)} AS module FROM lines WHERE {d.any_of('lang', langs)} AND {d.match(text, pattern)})"
        ranked = f"(SELECT *, row_number() OVER (PARTITION BY path, module ORDER BY line) AS nth FROM {source})"
        return _out(d, "low", "concat('Duplicate import: ', module)", ranked, "nth > 1")

    return make


def commented_code(d: Dialect) -> str:
    stripped = d.replace("text", r"^\s*(?://|#)\s*", "")
    code = " OR ".join(d.match("stripped", p) for p in (r"^\s*(?:const|let|var|def|return|if|for|while|import|from|function|class)\s", r";\s*$|\(\s*\)|=>\s*\{|\)\s*\{", r"\w+\s*\(.*\)|=\s*\w+\s*[;,]"))
    said = f"{d.match('text', r'^\s*(?://|#)')} AND NOT {d.match('text', r'(?i)(?://|#|<!--)\s*(?:TODO|FIXME|HACK|BUG|XXX|OPTIMIZE)\b')}"
    if isinstance(d, Ordered):
        return _out(d, "low", d.lit("Commented-out code block"), d.ask("runs", {"hits": f"{said} AND {d.let('stripped', stripped, code)}"}, least=3))
    source = f"(SELECT * FROM (SELECT *, {stripped} AS stripped FROM lines) WHERE {said} AND ({code}))"
    islands = f"(SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS island FROM {source})"
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY path, island ORDER BY line) AS nth FROM {islands})"
    return _out(d, "low", d.lit("Commented-out code block"), ranked, "nth = 3", "line - 2")


def todo(d: Dialect) -> str:
    pattern = r"(?i)(?://|#|<!--)\s*(TODO|FIXME|HACK|BUG|XXX|OPTIMIZE)\b\s*:?\s*(.{0,120})"
    tag, said = f"upper({d.extract('text', pattern, 1)})", d.trim(d.extract("text", pattern, 2))
    source = f"(SELECT path, line, {tag} AS tag, CASE WHEN {said} = '' THEN '(no description)' ELSE {said} END AS said FROM lines WHERE {d.match('text', pattern)})"
    return _out(d, "(CASE WHEN tag IN ('FIXME', 'BUG') THEN 'medium' ELSE 'low' END)", "concat(tag, ': ', substring(said, 1, 60), CASE WHEN length(said) > 60 THEN '…' ELSE '' END)", source)


# -- whole files -----------------------------------------------------------------------------------------


def counted(langs, pattern: str, least: int, title: str, path_not: str = _TEST, plural: bool = False) -> Select:
    """One issue for a file with at least ``least`` lines that match, at the first; ``%d`` in the title is their number."""

    def make(d: Dialect) -> str:
        before, _, after = title.partition("%d")
        middle = "CASE WHEN n > 1 THEN 's' ELSE '' END" if plural else "''"
        a, _, b = after.partition("%s")
        text = f"concat({d.lit(before)}, CAST(n AS STRING), {d.lit(a)}, {middle}, {d.lit(b)})"
        if isinstance(d, Ordered):
            told = d.ask("counts", {"hits": f"{d.any_of('lang', langs)} AND {d.match('text', pattern)}"}, "path, n, line")
            return _out(d, "low", text, f"(SELECT path, sum(n) AS n, min(line) AS line FROM {told} WHERE NOT {d.match('path', path_not)} GROUP BY path)", f"n >= {least}")
        source = f"(SELECT path, count(*) AS n, min(line) AS line FROM lines WHERE {d.any_of('lang', langs)} AND NOT {d.match('path', path_not)} AND {d.match('text', pattern)} GROUP BY path)"
        return _out(d, "low", text, source, f"n >= {least}")

    return make


def first_in_python(pattern: str, title: str, unless: str = "", also: str = "") -> Select:
    """The first matching line of a Python file, if the file has no line like ``unless`` and one like ``also``."""

    def make(d: Dialect) -> str:
        if isinstance(d, Ordered):
            marks = {n: f"lang = 'py' AND {d.match('text', p)}" for n, p in (("hits", pattern), ("unless", unless), ("also", also)) if p}
            return _out(d, "high", d.lit(title), d.ask("first", marks, narrow=True))
        more = "".join(f", max(CASE WHEN {d.match('text', p)} THEN 1 ELSE 0 END) AS {n}" for p, n in ((unless, "bad"), (also, "good")) if p)
        lines = _events(d, "lines", *(d.match("text", p) for p in (pattern, unless, also) if p))
        source = f"(SELECT path, min(CASE WHEN {d.match('text', pattern)} THEN line END) AS line{more} FROM {lines} WHERE lang = 'py' AND NOT wide GROUP BY path)"
        where = "line IS NOT NULL" + " AND bad = 0" * bool(unless) + " AND good = 1" * bool(also)
        return _out(d, "high", d.lit(title), source, where)

    return make


def insecure_random(d: Dialect) -> str:
    if isinstance(d, Ordered):
        marks = {"hits": d.match("text", r"Math\.random\s*\(\s*\)"), "also": d.match("text", "(?i)(?:token|secret|password|key|nonce|salt|session|csrf)")}
        return _out(d, "medium", d.lit("Insecure Randomness"), d.ask("every", marks, narrow=True))
    flag = f"max(CASE WHEN {d.match('text', '(?i)(?:token|secret|password|key|nonce|salt|session|csrf)')} THEN 1 ELSE 0 END) OVER (PARTITION BY path)"
    return _out(d, "medium", d.lit("Insecure Randomness"), f"(SELECT *, {flag} AS secret FROM {_events(d, 'lines', d.match('text', '(?i)(?:token|secret|password|key|nonce|salt|session|csrf)'), d.match('text', r'Math\.random\s*\(\s*\)'))} WHERE NOT wide)", f"secret = 1 AND {d.match('text', r'Math\.random\s*\(\s*\)')}")


MARKED = "(?i)TODO|FIXME|HACK|XXX"


def todo_density(d: Dialect) -> str:
    source = f"(SELECT path, 1 AS line, sum(CASE WHEN {d.match('text', MARKED)} THEN 1 ELSE 0 END) AS n, count(*) AS total FROM lines GROUP BY path)"
    if d.name == "spark":
        marked = d.size(d.filter(d.split_lines("content"), "t", d.match("t", MARKED)))
        each = "SELECT path, n, n_lines AS total FROM ordered WHERE kind = 'todo'" if isinstance(d, Ordered) else f"SELECT path, {marked} AS n, lines AS total FROM files"
        source = f"(SELECT path, 1 AS line, sum(n) AS n, sum(total) AS total FROM ({each}) GROUP BY path)"
    share = "CAST(floor(100.0 * n / total + 0.5) AS BIGINT)"
    return _out(d, "medium", f"concat('High TODO density: ', CAST(n AS STRING), ' TODOs in ', CAST(total AS STRING), ' lines (', CAST({share} AS STRING), '%)')", source, "n >= 5 AND 1.0 * n / total > 0.05")


def unpaired(on: str, off: str, most: int, title: str) -> Select:
    """The first lines of a JavaScript file that match ``on``, if none matches ``off``."""

    def make(d: Dialect) -> str:
        if isinstance(d, Ordered):
            marks = {n: f"{d.any_of('lang', JS)} AND {d.match('text', p)}" for n, p in (("hits", on), ("unless", off))}
            return _out(d, "medium", d.lit(title), d.ask("every", marks, "path, line, n"), f"n <= {most}")
        flags = f"(SELECT path, line, {d.match('text', on)} AS hit, max(CASE WHEN {d.match('text', off)} THEN 1 ELSE 0 END) OVER (PARTITION BY path) AS paired FROM {_events(d, 'lines', d.match('text', on), d.match('text', off))} WHERE {d.any_of('lang', JS)})"
        ranked = f"(SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) AS nth FROM {flags} WHERE hit AND paired = 0)"
        return _out(d, "medium", d.lit(title), ranked, f"nth <= {most}")

    return make


def growing_collection(d: Dialect) -> str:
    declared = r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:\[\s*\]|new\s+Map\s*\(|new\s+Set\s*\()"
    names = f"SELECT path, line, {d.extract('text', declared)} AS name FROM lines WHERE {d.any_of('lang', JS)} AND {d.match('text', declared)}"
    used = d.unnest(f"(SELECT path, {d.extract_all('text', r'(\w+)\.(?:clear|delete|splice|pop|shift)\s*\(')} AS hits FROM lines WHERE {d.any_of('lang', JS)})", "hits", "name", "path")
    reset = d.unnest(f"(SELECT path, line AS spot, {d.extract_all('text', r'(\w+)\s*=\s*\[')} AS hits FROM lines WHERE {d.any_of('lang', JS)})", "hits", "name", "path, spot")
    title = f"concat({d.lit("Module-level collection '")}, name, {d.lit("' may grow unboundedly")})"
    source = f"({names}) AS n"
    where = f"NOT EXISTS (SELECT 1 FROM ({used}) AS u WHERE u.path = n.path AND u.name = n.name) AND NOT EXISTS (SELECT 1 FROM ({reset}) AS r WHERE r.path = n.path AND r.name = n.name AND r.spot <> n.line)"
    return _out(d, "low", title, source, where)


def untyped(d: Dialect) -> str:
    """Shared source: untyped Python functions with their number in the file."""
    head = r"^\s*def\s+(\w+)\s*\(([^)]*)\)"
    params = d.extract("text", head, 2)
    typed = f"({d.match(params, r':\s*\w')} OR {d.trim(params)} IN ('', 'self', 'cls'))"
    returns = f"({d.match('text', '->')} OR {d.match('near', '->')})"
    lines = _beside(d, {"near": (1, 1)}, lambda t: d.match(t, head), "lang = 'py'")
    return f"(SELECT path, name, line, {d.extract('text', head, 1)} AS fn, row_number() OVER (PARTITION BY path ORDER BY line) AS nth, count(*) OVER (PARTITION BY path) AS n FROM {lines} WHERE {d.match('text', head)} AND (NOT {typed} OR NOT {returns}))"


def untyped_each(d: Dialect) -> str:
    return _out(d, "low", "concat('Untyped function: ', fn, '()')", untyped(d), "nth <= 8 AND n <= 10")


def untyped_summary(d: Dialect) -> str:
    return _out(d, "medium", "concat(CAST(n AS STRING), ' untyped functions in ', name, ' — consider adding type hints')", untyped(d), "n > 10 AND nth = 1", "1")


def external_url(d: Dialect) -> str:
    # hosts that do not count lose their scheme first: there is no look-ahead in the shared pattern language
    masked = d.replace("text", r"http(s?)://(cdn\.|fonts\.|githubusercontent\.com|unpkg\.com|cdnjs\.)", "hxxp$1://$2")
    pattern = r"""['"`]https?://([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})(?::\d+)?/[^'"`]{0,60}['"`]"""
    source = f"(SELECT path, line, {d.extract(masked, pattern, 0)} AS whole, {d.extract(masked, pattern, 1)} AS host FROM lines)"
    return _out(d, "low", "concat('Hardcoded URL: ', host)", source, f"whole <> '' AND NOT {d.match('whole', r'test|spec|example\.com|localhost')}")


# Names that say nothing, and short names that do.
_MEANINGLESS = (
    "foo", "bar", "baz", "test", "temp", "tmp", "data", "val", "ret", "res", "obj", "ptr", "ref", "buf", "p", "q", "r",
    "s", "t", "n", "m", "x2", "y2", "a1", "b1", "helper", "util", "stuff", "thing", "misc", "other", "handle",
    "process2", "update2", "init2", "setup2",
)
_SHORT = ("is", "on", "do", "go", "db", "fs", "io")


def _fn_name(d: Dialect) -> str:
    js = f"CASE WHEN {d.match('text', r'function\s+\w+\s*\(')} THEN {d.extract('text', r'function\s+(\w+)\s*\(')} ELSE {d.extract('text', r'(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(')} END"
    return f"(SELECT path, line, CASE WHEN lang = 'py' THEN {d.extract('text', r'def\s+(\w+)\s*\(')} ELSE {js} END AS fn FROM lines WHERE {d.any_of('lang', (*JS, *PY))})"


def name_meaningless(d: Dialect) -> str:
    return _out(d, "low", "concat('Meaningless function name: ', fn, '()')", _fn_name(d), d.any_of("lower(fn)", _MEANINGLESS))


def name_short(d: Dialect) -> str:
    return _out(d, "low", "concat('Too short function name: ', fn, '()')", _fn_name(d), f"fn <> '' AND length(fn) <= 2 AND NOT {d.any_of('lower(fn)', _SHORT)}")


def chain(d: Dialect) -> str:
    source = f"(SELECT path, line, {d.count('text', r'\.(?:filter|map|reduce|forEach|find|some|every)\s*\(')} AS n FROM lines WHERE {d.any_of('lang', JS)})"
    return _out(d, "low", "concat(CAST(n AS STRING), '-step array chain — consider single .reduce() pass')", source, "n >= 3")


def long_file(d: Dialect, limit: int = 300) -> str:
    source = f"(SELECT path, 1 AS line, {'sum(lines) AS n FROM files' if d.name == 'spark' else 'count(*) AS n FROM lines'} GROUP BY path)"
    return _out(d, f"(CASE WHEN n > {2 * limit} THEN 'high' ELSE 'medium' END)", "concat('Long file — ', CAST(n AS STRING), ' lines')", source, f"n > {limit}")


def _deepest(d: Dialect) -> str:
    """Spark: ``path, line, depth`` of the first of the deepest lines of each file, found in its row."""
    if isinstance(d, Ordered):
        return "(SELECT path, found.depth AS depth, -found.back AS line FROM (SELECT path, max(struct(n AS depth, -line AS back)) AS found FROM ordered WHERE kind = 'nesting' GROUP BY path))"
    indent = f"CAST((length(t) - length({d.replace('t', r'^\s+', '')})) div 4 AS BIGINT)"
    place = lambda depth, line: d.struct(depth=depth, back=f"-CAST({line} AS BIGINT)")
    py = f"array_max(transform(ls, (t, i) -> CASE WHEN {d.match('t', r'\S')} AND NOT {d.match('t', r'^\s*#')} THEN {place(indent, 'i + 1')} END))"
    now = "greatest(0L, b.depth + CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END)"
    within = f"aggregate(split({d.replace('t', r'[^{}]', '')}, ''), {d.struct(depth='a.depth', top='0L')}, (b, c) -> {d.let('z', now, d.struct(depth='z', top='greatest(b.top, z)'))})"
    after = d.let("w", within, d.struct(line="a.line + 1", depth="w.depth", top="greatest(a.top, w.top)", at="CASE WHEN w.top > a.top THEN a.line + 1 ELSE a.at END"))
    counts = f"(contains(t, '{{') OR contains(t, '}}')) AND NOT {d.match('t', r'^\s*//|^\s*\*')}"
    zero = d.struct(line="0L", depth="0L", top="0L", at="0L")
    other = f"aggregate(ls, {zero}, (a, t) -> CASE WHEN {counts} THEN {after} ELSE {d.struct(line='a.line + 1', depth='a.depth', top='a.top', at='a.at')} END, a -> {place('a.top', 'a.at')})"
    each = f"(SELECT path, CASE WHEN lang = 'py' THEN {py} ELSE {other} END AS found FROM (SELECT path, lang, {d.split_lines('content')} AS ls FROM files))"
    return f"(SELECT path, found.depth AS depth, -found.back AS line FROM (SELECT path, max(found) AS found FROM {each} GROUP BY path))"


def deep_nesting(d: Dialect, limit: int = 4) -> str:
    """Python: indents of four. Elsewhere braces, whose depth never falls below 0: the running sum less its least value."""
    if d.name == "spark":
        return _out(d, "(CASE WHEN depth > 6 THEN 'high' ELSE 'medium' END)", "concat('Deep nesting — ', CAST(depth AS STRING), ' levels')", _deepest(d), f"depth > {limit}")
    indent = f"CAST(floor((length(text) - length({d.replace('text', r'^\s+', '')})) / 4.0) AS BIGINT)"
    py = f"SELECT path, line, {indent} AS depth FROM lines WHERE lang = 'py' AND {d.trim('text')} <> '' AND NOT {d.match('text', r'^\s*#')}"
    braces = d.replace("text", r"[^{}]", "")
    some = f"(SELECT path, line, {braces} AS marks FROM lines WHERE lang <> 'py' AND NOT {d.match('text', r'^\s*//|^\s*\*')} AND {d.match('text', r'[{}]')})"
    each = d.unnest(some, d.series("length(marks)"), "spot", "path, line, marks")
    step = f"(SELECT path, line, spot, CASE WHEN substring(marks, CAST(spot AS INT), 1) = '{{' THEN 1 ELSE -1 END AS step FROM ({each}))"
    total = f"(SELECT *, sum(step) OVER (PARTITION BY path ORDER BY line, spot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM {step})"
    least = f"(SELECT *, min(total) OVER (PARTITION BY path ORDER BY line, spot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM {total})"
    other = f"SELECT path, line, CAST(total - CASE WHEN low < 0 THEN low ELSE 0 END AS BIGINT) AS depth FROM {least}"
    ranked = f"(SELECT path, line, depth, row_number() OVER (PARTITION BY path ORDER BY depth DESC, line) AS nth, count(*) OVER (PARTITION BY path) AS n FROM ({py} UNION ALL {other}))"
    return _out(d, "(CASE WHEN depth > 6 THEN 'high' ELSE 'medium' END)", "concat('Deep nesting — ', CAST(depth AS STRING), ' levels')", ranked, f"nth = 1 AND depth > {limit}")


_LOOP, _CLOSE = r"^\s*(?:for|while)\s*\(", r"^\s*\}"

# The rules' patterns, severities and titles.
RULES: dict[str, tuple[str, Select]] = {
    "sec_insecure_random": ("security", insecure_random),
    "sec_py_eval": ("security", first_in_python(r"\beval\s*\(", "Python eval()")),
    "sec_py_exec": ("security", first_in_python(r"\bexec\s*\(", "Python exec()")),
    "sec_py_pickle": ("security", first_in_python(r"\bpickle\.load", "Pickle Deserialization")),
    "sec_py_shell_true": ("security", first_in_python(r"subprocess\.\w+\([^)]*shell\s*=\s*True", "Shell Injection Risk")),
    "sec_py_os_system": ("security", first_in_python(r"\bos\.(?:system|popen)\s*\(", "OS Command Execution")),
    "sec_py_yaml_load": ("security", first_in_python(r"\byaml\.load\s*\(", "Unsafe YAML Load", unless=r"yaml\.safe_load")),
    "sec_py_tls_off": ("security", first_in_python(r"verify\s*=\s*False", "TLS Verification Disabled", also=r"\brequests\.")),
    "smell_long_file": ("smells", long_file),
    "smell_deep_nesting": ("smells", deep_nesting),
    "lang_py_print": ("language", counted(PY, r"^\s*print\s*\(", 1, "%d print() statement%s — use logging", plural=True)),
    "lang_py_module_global": ("language", module_global),
    "lang_js_console": ("language", counted(JS, r"console\.(?:log|debug|info|warn)\s*\(", 4, "%d console.log statements — remove before production")),
    "lang_go_fmt_print": ("language", counted(("go",), r"fmt\.(?:Print|Println|Printf)\s*\(", 3, "%d fmt.Print statements — use log or slog")),
    "lang_go_naked_return": ("language", naked_return),
    "lang_java_sysout": ("language", counted(("java",), r"System\.out\.(?:print|println|printf)\s*\(", 1, "%d System.out.println — use SLF4J/Logback")),
    "pat_url_external": ("patterns", external_url),
    "pat_name_meaningless": ("patterns", name_meaningless),
    "pat_name_short": ("patterns", name_short),
    "pat_regex_long": ("patterns", regex_long),
    "pat_todo_density": ("patterns", todo_density),
    "err_js_empty_catch": ("errors", window(JS, [r"\}\s*catch\s*\([^)]*\)\s*\{"], 1, 1, [(True, r"\}\s*$")], "medium", "Empty catch block")),
    "err_js_then_no_catch": ("errors", window(JS, [r"\.then\s*\("], 1, 5, [(False, r"\.catch\s*\(")], "low", "Promise .then() without .catch()", here_not=[r"\.catch\s*\("])),
    "err_js_promise_no_reject": ("errors", window(JS, [r"new\s+Promise\s*\("], 0, 14, [(False, r"reject\s*\(")], "low", "new Promise() never calls reject()")),
    "err_js_async_no_try": ("errors", async_no_try),
    "err_py_swallowed": ("errors", swallowed),
    "err_py_print_only": ("errors", window(PY, [r"^\s*except\b"], 1, 3, [(True, r"^\s*print\s*\("), (False, "raise|return|logging|logger")], "low", "Exception printed but not logged or re-raised")),
    "type_py_untyped": ("types", untyped_each),
    "type_py_untyped_summary": ("types", untyped_summary),
    "com_todo": ("comments", todo),
    "com_dead_code": ("comments", commented_code),
    "com_restated_doc": ("comments", restated_doc),
    "imp_js_buried": ("imports", buried_import),
    "imp_js_duplicate": ("imports", repeated_import((*JS, "mjs"), r"""^import\s+.+\s+from\s+['"]([^'"]+)['"]""")),
    "imp_py_duplicate": ("imports", repeated_import(PY, r"^(?:import|from)\s+([\w.]+)")),
    "imp_java_duplicate": ("imports", repeated_import(("java", "cs", "kt"), r"^import\s+([\w.]+)")),
    "mem_js_listener": ("memory", unpaired(r"\.addEventListener\s*\(", r"\.removeEventListener\s*\(", 3, "addEventListener without removeEventListener")),
    "mem_js_interval": ("memory", unpaired(r"\bsetInterval\s*\(", r"\bclearInterval\s*\(", 2, "setInterval without clearInterval")),
    "mem_js_timeout_loop": ("memory", in_loop(JS, _LOOP, r"\bsetTimeout\s*\(", _CLOSE, "low", "setTimeout inside a loop — creates N timers")),
    "mem_js_growing_collection": ("memory", growing_collection),
    "mem_js_use_effect": ("memory", use_effect),
    "mem_py_db_conn": ("memory", window(PY, [r"\b(?:connect|create_engine|psycopg2|pymysql|sqlite3\.connect)\s*\("], 0, 29, [(False, r"\.close\s*\(\s*\)|with\s+")], "medium", "Database connection may not be closed", path_not=_TEST)),
    "mem_py_growing_attr": ("memory", growing_attr),
    "perf_js_mutation_in_iter": ("performance", window(JS, [r"\.(?:map|filter|forEach|reduce)\s*\("], 0, 7, [(True, r"\bpush\s*\(|\bsplice\s*\(|\bpop\s*\(|\bshift\s*\(|\bunshift\s*\(")], "low", "Array mutation inside .map()/.filter() — use reduce or a for loop")),
    "perf_js_json_in_loop": ("performance", in_loop(JS, _LOOP, r"JSON\.(?:parse|stringify)\s*\(", _CLOSE, "medium", "JSON.parse/stringify inside a loop — performance bottleneck")),
    "perf_js_sync_xhr": ("performance", window(JS, ["XMLHttpRequest"], 0, 4, [(True, r"open\s*\(.+false")], "high", "Synchronous XMLHttpRequest blocks the UI thread")),
    "perf_js_dom_in_loop": ("performance", in_loop(JS, _LOOP, r"document\.(?:querySelector|getElementById|getElementsBy)\s*\(", _CLOSE, "medium", "DOM query inside a loop — cache the result outside")),
    "perf_js_chain": ("performance", chain),
    "perf_jsx_missing_key": ("performance", window(("jsx", "tsx"), [r"\.map\s*\("], 0, 5, [(True, r"<\w"), (False, r"key\s*=")], "medium", "React: missing key prop in list render")),
    "perf_py_concat_loop": ("performance", in_loop(PY, r"^\s*for\s", r"""\bstr\s*\+=|\bresult\s*\+=\s*['"]|\btext\s*\+=""", r"^\S", "medium", "String concatenation in loop — O(n²) memory copies", _TEST)),
    "perf_py_list_comp": ("performance", list_comp),
    "perf_py_regex_loop": ("performance", in_loop(PY, r"^\s*for\s", r"re\.(?:compile|match|search|findall|sub)\s*\(", r"^\S", "medium", "Regex operation inside loop — compile outside for ~2× speedup", _TEST)),
    "perf_go_concat_loop": ("performance", in_loop(("go",), r"^\s*for\s", r"""\bstr\s*\+=|\bresult\s*\+=\s*\"""", r"^\S", "medium", "String concatenation in loop — use strings.Builder")),
    "a11y_button_empty": ("accessibility", button_empty),
    "a11y_form_name": ("accessibility", window(("html", "jsx", "tsx", "vue", "svelte", "htm"), [r"(?i)<form\b[^>]*>"], 0, 4, [(False, r"(?i)<legend\b|<fieldset\b")], "low", "<form> without accessible name", here_not=[r"(?i)aria-label\s*=|aria-labelledby\s*="])),
}
