"""From issues to reports: scores, summaries, filters, top lists and exchange formats, as SQL in either dialect.

Every function takes a dialect and gives SQL over ``files``, ``lines`` and ``issues`` (category, rule, file, line,
severity, title); ``with_issues`` makes the last from the line rules, deduplicated as their categories ask.
"""

from __future__ import annotations

from lintlake.functions import highlight
from lintlake.functions.dialect import Dialect, Ordered
from lintlake.model import CYCLE_PENALTY, DEDUP, JS, NOT_SCORED, OTHER_MINUTES, OTHER_PENALTY, SEVERITY
from lintlake.operators import line_rules
from lintlake.sources import repeats

# What each report shows.
SARIF_CATEGORIES = ("security", "dead", "smells", "complexity", "duplicates", "dependencies", "language", "errors", "types", "patterns", "performance")
FIX_CATEGORIES = ("dead", "security", "dependencies", "duplicates", "smells", "complexity", "language", "patterns", "errors", "types", "comments")
QUICK_CATEGORIES = ("comments", "imports", "dead", "language", "types")
SKIP_DIRS = (
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "out", ".next", ".nuxt", "coverage", "__pycache__", ".venv",
    "venv", "env", "vendor", "target", "bin", "obj", ".idea", ".vscode",
)
SKIP_EXTS = (
    "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "woff", "woff2", "ttf", "eot", "mp3", "mp4", "avi", "mov", "zip",
    "tar", "gz", "rar", "pdf", "exe", "dll", "so", "dylib", "lock", "map",
)


# What a title (lower case) speaks of, and how that is mended in Python, in JavaScript and elsewhere.
FIX_KEYS = [
    ("secret|credential|key|token|password", "hardcoded_secret"), ("sql|injection", "sql_injection"), ("eval", "eval"), ("xss|innerhtml|dangerously", "xss"), ("tls|ssl|verify", "tls"),
    ("pickle", "pickle"), ("shell=true|subprocess", "subprocess_shell"),
]
_ELSE = None
FIXES = {
    "hardcoded_secret": ('Use `os.getenv("KEY")` or python-dotenv: `from dotenv import load_dotenv`', _ELSE, "Use `process.env.KEY` and a `.env` file with dotenv"),
    "sql_injection": ('Use parameterized queries: `cursor.execute("SELECT * WHERE id=?", (user_id,))`', _ELSE, "Use prepared statements or an ORM — never concatenate user input into SQL"),
    "eval": ("Replace with `ast.literal_eval()` for data, or `json.loads()` for JSON", _ELSE, "Replace eval() with JSON.parse(), a lookup table, or proper data structures"),
    "xss": (_ELSE, "Use `element.textContent = text` instead of innerHTML, or sanitize with DOMPurify", "Escape HTML output and use a template engine with auto-escaping"),
    "tls": (_ELSE, _ELSE, "Never disable SSL verification in production — fix the certificate chain instead"),
    "pickle": (_ELSE, _ELSE, "Replace pickle with JSON, msgpack, or a safe serialization format"),
    "subprocess_shell": (_ELSE, _ELSE, "Use `subprocess.run([cmd, arg1, arg2], shell=False)` — pass args as a list"),
}
# Title (lower case), languages, and the command before and behind the file's name; advice on the whole project.
COMMANDS = [
    ("unused import", ("py",), "autoflake --remove-all-unused-imports --in-place ", ""),
    ("unused import", JS, "npx eslint --fix ", " --rule 'no-unused-vars: error'"),
    ("wildcard import", ("py",), "isort ", ""),
    ("duplicate import", ("py",), "isort --force-single-line-imports ", ""),
    (r"console\.log|debug statement", JS, "npx eslint --fix ", " --rule 'no-console: error'"),
    ("loose equality", JS, "npx eslint --fix ", " --rule 'eqeqeq: error'"),
    ("import inside function", ("py",), "isort ", ""),
]
ARCHITECTURE = {
    "layers": "Apply layered architecture: separate concerns into api/, services/, repositories/, and models/ directories",
    "cycles": "Introduce dependency injection to break circular imports — pass dependencies as constructor/function arguments instead of importing directly",
    "god": ("Split god files (", ") into smaller single-responsibility modules"),
    "secrets": "Centralise credentials and auth config into a single secrets manager or config module — never inline them",
    "python": "Use __init__.py to define clean public APIs for each package — avoid importing implementation details across packages",
    "js": "Create a barrel file (index.ts) per feature folder to control public exports and enforce module boundaries",
    "repeats": "Extract repeated logic into a shared utils/ or helpers/ module — consolidate before further development",
}


def _severity(d: Dialect, k: int, other: str, col: str = "severity") -> str:
    cases = " ".join(f"WHEN {d.lit(s)} THEN {v[k] if isinstance(v[k], int) else d.lit(v[k])}" for s, v in SEVERITY.items())
    return f"CASE {col} {cases} ELSE {other} END"


def deduplicated(issues: str) -> str:
    """The first of the issues of a category that share file, line and the start of the title."""
    width = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in DEDUP.items()) + " ELSE 0 END"
    key = f"CASE WHEN {width} = 0 THEN concat(rule, title) ELSE substring(title, 1, {width}) END"
    return f"SELECT category, rule, file, line, severity, title FROM (SELECT *, row_number() OVER (PARTITION BY category, file, line, {key} ORDER BY rule, title) AS nth FROM ({issues})) WHERE nth = 1"


def deduplicated_lines(once: str = "") -> str:
    """Spark: the line rules' issues, deduplicated as ``deduplicated`` does where no two files share a path: in the row of their line.
    ``once``: a view of ``sources.repeats`` to read instead of ``lines``."""
    width = lambda x: "CASE " + x + ".category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in DEDUP.items()) + " ELSE 0 END"
    same = f"y.category = x.category AND {width('x')} > 0 AND substring(y.title, 1, {width('x')}) = substring(x.title, 1, {width('x')})"
    kept = f"CASE WHEN size(hits) < 2 THEN hits ELSE filter(hits, (x, i) -> NOT exists(slice(hits, 1, i), y -> {same})) END"
    return line_rules.fused_once(once, once=kept) if once else line_rules.fused("lines", once=kept)


def line_issues(d: Dialect) -> str:
    if d.name == "spark":
        return line_rules.fused("lines")
    return " UNION ALL ".join(f"SELECT {d.lit(r.category)} AS category, {d.lit(r.key)} AS rule, file, line, severity, title FROM ({r.select(d)})" for r in line_rules.RULES)


def with_issues(d: Dialect, views: str, issues: str = "", one_path: bool = False) -> str:
    """``one_path``: no two files share a path."""
    if d.name == "spark" and one_path and not issues:
        once = repeats.distinct_lines(f"{views} SELECT * FROM files", line_rules.path_kind(d))
        return f"{views}, issues AS (SELECT category, rule, file, line, severity, title FROM ({deduplicated_lines(once)}))"
    return f"{views}, found AS ({issues or line_issues(d)}), issues AS ({deduplicated('SELECT category, rule, file, line, severity, title FROM found')})"


def all_issues(d: Dialect) -> str:
    return "SELECT category, rule, file, line, severity, title FROM issues"


def file_scores(d: Dialect) -> str:
    """``path, name, dir, lang, lines, score, issues``; files in an import cycle (category circular) lose CYCLE_PENALTY more."""
    lost = f"SELECT file, count(*) AS n, sum({_severity(d, 1, str(OTHER_PENALTY))}) + max(CASE WHEN category = 'circular' THEN {CYCLE_PENALTY} ELSE 0 END) AS lost FROM issues WHERE category NOT IN ({', '.join(d.lit(c) for c in NOT_SCORED)}) GROUP BY file"
    dir_ = d.replace("path", r"/?[^/]*$", "")
    return f"SELECT path, name, {dir_} AS dir, lang, CAST(lines AS BIGINT) AS lines, CAST(greatest(0, least(100, 100 - coalesce(lost, 0))) AS BIGINT) AS score, CAST(coalesce(n, 0) AS BIGINT) AS issues FROM files LEFT JOIN ({lost}) AS l ON files.path = l.file"


def overall_score(d: Dialect) -> str:
    return f"SELECT CAST(coalesce(floor(avg(score) + 0.5), 100) AS BIGINT) AS score FROM ({file_scores(d)})"


def count_by_category(d: Dialect) -> str:
    return "SELECT category, count(*) AS n FROM issues GROUP BY category"


def totals(d: Dialect) -> str:
    return f"SELECT CAST(sum(CASE WHEN category <> 'split' THEN 1 ELSE 0 END) AS BIGINT) AS total_issues, (SELECT count(*) FROM ({file_scores(d)}) WHERE issues = 0) AS clean_files, (SELECT count(DISTINCT lang) FROM files) AS languages, (SELECT count(*) FROM files) AS n_files FROM issues"


def totals_at_once(d: Dialect) -> str:
    """As ``totals`` where no two files share a path: files and issues are read once each."""
    scored = f"category NOT IN ({', '.join(d.lit(c) for c in NOT_SCORED)})"
    found = f"SELECT sum(CASE WHEN category <> 'split' THEN 1 ELSE 0 END) AS total_issues, count(DISTINCT CASE WHEN {scored} THEN file END) AS marked FROM issues"
    return f"SELECT total_issues, n_files - marked AS clean_files, languages, n_files FROM ({found}) CROSS JOIN (SELECT count(DISTINCT lang) AS languages, count(*) AS n_files FROM files)"


def language_breakdown(d: Dialect) -> str:
    """The six most frequent languages and the rest, with their shares."""
    ranked = "SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS nth FROM files GROUP BY lang"
    return f"SELECT CASE WHEN nth <= 6 THEN lang ELSE 'other' END AS lang, CAST(sum(n) AS BIGINT) AS n, CAST(floor(100.0 * sum(n) / (SELECT count(*) FROM files) + 0.5) AS BIGINT) AS pct FROM ({ranked}) GROUP BY CASE WHEN nth <= 6 THEN lang ELSE 'other' END"


def metrics(d: Dialect) -> str:
    test = d.match("lower(path)", "test|spec|__tests__")
    return f"SELECT CAST(sum(lines) AS BIGINT) AS loc, CAST(floor(1.0 * sum(lines) / count(*) + 0.5) AS BIGINT) AS avg_lines, max(lines) AS max_lines, CAST(floor(100.0 * sum(CASE WHEN {test} THEN 1 ELSE 0 END) / count(*) + 0.5) AS BIGINT) AS test_pct FROM files"


def fix_minutes(d: Dialect) -> str:
    return f"SELECT CAST(coalesce(sum({_severity(d, 2, str(OTHER_MINUTES))}), 0) AS BIGINT) AS minutes FROM issues WHERE {d.any_of('category', FIX_CATEGORIES)}"


def section_minutes(d: Dialect) -> str:
    return f"SELECT category, CAST(sum({_severity(d, 2, str(OTHER_MINUTES))}) AS BIGINT) AS minutes FROM issues GROUP BY category"


def only_severity(d: Dialect, level: str = "high") -> str:
    return f"{all_issues(d)} WHERE severity = {d.lit(level)}"


def search(d: Dialect, text: str = "import") -> str:
    return f"{all_issues(d)} WHERE contains(lower(title), {d.lit(text.lower())}) OR contains(lower(file), {d.lit(text.lower())})"


def path_search(d: Dialect, text: str = "m1/") -> str:
    return f"SELECT * FROM ({file_scores(d)}) WHERE contains(lower(path), {d.lit(text.lower())})"


def worst_files(d: Dialect, n: int = 12) -> str:
    return f"SELECT * FROM ({file_scores(d)}) ORDER BY score, path LIMIT {n}"


def sections(d: Dialect, n: int = 40) -> str:
    """The first n issues of each category, the most severe first."""
    return f"SELECT category, file, line, severity, title FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_severity(d, 0, '5')}, file, line, title) AS nth FROM issues) WHERE nth <= {n}"


def quick_wins(d: Dialect, n: int = 8) -> str:
    """The easiest issues of the categories that are quick to fix: 3 minutes for low ones, else 8."""
    return f"SELECT category, file, line, title, CASE WHEN severity = 'low' THEN 3 ELSE 8 END AS minutes FROM issues WHERE {d.any_of('category', QUICK_CATEGORIES)} ORDER BY {_severity(d, 0, '5')} DESC, category, file, line, title LIMIT {n}"


def sarif_rules(d: Dialect) -> str:
    """One row for each rule of the exchange format: id, level and number of results."""
    rid = "concat(category, ':', substring(title, 1, 40))"
    return f"SELECT {rid} AS rule_id, min({_severity(d, 3, d.lit('warning'))}) AS level, count(*) AS results FROM issues WHERE {d.any_of('category', SARIF_CATEGORIES)} GROUP BY {rid}"


#: Issues and files that the page shows; issues of each section in print, and rows of a printed page.
HTML_ISSUES, HTML_FILES, PRINT_ISSUES, PAGE_ROWS = 200, 50, 200, 40


def _cells(d: Dialect, cells: list[str]) -> str:
    return "concat(" + ", ".join(f"'<td>', {highlight.escaped(d, c)}" for c in cells) + ")"


def _issue_row(d: Dialect) -> str:
    return f"concat('<tr>', {_cells(d, ['severity', 'title', 'file', "coalesce(CAST(line AS STRING), '')"])})"


def html_rows(d: Dialect, scores: str = "") -> str:
    """``part, nth, html``: the table rows of the page, the most severe issues (0) and the worst files (1)."""
    issues = f"SELECT 0 AS part, row_number() OVER (ORDER BY {_severity(d, 0, '5')}, file, coalesce(line, 0), title, rule) AS nth, {_issue_row(d)} AS html FROM issues"
    files = f"SELECT 1 AS part, row_number() OVER (ORDER BY score, path) AS nth, concat('<tr>', {_cells(d, ['CAST(score AS STRING)', 'path'])}) AS html FROM {scores or f'({file_scores(d)})'}"
    return f"SELECT part, nth, html FROM ({issues}) WHERE nth <= {HTML_ISSUES} UNION ALL SELECT part, nth, html FROM ({files}) WHERE nth <= {HTML_FILES}"


def printed_pages(d: Dialect) -> str:
    """``page, pages, section, html``: the first issues of each section, the most severe first, on numbered pages; a section begins a new one."""
    ranked = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_severity(d, 0, '5')}, file, coalesce(line, 0), title, rule) AS nth FROM issues) WHERE nth <= {PRINT_ISSUES})"
    paged = f"(SELECT category AS section, CAST(floor((nth - 1) / {PAGE_ROWS}.0) AS BIGINT) AS k, {d.listed(_issue_row(d), 'nth', '')} AS body FROM {ranked} GROUP BY category, CAST(floor((nth - 1) / {PAGE_ROWS}.0) AS BIGINT))"
    numbered = f"(SELECT *, row_number() OVER (ORDER BY section, k) AS page, count(*) OVER () AS pages FROM {paged})"  # as many rows as pages, whatever the issues
    head = "'<thead><tr><th>Severity<th>Issue<th>File<th>Line</thead>'"
    text = f"concat('<section class={chr(34)}page{chr(34)}><h2>', section, '</h2><table>', {head}, body, '</table><footer>Page ', CAST(page AS STRING), ' of ', CAST(pages AS STRING), '</footer></section>')"
    return f"SELECT page, pages, section, {text} AS html FROM {numbered}"


def json_summary(d: Dialect) -> str:
    """Issues of every category, by severity."""
    return "SELECT category, severity, count(*) AS n FROM issues GROUP BY category, severity"


def copied_category(d: Dialect, category: str = "imports") -> str:
    """The text block of a category."""
    row = "concat('[', upper(severity), '] ', title, ' — ', file, CASE WHEN line IS NULL THEN '' ELSE concat(':', CAST(line AS STRING)) END)"
    return f"SELECT {d.listed(row, 'file, coalesce(line, 0), title', chr(10))} AS block FROM issues WHERE category = {d.lit(category)}"


def refactor_points(d: Dialect, most: int = 5) -> str:
    """What to mend first: high issues of each category, then medium ones, a few of each."""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY category, severity ORDER BY file, coalesce(line, 0), title) AS nth FROM issues WHERE severity IN ('high', 'medium')"
    return f"SELECT CASE severity WHEN 'high' THEN 1 ELSE 2 END AS priority, category, concat(title, ' in ', file, CASE WHEN line IS NULL THEN '' ELSE concat(' line ', CAST(line AS STRING)) END) AS point FROM ({ranked}) WHERE nth <= {most}"


def pruned(d: Dialect) -> str:
    """Files that a scan keeps: outside skipped directories, without skipped extensions, not ignored."""
    ignore = ["src/m3/", "*.rb", "s1?.js"]
    keep = [f"NOT {d.match('path', '(?:^|/)(?:' + '|'.join(x.replace('.', '[.]') for x in SKIP_DIRS) + ')/')}", f"NOT {d.any_of('lang', SKIP_EXTS)}"]
    keep += [f"NOT {d.match('path', p)}" for p in map(gitignore_pattern, ignore[:1])] + [f"NOT {d.match('path', glob_pattern(p))}" for p in ignore[1:]]
    return f"SELECT path, lang FROM files WHERE {' AND '.join(keep)}"


def gitignore_pattern(line: str) -> str:
    """A line of an ignore file as a pattern over paths; no negation, no anchoring at the root."""
    body = line.strip().strip("/")
    return "(?:^|/)" + "".join({"*": "[^/]*", "?": "[^/]", ".": "[.]"}.get(c, c) for c in body.replace("**", "\0")).replace("\0", ".*") + "(?:/|$)"


def glob_pattern(glob: str) -> str:
    """A user's glob as an unanchored pattern; dots stand for any character, as ever."""
    return glob.replace("**", "\0").replace("*", "[^/]*").replace("?", "[^/]").replace("\0", ".*")


def scalars(d: Dialect) -> str:
    """The name functions over all paths."""
    base = f"lower(split_part({d.replace('path', '^.*/', '')}, '.', 1))"
    short = d.replace("path", r"^.*/([^/]*/[^/]*)$", "$1")
    escaped = "replace(replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), " + d.lit('"') + ", '&quot;')"
    return f"SELECT path, {base} AS base_name, {d.replace('path', '^.*/', '')} AS short_name, {short} AS short_path, {escaped} AS escaped, CAST(length(content) AS BIGINT) AS n_chars FROM files"


def score_bands(d: Dialect, minutes: str = "3 * issues") -> str:
    shown = f"CASE WHEN {minutes} >= 60 THEN concat('~', CAST(CAST(floor(({minutes}) / 6.0 + 0.5) / 10 AS DECIMAL(10, 1)) AS STRING), 'h') ELSE concat('~', CAST({minutes} AS STRING), 'm') END"
    return f"SELECT path, CASE WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' WHEN score >= 30 THEN 'poor' ELSE 'critical' END AS band, {shown} AS effort FROM ({file_scores(d)})"


def project_type(d: Dialect) -> str:
    """The framework that the first 20 files (5 000 characters each) speak of."""
    said = lambda p: f"max(CASE WHEN {d.match('head', p)} THEN 1 ELSE 0 END) = 1"
    many = lambda x: f"max(CASE WHEN lang = '{x}' THEN 1 ELSE 0 END) = 1"
    kinds = [(said("(?i)fastapi"), "FastAPI"), (said("(?i)django"), "Django"), (said("(?i)flask"), "Flask"), (said("next/"), "Next.js"), (said("from 'react'"), "React"), (said("express\\("), "Express"), (many("go"), "Go"), (many("java"), "Java"), (many("cs"), ".NET"), (many("rs"), "Rust")]
    cases = " ".join(f"WHEN {c} THEN {d.lit(n)}" for c, n in kinds)
    return f"SELECT CASE {cases} ELSE 'Unknown' END AS project_type FROM (SELECT lang, substring(content, 1, 5000) AS head FROM files ORDER BY path LIMIT 20)"


def high_entropy(d: Dialect) -> str:
    """Quoted strings of many different characters that no other secret rule reports on their line."""
    secret = next(r for r in line_rules.RULES if r.key == "sec_hardcoded_secret")
    found = d.extract_all("text", '''['"`]([A-Za-z0-9+/=_-]{20,})[`'"]''')
    quoted = f"NOT wide AND NOT {d.any_of('lang', ('json', 'lock', 'sum', 'mod', 'svg', 'woff', 'ttf', 'min'))} AND NOT ({secret.condition(d)})"
    some = f"(SELECT path, line, {found} AS found FROM lines WHERE {quoted})"
    strings = f"SELECT DISTINCT path, line, s FROM ({d.unnest(some, 'found', 's', 'path, line')}) WHERE NOT {d.match('s', '^[a-z][a-z0-9-]*$')} AND NOT {d.match('s', r'^\w+$')} AND NOT ({d.match('s', '^[0-9a-f-]{32,}$')} AND contains(s, '-'))"
    if d.name == "spark":  # asked of each text, in its row
        share = "(length(s) - length(replace(s, c, ''))) / length(s)"
        entropy = f"aggregate(array_distinct(filter(split(s, ''), c -> c <> '')), 0D, (a, c) -> {d.let('p', share, 'a - p * log2(p)')})"
        random = f"NOT {d.match('s', '^[a-z][a-z0-9-]*$')} AND NOT {d.match('s', r'^\w+$')} AND NOT ({d.match('s', '^[0-9a-f-]{32,}$')} AND contains(s, '-')) AND round({entropy}, 6) >= 4.5"
        if isinstance(d, Ordered):
            return f"SELECT path AS file, line, 'medium' AS severity, 'High-Entropy String' AS title FROM {d.ask('every', {'hits': f'{quoted} AND exists({found}, s -> {random})'}, narrow=True)}"
        return f"SELECT DISTINCT path AS file, line, 'medium' AS severity, 'High-Entropy String' AS title FROM lines WHERE {quoted} AND exists({found}, s -> {random})"
    letters = d.unnest(f"({strings})", d.series("length(s)"), "k", "path, line, s")
    counts = f"SELECT path, line, s, substring(s, CAST(k AS INT), 1) AS c, count(*) AS n FROM ({letters}) GROUP BY path, line, s, substring(s, CAST(k AS INT), 1)"
    entropy = f"(SELECT path, line, s, -sum(1.0 * n / length(s) * log2(1.0 * n / length(s))) AS e FROM ({counts}) GROUP BY path, line, s)"
    return f"SELECT DISTINCT path AS file, line, 'medium' AS severity, 'High-Entropy String' AS title FROM {entropy} WHERE round(e, 6) >= 4.5"


def fixes(d: Dialect) -> str:
    """How to mend issues: what they speak of, the advice for the project's main language, and a command for the file."""
    low = "lower(title)"
    key = "CASE " + " ".join(f"WHEN {d.match(low, p)} THEN {d.lit(k)}" for p, k in FIX_KEYS) + " END"
    cases = [f"WHEN fix_key = {d.lit(k)} AND main = 'py' THEN {d.lit(py)}" for k, (py, _, _) in FIXES.items() if py]
    cases += [f"WHEN fix_key = {d.lit(k)} AND {d.any_of('main', JS)} THEN {d.lit(js)}" for k, (_, js, _) in FIXES.items() if js]
    cases += [f"WHEN fix_key = {d.lit(k)} THEN {d.lit(other)}" for k, (_, _, other) in FIXES.items()]
    command = "CASE " + " ".join(f"WHEN {d.match(low, p)} AND {d.any_of('ext', langs)} THEN concat({d.lit(a)}, file, {d.lit(b)})" for p, langs, a, b in COMMANDS) + " END"
    main = "(SELECT lang AS main FROM files GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)"
    told = f"(SELECT category, file, line, title, {key} AS fix_key, {d.replace('file', r'^.*[.]', '')} AS ext FROM issues)"
    return f"SELECT category, file, line, title, fix_key, CASE {' '.join(cases)} END AS fix, {command} AS command FROM {told} AS t CROSS JOIN {main} AS m"


def architecture(d: Dialect, most: int = 5) -> str:
    """The first suggestions for the whole project, from counts of its files and issues."""
    n_issues = lambda where: f"(SELECT count(*) FROM issues WHERE {where})"
    god = "contains(title, 'God file')"
    short = d.replace("file", r"^.*/([^/]*/[^/]*)$", "$1")
    named = f"(SELECT {d.listed('shown', 'file', ', ')} FROM (SELECT file, {short} AS shown, row_number() OVER (ORDER BY file) AS nth FROM issues WHERE {god}) WHERE nth <= 3)"
    has = lambda langs: f"(SELECT count(*) FROM files WHERE {d.any_of('lang', langs)})"
    said = {
        "layers": ("(SELECT count(*) FROM files) > 50", ""), "cycles": ("(SELECT count(DISTINCT title) FROM issues WHERE category = 'circular') > 2", ""), "god": (f"{n_issues(god)} > 0", f"concat({d.lit(ARCHITECTURE['god'][0])}, {named}, {d.lit(ARCHITECTURE['god'][1])})"),
        "secrets": (n_issues(f"category = 'security' AND {d.match('title', '(?i)token|auth|key|secret')}") + " > 3", ""), "python": (has(("py",)) + " > 0", ""), "js": (has(JS) + " > 0", ""), "repeats": (n_issues("category = 'duplicates'") + " > 5", ""),
    }
    rows = " UNION ALL ".join(f"SELECT {k} AS nth, {text or d.lit(ARCHITECTURE[name])} AS suggestion, {when} AS fits" for k, (name, (when, text)) in enumerate(said.items()))
    return f"SELECT suggestion FROM (SELECT suggestion, row_number() OVER (ORDER BY nth) AS place FROM ({rows}) WHERE fits) WHERE place <= {most}"


def highlighted_lines(d: Dialect, once: str = "") -> str:
    """Every line as HTML with its tokens marked. ``once``: a view of ``sources.repeats`` to read instead of ``lines``."""
    if once:
        return f"SELECT place.path, place.line, html FROM (SELECT html, explode(places) AS place FROM (SELECT places, {highlight.highlighted(d)} AS html FROM {once}))"
    return f"SELECT path, line, {highlight.highlighted(d)} AS html FROM lines"


def sorted_files(d: Dialect, by: str = "issues", descending: bool = True) -> str:
    """All files with their scores, by a column."""
    return f"SELECT * FROM ({file_scores(d)}) ORDER BY {by} {'DESC' if descending else 'ASC'}, path"


def code_context(d: Dialect, n: int = 5, severity: str = "high") -> str:
    """The line of each issue of a severity and the ``n`` behind it, as one text."""
    places = d.unnest(f"(SELECT DISTINCT file, line AS first_line FROM issues WHERE severity = {d.lit(severity)} AND line IS NOT NULL)", d.series(str(n + 1)), "k", "file, first_line")
    return f"SELECT p.file, first_line AS line, {d.listed('text', 'l.line', chr(10))} AS context FROM ({places}) AS p JOIN lines AS l ON l.path = p.file AND l.line = first_line + k - 1 GROUP BY p.file, first_line"


def code_context_in_files(d: Dialect, n: int = 5, severity: str = "high") -> str:
    """As ``code_context`` in Spark where no two files share a path: files are joined to their issues, and no line is a row."""
    places = f"(SELECT file, collect_set(line) AS places FROM issues WHERE severity = {d.lit(severity)} AND line IS NOT NULL GROUP BY file)"
    context = d.struct(line="p", context=d.joined(f"slice(ls, CAST(p AS INT), {n + 1})", "\n"))
    each = d.let("ls", d.split_lines("content"), d.transform("places", "p", context))
    return f"SELECT file, x.line AS line, x.context AS context FROM (SELECT file, explode({each}) AS x FROM files JOIN {places} ON path = file)"


# -- over scans and pages -----------------------------------------------------------------------------------


def _scans(d: Dialect, events: str) -> str:
    """Daily pseudo-scans of each event type."""
    day = "CAST(ts AS DATE)"
    return f"(SELECT event_type AS project, {day} AS scanned_on, count(*) AS total_issues, count(DISTINCT user_id) AS total_files, CAST(greatest(0, 100 - count(*) % 100) AS BIGINT) AS score FROM {events} GROUP BY event_type, {day})"


def snapshot_diff(d: Dialect, sf_dir: str) -> str:
    over = "OVER (PARTITION BY project ORDER BY scanned_on)"
    return f"SELECT project, scanned_on, total_issues, score, CAST(total_issues - lag(total_issues) {over} AS BIGINT) AS issues_delta, CAST(score - lag(score) {over} AS BIGINT) AS score_delta FROM {_scans(d, d.table('events', sf_dir))}"


def trend(d: Dialect, sf_dir: str, n: int = 15) -> str:
    return f"SELECT project, scanned_on, score FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY scanned_on DESC) AS nth FROM {_scans(d, d.table('events', sf_dir))}) WHERE nth <= {n}"


def repo_urls(d: Dialect, sf_dir: str) -> str:
    """Owner and repository of a URL, as a repository link would be read."""
    pattern = r"^(?:https?://[^/]+/)?([^/?#\s]+)/([^/?#\s]+)"
    return f"SELECT url, {d.extract('url', pattern, 1)} AS owner, {d.replace(d.extract('url', pattern, 2), '[.]git$', '')} AS repo FROM {d.table('pages', sf_dir)}"


def links(d: Dialect, sf_dir: str) -> str:
    found = d.unnest(f"(SELECT page_id, {d.extract_all('html', 'href=\"([^\"]+)\"')} AS found FROM {d.table('pages', sf_dir)})", "found", "href", "page_id")
    return f"SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM ({found}) GROUP BY href"


ISSUE_QUERIES = {
    "issues_line_rules": all_issues, "score_file": file_scores, "score_overall": overall_score, "agg_count_by_category": count_by_category, "agg_totals": totals, "agg_fix_minutes": fix_minutes,
    "agg_section_minutes": section_minutes, "filter_severity": only_severity, "filter_search": search, "filter_path_search": path_search, "topk_worst_files": worst_files, "topk_section": sections,
    "quick_wins": quick_wins, "export_sarif": sarif_rules, "export_json": json_summary, "export_html": html_rows, "export_print": printed_pages, "copy_category": copied_category, "refactor_prompt": refactor_points, "score_band": score_bands, "specific_fixes": fixes, "arch_suggestions": architecture, "sort_files_by": sorted_files, "code_context": code_context,
}
#: Forms that read less where no two files share a path.
AT_ONCE = {totals: totals_at_once, code_context: code_context_in_files}
FILE_QUERIES = {"agg_lang_breakdown": language_breakdown, "agg_metrics_row": metrics, "scan_pruned": pruned, "scalar_functions": scalars, "project_type": project_type, "sec_high_entropy": high_entropy, "highlight_line": highlighted_lines}
TABLE_QUERIES = {"snapshot_diff": snapshot_diff, "win_trend_15": trend, "parse_repo_url": repo_urls, "href_edges": links}
