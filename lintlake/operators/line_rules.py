"""Rules that look at one line: a language, patterns it must and must not match, and a title.

``select`` turns a rule into SQL over ``lines`` for either dialect; ``fused`` evaluates all of them in one
pass over the lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from lintlake.functions.dialect import SPARK, Dialect
from lintlake.functions.literals import needed
from lintlake.model import JS, PY


@dataclass(frozen=True)
class Rule:
    key: str
    category: str
    severity: str
    title: str  # %s: what ``capture`` captures
    langs: tuple[str, ...] = ()
    must: tuple[str, ...] = ()
    must_not: tuple[str, ...] = ()
    absent: tuple[str, ...] = ()  # parts that the line must not contain
    path_not: str = ""
    narrow: bool = False  # not in files with very long lines
    capture: tuple[str, int] = ("", 1)
    measure: bool = False  # %s: the length of what is captured
    uncommented: str = ""  # its first match must not come after //
    where: str = ""  # further SQL that both dialects read the same

    def condition(self, d: Dialect) -> str:
        parts = [d.any_of("lang", self.langs)] if self.langs else []
        parts += [d.match("text", p) for p in self.must]
        parts += [f"NOT {d.match('text', p)}" for p in self.must_not]
        parts += [f"NOT {d.contains('text', p)}" for p in self.absent]
        if self.path_not:
            parts.append(f"NOT {d.match('path', self.path_not)}")
        if self.narrow:
            parts.append("NOT wide")
        if self.uncommented:
            parts.append(f"NOT {d.contains(d.replace('text', self.uncommented + '.*$', ''), '//')}")
        if self.where:
            parts.append(self.where)
        return " AND ".join(parts)

    def title_sql(self, d: Dialect) -> str:
        before, mark, after = self.title.partition("%s")
        if not mark:
            return d.lit(self.title)
        found = d.extract("text", *self.capture)
        return f"concat({d.lit(before)}, {f'CAST(length({found}) AS STRING)' if self.measure else found}, {d.lit(after)})"

    def select(self, d: Dialect) -> str:
        return f"SELECT path AS file, line, {d.lit(self.severity)} AS severity, {self.title_sql(d)} AS title FROM lines WHERE {self.condition(d)}"


_TEST = r"(?i)test|spec|__tests__"
_WEB = ("html", "jsx", "tsx", "vue", "svelte", "htm")

# The rules' patterns, severities and titles.
RULES = [
    # security: every file whose lines are not very long
    Rule("sec_hardcoded_secret", "security", "high", "Hardcoded Secret", must=(r"""(?i)(?:password|passwd|pwd|secret|api_key|apikey|token|auth)\s*[=:]\s*['"][^'"]{4,}['"]""",), absent=("process.env", "config.", "example", "placeholder"), narrow=True),
    Rule("sec_aws_key", "security", "high", "AWS Key Exposed", must=(r"AKIA[0-9A-Z]{16}",), narrow=True),
    Rule("sec_jwt", "security", "high", "JWT Token Exposed", must=(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.",), narrow=True),
    Rule("sec_private_key", "security", "high", "Private Key in Source", must=(r"-----BEGIN\s+(?:RSA\s+|EC\s+|OPENSSH\s+)?PRIVATE KEY",), narrow=True),
    Rule("sec_stripe_live", "security", "high", "Stripe Live Key", must=(r"(?:sk_live_|rk_live_)[A-Za-z0-9]{20,}",), narrow=True),
    Rule("sec_db_url_creds", "security", "high", "DB URL with Credentials", must=(r"(?:postgres|mysql|mongodb|redis|mssql)://[^:@\s]+:[^@\s]+@",), narrow=True),
    Rule("sec_eval", "security", "medium", "eval() Usage", must=(r"\beval\s*\(",), narrow=True, where="lang <> 'py'"),
    Rule("sec_inner_html", "security", "high", "innerHTML Assignment (XSS)", must=(r"innerHTML\s*=",), absent=(".textContent",), narrow=True),
    Rule("sec_dangerous_html", "security", "medium", "dangerouslySetInnerHTML", must=(r"dangerouslySetInnerHTML",), narrow=True),
    Rule("sec_weak_hash", "security", "medium", "Weak Hash Algorithm", must=(r"""(?i)(?:crypto\.createHash\s*\(\s*['"](?:md5|sha1)['"]|hashlib\.(?:md5|sha1)\s*\()""",), narrow=True),
    Rule("sec_debug_true", "security", "medium", "Debug Mode Enabled", must=(r"\bDEBUG\s*=\s*True\b",), narrow=True),
    Rule("sec_sql_injection", "security", "high", "SQL Injection Risk", must=(r"""(?i)['"`][^'"`]*(?:SELECT|INSERT|UPDATE|DELETE)[^'"`]*(?:\+|\$\{)""",), narrow=True),
    # language patterns
    Rule("lang_py_mutable_default", "language", "high", "Mutable default argument", PY, (r"def\s+\w+\s*\([^)]*=\s*(?:\[\s*\]|\{\s*\}|list\s*\(\s*\)|dict\s*\(\s*\)|set\s*\(\s*\))",)),
    Rule("lang_py_is_literal", "language", "medium", "`is` used for value comparison (use ==)", PY, (r"""\bis\s+['"\d]""",), (r"is\s+(?:None|True|False)\b",)),
    Rule("lang_js_var", "language", "low", "`var` declaration — use const or let", JS, (r"^\s*var\s+\w+",)),
    Rule("lang_js_document_write", "language", "high", "document.write() — blocks parser and enables XSS", JS, (r"document\.write\s*\(",)),
    Rule("lang_js_loose_eq", "language", "low", "Loose equality (==) — use ===", ("js",), (r"[^=!<>]==[^=]",), uncommented=r"==[^=]"),
    Rule("lang_go_ignored_error", "language", "medium", "Error return ignored with _", ("go",), (r",\s*_\s*:?=\s*\w+\(|=\s*\w+\([^)]*\)\s*;\s*_",)),
    Rule("lang_rs_unwrap", "language", "medium", ".unwrap() panics on Err/None — handle the error", ("rs",), (r"\.unwrap\s*\(\s*\)",), path_not=_TEST),
    Rule("lang_rs_expect", "language", "low", ".expect() panics — consider returning Result<>", ("rs",), (r"\.expect\s*\(",), path_not=_TEST),
    Rule("lang_rs_unsafe", "language", "high", "unsafe block — requires careful review", ("rs",), (r"unsafe\s*\{",), path_not=_TEST),
    Rule("lang_java_raw_type", "language", "medium", "Raw type %s — add type parameter", ("java",), (r"\b(?:List|Map|Set|Collection|ArrayList|HashMap|HashSet)\s+\w+\s*[=;(,]",), (r"<",), uncommented=r"\b(?:List|Map|Set|Collection|ArrayList|HashMap|HashSet)\s+\w+\s*[=;(,]", capture=(r"\b(List|Map|Set|Collection|ArrayList|HashMap|HashSet)\s+\w+\s*[=;(,]", 1)),
    Rule("lang_java_broad_catch", "language", "medium", "Catching Exception/Throwable — too broad", ("java",), (r"catch\s*\(\s*(?:Exception|Throwable)\s+",)),
    Rule("lang_cs_empty_catch", "language", "medium", "Empty catch block", ("cs",), (r"catch\s*(?:\(\s*\))?\s*\{?\s*\}",)),
    Rule("lang_cs_console", "language", "low", "Console.WriteLine — use ILogger", ("cs",), (r"Console\.(?:Write|WriteLine)\s*\(",), path_not=_TEST),
    # code patterns
    Rule("pat_url_localhost", "patterns", "medium", "Hardcoded localhost URL", must=(r"https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0)(?::\d+)?",), path_not=r"(?i)test|spec|config|\.env|fixture"),
    Rule("pat_url_private_ip", "patterns", "medium", "Hardcoded private IP address", must=(r"https?://(?:192\.168\.|10\.\d+\.|172\.(?:1[6-9]|2\d|3[01])\.)",)),
    Rule("pat_regex_long_py", "patterns", "low", "Complex regex (%s chars) — needs a comment", must=(r"""r['"][^'"]{80,}['"]""",), capture=(r"""r['"]([^'"]{80,})['"]""", 1), measure=True),
    # error handling
    Rule("err_py_bare_except", "errors", "medium", "Bare except: clause", PY, (r"^\s*except\s*:",)),
    # type safety
    Rule("type_ts_any", "types", "medium", "TypeScript `any` type used", ("ts", "tsx"), (r":\s*any\b",), (r"^[^:]*//",)),
    Rule("type_ts_ignore", "types", "medium", "@ts-ignore suppresses type errors", ("ts", "tsx"), (r"@ts-ignore",)),
    Rule("type_ts_nocheck", "types", "high", "@ts-nocheck disables type checking for entire file", ("ts", "tsx"), (r"@ts-nocheck",)),
    Rule("type_ts_non_null", "types", "low", "Non-null assertion operator (!.) used", ("ts", "tsx"), (r"\w+!\.\w+|\w+!\[",)),
    Rule("type_ts_double_cast", "types", "medium", "Double type cast (as unknown as T) bypasses type safety", ("ts", "tsx"), (r"as\s+unknown\s+as\s+",)),
    Rule("type_ts_implicit_any", "types", "low", "Function parameters have implicit any types", ("ts", "tsx"), (r"function\s+\w+\s*\([^)]*[^)\s][^)]*\)",), (r"function\s+\w+\s*\([^)]*:\s*\w[^)]*\)", r"function\s+\w+\s*\([^)]*\.\.\.[^)]*\)")),
    Rule("type_py_ignore", "types", "low", "type: ignore suppresses mypy error", PY, (r"# type: ignore",)),
    Rule("type_js_loose_eq", "types", "low", "Loose equality (==) — use === instead", ("js",), (r"[^=!<>]==[^=]",), uncommented=r"[^=!<>]==[^=]"),
    # comments
    Rule("com_empty", "comments", "low", "Empty comment", must=(r"^\s*(?://\s*$|#\s*$|/\*\s*\*/)",)),
    # imports
    Rule("imp_js_wildcard", "imports", "medium", "Wildcard namespace import", (*JS, "mjs"), (r"^\s*import\s*\*\s*as",)),
    Rule("imp_py_wildcard", "imports", "high", "Wildcard import (from x import *)", PY, (r"^\s*from\s+\S+\s+import\s+\*",)),
    Rule("imp_py_buried", "imports", "low", "Import inside function/block", PY, (r"^\s+(?:import|from)\s+",)),
    Rule("imp_java_wildcard", "imports", "medium", "Wildcard import", ("java", "cs", "kt"), (r"^\s*import\s+.*\*\s*;",)),
    # names
    Rule("name_single_letter", "names", "low", "Single-letter variable: '%s'", ("js", "ts", "jsx", "tsx", "py", "go", "java", "cs", "kt", "rs", "php", "rb"), (r"\b(?:const|let|var)\s+[a-df-hlmp-wz]\s*=",), capture=(r"\b(?:const|let|var)\s+([a-df-hlmp-wz])\s*=", 1)),
    # memory
    Rule("mem_py_open", "memory", "medium", "File opened without context manager (with)", PY, (r"\bopen\s*\(",), (r"with\s+open\s*\(", r"^\s*#"), path_not=_TEST),
    # performance
    Rule("perf_jsx_inline_prop", "performance", "low", "Inline function/object in JSX prop — creates new reference every render", ("jsx", "tsx"), (r"\bonChange\s*=\s*\{\s*\(|onSubmit\s*=\s*\{\s*\(|style\s*=\s*\{\s*\{",)),
    Rule("perf_py_list_wrap", "performance", "low", "Unnecessary list() wrapping in for loop", PY, (r"\bfor\s+\w+\s+in\s+list\s*\(",), path_not=_TEST),
    # accessibility
    Rule("a11y_img_alt", "accessibility", "high", "<img> missing alt attribute", _WEB, (r"(?i)<img\b[^>]*>",), (r"(?i)\balt\s*=",)),
    Rule("a11y_img_empty_src", "accessibility", "medium", "<img> has empty src attribute", _WEB, (r"""<img\b[^>]*src\s*=\s*["']['"]""",)),
    Rule("a11y_input_label", "accessibility", "high", "<input> missing label association", _WEB, (r"(?i)<input\b[^>]*>",), (r"""(?i)type\s*=\s*["'](?:hidden|submit|button|image|reset)["']""", r"(?i)\baria-label\s*=|\baria-labelledby\s*=|\bid\s*=")),
    Rule("a11y_link_icon", "accessibility", "medium", "<a> link contains only an icon — no accessible text", _WEB, (r"<a\b[^>]*href[^>]*>\s*<(?:svg|img|i|span)[^>]*/?>",), (r"(?i)aria-label\s*=|aria-labelledby\s*=",)),
    Rule("a11y_html_lang", "accessibility", "medium", "<html> missing lang attribute", _WEB, (r"(?i)<html\b[^>]*>",), (r"(?i)\blang\s*=",)),
    Rule("a11y_tabindex", "accessibility", "low", 'tabindex="%s" disrupts natural tab order', _WEB, (r"""(?i)tabindex\s*=\s*["']?0*[1-9]\d*""",), (r"""(?i)tabindex\s*=\s*["']?0+(?:[^0-9]|$)""",), capture=(r"""(?i)tabindex\s*=\s*["']?(\d+)["']?""", 1)),
    Rule("a11y_aria_hidden", "accessibility", "high", 'aria-hidden="true" on interactive element — keyboard trap', _WEB, (r"""(?i)aria-hidden\s*=\s*["']true["']""", r"(?i)<(?:button|a|input|select|textarea)\b")),
    Rule("a11y_click_div", "accessibility", "medium", "onClick on non-interactive element — not keyboard accessible", _WEB, (r"(?i)\bonClick\s*=|\bon-click\s*=", r"(?i)<(?:div|span|p|li)\b"), (r"(?i)role\s*=|tabindex\s*=",)),
]


def _hits(d: Dialect, rules: list[Rule]) -> str:
    """The issues of a line as an array; a pattern is tried where a text that its matches need is found."""
    guarded = [(r, " AND ".join([*filter(None, (needed(d, p) for p in r.must)), r.condition(d)])) for r in rules]
    made = ",\n".join(f"CASE WHEN {c} THEN named_struct('category', {d.lit(r.category)}, 'rule', {d.lit(r.key)}, 'severity', {d.lit(r.severity)}, 'title', {r.title_sql(d)}) END" for r, c in guarded)
    return f"filter(array({made}), x -> x IS NOT NULL)"


def hits(rules: list[Rule] = RULES) -> str:
    """Spark SQL for the issues of a line (path, lang, wide, text, low), by rule: of each language only its own rules are tried."""
    ordered = sorted(rules, key=lambda r: r.key)
    common = [r for r in ordered if not r.langs]
    cases = [f"WHEN {SPARK.lit(x)} THEN {_hits(SPARK, [r for r in ordered if not r.langs or x in r.langs])}" for x in sorted({x for r in ordered for x in r.langs})]
    other = _hits(SPARK, common) if common else _hits(SPARK, ordered[:1])  # of another language than all rules: none holds
    return f"CASE lang {' '.join(cases)} ELSE {other} END" if cases else other


def path_kind(d: Dialect, rules: list[Rule] = RULES) -> str:
    """All that rules ask of a path, as text: lines of files that share it have the same issues."""
    return "concat(" + ", ".join(f"CAST({d.match('path', p)} AS STRING)" for p in sorted({r.path_not for r in rules if r.path_not})) + ")"


def fused_once(lines: str, rules: list[Rule] = RULES, once: str = "hits") -> str:
    """As ``fused``, over lines that are told once with all their ``places`` (``sources.repeats``)."""
    found = f"(SELECT places, text, {hits(rules)} AS hits FROM (SELECT *, lower(text) AS low FROM {lines}))"
    each = f"(SELECT hit, text, explode(places) AS place FROM (SELECT places, text, explode({once}) AS hit FROM {found}))"
    return f"SELECT hit.category, hit.rule, place.path AS file, place.line, hit.severity, hit.title, substring({SPARK.trim('text')}, 1, 80) AS snippet FROM {each}"


def fused(lines: str, rules: list[Rule] = RULES, once: str = "hits") -> str:
    """Spark SQL that evaluates all rules on each line of ``lines`` in one pass. ``once``: what is kept of the array ``hits`` of a line."""
    found = f"(SELECT path, line, text, {hits(rules)} AS hits FROM (SELECT *, lower(text) AS low FROM {lines}))"
    return f"SELECT hit.category, hit.rule, path AS file, line, hit.severity, hit.title, substring({SPARK.trim('text')}, 1, 80) AS snippet FROM (SELECT path, line, text, explode({once}) AS hit FROM {found})"
