"""A line of source as HTML: comments, strings, keywords, calls and numbers in spans of their own, all else escaped.

One expression reads a line into tokens, from left to right: a comment to its end, a quoted text with its escapes (to the
end of the line where it is not closed), a word, a number, white space, or one character. A word is a call where the
next token that is no white space is an opening bracket. Each line is read for itself.

Cases: an empty line stays empty; a word or number counts where both its ends are word boundaries of ASCII, so 12ab is
neither, and a $ alone is no word.
"""

from __future__ import annotations

from lintlake.functions.dialect import Dialect

# Words that are keywords in any language.
KEYWORDS = (
    "const", "let", "var", "function", "class", "return", "if", "else", "for", "while", "do",
    "switch", "case", "break", "continue", "import", "export", "default", "from", "async",
    "await", "try", "catch", "finally", "throw", "new", "typeof", "instanceof", "null",
    "undefined", "true", "false", "void", "delete", "in", "of", "yield", "super", "this",
    "def", "self", "pass", "lambda", "with", "as", "and", "or", "not", "is", "elif", "except",
    "raise", "global", "nonlocal", "print", "func", "fn", "pub", "use", "mod", "impl", "trait",
    "mut", "match", "where", "public", "private", "protected", "static", "override",
    "virtual", "readonly", "abstract", "interface", "enum", "struct", "type", "extends",
    "implements", "package", "namespace", "using", "include", "require", "module", "end",
)
_SPACE = r"[ \t\f\r\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_QUOTED = "|".join(rf"{q}(?:\\[\s\S]|[^{q}\\])*(?:{q}|\\?)" for q in "\"'`")
_WORD, _NUMBER = r"[a-zA-Z_$][a-zA-Z0-9_]*", r"[0-9]+[.]?[0-9]*"


def tokens(d: Dialect) -> str:
    b = d.boundary
    return rf"(//[\s\S]*|#[\s\S]*|/[*][\s\S]*?[*]/|/[*][\s\S]*|{_QUOTED}|{b}{_WORD}{b}|{b}{_NUMBER}{b}|[0-9]+[a-zA-Z_][a-zA-Z0-9_]*|{_SPACE}|[\s\S])"


def escaped(d: Dialect, text: str) -> str:
    return f"replace(replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), {d.lit(chr(34))}, '&quot;'), {d.lit(chr(39))}, '&#39;')"


def highlighted(d: Dialect, text: str = "text") -> str:
    """SQL for the HTML of a line."""
    span = lambda kind: f"concat({d.lit(f'<span class={chr(34)}syn-{kind}{chr(34)}>')}, {escaped(d, 'x')}, '</span>')"
    token = lambda k: f"coalesce({d.behind('ts', 'n', k)}, '')"
    call = f"({token(1)} = '(' OR ({d.match(token(1), '^' + _SPACE + '$')} AND {token(2)} = '('))"
    kind = (
        f"CASE WHEN {d.match('x', r'^(?://|#|/[*])')} THEN {span('com')} WHEN {d.match('x', r'^[' + chr(34) + chr(39) + '`]')} THEN {span('str')}"
        f" WHEN {d.match('x', f'^{_WORD}$')} AND x <> '$' THEN CASE WHEN {d.any_of('x', KEYWORDS)} THEN {span('kw')} WHEN {call} THEN {span('fn')} ELSE {escaped(d, 'x')} END"
        f" WHEN {d.match('x', f'^{_NUMBER}$')} THEN {span('num')} ELSE {escaped(d, 'x')} END"
    )
    return d.let("ts", d.extract_all(text, tokens(d)), d.joined(d.transform_at("ts", "x", "n", kind), ""))
