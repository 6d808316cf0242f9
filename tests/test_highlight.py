"""Highlighted lines against a lexer that goes from character to character, and the texts that patterns need."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.functions.dialect import SPARK
from lintlake.functions.highlight import KEYWORDS, highlighted
from lintlake.functions.literals import required
from lintlake.operators import line_rules


def escape(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(a, b)
    return text


def lex(line):
    """Comments, strings and stretches of code, one character after another."""
    i = 0
    while i < len(line):
        if line[i] == "#" or line.startswith("//", i):
            yield "com", line[i:]
            return
        start = i
        if line.startswith("/*", i):
            end = line.find("*/", i + 2)
            i = len(line) if end < 0 else end + 2
            yield "com", line[start:i]
        elif line[i] in "\"'`":
            i += 1
            while i < len(line) and line[i] != line[start]:
                i += 2 if line[i] == "\\" else 1
            i = min(len(line), i + 1)
            yield "str", line[start:i]
        else:
            while i < len(line) and line[i] not in "\"'`#" and not line.startswith(("//", "/*"), i):
                i += 1
            yield "code", line[start:i]


def by_hand(line):
    out = []
    for kind, text in lex(line):
        if kind != "code":
            out.append(f'<span class="syn-{kind}">{escape(text)}</span>')
            continue
        parts = re.split(r"(\b[a-zA-Z_$]\w*\b|\b\d+\.?\d*\b)", text, flags=re.A)
        for k, part in enumerate(parts):
            said = escape(part)
            if re.fullmatch(r"[a-zA-Z_$]\w*", part, re.A) and k % 2:
                mark = "kw" if part in KEYWORDS else "fn" if parts[k + 1].lstrip(" \t\u00a0\u3000").startswith("(") else ""
            else:
                mark = "num" if re.fullmatch(r"\d+\.?\d*", part, re.A) else ""
            out.append(f'<span class="syn-{mark}">{said}</span>' if mark else said)
    return "".join(out)


def test_highlighted_lines(spark):
    rng = random.Random(4)
    parts = ["if", "go", "x", "$", "_a", "12", "1.5", "3.", "9z", "(", ")", " ", "  ", "\t", "\u00a0", ".", "=", "<", ">", "&", '"', "'", "`", "\\", "/", "//", "/*", "*/", "#", "é", "🎉", "return", "f (", "return("]
    lines = ["", "const a = f(1.5) // b", "$('#x').on(\"a\\\"b\")", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(4000))]
    got = spark.createDataFrame(list(enumerate(lines)), "k int, text string").selectExpr("k", f"{highlighted(SPARK)} AS html").collect()
    for k, html in got:
        assert html == by_hand(lines[k]), lines[k]


def test_required_texts():
    assert required("(?i)(?:Password|token)\\s*=") == {"password", "token"}
    assert required("a?bc+d*") == {"b"} or required("a?bc+d*") == {"c"}
    assert required("x*") is None and required("(?:ab|)c") == {"c"} and required("[ab]") is None
    assert required("(?<x>todo)") is None and required("(") is None  # what this parser does not read has no test before it
    assert all(required(p) for r in line_rules.RULES for p in r.must)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([p for r in line_rules.RULES for p in r.must] + ["(?:ab|cd)+e?", "a(?:b(?:c|d)){2,}", "(?i)X?yZ|q"]).flatmap(lambda p: st.tuples(st.just(p), st.from_regex(re.compile(p, re.A)))))
def test_matches_have_a_required_text(case):
    pattern, text = case
    assert any(t in text.lower() for t in required(pattern))


@pytest.mark.parametrize("key", ["issues_line_rules", "custom_rule_match"])
def test_patterns_are_tried_behind_texts(key, spark, sf):
    from lintlake.plans import catalog

    plan = catalog.queries()[key](spark, sf)._jdf.queryExecution().toString()
    assert "Contains(low" in plan
