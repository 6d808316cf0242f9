"""Versions as text that sorts as they do, in either dialect: bounds of ranges then compare as plain strings.

Release numbers are padded to one width, their zeros at the end dropped (1.0 is 1.0.0). What follows them sorts behind
them by marks below the dot: ``!`` before a pre-release of semantic versions (npm, Go), ``#`` else. A Python version has its
phases there instead: pre-release, post-release and development release, each of a fixed width, in the order in which
they are compared.

Cases: a leading v or =, build data behind + and upper case do not count; text that begins with no number sorts before
every version; a null is null.
"""

from __future__ import annotations

from lintlake.functions.dialect import Dialect

WIDTH = 20


def _padded(number: str) -> str:
    return f"lpad({number}, {WIDTH}, '0')"


def version_key(d: Dialect, version: str, ecosystem: str) -> str:
    text = f"lower({d.replace(d.replace(d.trim(version), '^[vV=]+', ''), '[+].*$', '')})"
    release = d.extract(text, r"^([0-9]+(?:[.][0-9]+)*)")
    rest = f"substring({text}, length({release}) + 1)"
    numbers = d.joined(d.transform(d.split_on(d.replace(release, r"(?:[.]0+)+$", ""), "[.]"), "x", _padded("x")), ".")
    # semantic versions: fields of a pre-release, numbers before words
    field = f"CASE WHEN {d.match('x', '^[0-9]+$')} THEN concat('0', {_padded('x')}) ELSE concat('1', x) END"
    semantic = f"CASE WHEN {rest} = '' THEN '#' ELSE concat('!', {d.joined(d.transform(d.split_on(d.replace(rest, '^[-]', ''), '[.]'), 'x', field), '!')}) END"
    # Python versions: phases
    phases = d.replace(rest, "[-_.]", "")
    pre = d.extract(phases, r"^(alpha|a|beta|b|preview|pre|rc|c)")
    pre_n = d.extract(phases, r"^(?:alpha|a|beta|b|preview|pre|rc|c)([0-9]*)")
    post_n, has_post = d.extract(phases, r"(?:post|rev|r)([0-9]+)"), d.match(phases, "post|rev|r[0-9]")
    dev_n, has_dev = d.extract(phases, r"dev([0-9]+)"), d.match(phases, "dev")
    kind = f"CASE WHEN {pre} IN ('alpha', 'a') THEN '1' WHEN {pre} IN ('beta', 'b') THEN '2' WHEN {pre} <> '' THEN '3' WHEN {has_dev} AND NOT {has_post} THEN '0' ELSE '9' END"
    post = f"CASE WHEN {has_post} THEN concat('1', {_padded(post_n)}) ELSE concat('0', {_padded(d.lit(''))}) END"
    dev = f"CASE WHEN {has_dev} THEN concat('0', {_padded(dev_n)}) ELSE '9' END"
    python = f"concat('#', {kind}, {_padded(pre_n)}, {post}, {dev})"
    return f"CASE WHEN {version} IS NULL THEN NULL WHEN {release} = '' THEN '' WHEN {ecosystem} = 'PyPI' THEN concat({numbers}, {python}) ELSE concat({numbers}, {semantic}) END"
