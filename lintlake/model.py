"""Settings, severities and column sets of the analyzer."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Thresholds of the analyzer."""

    cc_limit: int = 8
    fn_lines: int = 60
    file_lines: int = 300
    nest_depth: int = 4
    fn_params: int = 5
    dup_window: int = 6


# Severity -> (rank, score penalty, minutes to fix, level in exchange reports).
SEVERITY = {
    "critical": (0, 20, 45, "error"),
    "high": (1, 12, 20, "error"),
    "medium": (2, 6, 10, "warning"),
    "low": (3, 2, 3, "note"),
    "info": (4, 1, 1, "none"),
}
#: Penalty and minutes of a severity that is not listed.
OTHER_PENALTY, OTHER_MINUTES = 2, 5
#: What a file in an import cycle loses.
CYCLE_PENALTY = 15

ISSUE_COLUMNS = ["category", "rule", "file", "line", "severity", "title", "snippet"]
FILE_COLUMNS = ["path", "name", "lang", "content"]

# Language groups of the rules.
JS = ("js", "ts", "jsx", "tsx")
PY = ("py",)
CODE = ("js", "ts", "jsx", "tsx", "py", "go", "java", "cs", "kt", "rs", "rb", "php")
COMPLEX = (*CODE, "cpp", "c")
IMPORTING = ("js", "ts", "jsx", "tsx", "py", "go", "java", "cs", "kt", "rs", "vue", "svelte")
#: category -> characters of a title that count when issues of one line are the same; None: not deduplicated.
DEDUP = {
    "security": 1000, "language": 40, "patterns": 40, "errors": 1000, "types": 40, "memory": 30, "performance": 40, "accessibility": 30,
}
#: Categories that do not count for scores (test) or totals (split).
NOT_SCORED = ("tests", "split")
