"""The few expressions that Spark SQL and the SQL of the checking engine spell differently.

A rule is written once, as text with these expressions, and read by both. Patterns keep to what Java's
regular expressions and RE2 share: no look-around, no back-references.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession


#: Bytes of a table's files for each task that turns its rows into texts.
PART_BYTES = 1 << 20


class Dialect:
    name = ""
    boundary = ""

    def lit(self, value: str) -> str:
        raise NotImplementedError

    def match(self, col: str, pattern: str) -> str:
        raise NotImplementedError

    def takes(self, pattern: str) -> bool:
        """Whether the engine's regular expressions have such a pattern."""
        raise NotImplementedError

    def extract(self, col: str, pattern: str, group: int = 1) -> str:
        return f"coalesce(regexp_extract({col}, {self.lit(pattern)}, {group}), '')"

    def trim(self, col: str) -> str:
        return self.replace(col, r"^\s+|\s+$", "")

    def contains(self, col: str, part: str) -> str:
        return f"contains({col}, {self.lit(part)})"

    def any_of(self, col: str, values) -> str:
        return f"{col} IN ({', '.join(self.lit(v) for v in values)})"

    def at(self, path: str = "path", line: str = "line") -> str:
        """A place as text that orders by file, then line; ``file_of`` and ``line_of`` take it apart."""
        return f"concat({path}, chr(1), lpad(CAST({line} AS STRING), 9, '0'))"

    @staticmethod
    def file_of(at: str) -> str:
        return f"split_part({at}, chr(1), 1)"

    @staticmethod
    def line_of(at: str) -> str:
        return f"CAST(split_part({at}, chr(1), 2) AS BIGINT)"

    def values(self, rows: list[tuple[str, ...]], names: str) -> str:
        return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(self.lit(x) for x in r) + ')' for r in rows)}) AS t_({names}))"

    def block(self, first: int, last: int) -> str:
        """The lines from ``first`` to ``last`` after this one (negative: before), joined by line ends."""
        frame = f"OVER (PARTITION BY path ORDER BY line ROWS BETWEEN {self._bound(first)} AND {self._bound(last)})"
        return f"coalesce({self._joined(frame)}, '')"

    def on_lines(self, where: str, **columns: str) -> str:
        """``path, name, line`` and columns of the texts (over lang, wide, text) of the lines that meet a condition on the same."""
        return f"(SELECT path, name, line, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM lines WHERE {where})"

    def texts(self) -> str:
        """``lang, wide, text`` of the lines, each text of a language at least once."""
        return "(SELECT lang, wide, text FROM lines)"

    @staticmethod
    def _bound(n: int) -> str:
        return "CURRENT ROW" if n == 0 else f"{n} FOLLOWING" if n > 0 else f"{-n} PRECEDING"


class Spark(Dialect):
    name = "spark"
    #: Where a word of ASCII begins or ends; Java's own sign for it takes other letters for words as well.
    boundary = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

    def lit(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{") + "'"  # else ${x} is a variable

    def match(self, col: str, pattern: str) -> str:
        return f"({col} RLIKE {self.lit(pattern)})"

    def takes(self, pattern: str) -> bool:
        try:
            SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        except IllegalArgumentException:
            return False
        return True

    def extract_all(self, col: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({col}, {self.lit(pattern)}, {group})"

    def count(self, col: str, pattern: str) -> str:
        return f"CAST(regexp_count({col}, {self.lit(pattern)}) AS BIGINT)"

    def replace(self, col: str, pattern: str, to: str) -> str:
        return f"regexp_replace({col}, {self.lit(pattern)}, {self.lit(to)})"

    def _joined(self, frame: str) -> str:
        return f"array_join(collect_list(text) {frame}, '\\n')"

    def last_seen(self, col: str, order: str = "line") -> str:
        return f"last({col}, true) OVER (PARTITION BY path ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def unnest(self, source: str, array: str, name: str, cols: str = "*") -> str:
        return f"SELECT {cols}, {name} FROM (SELECT *, explode({array}) AS {name} FROM {source})"

    def split_lines(self, content: str) -> str:
        return f"split({content}, '\\n', -1)"

    def lines(self, files: str) -> str:
        return f"SELECT path, name, lang, wide, CAST(pos + 1 AS BIGINT) AS line, text FROM (SELECT path, name, lang, wide, posexplode({self.split_lines('content')}) AS (pos, text) FROM {files})"

    def series(self, n: str) -> str:
        return f"sequence(1, CAST({n} AS INT))"

    def listed(self, value: str, order: str, sep: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order}, {value} AS v_))), x_ -> x_.v_), {self.lit(sep)})"

    def split(self, col: str, sep: str) -> str:
        return f"split({col}, {self.lit(sep)}, -1)"

    def split_on(self, col: str, pattern: str) -> str:
        return f"split({col}, {self.lit(pattern)}, -1)"

    def table(self, name: str, sf_dir: str) -> str:
        return f"parquet.`{sf_dir}/{name}.parquet`"

    def parts(self, name: str, sf_dir: str) -> int:
        """Tasks for a table whose rows become many times their size: one for each ``PART_BYTES`` of its files."""
        spark = SparkSession.active()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return 1 + (fs.getContentSummary(path).getLength() if fs.exists(path) else 0) // PART_BYTES

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def concat(self, arrays: list[str]) -> str:
        return f"concat({', '.join(arrays)})"

    def sorted_list(self, value: str) -> str:
        return f"array_sort(collect_list({value}))"

    def fold(self, array: str, zero: str, step: str) -> str:
        """``step`` over a (so far) and x (an element)."""
        return f"aggregate({array}, {zero}, (a, x) -> {step})"

    def transform(self, array: str, x: str, to: str) -> str:
        return f"transform({array}, {x} -> {to})"

    def transform_at(self, array: str, x: str, n: str, to: str) -> str:
        """``to`` for each element and its place, as ``behind`` takes it."""
        return f"transform({array}, ({x}, {n}) -> {to})"

    def behind(self, array: str, n: str, k: int) -> str:
        """The k-th element behind a place, or null."""
        return f"get({array}, {n} + {k})"

    def filter(self, array: str, x: str, where: str) -> str:
        return f"filter({array}, {x} -> {where})"

    def first_of_each(self, array: str) -> str:
        return f"array_distinct({array})"

    def joined(self, array: str, sep: str) -> str:
        return f"array_join({array}, {self.lit(sep)})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def let(self, name: str, value: str, then: str) -> str:
        """``then`` with ``name`` for a value that is worked out once."""
        return f"element_at(transform(array({value}), {name} -> {then}), 1)"

    def groups_of(self, edges: str) -> str:
        """The groups that an array of edges (a, b) joins, as arrays of names."""
        met = "array_contains(g, x.a) OR array_contains(g, x.b)"
        joined = f"concat(filter(acc, g -> NOT ({met})), array(array_distinct(concat(array(x.a, x.b), flatten(filter(acc, g -> {met}))))))"
        return f"aggregate({edges}, CAST(array() AS ARRAY<ARRAY<STRING>>), (acc, x) -> {joined})"


class Told(Spark):
    """Spark where ``told`` (lang, wide, long, text, places) has each line of some files once (``sources.repeats``), and ``lines`` is made of it.

    What depends on a line alone is asked of the line before its places are rows. Conditions find their way below the places by themselves.
    """

    #: ``lines``, made of ``told``.
    LINES = "SELECT place.path AS path, place.name AS name, lang, wide, place.line AS line, text FROM (SELECT lang, wide, text, explode(places) AS place FROM told)"

    def on_lines(self, where: str, **columns: str) -> str:
        made = f"SELECT places, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM told WHERE {where}"
        return f"(SELECT place.path AS path, place.name AS name, place.line AS line, {', '.join(columns)} FROM (SELECT {', '.join(columns)}, explode(places) AS place FROM ({made})))"

    def texts(self) -> str:
        return "(SELECT lang, wide, text FROM told)"


class Ordered(Told):
    """Told where what rules ask of lines in their order was found in one pass (``operators.ordered``), and its tables are at hand."""

    def __init__(self) -> None:
        #: What rules have asked for, by the kind of row that tells it: how it is found, expressions over lang and text, and more.
        self.asked: dict[str, tuple[str, dict[str, str], dict]] = {}

    def ask(self, how: str, marks: dict[str, str], columns: str = "path, line", **more: object) -> str:
        """A source of rows that ``how`` (of ``operators.ordered.WAYS``) finds from marks of lines."""
        kind = f"{how}_{hashlib.md5(repr((marks, more)).encode()).hexdigest()[:12]}"
        self.asked[kind] = how, marks, more
        return f"(SELECT {columns} FROM ordered WHERE kind = '{kind}')"


class Duck(Dialect):
    name = "duck"
    boundary = r"\b"

    def lit(self, value: str) -> str:
        parts = value.split("\n")
        return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) + ")" if len(parts) > 1 else "'" + value.replace("'", "''") + "'"

    def match(self, col: str, pattern: str) -> str:
        return f"regexp_matches({col}, {self.lit(pattern)})"

    def takes(self, pattern: str) -> bool:
        try:
            re.compile(pattern)  # what it shares with RE2; patterns of rules keep to that
        except re.error:
            return False
        return True

    def extract_all(self, col: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({col}, {self.lit(pattern)}, {group})"

    def count(self, col: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({col}, {self.lit(pattern)})) AS BIGINT)"

    def replace(self, col: str, pattern: str, to: str) -> str:
        return f"regexp_replace({col}, {self.lit(pattern)}, {self.lit(to.replace('$', chr(92)))}, 'g')"

    def _joined(self, frame: str) -> str:
        return f"string_agg(text, chr(10)) {frame}"

    def last_seen(self, col: str, order: str = "line") -> str:
        return f"last_value({col} IGNORE NULLS) OVER (PARTITION BY path ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def unnest(self, source: str, array: str, name: str, cols: str = "*") -> str:
        return f"SELECT {cols}, {name} FROM (SELECT *, unnest({array}) AS {name} FROM {source})"

    def split_lines(self, content: str) -> str:
        return f"string_split({content}, chr(10))"

    def lines(self, files: str) -> str:
        array = self.split_lines("content")
        return f"SELECT path, name, lang, wide, CAST(generate_subscripts({array}, 1) AS BIGINT) AS line, unnest({array}) AS text FROM {files}"

    def series(self, n: str) -> str:
        return f"generate_series(1, {n})"

    def listed(self, value: str, order: str, sep: str) -> str:
        return f"string_agg({value}, {self.lit(sep)} ORDER BY {order})"

    def split(self, col: str, sep: str) -> str:
        return f"string_split({col}, {self.lit(sep)})"

    def split_on(self, col: str, pattern: str) -> str:
        return f"string_split_regex({col}, {self.lit(pattern)})"

    def table(self, name: str, sf_dir: str) -> str:
        return name

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def array(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def concat(self, arrays: list[str]) -> str:
        return f"flatten([{', '.join(arrays)}])"

    def sorted_list(self, value: str) -> str:
        return f"list_sort(list({value}))"

    def fold(self, array: str, zero: str, step: str) -> str:
        return f"list_reduce({array}, lambda a, x: {step}, {zero})"

    def transform(self, array: str, x: str, to: str) -> str:
        return f"list_transform({array}, lambda {x}: {to})"

    def transform_at(self, array: str, x: str, n: str, to: str) -> str:
        return f"list_transform({array}, lambda {x}, {n}: {to})"

    def behind(self, array: str, n: str, k: int) -> str:
        return f"{array}[{n} + {k}]"

    def filter(self, array: str, x: str, where: str) -> str:
        return f"list_filter({array}, lambda {x}: {where})"

    def first_of_each(self, array: str) -> str:
        return f"list_filter({array}, lambda v_, i_: list_position({array}, v_) = i_)"

    def joined(self, array: str, sep: str) -> str:
        return f"array_to_string({array}, {self.lit(sep)})"

    def size(self, array: str) -> str:
        return f"len({array})"

    def let(self, name: str, value: str, then: str) -> str:
        return f"list_transform([{value}], lambda {name}: {then})[1]"

    def disjoint(self, spans: str, columns: tuple[str, ...]) -> str:
        """Of ``spans`` (path, head, tail and columns), each that begins behind the last one taken before it in its file."""
        after = "n_ AS MATERIALIZED (SELECT c.path, c.head, min(o.head) AS next FROM c_ AS c JOIN c_ AS o ON c.path = o.path AND o.head > c.tail GROUP BY c.path, c.head)"
        taken = "t_(path, head) AS (SELECT path, min(head) FROM c_ GROUP BY path UNION ALL SELECT n_.path, n_.next FROM t_ JOIN n_ ON t_.path = n_.path AND t_.head = n_.head)"
        return f"WITH RECURSIVE c_ AS MATERIALIZED ({spans}), {after}, {taken} SELECT c_.path, c_.head, c_.tail, {', '.join(columns)} FROM c_ JOIN t_ ON c_.path = t_.path AND c_.head = t_.head"

    def group_counts(self, edges: str) -> str:
        """path, n_groups: how many groups the edges a - b of a path join."""
        both = "b_ AS MATERIALIZED (SELECT path, a, b FROM e_ UNION SELECT path, b, a FROM e_)"
        reach = "r_(path, a, b) AS (SELECT path, a, b FROM b_ UNION SELECT r_.path, r_.a, b_.b FROM r_ JOIN b_ ON r_.path = b_.path AND r_.b = b_.a)"
        return f"WITH RECURSIVE e_ AS MATERIALIZED ({edges}), {both}, {reach} SELECT path, count(DISTINCT least_) AS n_groups FROM (SELECT path, a, least(a, min(b)) AS least_ FROM r_ GROUP BY path, a) GROUP BY path"


SPARK, DUCK, TOLD, ORDERED = Spark(), Duck(), Told(), Ordered()
