"""The analyzer over any files: all rules, one table of issues, and the scores."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.dialect import ORDERED, SPARK, TOLD, Dialect
from lintlake.model import Settings
from lintlake.operators import context_rules, cross_rules, function_rules, graph, line_rules, ordered
from lintlake.plans import report
from lintlake.sources import corpora, repeats

#: Parts of the issues that are found at once.
PARALLEL = 6


class Analysis:
    """Issues of ``files`` (path, name, lang, content). The lines are split once and written, each once with its places, for all rules to read;
    what rules ask of lines in their order is found in one pass, and written as well."""

    def __init__(self, files: DataFrame, settings: Settings = Settings(), categories: list[str] | None = None, advisories: DataFrame | None = None, more: dict[str, Callable[[Analysis], DataFrame]] | None = None) -> None:
        """``advisories``: as ``sources.advisories.read`` gives them. ``more``: further analyzers by category; each gives file, line,
        severity and title, and one that cannot be called is passed over."""
        self.spark = files.sparkSession
        self.settings = settings
        self.categories = categories
        self.more = {k: f for k, f in (more or {}).items() if callable(f)}
        self.key = key = uuid.uuid4().hex[:12]
        files.select("path", "name", "lang", "content").createOrReplaceTempView(f"raw_{key}")
        self.advisories = f"advisories_{key}" if advisories is not None else ""
        if advisories is not None:
            advisories.createOrReplaceTempView(self.advisories)
        both = corpora.views(SPARK, f"SELECT * FROM raw_{key}")
        self.folder = f"{graph.shared_folder(self.spark)}/analysis-{key}"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        self.spark.sql(f"{both} SELECT * FROM files").write.parquet(f"{self.folder}/files")
        self.files = self._read("files")
        self.tables = ["files"]  # the rest is made of them, side by side
        once = repeats.distinct_lines(f"SELECT * FROM files_{key}", line_rules.path_kind(SPARK), self.spark, whole=True)
        made = {"told": lambda: self.sql(f"SELECT * FROM {once}")}
        rules = {k: (c, lambda d, k=k, f=f: self._select(d, k, f)) for k, (c, f) in (context_rules.RULES | cross_rules.RULES).items()}
        rules |= {"circular_scc": ("circular", cross_rules.import_edges), "sec_high_entropy": ("security", report.high_entropy)}
        wanted = ordered.kinds({k: f for k, (c, f) in rules.items() if self.wants(c)}, self.wants)
        if wanted:
            self.sql("SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS rank FROM (SELECT DISTINCT path FROM files)").write.parquet(f"{self.folder}/ranks")
            self._read("ranks")
            ranked = f"SELECT f.path, name, coalesce(lang, '') AS lang, CAST(lines AS BIGINT) AS n_lines, coalesce(wide, false) AS wide, rank, content FROM files_{key} AS f JOIN ranks_{key} AS r ON f.path <=> r.path"
            made["ordered"] = lambda: ordered.found(self.spark, ranked, settings, wanted)
        self._side_by_side({f"{self.folder}/{name}": df for name, df in made.items()})
        self._read("told")
        self.tables.append("told")
        if wanted:
            self._read("ordered", ordered.SCHEMA)
            self.tables += ["ranks", "ordered"]

    def _read(self, name: str, schema: str = "") -> DataFrame:
        """A written table, and a view of it for the analysis' statements. ``schema``: of a table that may have no file."""
        df = (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.folder}/{name}")
        df.createOrReplaceTempView(f"{name}_{self.key}")
        return df

    def _side_by_side(self, made: dict[str, Callable[[], DataFrame]]) -> None:
        """Write each table below its path, some at once; one of several kinds of rows by kind."""

        def write(x: tuple[str, Callable[[], DataFrame]]) -> None:
            df = x[1]()
            (df.write.partitionBy("kind") if "kind" in df.columns else df.write).parquet(x[0])

        with ThreadPoolExecutor(PARALLEL) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(write), made.items()))

    def sql(self, select: str, more: str = "", spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        # a path is listed, and its schema read by a job, for every statement that names it; a view once
        own = spark is self.spark
        table = (lambda n: f"{n}_{self.key}") if own else (lambda n: f"parquet.`{self.folder}/{n}`")
        known = {n: f"SELECT * FROM {table(n)}" for n in self.tables}
        if own and "ordered" in self.tables:  # reports, which other sessions ask for, read files and lines
            known |= {n: v.format(rows=table("ordered")) for n, v in ordered.VIEWS.items()}
        if own and "told" in self.tables:
            known |= {n: function_rules.spans(SPARK, x) for n, x in function_rules.EXTRACTORS.items()}
        said = f"{more} {select}"
        lines = "told" in self.tables and "lines" in said
        # every table of a statement is planned, whether it is read or not
        named = [f"{n} AS ({v})" for n, v in known.items() if n == "files" or n in said or (lines and n == "told")]
        return spark.sql(f"WITH {', '.join(named)}{f', lines AS ({TOLD.LINES})' if lines else ''}{more} {select}")

    def close(self) -> None:
        """Delete the written tables; what was not collected or written elsewhere by then is gone. Else Spark does it when the session ends."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def wants(self, category: str) -> bool:
        return self.categories is None or category in self.categories

    def _select(self, d: Dialect, key: str, select: Callable[[Dialect], str]) -> str:
        """The SQL of a rule with the settings."""
        s = self.settings
        return context_rules.long_file(d, s.file_lines) if key == "smell_long_file" else context_rules.deep_nesting(d, s.nest_depth) if key == "smell_deep_nesting" else cross_rules.exact_block(d, s.dup_window) if key == "dup_exact_block" else cross_rules.vulnerable(d, table=self.advisories) if key == "dep_vulnerable" else select(d)

    def parts(self) -> dict[str, DataFrame]:
        """The issues before deduplication (category, rule, file, line, severity, title), in parts that are found apart."""
        return {name: part() for name, part in self._parts().items()}

    def _cycles(self) -> DataFrame:
        """The issues of files in import cycles; every member carries the penalty. Its steps run when it is called."""
        members = graph.strong_components(self.sql(cross_rules.import_edges(ORDERED)))
        sizes = graph.cycle_issues(members).withColumnRenamed("file", "scc")
        found = members.join(sizes, "scc").select(F.col("node").alias("file"), "line", "severity", "title")
        return found.select(F.lit("circular").alias("category"), F.lit("circular_scc").alias("rule"), *found.columns)

    def _parts(self) -> dict[str, Callable[[], DataFrame]]:
        """The parts by name, those with the most steps first; some run Spark when they are called."""
        names = ["category", "rule", "file", "line", "severity", "title"]
        found: dict[str, list[DataFrame]] = {}

        def add(category: str, rule: str, df: DataFrame) -> None:
            found.setdefault(category, []).append(df.select(F.lit(category).alias("category"), F.lit(rule).alias("rule"), *names[2:]))

        for key, (category, select) in (context_rules.RULES | cross_rules.RULES).items():
            if self.wants(category):
                add(category, key, self.sql(self._select(ORDERED, key, select)))
        for key, (category, _, select) in function_rules.RULES.items():
            if self.wants(category):
                add(category, key, self.sql(select(ORDERED, self.settings)))
        for category, analyzer in self.more.items():
            if self.wants(category):
                add(category, f"{category}_more", analyzer(self))
        if self.wants("security"):
            add("security", "sec_high_entropy", self.sql(report.high_entropy(ORDERED)))
        out: dict[str, Callable[[], DataFrame]] = {"cycles": self._cycles} if self.wants("circular") else {}
        out |= {category: (lambda dfs=dfs: reduce(DataFrame.unionByName, dfs)) for category, dfs in found.items()}
        rules = [r for r in line_rules.RULES if self.wants(r.category)]
        if rules:
            out["lines"] = lambda: self.sql(line_rules.fused_once("told", rules)).select(names)
        return out

    def found(self) -> DataFrame:
        """All issues, before deduplication. Parts are small plans that run side by side; each is written once."""
        folder = f"{self.folder}/found-{uuid.uuid4().hex[:12]}"
        parts = self._parts()
        self._side_by_side({f"{folder}/{name}": part for name, part in parts.items()})
        return self.spark.read.parquet(*[f"{folder}/{name}" for name in parts])

    def issues(self) -> DataFrame:
        """Issues, one for each place and start of title where the category asks for that."""
        name = f"found_{uuid.uuid4().hex[:12]}"
        self.found().createOrReplaceTempView(name)
        return self.spark.sql(report.deduplicated(f"SELECT * FROM {name}"))

    def report(self, issues: DataFrame, select) -> DataFrame:
        """One of the report functions over issues, in the session that they are of."""
        name = f"issues_{uuid.uuid4().hex[:12]}"
        issues.createOrReplaceTempView(name)
        return self.sql(select(SPARK), f", issues AS (SELECT * FROM {name})", issues.sparkSession)
