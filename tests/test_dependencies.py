"""Versions, ranges of advisories, manifests of projects, and repeated blocks against plain Python."""

import functools
import itertools
import json
import random
import re

import pytest

from lintlake.functions.dialect import SPARK
from lintlake.functions.versions import version_key
from lintlake.operators import cross_rules
from lintlake.plans import catalog
from lintlake.plans.analyze import Analysis
from lintlake.sources import advisories, corpora
from lintlake.sources import files as sources

#: In order, each below the next; those of a tuple are equal.
SEMANTIC = ["x", ("0", "0.0.0"), "0.0.1", "0.9", "1.0.0-0", "1.0.0-2", "1.0.0-11", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-alpha-x", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", ("1", "1.0.0", "v1.0", "1.0.0+build.5"), "1.0.0.1", "1.0.2", "1.0.10", "1.2", "1.10", "2.0.0-rc.1", "2", "10.0"]
PYTHON = ["", "0.9", "1.0.dev1", "1.0.dev12", "1.0a1.dev2", "1.0a1", ("1.0a2", "1.0-alpha.2"), "1.0b1", "1.0rc1.dev1", ("1.0rc1", "1.0c1"), "1.0rc10", ("1.0", "1.0.0", "v1"), "1.0.post1.dev1", "1.0.post1", "1.0.post2", "1.0.1.dev1", "1.0.1", "1.1", "1.10"]


@pytest.mark.parametrize("ecosystem, order", [("npm", SEMANTIC), ("Go", SEMANTIC), ("PyPI", PYTHON)])
def test_keys_sort_as_versions_do(spark, ecosystem, order):
    rows = [(k, v) for k, same in enumerate(order) for v in ((same,) if isinstance(same, str) else same)]
    keyed = spark.createDataFrame(rows, "place int, v string").selectExpr("place", f"{version_key(SPARK, 'v', repr(ecosystem))} AS k").collect()
    for a, b in itertools.combinations(keyed, 2):
        assert (a["k"] < b["k"]) == (a["place"] < b["place"]) and (a["k"] == b["k"]) == (a["place"] == b["place"]), (a, b, rows)


def compare(a, b):
    """Semantic versions, written out."""

    def parts(v):
        release, _, pre = v.partition("-")
        numbers = [int(x) for x in release.split(".")]
        return numbers + [0] * (4 - len(numbers)), [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in pre.split(".")] if pre else None

    (ra, pa), (rb, pb) = parts(a), parts(b)
    if ra != rb:
        return -1 if ra < rb else 1
    if pa == pb:
        return 0
    return 1 if pa is None else -1 if pb is None else -1 if pa < pb else 1


def test_keys_of_random_versions(spark):
    rng = random.Random(2)
    make = lambda: ".".join(str(rng.choice([0, 0, 1, 2, 9, 10, 11, 100])) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", f"-{rng.choice(['alpha', 'rc', 'b-1', '7'])}", f"-rc.{rng.randint(0, 20)}", f"-{rng.randint(0, 12)}.x"])
    versions = sorted({make() for _ in range(300)})
    keys = {r["v"]: r["k"] for r in spark.createDataFrame([(v,) for v in versions], "v string").selectExpr("v", f"{version_key(SPARK, 'v', repr('npm'))} AS k").collect()}
    order = sorted(versions, key=functools.cmp_to_key(compare))
    for a, b in zip(order, order[1:], strict=False):
        assert (keys[a] == keys[b]) if compare(a, b) == 0 else keys[a] < keys[b], (a, b)


def test_ranges_of_records(spark, tmp_path):
    """Events in order, several ranges, last affected versions, listed versions, no version, and records that say nothing."""
    affected = lambda name, ranges, versions=(): {"package": {"ecosystem": "npm", "name": name}, "versions": list(versions), "ranges": [{"type": t, "events": e} for t, e in ranges]}
    records = [
        {"id": "R-1", "aliases": ["C-1"], "database_specific": {"severity": "HIGH"}, "affected": [affected("a", [("SEMVER", [{"introduced": "0"}, {"fixed": "1.2.0"}, {"introduced": "2.0.0-beta"}, {"fixed": "2.1"}])])]},
        {"id": "R-2", "affected": [affected("a", [("SEMVER", [{"introduced": "3.0.0"}, {"last_affected": "3.4.9"}]), ("GIT", [{"introduced": "0"}])], ["7.0.0"])]},
        {"id": "R-3", "affected": [affected("b", [("SEMVER", [{"introduced": "1.0.0"}])])]},
        {"id": "R-4"},
    ]
    (tmp_path / "adv.json").write_text("\n".join(map(json.dumps, records)))
    table = advisories.read(spark, f"file://{tmp_path}/adv.json")
    assert table.columns == cross_rules.ADVISORY.split(", ")
    want = {"1.1.9": {"C-1"}, "1.2.0": set(), "1.10.0": set(), "2.0.0-alpha": set(), "2.0.0-beta.2": {"C-1"}, "2.0.9": {"C-1"}, "2.1.0": set(), "3.4.9": {"R-2"}, "3.4.10": set(), "7.0.0": {"R-2"}, "7.0.1": set()}
    for version, ids in want.items():
        files = sources.read_table(spark.createDataFrame([("package.json", json.dumps({"dependencies": {"a": f"^{version}", "b": "~0.9.9", "local": "file:x"}})), ("sub/package.json", json.dumps({"dependencies": {"b": "1.5.0"}})), ("bad/requirements.txt", "numpy\n")], "path string, content string"))
        got = Analysis(files, categories=["dependencies"], advisories=table).issues().collect()
        assert {r["title"].rsplit(" ", 1)[1] for r in got} == ids and all(f"a@{version}" in r["title"] for r in got), version


def test_manifests_grow_with_the_table(spark, sf):
    """What the queries find is what a plain reading of the manifests finds."""
    files = spark.sql(f"{corpora.views(SPARK, corpora.manifests(SPARK, sf))} SELECT path, content FROM files").collect()
    listed = spark.sql(f"SELECT * FROM {corpora.advisories(SPARK, sf)}").collect()
    n_suppliers = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert len(files) == 3 * n_suppliers
    deps = set()
    for path, content in files:
        if path.endswith("package.json"):
            both = json.loads(content)
            clean = {k: re.sub(r"[\^~>=<]", "", v).split(" ")[0] for k, v in (both["dependencies"] | both["devDependencies"]).items()}
            deps |= {("npm", k, v, path) for k, v in clean.items() if v[:1].isdigit()}
        elif path.endswith(".txt"):
            found = (re.match(r"([a-zA-Z0-9_\-]+)\s*(?:[><=!]+\s*([\d.]+))?", line.strip()) for line in content.split("\n"))
            deps |= {("PyPI", m[1], m[2] or "", path) for m in found if m}
        else:
            deps |= {("Go", m[1], m[2], path) for m in (re.match(r"require\s+(\S+)\s+v([\d.]+)", line) for line in content.split("\n")) if m}
    queries = catalog.queries()
    assert {tuple(r) for k in ("npm", "pypi", "go") for r in queries[f"dep_inventory_{k}"](spark, sf).collect()} == deps
    by_package = {}
    for a in listed:
        by_package.setdefault((a["eco"], a["package"]), []).append(a)
    plain = lambda v: re.sub(r"rc", "-rc.", v)  # noqa: E731  (the one Python pre-release there)
    hit = lambda v, a: not v or (compare(plain(v), plain(a["introduced"])) >= 0 and (not a["until"] or compare(v, a["until"]) < 0) and (not a["last"] or compare(v, a["last"]) <= 0))
    want = {(path, name, version, a["id"]) for eco, name, version, path in deps for a in by_package.get((eco, name), []) if hit(version, a)}
    got = queries["dep_vulnerable_uncapped"](spark, sf).collect()
    assert len(got) == len(want) > 500
    assert {(r["file"], r["title"]) for r in got} == {(path, f"Vulnerable dependency: {name}@{version} — CVE-{re.sub('[^0-9]', '', i.split('-')[1])}") for path, name, version, i in want}


def test_block_pairs_by_hand(spark):
    rng = random.Random(9)
    rows = [(f"{k}.py", "\n".join(rng.choice(["a = 1", "b = 2", "", "# c"]) for _ in range(rng.randint(5, 40)))) for k in range(12)]
    first = {}
    for path, content in sorted(rows):
        lines = content.split("\n")
        for i in range(len(lines) - 5) if len(lines) > 10 else ():
            block = lines[i : i + 6]
            if sum(bool(x.strip()) and not x.strip().startswith(("//", "#")) for x in block) >= 4:
                first.setdefault("\n".join(block), {}).setdefault(path, i + 1)
    want = {(*list(p.items())[0], *list(p.items())[1]) for p in first.values() if len(p) > 1}
    a = Analysis(sources.read_table(spark.createDataFrame(rows, "path string, content string")), categories=["none"])
    assert {tuple(r)[:4] for r in a.sql(cross_rules.block_pairs(SPARK)).collect()} == want and want
    assert {(r["file"], r["line"]) for r in a.sql(cross_rules.exact_block(SPARK)).collect()} == {w[:2] for w in want}


def test_no_text_of_blocks_is_shuffled(spark, sf):
    plan = catalog.queries()["dup_exact_block"](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("FileScan parquet [l_") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan
