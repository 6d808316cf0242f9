"""Components, breaks and chains of import graphs against plain walks over the same edges."""

import random

import numpy as np
import pytest

from lintlake.operators import graph


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    seen = {}
    for node in {x for e in edges for x in e}:
        todo, found = [node], set()
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in found:
                    found.add(x)
                    todo.append(x)
        seen[node] = found
    return seen


def components_by_hand(edges):
    far = reach([e for e in edges if e[0] != e[1]])
    groups = {n: sorted(m for m in far if m == n or (m in far[n] and n in far[m])) for n in far}
    return {n: g[0] for n, g in groups.items() if len(g) > 1}


def chain_by_hand(edges, scc, of):
    inner = sorted({(a, b) for a, b in edges if a != b and of.get(a) == of.get(b) == scc})
    degree = {}
    for _, b in inner:
        degree[b] = degree.get(b, 0) + 1
    now = min(n for n in degree if degree[n] == max(degree.values()))
    chain = [now]
    while True:
        after = next((b for a, b in inner if a == now and b not in chain), None)
        if after is None:
            return " → ".join([*chain, chain[0]])
        chain.append(after)
        now = after


def random_graph(rng):
    n = rng.randint(2, 26)
    names = [f"n{k:02d}" for k in range(n)]
    kind = rng.random()
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(1, int(n * rng.choice([0.8, 1.3, 2.5]))))]
    if kind < 0.3:  # a ladder without cycles, and one edge back
        edges = [(a, b) for a, b in zip(names, names[1:], strict=False)] + [(a, b) for a, b in zip(names, names[2:], strict=False)] + [(names[-1], rng.choice(names))]
    return edges


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    """Several graphs at once, as parts of one that do not touch."""
    rng = random.Random(seed)
    edges = [(f"g{k}{a}", f"g{k}{b}") for k in range(5) for a, b in random_graph(rng)]
    frame = spark.createDataFrame(edges, "src string, dst string").persist()
    want = components_by_hand(edges)
    members = graph.strong_components(frame).persist()
    assert {r["node"]: r["scc"] for r in members.collect()} == want
    chains = {r["scc"]: r["chain"] for r in graph.cycle_chains(frame, members).collect()}
    assert chains == {scc: chain_by_hand(edges, scc, want) for scc in set(want.values())}


def test_no_cycles(spark):
    for edges in ([], [("a", "a")], [("a", "b"), ("b", "c")]):
        frame = spark.createDataFrame(edges, "src string, dst string")
        members = graph.strong_components(frame)
        assert members.columns == ["node", "scc"] and members.collect() == [] and graph.cycle_chains(frame, members).collect() == []


def test_ring_of_a_hundred_thousand(spark, monkeypatch):
    """A ring with a long tail on either side takes a few dozen steps, and its chain is the ring."""
    steps = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: steps.append(1) or real(df))
    n = 100_000
    frame = spark.range(n).selectExpr("format_string('f%06d', id) AS src", f"format_string('f%06d', (id + 1) % {n}) AS dst")
    members = graph.strong_components(frame).persist()
    assert members.selectExpr("count(*)", "min(scc)", "max(scc)").first() == (n, "f000000", "f000000")
    assert len(steps) < 40
    chain = graph.cycle_chains(frame, members).first()["chain"]
    assert chain == " → ".join([*(f"f{k:06d}" for k in range(n)), "f000000"])


def test_walk_of_a_million_edges():
    rng = np.random.default_rng(3)
    s, t = np.divmod(np.unique(rng.integers(0, 1 << 36, 1_000_000)), 1 << 18)
    chain = graph.walk(s.astype(np.int32), t.astype(np.int32))
    assert len(set(chain.tolist())) == len(chain) and chain[0] == np.argmax(np.bincount(t))
    have = set(zip(s.tolist(), t.tolist(), strict=True))
    assert all(e in have for e in zip(chain[:-1].tolist(), chain[1:].tolist(), strict=True))
