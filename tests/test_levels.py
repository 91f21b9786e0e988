import random
from functools import lru_cache

import pytest

from loomspark.operators import callgraph
from loomspark.scratch import Scratch


def brute(names, edges):
    calls = {n: sorted({b for a, b in edges if a == n and b in names}) for n in names}

    def reach(n):
        seen, left = set(), [n]
        while left:
            for c in calls[left.pop()]:
                if c not in seen:
                    seen.add(c)
                    left.append(c)
        return seen

    reached = {n: reach(n) for n in names}
    counts_as_0 = lambda a, b: b <= a and (a == b or a in reached[b])  # noqa: E731  b is on a cycle with a

    @lru_cache(None)
    def level(n):
        return max((1 if counts_as_0(n, c) else level(c) + 1 for c in calls[n]), default=0)

    used = sorted({level(n) for n in names})
    inside = {(a, b) for a in names for b in calls[a] if a != b and a in reached[b]}
    return {n: used.index(level(n)) for n in names}, inside


def frames(spark, names, edges):
    return spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(edges), "caller string, callee string")


@pytest.mark.parametrize("seed, n, m", [(1, 14, 18), (2, 30, 45)])
def test_same_as_plain_search(spark, seed, n, m):
    rnd = random.Random(seed)
    names = [f"f{k:02}" for k in range(n)]
    edges = [(rnd.choice(names), rnd.choice([*names, "unknown"])) for _ in range(m)]
    want, inside = brute(set(names), edges)
    v, e = frames(spark, names, edges)
    assert {r.name: r.level for r in callgraph.levels(v, e).collect()} == want
    if seed == 2:
        known = e.where("callee <> 'unknown'").distinct()
        assert {tuple(r) for r in callgraph.cyclic(Scratch(spark, "test"), known).select("caller", "callee").collect()} == inside


def test_long_and_short_ways(spark):
    """Random graphs without cycles, some of whose functions are settled early by short ways and others late by long ones."""
    rnd = random.Random(5)
    names = [f"f{k:03}" for k in range(160)]
    edges = [(names[k], names[k + 1]) for k in range(60)] + [(names[a], names[b]) for a, b in (sorted(rnd.sample(range(160), 2)) for _ in range(220))]
    want, _ = brute(set(names), edges)
    v, e = frames(spark, names, edges)
    assert {r.name: r.level for r in callgraph.levels(v, e).collect()} == want


def test_a_cycle_of_ten_thousand_functions(spark):
    """And a tail that leads to it: rounds grow with the logarithm."""
    n = 10_000
    names = [f"f{k:05}" for k in range(n)] + ["leaf", "top"]
    edges = [(names[k], names[(k + 1) % n]) for k in range(n)] + [(names[n - 1], "leaf"), ("top", names[0])]
    v, e = frames(spark, names, edges)
    got = {r.name: r.level for r in callgraph.levels(v, e).collect()}
    assert got == {"leaf": 0, "top": n + 1} | {names[k]: n - k for k in range(n)}


def test_branches_that_meet_again_and_again(spark):
    """A chain of 64 diamonds: no single chain, but each round halves it."""
    edges = [(f"a{k:03}", f"{x}{k:03}") for k in range(64) for x in "bc"] + [(f"{x}{k:03}", f"a{k + 1:03}") for k in range(64) for x in "bc"]
    names = sorted({x for e in edges for x in e})
    v, e = frames(spark, names, edges)
    got = {r.name: r.level for r in callgraph.levels(v, e).collect()}
    assert got == {n: 2 * (64 - int(n[1:])) - (n[0] != "a") for n in names}


def test_no_functions_and_no_calls(spark):
    v, e = frames(spark, [], [])
    assert callgraph.levels(v, e).collect() == []
    v, e = frames(spark, ["a"], [("a", "b")])
    assert [tuple(r) for r in callgraph.levels(v, e).collect()] == [("a", 0)]


def test_rounds_write_what_is_open_only(spark, monkeypatch):
    """A chain beside many functions that call nothing: these are written once, whatever the rounds."""
    rows, plain = {}, Scratch.cut

    def cut(self, df, name, by=None):
        table = plain(self, df, name, by)
        if name.startswith("way"):
            rows[name] = table.count()
        return table

    monkeypatch.setattr(Scratch, "cut", cut)
    names = [f"f{k:03}" for k in range(300)]
    v, e = frames(spark, names, [(names[k], names[k + 1]) for k in range(16)])
    assert {r.name: r.level for r in callgraph.levels(v, e).collect()} == {n: max(16 - k, 0) for k, n in enumerate(names)}
    assert len(rows) > 3 and sum(rows.values()) < 2 * len(names)
