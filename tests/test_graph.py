"""Graph queries against plain walks, on random graphs, on a long line, and where they must raise."""

import random
import time

import pytest

from chronolake.operators import dag


def random_graph(seed, n=60):
    r = random.Random(seed)
    parents = {k: r.sample(range(k), min(k, r.choice([0, 1, 1, 1, 2, 2, 3]))) for k in range(n)}
    return {k: p for k, p in parents.items() if p}


def walk(parents, node):
    """{ancestor: depth} of a node, itself included."""
    seen, level, depth = {node: 0}, [node], 0
    while level:
        depth += 1
        level = sorted({p for k in level for p in parents.get(k, []) if p not in seen})
        seen |= dict.fromkeys(level, depth)
    return seen


def bases(parents, a, b):
    common = walk(parents, a).keys() & walk(parents, b).keys()
    return {n for n in common if not any(n != m and n in walk(parents, m) for m in common)}


def table(spark, parents):
    return spark.createDataFrame([(k, p, i) for k, ps in parents.items() for i, p in enumerate(ps)], "child long, parent long, ord int")


@pytest.mark.parametrize("seed", [1, 2])
def test_closures_equal_plain_walks(spark, monkeypatch, seed):
    """With a short search first, and over lines alone."""
    if seed == 2:
        monkeypatch.setattr(dag, "SHORT_JOBS", 0)
    parents = random_graph(seed)
    edges = table(spark, parents)
    nodes = [59, 41, 30]
    reach = {n: walk(parents, n) for n in nodes}
    assert {(r.start, r.node) for r in dag.reachable(edges, nodes).collect()} == {(n, m) for n in nodes for m in reach[n]}
    assert {(r.start, r.node): r.depth for r in dag.ancestors_of(edges, nodes).collect()} == {(n, m): d for n in nodes for m, d in reach[n].items()}
    assert {r.node for r in dag.common_ancestors(edges, nodes).collect()} == set.intersection(*(set(reach[n]) for n in nodes))
    assert {r.node for r in dag.merge_bases(edges, 59, 41).collect()} == bases(parents, 59, 41)
    pairs = spark.createDataFrame([(a, b) for a in range(0, 60, 7) for b in range(0, 60, 5)], "a long, b long")
    want = {(r.a, r.b) for r in pairs.collect()}
    got = {}
    for r in dag.merge_bases_of(dag.Lines(edges), pairs).collect():
        got.setdefault((r.a, r.b), set()).add(r.node)
    known = {n for k, ps in parents.items() for n in (k, *ps)}
    for a, b in want:
        assert got.get((a, b), set()) == (bases(parents, a, b) if {a, b} <= known or a == b else set())
    rows = {(r.a, r.b): (r.ahead, r.behind) for r in dag.ahead_behind(edges, pairs).collect()}
    related = {(r.a, r.b): r.related for r in dag.all_related(edges, pairs).collect()}
    holds = {(r.ancestor, r.node): r.holds for r in dag.descends(edges, pairs.toDF("ancestor", "node")).collect()}
    steps = {(r.ancestor, r.node): r.distance for r in dag.distances(edges, pairs.toDF("ancestor", "node")).collect()}
    for a, b in want:
        x, y = walk(parents, a), walk(parents, b)
        if {a, b} <= known:
            assert rows[a, b] == (len(x.keys() - y.keys()), len(y.keys() - x.keys()))
        assert related[a, b] == bool(x.keys() & y.keys())
        assert holds[a, b] == (a in y) and steps[a, b] == y.get(a, -1)


def test_levels_equal_plain_ones(spark):
    parents = random_graph(3) | {100 + i: [99 + i] for i in range(1, 40)} | {100: [59, 58]}
    level = {}
    for n in sorted({n for k, ps in parents.items() for n in (k, *ps)}):
        level[n] = max((level[p] + 1 for p in parents.get(n, [])), default=0)
    nodes = spark.createDataFrame([(n,) for n in level], "node long")
    assert {r.node: r.level for r in dag.generations(table(spark, parents), nodes).collect()} == level


def test_a_round_of_levels_writes_only_what_was_reached(spark, monkeypatch):
    """Not all that waits, in every round."""
    n, written, plain = 256, [], dag._staged_sum

    def counted(df, name, what):
        found = plain(df, name, what)
        written.append(found[3])
        return found

    monkeypatch.setattr(dag, "_staged_sum", counted)
    edges = table(spark, {k: sorted({k // 2, k // 3} if k % 3 == 0 else {k // 2}) for k in range(1, n)})
    levels = {r.node: r.level for r in dag.generations(edges, dag._nodes(edges)).collect()}
    assert levels == {k: k.bit_length() for k in range(n)}
    assert sum(written) < 2 * n


def test_a_long_line_takes_few_rounds(spark):
    n = 1000
    edges = table(spark, {k: [k - 1] for k in range(1, n)} | {2000: [990], 2001: [2000]})
    began = time.time()
    assert [r.node for r in dag.merge_bases(edges, n - 1, 2001).collect()] == [990]
    assert dag.revision_range(edges, [n - 1], [2001]).count() == 9
    levels = {r.node: r.level for r in dag.generations(edges, dag._nodes(edges)).collect()}
    assert levels[n - 1] == n - 1 and levels[2001] == 992
    assert time.time() - began < 120  # about 15 s on 8 cores; a round a commit would take ten minutes


def test_cycles_raise(spark):
    ring, tailed = table(spark, {1: [2], 2: [3], 3: [1]}), table(spark, {1: [2], 2: [3], 3: [1], 4: [3]})
    for run in (lambda: dag.Lines(ring), lambda: dag.generations(tailed, dag._nodes(tailed))):
        with pytest.raises(ValueError, match="cycle"):
            run()
