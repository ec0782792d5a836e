"""The graph queries beyond one step, against a plain breadth-first search."""

import random
from collections import deque

from tenetry.operators import graph
from tenetry.plans import catalogue

WORDS = ["queue", "ledger", "cache", "index", "token", "shard"]


def registry(seed: int, n: int = 14):
    """Thinly linked beliefs, so that most are more than one shared label apart; two replaced others."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        labels = {f"label {rng.randrange(n)}" for _ in range(rng.randint(1, 2))}
        rows.append((f"b{i:02}", " ".join(rng.sample(WORDS, 3)), rng.randrange(1, 100) / 100, sorted(labels), None))
    return [*rows, ("old1", "old", 0.5, ["label 1"], "b00"), ("old2", "old", 0.5, None, "b01")]


def search(rows, start, max_hops):
    """Paths in the order in which an ordered breadth-first search meets their ends."""
    near = {}
    for i, _, _, labels, by in rows:
        for x in labels or [] if by is None else []:
            near.setdefault(f"b:{i}", set()).add(f"c:{x}")
            near.setdefault(f"c:{x}", set()).add(f"b:{i}")
    paths, queue = {f"b:{start}": [f"b:{start}"]}, deque([f"b:{start}"])
    while queue:
        node = queue.popleft()
        for x in sorted(near[node]) if len(paths[node]) <= max_hops else []:
            if x not in paths:
                paths[x] = [*paths[node], x]
                queue.append(x)
    return paths


def test_queries_go_as_far_as_the_operators(spark, tmp_path, monkeypatch):
    conf_of = lambda rows: {i: c for i, _, c, *_ in rows}
    deepest = 0
    for seed in (1,):
        rows = registry(seed)
        df = spark.createDataFrame(rows, "id string, statement string, confidence double, connections array<string>, superseded_by string")
        monkeypatch.setattr(catalogue, "beliefs", lambda spark, d, df=df: df)
        run = lambda name: catalogue.queries()[name](spark, "").collect()
        conf, words = conf_of(rows), {i: set(s.split()) for i, s, *_ in rows}
        far = {s: search(rows, s, 6) for s in ("b00", "b01")}
        assert {(r["start"], r["node"], r["hops"]) for r in run("graph_walk")} == {(s, n, len(p) - 1) for s in far for n, p in far[s].items() if len(p) <= 4}
        assert {(r["start"], r["node"], r["path"]) for r in run("shortest_paths")} == {(s, n, " > ".join(p)) for s in far for n, p in far[s].items()}
        chains, moved = set(), {(s, s, 0, round(max(conf[s] - 0.3, 0), 6)) for s in far}
        for s in far:
            found = []
            for n, p in far[s].items():
                if n[0] == "b" and 1 < len(p) <= 5:
                    strength = 1.0
                    for x in p[::2]:
                        strength *= conf[x[2:]]
                    found.append((-round(strength, 6), len(p) - 1, -conf[n[2:]], n[2:], " > ".join(p)))
                    both = words[s] & words[n[2:]]
                    if both:
                        hops = len(p) // 2
                        moved.add((s, n[2:], hops, round(min(max(conf[n[2:]] - 0.3 * 0.5**hops * len(both) / len(words[s] | words[n[2:]]), 0), 1), 6)))
            chains |= {(s, i, hops, -x, chain, k + 1) for k, (x, hops, _, i, chain) in enumerate(sorted(found)[:5])}
        assert {(r["start"], r["id"], r["hops"], r["strength"], r["chain"], r["rank"]) for r in run("infer")} == chains
        assert {(r["start"], r["id"], r["hops"], r["confidence"]) for r in run("propagate")} == moved
        deepest = max(deepest, *(len(p) - 1 for f in far.values() for p in f.values()))
        assert any(c[2] == 4 for c in chains) and any(m[2] == 2 for m in moved)
    assert deepest > 4
    assert graph.infer.__defaults__ == (4, 5)
