"""Components of random graphs and long chains."""

import random

from sablefin.llm.components import connected_components


def brute(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start] if start not in out else []
        while todo:
            at = todo.pop()
            if at not in out:
                out[at] = start
                todo += near[at]
    return out


def check(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    found = connected_components(df).collect()
    assert {r.node: r.component for r in found} == brute(edges)
    assert len(found) == len(brute(edges))


def test_chain_star_and_random(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(300, 360)]
    star = [(1000, i) for i in range(1001, 1060)]
    loose = [(rng.randrange(-50, 200), rng.randrange(-50, 200)) for _ in range(90)]
    check(spark, [*chain, *star, *loose, (7, 7), (None, 3), (3, None), *loose[:5]])


def test_no_edges(spark):
    check(spark, [])
