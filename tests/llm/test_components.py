"""Components against a plain search."""

import random

from folioweave.llm.components import components


def plain(edges):
    comp = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            comp.setdefault(a, a), comp.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in comp and b in comp:
                m = min(comp[a], comp[b])
                changed |= comp[a] != m or comp[b] != m
                comp[a] = comp[b] = m
    return comp


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(-50, 900), rng.randint(-50, 900)) for _ in range(500)]  # trees and some larger parts
    edges += [(i, i + 1) for i in range(2000, 2060)] + [(3000, i) for i in range(2900, 3100)] + [(i + 7, i) for i in range(4000, 4090, 7)]
    edges += [(5, 5), (None, 1), (1, None), edges[0], edges[0][::-1]]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain(edges)
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
