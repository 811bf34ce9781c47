"""Clusters by rounds of stars against union-find, and what later rounds still hold."""

import random

import pytest

from docforge.operators import components


def union_find(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("most", [0, components.MOST_BROADCAST])
def test_clusters_of_any_shape(spark, monkeypatch, most):
    monkeypatch.setattr(components, "MOST_BROADCAST", most)
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)]  # small clusters and one large
    links += [(1000 + n, 1001 + n) for n in range(30)] + [(2000, 2001 + n) for n in range(30)] + [(2050 - n, 2050) for n in range(30)] + [(3000, 3001), (4000, 4000)]
    got = {r.id: r.label for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == union_find(links)


def test_finished_clusters_are_in_no_later_round(spark, monkeypatch):
    held = []
    least = components._with_least
    monkeypatch.setattr(components, "_with_least", lambda links, n: held.append(n) or least(links, n))
    links = [(3 * n, 3 * n + 1) for n in range(500)] + [(10_000 + n, 10_001 + n) for n in range(40)]
    got = components.connected(spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.label for r in got.collect()} == union_find(links)
    assert held[0] == 2 * 540 and len(held) > 2 and max(held[2:]) <= 2 * 80
