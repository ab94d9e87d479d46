import random

from tallywren.operators.graph import connected_components


def truth(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_random_and_chain(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5000, 5000 + i) for i in range(1, 300)]
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + chain + star + [(None, 3), (7, 7), (1000, 1001)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == truth(edges)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
