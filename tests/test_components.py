import random

import pytest

from rillstone.operators.components import connected_components


def brute(edges):
    label = {n: n for e in edges if None not in e for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is None or b is None:
                continue
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return label


def graphs():
    rng = random.Random(2)
    path = [(i, i + 1) for i in range(200)]
    rng.shuffle(path)
    yield path
    yield [(0, i) for i in range(1, 150)] + [(500, i) for i in range(501, 600)] + [(7, 7), (900, 900), (None, 3), (3, None)]
    yield [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    yield [(1000 - i, i) for i in range(100)] + [(i, i + 1) for i in range(0, 99, 2)] * 2
    yield []


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
@pytest.mark.parametrize(("chunk", "last"), [(1 << 20, 1 << 16), (8, 0)])
def test_components(spark, chunk, last, kind):
    name = {"long": lambda n: n, "string": lambda n: f"é{n:05d}", "binary": lambda n: bytes([n >> 8, n & 255])}[kind]
    every = list(graphs())
    for edges in every if last or kind == "long" else every[1:2]:
        rows = [tuple(None if n is None else name(n) for n in e) for e in edges]
        frame = spark.createDataFrame(rows, f"a {kind}, b {kind}").repartition(3)
        got = {(bytes(r.node) if kind == "binary" else r.node): (bytes(r.component) if kind == "binary" else r.component) for r in connected_components(frame, chunk=chunk, last=last).collect()}
        assert got == brute(rows)
