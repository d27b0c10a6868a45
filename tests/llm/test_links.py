"""How many edges a large group of near copies gives, and that they link what all pairs do."""

import random

import numpy as np
import pytest

from tokenlens.llm import simhash


def roots(edges: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    root = {k: k for k in nodes}

    def of(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = of(a), of(b)
        root[max(x, y)] = min(x, y)
    return {k: of(k) for k in nodes}


@pytest.mark.parametrize("chunk", [16, 1024])
def test_near_copies_have_few_edges(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(3)
    near, far = rng.getrandbits(62), [rng.getrandbits(62) for _ in range(40)]
    prints = {k: near ^ (1 << rng.randrange(62)) for k in range(400)} | {1000 + k: f for k, f in enumerate(far)}
    nodes = list(prints)
    rng.shuffle(nodes)
    rows = [(n, key, prints[n]) for key in range(30) for n in nodes if key == 0 or rng.random() < 0.9]
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame(rows, "node long, key long, s0 long").repartition(5)).distinct().collect()]
    each = [(a, b) for a in nodes for b in nodes if a < b and (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS]
    assert roots(got, nodes) == roots(each, nodes)
    # Each key leaves out a tenth of the rows: a copy's edges lead to the few smallest of all.
    chunks = int(np.ceil(len(nodes) / chunk))
    assert len(got) <= (5 * len(nodes) if chunks == 1 else 30 * (len(nodes) + chunks**2))
