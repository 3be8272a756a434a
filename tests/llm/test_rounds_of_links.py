"""Components of links that hang together by long ways take few rounds, whatever the number of tasks."""

import random

import numpy as np
import pytest

from glyphmill.llm import components


def groups(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for a, b in links if a != b for x in (a, b)}


def tangle():
    """A long path of shuffled numbers, a random graph, a node with very many links, and many that share several."""
    rng = random.Random(5)
    path = list(range(2000))
    rng.shuffle(path)
    links = list(zip(path, path[1:], strict=False)) + [(rng.randrange(3000, 5000), rng.randrange(3000, 5000)) for _ in range(1500)]
    return links + [(6000, k) for k in range(6001, 8500)] + [(rng.randrange(9000, 9014), k) for k in range(9014, 9500) for _ in range(3)] + [(7, 7)]


def test_forest():
    links = tangle()
    a, b = (np.array(x, np.int64) for x in zip(*links, strict=True))
    want = {x: c for x, c in groups(links).items() if x != c}
    assert dict(zip(*(x.tolist() for x in components.forest(a, b)), strict=True)) == want
    assert not len(components.forest(a[:0], b[:0])[0])


@pytest.mark.parametrize("most", [components.FOREST_LINKS, 500])
def test_few_rounds(spark, monkeypatch, most):
    written = []
    monkeypatch.setattr(components, "FOREST_LINKS", most)
    monkeypatch.setattr(components, "materialise", lambda df, real=components.materialise: written.append(1) or real(df))
    links = tangle()
    frame = spark.createDataFrame(links, "a long, b long").repartition(8)
    assert dict(map(tuple, components.connected_components(frame).collect())) == groups(links)
    assert len(written) <= (2 if most > len(links) else 30)
