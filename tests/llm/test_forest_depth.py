"""Embedding near-dedup where the trees need more levels than the driver's sample carries."""

import numpy as np
import pytest

from cataloom.llm import embedding_dedup as E


def planted(n, groups, dim, seed):
    """Random vectors, and groups of two to four near copies among them."""
    draw = np.random.default_rng(seed)
    rows = draw.normal(size=(n, dim))
    at, links = 0, set()
    for _ in range(groups):
        size = int(draw.integers(2, 5))
        base = draw.normal(size=dim)
        for k in range(size):
            rows[at + k] = base + draw.normal(size=dim) * 0.2
        at += size
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for low in range(0, n, 500):
        a, b = np.nonzero(unit[low : low + 500] @ unit.T >= 0.9)
        links |= {(int(x) + low, int(y)) for x, y in zip(a, b, strict=True) if x + low < y}
    return rows, links


@pytest.mark.parametrize("sample, leaf", [(200, 25), (64, 40)])
def test_leaves_of_leaves_lose_few_links(spark, sample, leaf):
    rows, links = planted(3000, 250, 24, 4)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(5000, rows[7].tolist()), (5001, None), (None, rows[8].tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in E.near_vectors(df, sample=sample, leaf=leaf).collect()}
    again = {r.vec_id: r for r in E.near_vectors(df, sample=sample, leaf=leaf).collect()}
    assert got == again and len(got) == 3003
    found = sum(r.n_links for i, r in got.items() if i is not None and i < 3000)
    copies = 2 * sum(7 in pair for pair in links) // 2 + 1  # vector 5000 repeats vector 7
    assert 0.95 * (2 * len(links) + copies) <= found <= 2 * len(links) + copies and len(links) > 300
    assert got[5000].component_id == got[7].component_id and got[5001].n_links == got[None].n_links == 0
    for a, b in links:
        if got[a].n_links and got[b].n_links:
            assert got[a].component_id <= a and got[b].component_id <= b


def test_deeper_leaves_are_small(spark):
    rows, _ = planted(4000, 10, 16, 5)
    df = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, copies long")
    draw = np.random.default_rng(1)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    trees = [E._Tree(unit[:100], 2, draw) for _ in range(2)]
    out = E._deeper(df, 4000, 16, trees, 4, E.SPILL)
    leaves = [r["count"] for r in out.groupBy("code").count().collect()]
    assert len(leaves) == 2 * 4 * 16 and max(leaves) < 4000 / 8
    per = {r.vec_id: (r.n, r.k) for r in out.groupBy("vec_id").agg({"code": "count"}).withColumnRenamed("count(code)", "n").join(out.selectExpr("vec_id", "size(codes) as k").distinct(), "vec_id").collect()}
    assert len(per) == 4000 and all(n == k >= 2 for n, k in per.values())
