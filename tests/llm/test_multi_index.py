import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from linklore.llm import multi_index as M

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, least=0.93):
    """n_links and component of every row by comparing all pairs."""
    ok = [r[1] is not None and len(r[1]) and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1])
          and any(v for v in r[1]) for r in rows]
    x = [M.unit(np.array(r[1], np.float32)) if k else None for r, k in zip(rows, ok)]
    n, above = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and float(x[i] @ x[j]) >= least:
                n[i] += 1
                n[j] += 1
                above[root(i)] = root(j)
    least_id = {}
    for i, r in enumerate(rows):
        least_id[root(i)] = min(least_id.get(root(i), r[0]), r[0])
    return {r[0]: (n[i], least_id[root(i)]) for i, r in enumerate(rows)}


def planted(rng, groups=30, dim=64):
    rows = []
    for g in range(groups):
        base = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 9))):
            noise = rng.standard_normal(dim) * rng.uniform(0, 0.4)
            rows.append((base + noise, int(g % 3)))
        rows += [rows[-1]] * int(rng.integers(0, 3))
    rows += [(rng.standard_normal(dim), int(rng.integers(3))) for _ in range(300)]
    order = rng.permutation(len(rows))
    return [(int(k), [float(np.float32(v)) for v in rows[i][0]], rows[i][1]) for k, i in enumerate(order)]


def test_links_and_components_against_brute_force(spark):
    rows = planted(np.random.default_rng(2))
    want = brute(rows)
    got = {r["vec_id"]: r for r in M.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    total, found = sum(n for n, _ in want.values()), sum(got[i]["n_links"] for i in want)
    assert all(got[i]["n_links"] <= want[i][0] for i in want)
    assert found >= 0.97 * total
    assert sum(got[i]["component_id"] == want[i][1] for i in want) >= 0.98 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_crowded_cell_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64)
    rows = [(i, [float(v) for v in base + 0.05 * rng.standard_normal(64)], 1) for i in range(150)]
    got = M.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(r["n_links"] for r in got) >= 0.98 * 150 * 149


def test_odd_rows_link_with_nothing(spark):
    a = [1.0, 2.0, 3.0, 4.0]
    nan, inf = float("nan"), float("inf")
    rows = [(0, a, 1), (1, a, 1), (2, a, 2), (3, a, None), (4, None, 1), (5, [], 1), (6, [0.0] * 4, 1),
            (7, [1.0, None, 3.0, 4.0], 1), (8, [nan, 2.0, 3.0, 4.0], 1), (9, [inf, 2.0, 3.0, 4.0], 1),
            (10, [1.0, 2.0, 3.0], 1), (11, [2.0, 4.0, 6.0, 8.0], 1), (None, a, 1), (12, [1e-30 * v for v in a], 1),
            (13, [3.0], 1), (14, [1e30 * v for v in a], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in M.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in (0, 1, 11, 12, 14):
        assert got[i] == (4, 0, i == 0)
    for i in (2, 3, 4, 5, 6, 7, 8, 9, 10, 13):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.near_vectors(empty).count() == 0
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)]
    extra = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("x")).withColumn("n_links", F.lit(9))
    assert sorted(tuple(r) for r in M.near_vectors(extra).collect()) == [(0, 1, 0, True), (1, 1, 0, False)]


def test_traversal_order_is_multi_sequence():
    rng = np.random.default_rng(1)
    grid = M.fit_grid(M.unit(rng.standard_normal((600, 16))), 8)
    a, b = (d[0] for d in grid.distances(M.unit(rng.standard_normal((1, 16)))))
    heap, seen, order = [(0.0, 0, 0)], {(0, 0)}, []
    i, j = np.argsort(a), np.argsort(b)
    while heap:
        _, p, q = heapq.heappop(heap)
        if a[i[p]] + b[j[q]] > a.min() + b.min() + grid.slack:
            break
        order.append(i[p] * len(grid.right) + j[q])
        for n in ((p + 1, q), (p, q + 1)):
            if n not in seen and n[0] < len(a) and n[1] < len(b):
                seen.add(n)
                heapq.heappush(heap, (a[i[n[0]]] + b[j[n[1]]], *n))
    assert grid.visited(a, b).tolist() == order


@pytest.mark.parametrize("codes", [4, 16])
def test_recall_at_the_least_cosine(codes):
    rng = np.random.default_rng(9)
    x = M.unit(rng.standard_normal((3000, 64)))
    grid = M.fit_grid(x, codes)
    q = M.unit(rng.standard_normal((800, 64)))
    u = rng.standard_normal(q.shape)
    u = M.unit(u - (u * q).sum(axis=1, keepdims=True) * q)
    y = 0.93 * q + np.sqrt(1 - 0.93**2) * u
    (own_q, seen_q), (own_y, seen_y) = grid.cells(q), grid.cells(y)
    hit = [a in sy or b in sq for a, b, sq, sy in zip(own_q, own_y, seen_q, seen_y)]
    assert np.mean(hit) >= 0.95
