import math

import numpy as np
import pytest

from gleaner.llm import vector_dedup as V


def brute(rows):
    able = {}
    for i, e, label in rows:
        if label is None or not e or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            continue
        able[i] = (np.array(e, float) / np.linalg.norm(np.array(e, float)), label)
    root = {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(root, 0)
    ids = sorted(able)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            (u, a), (v, b) = able[i], able[j]
            if a == b and len(u) == len(v) and float(u @ v) >= V.THRESHOLD:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i in root}


@pytest.mark.parametrize("cell,block,level", [(4096, 1024, 256), (20, 7, 256), (9, 7, 4)])
def test_against_brute_force(spark, monkeypatch, cell, block, level):
    monkeypatch.setattr(V, "CELL", cell)
    monkeypatch.setattr(V, "ONE_LEVEL", level)
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = []
    for i in range(300):
        e = base[i % 40] + rng.normal(scale=0.08, size=8)
        rows.append((i, e.tolist(), int(i % 3)))
    rows += [(1000 + k, base[0].tolist(), 1) for k in range(30)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 8, 1), (2003, [None] * 8, 1), (2004, [math.nan] * 8, 1), (2005, [math.inf] * 8, 1), (2006, base[0].tolist(), None), (2007, base[0][:4].tolist(), 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, unit string").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in V.link_vectors(df).collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert V.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_rows_of_one_id(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (3, [0.0, 2.0], 1), (None, [3.0, 0.0], 1), (7, [1.0, 1.0], 1)]
    got = [tuple(r) for r in V.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()]
    assert sorted(got, key=str) == sorted([(5, 1, 5, True), (5, 1, 3, False), (3, 1, 3, True), (None, 1, 5, False), (7, 0, 7, True)], key=str)


def test_two_levels_cover_every_pair():
    """Every pair within reach has one of the two in the other's home cell."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 6)).repeat(20, axis=0) + rng.normal(scale=0.05, size=(600, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = V.spherical_kmeans(x, 5)
    near = np.argmax(x @ c.T, axis=1)
    cells = V.Cells(c, [V.spherical_kmeans(x[near == i], 7) if (near == i).sum() > 1 else c[i : i + 1] for i in range(5)])
    home, guests = {}, set()
    for rows, at, guest in cells.visits(x, 2 * math.sin(math.acos(V.THRESHOLD) / 2)):
        for i, cell, g in zip(rows.tolist(), at.tolist(), guest.tolist()):
            if g:
                guests.add((i, cell))
            else:
                assert i not in home
                home[i] = cell
    assert len(home) == 600 and len(set(home.values())) > 20 and guests
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= V.THRESHOLD, 1))):
        assert (home[i] == home[j]) + ((int(i), home[j]) in guests) + ((int(j), home[i]) in guests) == 1
