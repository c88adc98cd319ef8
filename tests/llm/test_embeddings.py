import math
import random

import numpy as np
import pytest
from lodestone.llm import embeddings as E
from lodestone.llm.components import connected_components
from lodestone.llm.queries import op1_embeddings


def brute(rows, threshold=E.THRESHOLD):
    ok = [i for i, (v, e, k) in enumerate(rows) if v is not None and k is not None and E._usable(e) is not None]
    unit = {i: (x := np.array(rows[i][1], np.float64)) / np.linalg.norm(x) for i in ok}
    links, near = {i: 0 for i in range(len(rows))}, {i: [] for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                near[a].append(b)
    out = []
    for i, (v, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min((rows[j][0] for j in seen), default=None) if v is not None else None
        out.append((v, links[i], c, v is None or v == c))
    return sorted(out, key=repr)


def same(spark, rows):
    df = spark.createDataFrame([(v, None if e is None else [None if x is None else float(x) for x in e], k, 0) for v, e, k in rows], "vec_id long, embedding array<float>, label int, copies int")
    return sorted([tuple(r) for r in E.near_duplicates(df).collect()], key=repr)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted([tuple(r) for r in op1_embeddings(spark, sf).collect()], key=repr) == brute(rows)


@pytest.mark.parametrize("loose", [10, 1000])
def test_odd_rows_and_large_groups(spark, monkeypatch, loose):
    monkeypatch.setattr(E, "BLOCK", 16)
    monkeypatch.setattr(E, "INDEX_BLOCK", 16)
    monkeypatch.setattr(E, "BUCKET", 20)
    monkeypatch.setattr(E, "LOOSE", loose)
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((6, 16))
    rows = [(i, np.float32(base[i % 6] + rnd.standard_normal(16) * 0.12).tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, base[0].astype(np.float32).tolist(), 0) for i in range(20)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [math.nan] + [1.0] * 15, 0), (303, [math.inf] * 16, 0), (304, [None] + [1.0] * 15, 0), (305, [1.0, 0.0], 0), (306, [2.0, 0.0], 0), (307, [-0.0, 1.0], 0), (308, [0.0, 1.0], 0), (309, base[0].tolist(), None), (None, base[0].tolist(), 0), (310, [], 0), (305, None, 0)]
    rows = [(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e], k) for v, e, k in rows]
    assert same(spark, rows) == brute(rows)


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("bits", [2, 5, 10, 20])
def test_recall_follows_the_tables(bits):
    found, tables = E.tables_for(E.BUCKET << bits)
    assert found == bits or bits == 2
    assert (1 - (1 - math.acos(0.98) / math.pi) ** found) ** tables <= E.MISS


def test_loose_groups(spark, monkeypatch):
    monkeypatch.setattr(E, "LOOSE", 50)
    monkeypatch.setattr(E, "BLOCK", 32)
    monkeypatch.setattr(E, "BUCKET", 2)
    steps = np.random.default_rng(5).standard_normal((400, 16))
    walk = np.zeros((400, 16))
    walk[0] = steps[0]
    for i in range(1, 400):  # neighbours link, the ends lie far apart: one group, many buckets
        walk[i] = walk[i - 1] / np.linalg.norm(walk[i - 1]) + 0.045 * steps[i]
    rows = [(i, np.float32(v).tolist(), 1) for i, v in enumerate(walk)]
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) < 200
    assert same(spark, rows) == want


def test_sketches():
    rnd = np.random.default_rng(6)
    a = rnd.standard_normal((20_000, 32))
    other = rnd.standard_normal((20_000, 32))
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    other -= (other * unit).sum(1, keepdims=True) * unit
    b = 0.98 * unit + math.sqrt(1 - 0.98**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    apart = (E.signs(a, E.SKETCH) != E.signs(b, E.SKETCH)).sum(1)
    assert apart.max() <= E.sketch_slack() < 40 and abs(apart.mean() / E.SKETCH - math.acos(0.98) / math.pi) < 0.005


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rnd.randint(0, 200), 1000 + rnd.randint(0, 200)) for _ in range(150)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7), (None, 3), (3, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(8)).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
