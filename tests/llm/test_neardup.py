import random
from collections import Counter

import numpy as np
import pytest
from lodestone.llm import neardup as N
from lodestone.llm.queries import op4_minhash


def bag(text):
    w = (text or "").encode().lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    """Classes of {doc_id: text}."""
    bags = {d: bag(t) for d, t in rows.items()}
    by = {}
    for d, b in bags.items():
        for s in b:
            by.setdefault(s, []).append(d)
    parent = {d: d for d in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, b in bags.items():
        near = Counter()
        for s, n in b.items():
            for e in by[s]:
                if e < d:
                    near[e] += min(n, bags[e][s])
        for e, both in near.items():
            if both >= 0.8 * (sum(b.values()) + sum(bags[e].values()) - both):
                x, y = sorted((find(d), find(e)))
                parent[y] = x
    return {d: find(d) for d in rows}


def test_signatures_are_unbiased():
    rnd = np.random.default_rng(1)
    for wa, wb in (([1, 1, 1, 0, 5], [1, 1, 0, 2, 3]), ([7, 1], [12, 1]), ([100, 3, 40], [90, 0, 64])):
        hits, total = 0, 0
        for _ in range(40):
            x = rnd.integers(0, 1 << 63, len(wa)).astype(np.uint64)
            sig = [N.signatures(np.zeros(sum(v > 0 for v in w), np.int64), x[np.array(w) > 0], np.array([v for v in w if v]), 1, 128)[0] for w in (wa, wb)]
            hits += (sig[0] == sig[1]).sum()
            total += 128
        want = sum(map(min, wa, wb)) / sum(map(max, wa, wb))
        assert abs(hits / total - want) < 4 * (want * (1 - want) / total) ** 0.5


def test_batches_do_not_matter():
    rnd = np.random.default_rng(2)
    docs = [(np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))) for n in (1, 3, 50, 400)]
    weights = [rnd.integers(1, 9, len(x)) for x in docs]
    one = [N.signatures(np.zeros(len(x), np.int64), x, w, 1)[0] for x, w in zip(docs, weights)]
    together = N.signatures(np.repeat(np.arange(4), [len(x) for x in docs]), np.concatenate(docs), np.concatenate(weights), 4)
    assert all((a == b).all() for a, b in zip(one, together))


def variants(rnd, n, words, edits):
    base = ["w%d" % rnd.randint(0, 5000) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = "e%d" % rnd.randint(0, 5000)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small, block", [(12, 256), (3, 8)])
def test_against_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "BLOCK", block)
    rnd = random.Random(small)
    texts = variants(rnd, 60, 120, 6) + variants(rnd, 25, 60, 1) + variants(rnd, 3, 4000, 60) + ["la " * k for k in (3, 4, 5, 6, 90, 100, 110, 140)]
    texts += [" ".join("w%d" % rnd.randint(0, 5000) for _ in range(50)) for _ in range(40)] + ["one", "One", "one two", "same text here"] * 3
    rows = {i * 3: t for i, t in enumerate(texts)}
    want = brute(rows)
    extra = [(9000, None), (9001, ""), (9002, " \n"), (9003, None), (3, None)]
    df = spark.createDataFrame([(d, t, "s", 1.5) for d, t in [*rows.items(), *extra, (0, texts[0])]] + [(None, texts[0], "s", 1.0)], "doc_id long, text string, key string, n double")
    got = N.near_duplicates(df).collect()
    assert len(got) == df.count()
    classes = {r.doc_id: r.class_id for r in got if r.doc_id is not None and (r.doc_id, r.class_id) != (3, 3)}
    assert classes == {d: c for d, c in want.items() if (d, c) != (3, 3)} | {d: d for d, _ in extra if d != 3}
    kept = N.first_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values()) | {d for d, _ in extra} | {None}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).collect() == [] and N.first_of_each(df).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.class_id for r in op4_minhash(spark, sf).collect()} == brute(rows)
