import random
from collections import defaultdict

import numpy as np
import pytest
from lodestone.llm.lines import LineIndex, dedup_lines


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        hi, lo = rnd.integers(0, 1 << 63, n).astype(np.uint64), rnd.integers(0, 1 << 63, n).astype(np.uint64)
        lo[: n // 2] = lo[:1].repeat(n // 2)  # halves that agree
        index = LineIndex.from_bytes(LineIndex.build(hi, lo, np.arange(n), np.arange(n) * 2).to_bytes())
        assert sorted(index.hash.find(hi, lo).tolist()) == list(range(n))
        found, count, last = index.probe(hi, lo)
        assert found.all() and (count == np.arange(n)).all() and (last == 2 * np.arange(n)).all()
        other = rnd.integers(0, 1 << 63, 500).astype(np.uint64)
        assert not index.probe(other, other ^ np.uint64(5))[0].any()


def brute(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(d)
    out = []
    for d, t in rows:
        kept = []
        for x in (t or "").split("\n"):
            h = holders.get(key(x), [])
            last = max((y for y in h if y is not None), default=None)
            if len(h) < 5 or last is None or d == last:
                kept.append(x)
        out.append((d, (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    common = [c * n for c in "aBé" for n in (20, 39, 40, 41)] + ["x" * 200, "  " + "a" * 40 + "\t", "A" * 40, "É" * 40, ""]
    rows = [(i, "\n".join(rnd.choice(common) if rnd.random() < 0.6 else str(rnd.random()) * 3 for _ in range(rnd.randint(0, 12)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n".join(common * 50)), (None, "a" * 40), (5, "a" * 41 + "\n" + "x" * 200), (5, "a" * 41 + "\n" + "x" * 200)]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, hi string, n_lines int")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "hi", "n_lines", "n_dropped"]
    got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()], key=repr)
    assert got == brute(rows)


def test_empty_and_nothing_repeated(spark):
    df = spark.createDataFrame([(1, "a" * 50), (2, "b" * 50)], "doc_id long, text string")
    assert dedup_lines(df.limit(0)).collect() == []
    assert sorted(r.text for r in dedup_lines(df).collect()) == ["a" * 50, "b" * 50]
