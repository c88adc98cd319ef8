"""Each stage against a plain version of it, on its own input."""

import corpus_pipeline as P
import pytest
from lodestone.llm import toxicity
from lodestone.llm.common import materialize
from test_lines import brute as brute_lines
from test_neardup import brute as brute_classes
from test_packing import check, tok  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in P.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF), name))
    return docs


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    assert all(d.columns == steps[0].columns and d.dtypes == steps[0].dtypes for d in steps[:-1])


def test_toxicity(spark, steps):
    model = toxicity.train(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert texts(steps[1]) == {d: t for d, t in texts(steps[0]).items() if model.score(t) < 0.3}


def test_lines(steps):
    want = {d: t for d, _, _, t in brute_lines(list(texts(steps[1]).items()))}
    assert texts(steps[2]) == want and all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_near_duplicates(steps):
    before = texts(steps[2])
    classes = brute_classes(before)
    assert texts(steps[3]) == {d: t for d, t in before.items() if classes[d] == d}


def test_mixing(steps):
    before, size = {r.doc_id: r for r in steps[3].collect()}, {}
    for r in before.values():
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    out = steps[4].collect()
    assert {r.doc_id for r in out} <= set(before) and all(r == before[r.doc_id] for r in out)
    assert sum(len(r.text.split()) for r in out) == pytest.approx(sum(size.values()), rel=0.25)


def test_packing(steps, tok):  # noqa: F811
    copies = {}
    for r in steps[4].collect():
        copies.setdefault(r.doc_id, []).append(r.text)
    assert steps[5].selectExpr("sum(length)").first()[0] == sum(len(v) * (len(tok.encode(v[0], add_special_tokens=False).ids) + 1) for v in copies.values())


def test_run_agrees(spark, steps):
    key = lambda df: sorted(map(str, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(P.run(spark, SF)) == key(steps[5])


def test_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names; and no rows at all."""
    texts_ = [None, "", " \n ", "x " * 20_000, "a plain text of seven words here", "a plain text of seven words here", "é", "line\n" * 50]
    rows = [(i if i != 6 else None, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if i % 2 else 1, 0.5, "n", i) for i, t in enumerate(texts_)]
    rows += [rows[4], rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines string, copies int")
    empty = docs.limit(0)
    for name, stage in P.STAGES:
        out, none = materialize(stage(spark, docs, SF), f"odd-{name}"), stage(spark, empty, SF)
        assert none.count() == 0
        if name != "packing":
            assert out.columns == none.columns == docs.columns and out.dtypes == docs.dtypes
            assert {r.score for r in out.collect()} == {0.5} and {r.n_lines for r in out.collect()} == {"n"}
            docs = out
    assert out.selectExpr("count(distinct sequence_id, offset) = count(*)").first()[0]
