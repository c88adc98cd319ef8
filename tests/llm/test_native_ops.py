"""Mixing, license scan and quality ledger: odd rows, brute force, SQL."""

import random
import re
from collections import Counter

import pytest
from oracle import compare

from lodestone.llm import licenses, mixing, quality
from lodestone.llm.queries import ORACLE, QUERIES, op3_licenses

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "x y z x y z", "\n\n", "All rights reserved. " * 3, "é ß 日本", "a\x00b", "CC BY CC BY", "w " * 20_000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, [None, "b", "a"][i % 3], t, "n") for i, t in enumerate(ODD)] + [(3, "a", None, "", "n"), (None, "x y", "a", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, norm string, n_words string")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    compare(QUERIES[name](spark, SF), ORACLE[name], SF)


def brute_licenses(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    hits = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    norm, spans = f" {' '.join(words)} ", []
    for k, (label, key, expression, conf) in enumerate(licenses.rules()):
        if key in norm[1:-1]:
            for m in re.finditer(f"(?<= )(?:{expression})(?= )", norm):
                a = norm[: m.start()].count(" ") - 1
                spans.append((a, -(a + m[0].count(" ") + 1), k, label, conf))
    kept = [d for d in spans if not any(e != d and e[0] <= d[0] and -e[1] >= -d[1] and ((e[0], e[1]) != (d[0], d[1]) or e[2] < d[2]) for e in spans)]
    return len(words), sorted(hits), sorted((a, -b, k) for a, b, k, *_ in kept)


def test_licenses_against_brute_force(spark, odd):
    rnd = random.Random(5)
    vocab = "cc by nc sa 4 0 the gnu general public license version 2 licensed under apache mit bsd all rights reserved copyright 2020 x".split()
    texts = {i: rnd.choice([" ", "-", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60))) for i in range(200)}
    texts |= {1000 + i: t for i, t in enumerate(ODD)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        n, hits, kept = brute_licenses(texts[r.doc_id])
        assert r.n_words == n
        assert sorted((h.start, h.label) for h in r.base) == hits
        assert sorted((d.start, d.end, d.priority) for d in r.detections) == kept
    assert licenses.license_report(licenses.scan_licenses(odd)).count() == odd.count()
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert len(licenses.rules()) >= 200


def sample(rnd, parsed):
    """A random text that a parsed expression matches."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, x = rnd.choice(arg)
            out += chr(x if str(kind) == "LITERAL" else rnd.randint(*x))
        elif name == "MAX_REPEAT":
            out += "".join(sample(rnd, arg[2]) for _ in range(rnd.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif name == "BRANCH":
            out += sample(rnd, rnd.choice(arg[1]))
        else:
            out += sample(rnd, arg[3])
    return out


def test_keyword_gate_loses_no_match(spark, monkeypatch):
    rnd, table = random.Random(8), licenses.rules()
    texts = [" ".join(sample(rnd, re._parser.parse(x)).split()) for _, _, x, _ in table for _ in range(8)]
    keys = [k for _, k, _, _ in table for _ in range(8)]
    assert [(k, t) for k, t in zip(keys, texts, strict=True) if k not in t or (w := licenses.anchor(k)) and w not in t.split()] == []
    lines = ["Licensed under GPLv2", "see gplv3", "Expat license", "PSF license", "do what the heck you want to public license", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-NonCommercial-NoDerivs", "Free to use, copy and modify."]
    texts = lines + texts[::8]
    monkeypatch.setattr(licenses, "rules", lambda: [(a, "", x, c) for a, _, x, c in table])
    want = [brute_licenses(t)[2] for t in texts]
    monkeypatch.undo()
    found = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        assert sorted((d.start, d.end, d.priority) for d in r.detections) == want[r.doc_id], texts[r.doc_id]
    got = {r.doc_id: [d.label for d in r.detections] for r in found}
    assert [got[i] for i in range(8)] == [["gpl-2.0"], ["gpl-3.0"], ["mit"], ["python-2.0"], ["wtfpl"], ["cc-by-sa"], ["cc-by-nc-nd"], ["other-permissive"]]


def test_licenses_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    table = licenses.rules()
    got = op3_licenses(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hits, kept = brute_licenses(texts[r.doc_id])
        base = sorted({label for _, label in hits})
        labels = sorted({*base, *(table[k][0] for *_, k in kept)})
        best = max([0.5 if hits else 0.0, *(table[k][3] for *_, k in kept)])
        assert (r.n_words, r.n_base, r.base_labels, r.labels, r.n_detections) == (n, len(hits), ",".join(base), ",".join(labels), len(kept))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None)) and abs(r.score - best) < 1e-12


def test_known_lines(spark):
    lines = {0: "Licensed under the Apache License, Version 2.0.", 1: "Released under the MIT License.", 2: "Licensed under CC BY-NC 4.0.", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "An apache of the mit."}
    got = {r.doc_id: r for r in licenses.license_report(licenses.scan_licenses(spark.createDataFrame(list(lines.items()), "doc_id long, text string"))).collect()}
    assert [got[i].labels for i in range(5)] == ["apache-2.0", "mit", "cc-by,cc-by-nc", "gpl,gpl-3.0", ""]


def brute_quality(text):
    text = text or ""
    words = re.findall(quality.WORD, text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(quality.WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_against_brute_force(spark, odd):
    rnd = random.Random(6)
    texts = {i: "".join(rnd.choice(["a ", "b ", "c\n", "# ", "dd ", "  "]) for _ in range(rnd.randint(0, 80))) for i in range(200)} | {1000 + i: t for i, t in enumerate(ODD)}
    for r in quality.ledger(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id])
    book = quality.ledger(odd)
    assert book.count() == odd.count() and quality.ledger(odd.limit(0)).count() == 0
    full = [r.fail_bits for r in book.collect()]
    for r in quality.ablations(book, "v1").collect():
        bit = quality.mask((r.rule,))
        assert r.n_failed == sum(b & bit > 0 for b in full) and r.n_only == sum(b == bit for b in full)


def test_mixing_odd_rows(spark, odd):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and all(0 <= r.taken <= 3 * r.size for r in out)
    copies = sorted(mixing.mixed_documents(odd).select("doc_id").collect(), key=str)
    assert len(copies) == sum(r.copies for r in out) and mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0


def test_mixing_rows_without_an_id(spark):
    rows = [(None, f"{i} " + "w " * 11, "a") for i in range(200)] + [(i, "w " * 12, "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, weights=(1.0, 20.0)).collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 24 for s in target) and 0 < target["a"] < 2400


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


def test_mixing_meets_targets(spark):
    rnd = random.Random(8)
    rows = [(i, "w " * rnd.randint(0, 30), "s%d" % min(rnd.randint(0, 40), 9)) for i in range(3000)] + [(9000, "w " * 5, None)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 15
