"""Toxicity and language: held-out accuracy, brute-force parse, odd rows."""

import random
import zlib

import numpy as np
import pytest
from lodestone.llm import langid, toxicity
from lodestone.llm.queries import op9_toxicity, op10_language

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    for sf, recall, noise in (("/root/testdata/sf0.01", 0.7, 0.08), ("/root/testdata/sf0.1", 0.9, 0.02)):
        got = {r.doc_id: r for r in op9_toxicity(spark, sf).collect()}
        labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
        assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
        held = [(got[d].predicted, t) for d, t in labels.items() if got[d].held_out]
        toxic, clean = ([p for p, t in held if t == c] for c in (1, 0))
        print(sf, sum(toxic), len(toxic), sum(clean), len(clean))
        assert sum(toxic) >= recall * len(toxic) and sum(clean) <= noise * len(clean)


def plain_grams(text):
    """Hashed n-grams, one by one."""
    text, out = f" {text.lower()} ", set()
    for n in toxicity.NGRAMS:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % (1 << 64)
                h ^= h >> 29
            out.add((h * (2 * n + 1) % (1 << 64)) >> (64 - toxicity.BITS))
    return sorted(out)


def test_toxicity_against_a_plain_classifier(spark, monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    words = ["idiot", "fool", "tree", "Über", "sun", "日本", "a", "road"]
    texts = {i: " ".join(rnd.choice(words[2:] if i % 3 else words) for _ in range(rnd.randint(0, 60))) for i in range(240)}
    toxic = {i: int("idiot" in t or "fool" in t) for i, t in texts.items()}
    for t in list(texts.values())[:20]:
        assert toxicity.features(t).tolist() == (plain_grams(t) if t else [])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    model = toxicity.train(docs, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    own = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [sum(toxic[i] == c for i in own) for c in (0, 1)]
    counts = {}
    for i in own:
        for g in plain_grams(texts[i]) if texts[i] else ():
            counts.setdefault(g, [0, 0])[toxic[i]] += 1
    for g, (n0, n1) in counts.items():
        if (k := model.number[g]) > 0:
            assert n0 + n1 >= toxicity.LEAST_ROWS
            assert abs(model.ratio[k - 1] - (np.log((n1 + 1) / (rows[1] + 2)) - np.log((n0 + 1) / (rows[0] + 2)))) < 1e-9
    for r in toxicity.score(docs, model).collect():
        x = [model.number[g] - 1 for g in (plain_grams(texts[r.doc_id]) if texts[r.doc_id] else ()) if model.number[g] > 0]
        z = model.bias + sum(model.weight[k] for k in set(x)) / max(1e-300, sum(model.ratio[k] ** 2 for k in set(x)) ** 0.5)
        want = 1 / (1 + np.exp(-z)) if x else model.prior
        assert abs(r.score - want) < 1e-9 and (not x or (r.score >= 0.3) == toxic[r.doc_id])


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot there", "s"), (1, "you idiot there", "s"), (2, None, "s"), (3, "", "s"), (None, "a", "s"), (4, "a kind word", "s"), (5, "idiot " * 20_000, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (4, 0), (None, 1), (5, 1), (99, 0)], "doc_id long, toxic int")
    for some in (labels, labels.where("toxic = 1"), labels.limit(0)):
        model = toxicity.train(docs, some)
        out = toxicity.score(docs, model).collect()
        assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.score(docs, model).columns == ["doc_id", "text", "score"]
    assert model.score("anything") == model.score(None) and model.score("x") < 1e-6


def test_language_held_out(spark):
    got = {r.doc_id: r for r in op10_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [(got[d.doc_id].lang_pred, d.lang) for d in docs if got[d.doc_id].held_out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(1, "der die das", "de", 0), (2, None, "de", 0), (3, "123 !", "de", 0), (4, "the of and", "en", 0), (5, "the", None, 0), (None, "the", "en", 0), (6, "of " * 30_000, "en", 0), (4, "the of and", "en", 0)], "doc_id long, text string, lang string, lang_pred int")
    out = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert out[2].lang_pred == out[3].lang_pred == "und" and out[2].score == 0.0
    assert out[5].lang_pred in ("de", "en", "und") and langid.identify(docs.limit(0), langid.train(docs)).count() == 0
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def plain_parse(known, s):
    """Phrases of s, each the longest that occurs in known, or one symbol; both are lists of numbers."""
    text = "".join(map(chr, known))
    at = n = 0
    while at < len(s):
        step = 0
        while at + step < len(s) and s[at + step] and "".join(map(chr, s[at : at + step + 1])) in text:
            step += 1
        at, n = at + max(step, 1), n + 1
    return n


@pytest.mark.parametrize("block, blocks", [(256, 8192), (8, 48), (5, 3)])
def test_parse_against_brute_force(monkeypatch, block, blocks):
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "BLOCKS", blocks)
    rnd = random.Random(4)
    learned = {k: "".join(rnd.choice(a) for _ in range(300)) for k, a in (("x", "abc "), ("y", "bcd "), ("z", "ade "))}
    learned["w"] = "ab" * 150
    model = langid.build(learned)
    known = [model.encode(learned[k])[0].tolist() for k in model.langs]
    texts = ["".join(rnd.choice("abcdeQ ") for _ in range(rnd.randint(0, 60))) + "a" for _ in range(60)]
    # Long matches, which pass whole blocks: stretches of the training texts, alone and joined.
    texts += ["".join((t := learned[rnd.choice("wxyz")])[(i := rnd.randint(0, 200)) : i + rnd.randint(1, 99)] for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    texts += ["ab" * 140, "a", learned["x"] * 3, "b" + "ab" * 100 + "c" + "ba" * 70]
    found = model.predict(texts)
    for text, (lang, score) in zip(texts, found, strict=True):
        s = model.encode(text)[0].tolist()
        cost = [plain_parse(k, s) * w for k, w in zip(known, model.log_size, strict=True)]
        order = sorted(range(4), key=lambda i: (cost[i], i))
        assert lang == model.langs[order[0]]
        assert abs(score - cost[order[1]] / (cost[order[0]] + cost[order[1]])) < 1e-12


def test_every_letter_of_the_training_texts_is_known():
    rnd = random.Random(5)
    hans, more, hangul = ([chr(c) for c in range(a, a + 1500)] for a in (0x4E00, 0x5A00, 0xAC00))
    alphabets = {"aa": [chr(c) for c in range(0x3B1, 0x3CA)] + list("ABCıİß"), "ja": more + hans[:500], "ko": hangul, "zh": hans + more[:500]}
    learned = {k: "".join(rnd.choice(a) for _ in range(6000)) for k, a in alphabets.items()}
    model = langid.build(learned)
    for text in learned.values():
        assert langid.UNKNOWN not in model.encode(text)[0]
    assert model.table.nbytes < 8 * 8 * sum(map(len, learned.values())) + 8 * 3 * model.width * len(learned)
    for k in ("ko", "zh", "ja"):
        text = "".join(learned[k][a : a + 5] for a in (rnd.randrange(5990) for _ in range(20)))
        assert model.predict([text])[0][0] == k
    known = {k: model.encode(t)[0].tolist() for k, t in learned.items()}
    grams = {k: {tuple(x[i : i + n]) for n in range(1, 13) for i in range(len(x) - n + 1)} for k, x in known.items()}
    for _ in range(20):
        text = "".join((t := learned[rnd.choice(list(learned))])[(a := rnd.randrange(5990)) : a + rnd.randint(1, 6)] for _ in range(20))
        s = model.encode(text)[0].tolist()
        want = []
        for k in model.langs:
            at = n = 0
            while at < len(s):
                step = 1
                while at + step < len(s) and step < 12 and tuple(s[at : at + step + 1]) in grams[k]:
                    step += 1
                at, n = at + step, n + 1
            want.append(n)
        padded = np.full((1, langid.BLOCK), model.width - 1, np.uint32)
        padded[0, : len(s)] = s
        assert model.phrases(padded, np.array([False]))[0][0].tolist() == want


def test_every_sampled_document_is_learned_from(spark):
    docs = [(i, (chr(0x4E00 + i) * 3 + "ab " * 30) * 60, "de") for i in range(60)] + [(100, "short", "de"), (101, "", "de"), (102, "123", "de")]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    used = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    root = np.array([model.base[0]])
    assert len(used) > 30 and all(model.step(root, np.array([model.symbols[chr(0x4E00 + i)]]))[0] >= 0 for i in used)
    assert round(2 ** model.log_size[0] - 2) <= langid.TRAIN_SYMBOLS
    assert langid.shares([5, 100, 100, 1], 106) == [5, 50, 50, 1] and langid.shares([3, 4], 100) == [3, 4]
