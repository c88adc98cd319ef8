import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.packing import Encoder, Packer, pack_documents
from lodestone.llm.queries import op7_packing


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_agrees_with_tokenizers(tok):
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(1)
    alphabet = ["a", "B", " ", "  ", "\n", "é", "ß", "1", "!!", "'s", "\t", " ", "😀", "日本", "the", " \n", " ", "\u0085", "\x1c", "don't", "_", "   ", "\u3000", "\x1c ", "\n ", " \n"]
    texts = ["", " ", "a", "a b", " a", "a ", "a\nb c\n\nd", "x  y"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        assert list(np.frombuffer(enc(t), "<u4")) == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_agree_with_tokenizers(spark, tok):
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(2)
    alphabet = ["a", " ", "  ", "\n", "é", "'s", "the", "<|endoftext|>", "<|endoftext", "|>", "<", "<|ENDOFTEXT|>"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|endoftext|>"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 20))) for _ in range(2000)]
    for t in texts:
        assert list(np.frombuffer(enc(t), "<u4")) == tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert list(np.frombuffer(enc(texts[0]), "<u4")) == [64, 220, 50256, 275]
    docs = dict(enumerate(texts[:50]))
    assert check(pack_documents(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect(), docs, tok) == 0


def check(rows, docs, tok):
    """rows: of pack_documents; docs: {doc_id: text}, ids unique."""
    pieces = sorted((tuple(r)[:7] for r in rows), key=lambda r: (r[0], r[1]))
    at = {d: 0 for d in docs}
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in docs.items()}
    for d, start, length, crc, total, _, _ in pieces:
        assert start == at[d] and length > 0 and total == len(ids[d])
        assert crc == zlib.crc32(ids[d][start : start + length].tobytes())
        at[d] += length
    assert at == {d: len(x) for d, x in ids.items()}
    used = {}
    for *_, seq, off in sorted(pieces, key=lambda r: (r[5], r[6])):
        assert off == used.get(seq, 0)
        used[seq] = off + next(r[2] for r in pieces if r[5] == seq and r[6] == off)
    assert all(n <= 1024 for n in used.values())
    return sum(1024 - n for n in used.values() if n & (n - 1))


def test_documents_of_all_kinds(spark, tok):
    rnd = random.Random(7)
    docs = {i: " ".join("word%d" % rnd.randint(0, 99) for _ in range(rnd.choice([0, 1, 5, 300, 3000]))) for i in range(60)}
    docs |= {100: None, 101: "", 102: "a\n\nb  c", 103: "x" * 50_000}
    df = spark.createDataFrame([(k, v, "z") for k, v in docs.items()], "doc_id long, text string, tier string").repartition(3)
    assert check(pack_documents(df, round_size=8).collect(), docs, tok) == 0
    assert pack_documents(df.limit(0)).collect() == []


def test_full_windows_and_balanced_groups():
    rnd = random.Random(3)
    p = Packer(0)
    for i in range(500):
        p.add(i, b"\1\0\0\0" * rnd.randint(1, 2500))
        if i % 50 == 49:
            p.pack()
    p.finish()
    sizes, groups = {}, {}
    for r in p.rows():
        sizes[r[5]] = sizes.get(r[5], 0) + r[2]
        groups[r[8]] = groups.get(r[8], 0) + r[2]
    assert all(n & (n - 1) == 0 for n in sizes.values())
    assert max(groups.values()) <= 8 * 1024 and sorted(groups.values())[len(groups) // 2] == 8 * 1024


def test_repeated_rows(spark, tok):
    df = spark.createDataFrame([(1, "a b c")] * 3, "doc_id long, text string")
    rows = pack_documents(df.coalesce(1)).collect()
    assert sum(r.length for r in rows) == 3 * (len(tok.encode("a b c", add_special_tokens=False).ids) + 1)


def test_whole_table(spark, tok):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(op7_packing(spark, sf).collect(), docs, tok) == 0


def test_other_vocabularies_take_the_plain_way():
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    for t in ("a b  c\n d", "", " x", "don't stop <|endoftext|> now"):
        assert list(np.frombuffer(Encoder(path)(t), "<u4")) == other.encode(t, add_special_tokens=False).ids
