"""Hierarchical multi-length packing of tokenised documents.

Every document becomes its token ids and a closing id 0. Whole windows of the longest tier are cut off first; the rest,
the tail, is routed to the smallest tier that holds it. Tiers are packed from the longest down: a window opens with a tail
of its own tier, its gap is filled with the best-fitting tails of any shorter tier, and what still gapes is closed by
cutting one tail, whose remainder is routed again. So every window is full, and all tiers are powers of two, which need no
padding. What is left at a partition's end, fewer ids than the shortest tier, is cut into full powers of two. Windows are
dealt to step groups of equal token numbers.

The plan has no shuffle: each partition packs its own documents in bounded rounds, and what a round leaves over (less than
a window) moves to the next one. Sequence ids carry the partition's number.
"""

from __future__ import annotations

import array
import bisect
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lodestone.llm.common import ship

#: Context sizes, longest first; each is a power of two.
TIERS = (1024, 512, 256, 128)
#: Tails that one packing round holds.
ROUND = 4096
#: Tokens of a training step's group of sequences.
GROUP_TOKENS = 8 * 1024
#: Distinct words whose ids a Python worker remembers.
CACHE = 600_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)

#: Punctuation that closes a word of letters.
CLOSING = ".,;:!?"
#: White space besides the blank and the line feed.
OTHER_BLANKS = re.compile(r"[^\S \n]")

_ENCODERS: dict[str | None, Encoder] = {}


class Encoder:
    """Text to little-endian 32-bit ids by the tokenizers library, with a cache of words.

    The vocabulary's byte-level pre-tokeniser always cuts where white space begins, and before a blank that a non-blank
    follows. In a text whose white space is single blanks and line feeds, each word with what stands before it is encoded by
    itself and remembered; in other texts only the second kind of cut is used. A new word of letters is one piece of the
    pre-tokeniser (as are its letters before closing punctuation), so the library's model gets it directly. Texts that hold
    an added token go to the library whole.
    """

    def __init__(self, vocabulary: str) -> None:
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        kind = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in kind["added_tokens"]]
        cut = kind["pre_tokenizer"] or {}
        #: Whether the cuts hold: only for the byte-level pre-tokeniser with its own pattern, without a normaliser.
        self.cuts = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not kind["normalizer"]
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(256 + i) for i, b in enumerate(hidden)}

    def word(self, letters: str) -> bytes:
        """Ids of a blank and letters."""
        piece = f" {letters}".encode().decode("latin-1").translate(self.letters)
        return array.array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def new(self, w: str) -> bytes:
        """Ids of a word that is not remembered, with the blank before it unless it begins with a line feed."""
        if w[0] == "\n":
            return self.plain(w)
        letters = w.rstrip(CLOSING)
        if not letters.isalpha():
            return self.plain(" " + w)
        ids = self.words.get(letters) or self.word(letters)
        if tail := w[len(letters) :]:
            if tail not in self.tails:
                if len(self.tails) >= CACHE:
                    self.tails.clear()
                self.tails[tail] = self.plain(tail)
            ids += self.tails[tail]
        return ids

    def plain(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.cuts or any(t in text for t in self.added):
            return self.plain(text)
        if not text:
            return b""
        if any(x in text for x in ("  ", "\n\n", " \n", "\n ")) or text[0] in " \n" or text[-1] in " \n" or OTHER_BLANKS.search(text):
            words = [""]
            for k, w in enumerate(text.split(" ")):
                if k and w and not w[0].isspace():
                    words.append(w)
                else:  # a blank before a blank, or at the end, is no cut
                    words[-1] += f" {w}" if k else w
        else:
            words = text.replace("\n", " \n").split(" ")
        known = self.words
        out = [known.get(w) for w in words]
        out[0] = self.plain(words[0])
        for i, ids in enumerate(out):
            if ids is None:
                w = words[i]
                out[i] = ids = known.get(w) or self.new(w)
                if len(known) < CACHE and len(w) < 64:
                    known[w] = ids
        return b"".join(out)


def encoder(vocabulary: str | None) -> Encoder:
    """The worker's encoder of a vocabulary file on this machine; by default byte_bpe_50k.json of public_tokenizers."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return _ENCODERS[vocabulary]


@dataclass(slots=True)
class Tail:
    """Ids [start, start + length) of a document, 4 bytes an id."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4


class Packer:
    """Packs the tails of one partition; rows() hands out the pieces placed so far."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS) -> None:
        self.base, self.tiers, self.group_tokens = partition << 40, tiers, group_tokens
        self.sequences = 0
        self.groups, self.group_no, self.filled = {}, 0, {}
        self.tails: dict[int, list[tuple[int, int]]] = {t: [] for t in tiers}  # sorted (length, number)
        self.held: dict[int, Tail] = {}
        self.number = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, longest = len(ids) // 4, self.tiers[0]
        for start in range(0, n - n % longest, longest):
            self.place([Tail(doc_id, start, ids[4 * start : 4 * (start + longest)], n)])
        if n % longest:
            start = n - n % longest
            self.hold(Tail(doc_id, start, ids[4 * start :], n))

    def hold(self, tail: Tail) -> None:
        tier = min(t for t in self.tiers if t >= len(tail))
        self.number += 1
        self.held[self.number] = tail
        bisect.insort(self.tails[tier], (len(tail), self.number))

    def take(self, most: int, tiers: Iterable[int]) -> Tail | None:
        """The longest tail of at most so many ids in these tiers, longest tier first."""
        for t in tiers:
            if (i := bisect.bisect_right(self.tails[t], (most, self.number + 1))) > 0:
                return self.held.pop(self.tails[t].pop(i - 1)[1])
        return None

    def cut(self, gap: int, tiers: Iterable[int]) -> Tail | None:
        """The first gap ids of the shortest tail there is; the remainder is routed again."""
        for t in reversed(list(tiers)):
            if self.tails[t]:
                tail = self.held.pop(self.tails[t].pop(0)[1])
                self.hold(Tail(tail.doc_id, tail.start + gap, tail.ids[4 * gap :], tail.doc_tokens))
                return Tail(tail.doc_id, tail.start, tail.ids[: 4 * gap], tail.doc_tokens)
        return None

    def pack(self) -> None:
        """Fill windows, longest tier first, until what is left cannot fill one of the shortest tier."""
        for k, tier in enumerate(self.tiers):
            # Stop opening windows of a tier when its tails and all shorter ones no longer fill it.
            total = sum(n for t in self.tiers[k:] for n, _ in self.tails[t])
            while self.tails[tier] and total >= tier:
                window, gap = [], tier
                while gap:
                    tail = self.take(gap, self.tiers[k:]) or self.cut(gap, self.tiers[k:])
                    window.append(tail)
                    gap -= len(tail)
                total -= tier
                self.place(window)
            if self.tails[tier] and k + 1 < len(self.tiers):  # too few ids for this tier: halve them into the next
                for _, number in self.tails[tier]:
                    tail, nxt = self.held.pop(number), self.tiers[k + 1]
                    for a in range(0, len(tail), nxt):
                        self.hold(Tail(tail.doc_id, tail.start + a, tail.ids[4 * a : 4 * (a + nxt)], tail.doc_tokens))
                self.tails[tier] = [x for x in self.tails[tier] if x[1] in self.held]

    def finish(self) -> None:
        """Place the rest, in windows of the powers of two that make up its length."""
        self.pack()
        rest = [self.held.pop(n) for t in self.tiers for _, n in self.tails[t]]
        self.tails = {t: [] for t in self.tiers}
        while left := sum(map(len, rest)):
            gap = 1 << (left.bit_length() - 1)
            window = []
            while gap:
                tail = rest.pop(0)
                if len(tail) > gap:
                    rest.insert(0, Tail(tail.doc_id, tail.start + gap, tail.ids[4 * gap :], tail.doc_tokens))
                    tail = Tail(tail.doc_id, tail.start, tail.ids[: 4 * gap], tail.doc_tokens)
                window.append(tail)
                gap -= len(tail)
            self.place(window)

    def place(self, window: list[Tail]) -> None:
        size = sum(map(len, window))
        if self.filled.get(size, self.group_tokens) >= self.group_tokens:
            self.groups[size], self.filled[size] = self.group_no, 0
            self.group_no += 1
        self.filled[size] += size
        offset = 0
        for t in window:
            self.out.append((t.doc_id, t.start, len(t), zlib.crc32(t.ids), t.doc_tokens, self.base + self.sequences, offset, size, self.base + self.groups[size]))
            offset += len(t)
        self.sequences += 1

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_documents(docs: DataFrame, vocabulary: str | None = None, round_size: int = ROUND) -> DataFrame:
    """One row per piece of each document; SCHEMA's columns.

    docs: doc_id, text; other columns are ignored. A null text counts as empty: it is the single id 0. Repeated rows and
    null ids are packed as documents of their own. An empty table gives no rows. Reruns over the same partitions agree.
    vocabulary: path of a tokenizers file, the same on every executor; by default each executor's own byte_bpe_50k.json.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, held = encoder(vocabulary), Packer(TaskContext.get().partitionId()), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, encode(text.as_py() or "") + b"\0\0\0\0")
                held += 1
                if held >= round_size:
                    packer.pack()
                    held = 0
                    yield _batch(packer.rows())
                elif len(packer.out) >= 50_000:
                    yield _batch(packer.rows())
        packer.finish()
        yield _batch(packer.rows())

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


_ARROW = pa.schema([(n, pa.int32() if k == "int" else pa.int64()) for n, k in (x.split() for x in SCHEMA.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
