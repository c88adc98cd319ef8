"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language tells how far a text can be read as a substring of that text; a parse
cuts the text greedily into such longest matches (phrases). The fewer phrases, weighted by the logarithm of the training
text's length, the closer the language. Automata become sparse transition tables; every letter of the training texts is a
symbol of its own.

Texts are parsed whole. To go through them in lockstep, they are cut into blocks, and every block is parsed from its start
on as if a phrase began there. Then the parse before it is carried on into the block until one of its phrases begins where
one of the block's own does; from there on both are the same. Phrases counted are those of the one parse from the text's
start, however far a phrase reaches.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_bucket, materialize, ship

#: Training text of a language: so many symbols, shared out if there are many languages, from about TRAIN_DOCS documents
#: (chosen by a hash of doc_id) in equal shares, of each a passage of at most TRAIN_CHARS code points at a place that the
#: hash chooses.
TRAIN_SYMBOLS, ALL_SYMBOLS, TRAIN_DOCS, TRAIN_CHARS = 20_000, 600_000, 64, 4_000
#: Documents that the training samples of all languages hold together, about; languages whose counts are broadcast.
ALL_DOCS, BROADCAST_LANGS = 20_000, 10_000
#: Places that are tried for a state's transitions before the table grows.
TRIES = 1000
#: Symbols of a block, and blocks times languages that are parsed at a time.
BLOCK, BLOCKS = 256, 8192
#: Bytes that the broadcast tables may have.
MODEL_BYTES = 1 << 29

UNKNOWN, GAP = 0, 1


class Automaton:
    """Suffix automaton of a sequence of small integers."""

    def __init__(self, symbols: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


def place(states: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Table of the transitions (-1: none), and each state's base in it.

    The transition of a state by symbol c is at base + c and holds base << 32 | base of the next state. Bases differ and
    rows are laid into each other's gaps, fullest first, so the table follows the number of transitions.
    """
    rnd = random.Random(0).random
    size = 2 * sum(map(len, states)) + 2
    used, taken, base = bytearray(size + width), bytearray(size), [0] * len(states)
    for state in sorted(range(len(states)), key=lambda i: -len(states[i])):
        steps = states[state]
        for _ in range(TRIES):
            b = int(rnd() * size)
            if not taken[b] and not any(used[b + c] for c in steps):
                break
        else:
            b = size + width
            used.extend(bytes(width + 1))
            taken.extend(bytes(width + 1))
            size = b + 1
        base[state], taken[b] = b, 1
        for c in steps:
            used[b + c] = 1
    table = np.full(size + width, -1, np.int64)
    for state, steps in enumerate(states):
        for c, to in steps.items():
            table[base[state] + c] = base[state] << 32 | base[to]
    return table, np.array(base)


@dataclass
class Model:
    """Tables of transitions (see place) of all languages, one after another; symbol `width - 1` is padding."""

    langs: list[str]
    symbols: dict[str, int]
    table: np.ndarray
    base: np.ndarray
    width: int
    log_size: np.ndarray

    def __post_init__(self) -> None:
        self.lut: np.ndarray | None = None

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols of a text, letters in lower case, any run of other characters as one gap; whether it has a letter."""
        if self.lut is None:
            self.lut, self.alpha = lookup(self.symbols)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.lut[points]
        gap = s == GAP
        keep = np.ones(len(s), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        return s[keep], bool(self.alpha[points].any())

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states that the symbols lead to; -1: none."""
        found = self.table[state + symbol]
        return np.where(found >> 32 == state, found & 0xFFFFFFFF, -1)

    def phrases(self, blocks: np.ndarray, follows: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """blocks: n x BLOCK symbols; follows: whether a block goes on with the text of the one before; state: where the first
        block's parse stands, if it goes on with an earlier text.

        Returns n x languages: the phrases that begin in each block (those of a carried-on parse are counted where it started),
        and the state in which each text's last block ends (other rows mean nothing).
        """
        n, langs, root = len(blocks), len(self.langs), self.base[None, :]
        symbols, pad = blocks.T.astype(np.int64), self.width - 1
        at = np.repeat(root, n, 0)
        if state is not None:
            at[0] = state
        begins = np.zeros((BLOCK, n, langs), bool)
        for k, column in enumerate(symbols):
            at, begins[k] = self._read(at, column[:, None], root)
        # Carry each block's parse into the next one of its text. Row e of the lists below: block, language.
        own, lang = (x.reshape(-1) for x in np.meshgrid(np.flatnonzero(follows[1:]), np.arange(langs), indexing="ij"))
        where, now = (own + 1) * BLOCK, at[own, lang]
        more, to, end = np.zeros(len(own), np.int64), np.full(len(own), -1, np.int64), now.copy()
        left = np.arange(len(own))
        while len(left):
            spot = where[left]
            inside = spot < n * BLOCK
            inside[inside] &= (spot[inside] % BLOCK > 0) | follows[spot[inside] // BLOCK]
            end[left[~inside]] = now[left[~inside]]
            left, spot = left[inside], spot[inside]
            block, place, tongue = spot // BLOCK, spot % BLOCK, lang[left]
            symbol = symbols[place, block]
            nxt, begun = self._read(now[left], symbol, self.base[tongue])
            met = begun & begins[place, block, tongue]
            over = symbol == pad
            to[left[met]] = spot[met]
            end[left[over]] = now[left[over]]
            more[left] += begun & ~met
            now[left] = nxt
            where[left] += 1
            left = left[~met & ~over]
        # A block counts from where the parse before it met its own; what a parse passed wholly does not count.
        first, alive = np.zeros((n, langs), np.int64), np.ones((n, langs), bool)
        extra = np.zeros((n, langs), np.int64)
        extra[own, lang] = more
        near = to // BLOCK == own + 1
        first[to[near] // BLOCK, lang[near]] = to[near] % BLOCK
        for e in np.flatnonzero(~near):  # in the order of blocks
            b, g = own[e], lang[e]
            if alive[b, g]:
                stop = to[e] // BLOCK if to[e] >= 0 else int(b) + 1 + int(np.argmin(np.r_[follows[b + 1 :], False]))
                alive[b + 1 : stop, g] = False
                if to[e] >= 0:
                    first[stop, g] = to[e] % BLOCK
                else:
                    at[stop - 1, g] = end[e]
        count = np.zeros((n, langs), np.int64)
        for k in range(BLOCK):
            count += begins[k] & (k >= first)
        return np.where(alive, count + extra, 0), at

    def _read(self, state: np.ndarray, symbol: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, whether a phrase begins with the symbol). A phrase begins at the root, or where the one before cannot go
        on; a symbol that nothing matches is one. Padding changes nothing."""
        padding = symbol == self.width - 1
        ahead = self.step(state, symbol)
        begun = (ahead < 0) & ~padding
        if begun.any():
            first = self.step(root, symbol)
            ahead = np.where(begun, np.where(first < 0, root, first), ahead)
        return np.where(padding, state, ahead), (begun | (state == root)) & ~padding

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; ("und", 0.0) for null, for texts without a letter, and if nothing was learned."""
        encoded = [self.encode(t) if t and self.langs else (None, False) for t in texts]
        totals = np.zeros((len(texts), max(1, len(self.langs))), np.int64)
        most = max(16, BLOCKS // max(1, len(self.langs)))
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        state = None  # of the text whose first part is done

        def flush() -> np.ndarray:
            nonlocal state
            owner = np.concatenate(owners)
            follows = np.r_[state is not None, owner[1:] == owner[:-1]]
            count, end = self.phrases(np.concatenate(held), follows, state)
            np.add.at(totals, owner, count)
            held.clear()
            owners.clear()
            state = None
            return end[-1]

        for i, (s, letters) in enumerate(encoded):
            if letters:
                n = -(-len(s) // BLOCK)
                padded = np.full(n * BLOCK, self.width - 1, s.dtype)
                padded[: len(s)] = s
                blocks, begin = padded.reshape(-1, BLOCK), 0
                while begin < n:
                    part = blocks[begin : begin + most - sum(map(len, held))]
                    held.append(part)
                    owners.append(np.full(len(part), i))
                    begin += len(part)
                    if sum(map(len, held)) >= most:
                        end = flush()
                        state = end if begin < n else None
        if held:
            flush()
        out = []
        for (s, letters), total in zip(encoded, totals, strict=True):
            if not letters:
                out.append(("und", 0.0))
                continue
            cost = total * self.log_size / max(1, len(s))
            order = np.lexsort((np.arange(len(cost)), cost))
            best = cost[order[0]]
            out.append((self.langs[order[0]], float(cost[order[1]] / (best + cost[order[1]])) if len(order) > 1 else 1.0))
        return out


def fold(letter: str) -> str:
    """A letter in lower case, if that is one code point."""
    return low if len(low := letter.lower()) == 1 else letter


def lookup(symbols: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Code point to symbol, in the smallest type that holds all and the padding, and to whether it is a letter."""
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    lut = np.where(alpha, UNKNOWN, GAP).astype(np.min_scalar_type(len(symbols) + 2))
    for c in np.flatnonzero(alpha):
        lut[c] = symbols.get(fold(chr(c)), UNKNOWN)
    return lut, alpha


def shares(sizes: list[int], most: int) -> list[int]:
    """Equal shares of `most`; what the short ones leave goes to the others."""
    out = [0] * len(sizes)
    for n, i in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        out[i] = min(sizes[i], most // (len(sizes) - n))
        most -= out[i]
    return out


def build(texts: dict[str, str | list[str]]) -> Model:
    """texts: training text by language, or several, which get equal shares. Languages without a letter are left out."""
    texts = {k: [t] if isinstance(t, str) else t for k, t in texts.items()}
    langs = sorted(k for k, ts in texts.items() if any(c.isalpha() for t in ts for c in t))
    seen = Counter(fold(c) for k in langs for t in texts[k] for c in t if c.isalpha())
    symbols = {c: i + 2 for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}
    width = len(symbols) + 3
    model = Model(langs, symbols, np.zeros(0, np.int64), np.zeros(len(langs), np.int64), width, np.zeros(len(langs)))
    tables, at = [], 0
    most = max(1, min(TRAIN_SYMBOLS, ALL_SYMBOLS // max(1, len(langs))))
    for i, lang in enumerate(langs):
        # A gap stands between the texts' shares.
        parts = [x for t in texts[lang] if len(x := model.encode(t)[0])]
        cut = shares([len(x) for x in parts], max(len(parts), most - len(parts) + 1))
        s = np.concatenate([y for x, n in zip(parts, cut, strict=True) for y in (np.array([GAP], x.dtype), x[:n])])[1:]
        table, base = place(Automaton(s.tolist()).next, width)
        table = table[: max(int(base.max()), int(np.flatnonzero(table >= 0).max(initial=0))) + 1]  # foreign states never match
        model.base[i], model.log_size[i] = at + base[0], np.log2(len(s) + 2)
        tables.append(np.where(table < 0, -1, table + (at << 32 | at)))
        at += len(table)
    model.table = np.concatenate([*tables, np.full(width, -1, np.int64)])
    model.lut = None
    return model


def train(docs: DataFrame) -> Model:
    """Learn from documents with text and lang whose crc bucket is not 2; see the bounds above.

    Counts per language cover all those documents; the sample follows from them by hash, so reruns agree.
    """
    usable = docs.where("doc_id is not null and lang is not null and text is not null").where(crc_bucket(F.col("doc_id")) != 2)
    counts = materialize(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    langs = counts.count()
    docs_each = max(1, min(TRAIN_DOCS, ALL_DOCS // max(1, langs)))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < F.lit(float(1 << 31)) * docs_each / F.col("n")
    picked = usable.select("doc_id", "lang", "text").join(F.broadcast(counts) if langs <= BROADCAST_LANGS else counts, "lang").where(part)
    start = F.pmod(F.xxhash64("doc_id", F.lit("passage")), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))).cast("int")
    rows = picked.groupBy("lang", "doc_id").agg(F.min(F.substring(F.col("text"), start + 1, F.lit(TRAIN_CHARS))).alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return build(texts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, lang_pred, score (0.5 to 1, the runner-up's share of the cost; 1 if
    one language is known).

    Null and empty texts, texts without a letter, and all texts if nothing was learned: `und`, 0. Texts of any length are
    parsed whole. Of languages at the same cost the first by code point wins. Repeated rows give repeated rows, an empty
    table none; other columns are ignored, also those named like the result's.
    """
    if model.table.nbytes > MODEL_BYTES:
        raise ValueError(f"the model's tables have {model.table.nbytes} bytes: lower ALL_SYMBOLS")
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                found = m.predict(b.column(1).to_pylist())
                yield pa.record_batch([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
