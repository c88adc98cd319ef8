"""MinHash near-dedup of documents by BagMinHash signatures, banding and exact multiset verification.

A document is the multiset of its 5-word shingles; similarity is weighted Jaccard, sum of minima over sum of maxima.

Signatures. Every shingle owns Poisson processes over (time, signature place, weight level). Levels are the integers, split
into a hierarchy of dyadic intervals [0,1), [1,2), [2,4), [4,8) ...; an interval of length n has a process of rate n per
place. A shingle of weight w takes part with the points whose level lies under w: intervals under w count whole, in the one
that holds w each point's level is drawn and compared. A place's value is the earliest point of any shingle, so two
documents agree in a place with exactly their weighted Jaccard as probability. Points are generated in order, in chunks
that double, and only while a process can still come before the document's latest place.

Candidates. ROWS places form a band; documents that agree in a band share a bucket. First every bucket's members are
compared with its smallest member, and the pairs that reach the threshold are joined to components. Buckets that lie within
one component are done. In the others all pairs of different components are compared: small buckets list them, large ones
are compared in blocks within tasks, which give back what hangs together, not pairs. Comparisons are exact (over 64-bit
shingle hashes); nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import attach, group_stats, materialize, salt, ship, text_bytes
from lodestone.llm.components import connected_components

WORDS, THRESHOLD = 5, 0.8
#: Bands and places in each: a pair at the threshold meets in no band with probability (1 - 0.8^4)^26, about 1e-6.
BANDS, ROWS = 26, 4
PLACES = BANDS * ROWS
#: Buckets of at most so many documents list their pairs, larger ones are compared in blocks of so many.
SMALL, BLOCK = 12, 256
#: Up to so many document ids are broadcast to pick their texts (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 500_000
#: Shingles whose signatures are made in one go, and columns of a block's matrix.
BATCH, COLUMNS = 50_000, 8192

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of the shingles of a text in order: words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, WORDS at a time; of fewer
    words one shingle, of none none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mix(h * _GOLD + w[k : len(w) - size + 1 + k])
    return h


def tokens(h: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: the n-th occurrence of a shingle becomes a hash of both."""
    s = np.sort(h)
    first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0)) if len(s) else np.zeros(0, np.int64)
    return np.sort(_mix(s + (np.arange(len(s)) - start).astype(np.uint64) * _GOLD).view(np.int64))


def _processes(owner: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, seed, rate, share) of each dyadic process; share: the part of its levels that lies under the weight."""
    docs, seeds, rates, shares, low, k = [], [], [], [], 0, 0
    left = np.arange(len(x))
    while len(left):
        size = max(1, low)
        docs.append(owner[left])
        seeds.append(_mix(x[left] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
        rates.append(np.full(len(left), float(size)))
        shares.append(np.minimum(1.0, (w[left] - low) / size))
        low, k = low + size, k + 1
        left = left[w[left] > low]
    return tuple(map(np.concatenate, (docs, seeds, rates, shares)))


def signatures(owner: np.ndarray, x: np.ndarray, w: np.ndarray, n_docs: int, places: int = PLACES) -> np.ndarray:
    """n_docs x places earliest points. owner: document of each distinct shingle x with weight w; each document has one."""
    best = np.full((n_docs, places), np.inf)
    doc, seed, rate, share = _processes(owner, x, w) if len(x) else (np.zeros(0, np.int64),) * 4
    time, number, chunk = np.zeros(len(doc)), 0, 1
    while len(doc):
        index = np.arange(number, number + chunk, dtype=np.uint64)
        u = _mix(seed[:, None] + (index * np.uint64(2) + np.uint64(1))[None, :] * _GOLD)
        gaps = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / (rate * places)[:, None]
        at = time[:, None] + np.cumsum(gaps, axis=1)
        v = _mix(u + _GOLD)
        place = ((v >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)
        level = (v & np.uint64(0xFFFFFFFF)).astype(np.float64) / (1 << 32)
        ok = level < share[:, None]
        ok &= at < best.max(axis=1)[doc][:, None]
        r, c = np.nonzero(ok)
        np.minimum.at(best.reshape(-1), doc[r] * places + place[r, c].astype(np.int64), at[r, c])
        time, number, chunk = at[:, -1], number + chunk, min(2 * chunk, 256)
        go = time < best.max(axis=1)[doc]
        doc, seed, rate, share, time = doc[go], seed[go], rate[go], share[go], time[go]
    return best


def band_codes(best: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n x bands 64-bit codes; equal places make equal codes."""
    bits = best.view(np.uint64).reshape(len(best), bands, -1)
    h = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD), bits.shape[:2]).copy()
    for k in range(bits.shape[2]):
        h = _mix(h * _GOLD + bits[:, :, k])
    return h.view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (128-bit digest of the words), n (shingles), codes (one a band) of every row; rows without words or
    without a doc_id have a null key."""

    def finish(held: list[tuple]) -> pa.RecordBatch:
        ids, keys, all_x, all_w, ns = zip(*held, strict=True)
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in all_x])
        codes = band_codes(signatures(owner, np.concatenate(all_x), np.concatenate(all_w), len(ids)))
        return _sketch_batch(ids, keys, ns, list(codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bare = [], 0, []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                h = shingles(text) if doc_id is not None else ()
                if not len(h):
                    bare.append(doc_id)
                    continue
                x, w = np.unique(h, return_counts=True)
                held.append((doc_id, xxhash.xxh3_128_digest(b" ".join(text.lower().split())), x, w, len(h)))
                size += len(x)
                if size >= BATCH or len(held) >= 512:
                    yield finish(held)
                    held, size = [], 0
            yield _sketch_batch(bare, *[[None] * len(bare)] * 3)
            bare = []
        if held:
            yield finish(held)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, n long, codes array<long>")


def _sketch_batch(ids: list, keys: list, ns: list, codes: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(codes, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "codes"])


def _tokens_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, tokens of the documents in ids (id)."""
    few = ids.count() <= BROADCAST_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                yield pa.record_batch([part.column(0), pa.array([tokens(shingles(t)) for t in text_bytes(part.column(1))], pa.list_(pa.int64()))], names=["id", "tokens"])

    picked = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return materialize(picked.mapInArrow(run, "id long, tokens array<long>"), "near-tokens")


def _verify(pairs: DataFrame, toks: DataFrame, threshold: float) -> DataFrame:
    """The pairs (src, dst) whose multisets reach the threshold."""
    a = toks.select(F.col("id").alias("src"), F.col("tokens").alias("ta"))
    b = toks.select(F.col("id").alias("dst"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "src").join(b, "dst").where(both >= F.lit(threshold) * (F.size("ta") + F.size("tb") - both)).select("src", "dst")


def compare_block(ids: np.ndarray, parts: np.ndarray, labels: np.ndarray, toks: list[np.ndarray], a: int, b: int, threshold: float) -> np.ndarray:
    """Smallest id that each document hangs together with, over the pairs of part a with part b of different components."""
    n = np.array([len(t) for t in toks], np.int64)
    owner = np.repeat(np.arange(len(ids)), n)
    values, column, seen = np.unique(np.concatenate(toks), return_inverse=True, return_counts=True)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(ids), len(ids)), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        m = np.zeros((len(ids), min(COLUMNS, int(shared.sum()) - start)), np.float32)
        m[owner[lo:hi], column[lo:hi] - start] = 1
        both += m @ m.T
    linked = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-6
    linked &= (parts == a)[:, None] & (parts == b)[None, :] | (parts == b)[:, None] & (parts == a)[None, :]
    linked &= labels[:, None] != labels[None, :]
    i, j = np.nonzero(linked)
    root = ids.copy()
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        if (least == root).all():
            return root
        root = least


def _blocks(members: DataFrame, toks: DataFrame, threshold: float) -> DataFrame:
    """src, dst: what hangs together in large buckets. members: code, size, id, component."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    each = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id", "code"), F.col("parts")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least("part", x).alias("a"), F.greatest("part", x).alias("b"))))
    work = each.withColumn("w", pairs).select("code", "w.a", "w.b", "parts", "part", "id", "component").join(toks, "id")
    # The pieces of a bucket go to consecutive partitions, so they never pile up in one.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.pmod(F.xxhash64("code"), F.lit(tasks)) + F.col("a").cast("long") * F.col("parts") + F.col("b"), F.lit(tasks)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def compare() -> pa.RecordBatch:
            ids, parts, labels = (np.array([r[i] for r in held], np.int64) for i in (0, 1, 2))
            root = compare_block(ids, parts, labels, [r[3] for r in held], at[1], at[2], threshold)
            far = root != ids
            return pa.record_batch([pa.array(ids[far]), pa.array(root[far])], names=["src", "dst"])

        for batch in batches:
            code, a, b, part, id_, label = (batch.column(i).to_pylist() for i in range(6))
            lists = batch.column(6)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k in range(batch.num_rows):
                here = (code[k], a[k], b[k])
                if here != at:
                    if len(held) > 1:
                        yield compare()
                    held, at = [], here
                held.append((id_[k], part[k], label[k], values[offsets[k] : offsets[k + 1]].copy()))
        if len(held) > 1:
            yield compare()

    dealt = work.select("code", "a", "b", "part", "id", "component", "tokens", "parts").repartitionById(tasks, place).sortWithinPartitions("code", "a", "b")
    return dealt.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest doc_id linked directly or through others), kept (it is that one) per row of docs.

    docs: doc_id, text; other columns are ignored. Documents without words (null, empty, blank) are classes of their own,
    as are rows without a doc_id (class null, kept). Rows of one doc_id stand for one document: they stay or go together.
    An empty table gives no rows.
    """
    ship(docs.sparkSession)
    every = materialize(_sketches(docs).withColumn("_salt", salt("doc_id")), "near-sketch")
    sketch = every.where("key is not null")
    stats = group_stats(sketch, ["key"], {"rep": (F.min("doc_id"), F.min), "n": (F.max("n"), F.max), "codes": (F.first("codes"), F.first)})
    stats = materialize(stats, "near-reps")
    each = stats.select(F.col("rep").alias("id"), "n", F.explode("codes").alias("code"))
    buckets = materialize(each.groupBy("code").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("hub"), F.min_by("n", "id").alias("hub_n")).where("size > 1"), "near-buckets")
    members = materialize(each.join(buckets, "code"), "near-members")
    toks = _tokens_of(docs, members.select("id").distinct())

    alike = lambda a, b: F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)
    stars = members.where((F.col("id") != F.col("hub")) & alike(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("src"), F.col("id").alias("dst")).distinct()
    links = materialize(_verify(stars, toks, threshold), "near-stars")
    parts = connected_components(links)

    named = members.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = materialize(named.select("code", "size", "id", "n", "component"), "near-named")
    torn = materialize(named.groupBy("code").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("code"), "near-torn")
    open_ = named.join(torn, "code", "left_semi")
    listed = open_.where(F.col("size") <= SMALL).groupBy("code").agg(F.collect_list(F.struct("id", "n", "component")).alias("d"))  # at most SMALL
    crossed = F.explode(F.flatten(F.transform("d", lambda x: F.transform(F.filter("d", lambda y: (y["id"] > x["id"]) & (y["component"] != x["component"]) & alike(x["n"], y["n"])), lambda y: F.struct(x["id"].alias("src"), y["id"].alias("dst"))))))
    pairs = listed.select(crossed.alias("p")).select("p.src", "p.dst").distinct()
    more = _verify(pairs, toks, threshold).unionByName(_blocks(open_.where(F.col("size") > SMALL), toks, threshold))
    final = connected_components(materialize(more, "near-more").unionByName(parts.select(F.col("id").alias("src"), F.col("component").alias("dst"))))

    known = stats.select("key", "rep", "_salts").join(final.withColumnRenamed("id", "rep"), "rep", "left").select("key", "_salts", F.coalesce("component", "rep").alias("class_id"))
    linked = attach(sketch.select("doc_id", "key", "_salt"), known, ["key"]).select("doc_id", "class_id")
    alone = every.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their own columns, that near_duplicates keeps."""
    gone = materialize(near_duplicates(docs, threshold).where("not kept").select("doc_id").distinct(), "near-gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
