"""Line dedup by probing sharded minimal perfect hashes.

Lines become 128-bit hashes of their keys. Counting finds, by hash, how many documents hold a line and the largest of their
ids; the distinct hashes that two documents or more hold are dealt to shards, and each shard builds a minimal perfect hash
over its hashes, which indexes compact arrays of fingerprints (64 bits), counts (32 bits) and last ids. Hashes of one
document would be four fifths of an index or more and can drop nothing, whatever the threshold, so they stay outside: a
probe with one finds no fingerprint. Documents probe the arrays: a probe is a hash, a doc_id and its text's hash, it is sent
to its hash's shard, the count found there decides, and only the hits that must go come back, grouped by document. No line's
text is shuffled, and no join meets a line with a line.

A shard with many probes (a very common line) is copied to several sub-shards, and its probes are dealt among them by
doc_id. Tasks stream their probes past the index of the moment, so memory holds one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import materialize, ship, text_bytes

#: A line's key counts from so many code points, and is dropped from so many documents on.
MIN_CHARS, MIN_DOCS = 40, 5
#: Up to so many dropped keys are broadcast to the documents (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_DROPS = 500_000
#: Hashes of one shard at most, about; probes of one sub-shard that hit, about, at least.
SHARD_KEYS, SHARD_PROBES = 50_000, 1_000
#: Up to so many shards their sizes are broadcast (two integers each); beyond, they are joined by shuffle.
BROADCAST_SHARDS = 500_000

_BLANKS = b" \t\n\x0b\x0c\r"
_EDGE = 4 * MIN_CHARS


def line_key(line: bytes) -> bytes | None:
    """The line stripped of `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased; None if it has too few code points."""
    if len(line) < MIN_CHARS:
        return None
    key = line.strip(_BLANKS).lower()
    if len(key) < MIN_CHARS or (len(key) < _EDGE and not key.isascii() and len(key.decode()) < MIN_CHARS):
        return None
    return key


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _mix(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    h = lo + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(by)) ^ hi
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 128-bit keys, by levels of bit arrays.

    On each level the keys left fall on twice as many bits; bits that one key alone hit are set, the other keys go on to
    the next level. A key's number is the rank of its bit.
    """

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels, self.ranks, seen = levels, [], 0
        for bits in levels:
            rank = np.cumsum(bits, dtype=np.int64) + (seen - 1)
            self.ranks.append(rank.astype(np.int32))
            seen += int(bits.sum())

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        levels = []
        while len(hi):
            size = 2 * len(hi) + 1
            at = (_mix(hi, lo, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = ~bits[at]
            hi, lo = hi[left], lo[left]
        return cls(levels)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The keys' numbers; for other keys some number, or -1."""
        out, left = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, bits in enumerate(self.levels):
            at = (_mix(hi[left], lo[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out


class LineIndex:
    """A shard: its perfect hash, and by number the fingerprint, document count and last doc_id of each hash."""

    def __init__(self, hash_: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> None:
        self.hash, self.prints, self.counts, self.last = hash_, prints, counts, last

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        hash_ = PerfectHash.build(hi, lo)
        number = hash_.find(hi, lo)
        order = np.argsort(number)
        return cls(hash_, (hi ^ lo)[order], np.minimum(counts[order], 0xFFFFFFFF).astype(np.uint32), last[order])

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, count, last doc_id) of each probe."""
        if not len(self.prints):
            return np.zeros(len(hi), bool), np.zeros(len(hi), np.int64), np.zeros(len(hi), np.int64)
        number = self.hash.find(hi, lo)
        slot = np.maximum(number, 0)
        return (number >= 0) & (self.prints[slot] == hi ^ lo), self.counts[slot], self.last[slot]

    def to_bytes(self) -> bytes:
        levels = self.hash.levels
        head = np.array([len(levels), len(self.prints), *map(len, levels)], np.int64)
        return b"".join([head.tobytes(), self.prints.tobytes(), self.counts.tobytes(), self.last.tobytes(), *(np.packbits(x).tobytes() for x in levels)])

    @classmethod
    def from_bytes(cls, data: bytes) -> LineIndex:
        n_levels, n = np.frombuffer(data, np.int64, 2).tolist()
        sizes = np.frombuffer(data, np.int64, n_levels, 16)
        at, arrays, levels = 16 + 8 * n_levels, [], []
        for kind in (np.uint64, np.uint32, np.int64):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        for size in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(PerfectHash(levels), *arrays)


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), hi, lo: a row for each distinct key of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ids, rows, sizes = [], batch.column(0), batch.column(1), []
            for text in text_bytes(batch.column(2)):
                keys = {key_hash(k) for line in (text or b"").split(b"\n") if (k := line_key(line)) is not None}
                out.extend(keys)
                sizes.append(len(keys))
            both = np.frombuffer(b"".join(out), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            for a in range(0, len(both), 50_000):
                part = both[a : a + 50_000]
                yield pa.record_batch([ids.take(owner.slice(a, 50_000)), rows.take(owner.slice(a, 50_000)), pa.array(part[:, 0]), pa.array(part[:, 1])], names=["doc_id", "row", "hi", "lo"])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, hi long, lo long")


def build_index(hashes: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, int]:
    """(index: shard, subs, blob; number of shards) over the hashes of two documents or more (of min_docs, if that is one)."""
    spark = hashes.sparkSession
    counted = hashes.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min(2, min_docs))
    counted = materialize(counted, "lines-counted")
    keys, hits = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(4 * tasks, -(-keys // SHARD_KEYS))
    each = max(SHARD_PROBES, hits // (2 * tasks))
    counted = counted.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    sizes = counted.groupBy("shard").agg((F.lit(1) + F.floor(F.sum("n") / each)).cast("int").alias("subs"))

    def build(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        index = LineIndex.build(pdf["hi"].to_numpy().view(np.uint64), pdf["lo"].to_numpy().view(np.uint64), pdf["n"].to_numpy(np.int64), pdf["last"].fillna(-1 << 62).to_numpy(np.int64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "blob": [index.to_bytes()]})

    blobs = counted.groupBy("shard").applyInPandas(build, "shard int, blob binary")
    return blobs.join(sizes, "shard"), shards


def find_repeated(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row, drops (array of hi, lo): the keys whose lines the rows of that id and text lose."""
    hashes = line_hashes(docs)
    index, shards = build_index(hashes, min_docs)
    index = materialize(index, "lines-index")
    sizes = index.select("shard", "subs")
    probes = hashes.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int")).join(F.broadcast(sizes) if shards <= BROADCAST_SHARDS else sizes, "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("doc_id", "row"), F.col("subs")).cast("int").alias("sub"), F.lit(1).alias("kind"), "hi", "lo", "doc_id", "row", F.lit(None).cast("binary").alias("blob"))
    zero = F.lit(0).cast("long")
    shared = index.select("shard", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(0).alias("kind"), zero.alias("hi"), zero.alias("lo"), zero.alias("doc_id"), zero.alias("row"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: LineIndex | None = None
        for batch in batches:
            kinds = batch.column(2).to_numpy()
            hi, lo = (batch.column(i).to_numpy().view(np.uint64) for i in (3, 4))
            ids = batch.column(5)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy()
            starts = np.flatnonzero(kinds == 0)
            for a, b in zip([-1, *starts], [*starts, len(kinds)], strict=True):
                if a >= 0:
                    held = LineIndex.from_bytes(batch.column(7)[int(a)].as_py())
                if b > a + 1 and held is not None:
                    part = slice(a + 1, b)
                    found, count, last = held.probe(hi[part], lo[part])
                    # Without any id among the holders there is no last one, and all of them keep the line.
                    go = found & (count >= min_docs) & (last > -1 << 62) & (~known[part] | (number[part] != last))
                    if go.any():
                        at = np.flatnonzero(go) + a + 1
                        yield pa.record_batch([ids.take(pa.array(at)), batch.column(6).take(pa.array(at)), pa.array(hi[at].view(np.int64)), pa.array(lo[at].view(np.int64))], names=["doc_id", "row", "hi", "lo"])

    dealt = probes.unionByName(shared).repartition("shard", "sub").sortWithinPartitions("shard", "sub", "kind")
    found = dealt.mapInArrow(run, "doc_id long, row long, hi long, lo long")
    return found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("hi", "lo")).alias("drops"))  # at most a text's distinct lines


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text replaced by its kept lines, and two columns appended: lines before, and lines dropped. counts names
    them; columns of those names are replaced.

    Lines end at \\n; a null or empty text is one empty line, its new text is empty. A key held by min_docs rows or more
    loses all its lines but those in the rows of the largest doc_id that holds it. Repeated rows count one by one and are
    treated alike; a null doc_id is smaller than any other. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c not in counts]
    drops = materialize(find_repeated(docs, min_docs), "lines-drops")
    few = (drops.agg(F.sum(F.size("drops") + 1)).first()[0] or 0) <= BROADCAST_DROPS
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)])
    id_at, text_at = own.index("doc_id"), own.index("text")
    same = plain[f"c{id_at}"].eqNullSafe(drops["doc_id"]) & (F.xxhash64(plain[f"c{text_at}"]) == drops["row"])
    joined = plain.join(F.broadcast(drops) if few else drops, same, "left").drop(drops["doc_id"], drops["row"])
    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(own)]).add("n_lines", "long").add("n_dropped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, gone = [], [], []
            for text, drop in zip(text_bytes(batch.column(text_at)), batch.column(len(own)).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                kept = lines
                if drop:
                    out = {np.array([d["hi"], d["lo"]], np.int64).astype(">i8").tobytes() for d in drop}
                    kept = [x for x in lines if (k := line_key(x)) is None or key_hash(k) not in out]
                texts.append(b"\n".join(kept))
                before.append(len(lines))
                gone.append(len(lines) - len(kept))
            columns = batch.columns[: len(own)]
            columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.record_batch([*columns, pa.array(before, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], F.col("n_lines").alias(counts[0]), F.col("n_dropped").alias(counts[1]))
