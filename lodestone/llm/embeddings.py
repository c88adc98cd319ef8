"""Embedding near-dedup by random-hyperplane sign hashing, exact cosines and distributed connected components.

Exact copies are collapsed first. Each remaining vector gets a sign code in every table and a sign sketch of SKETCH bits.
What is dealt to the buckets (vectors of one label whose codes agree in a table) is small: bucket, id and sketch. Members
of a bucket whose sketches differ in few enough bits hang together; what hangs together over all tables is a group, the
only place where links can be. Vectors are fetched once for the groups' members alone, and a group is compared by matrix
products in double precision: small ones whole, large ones in blocks, each pair of blocks a piece of work of its own. So the
bytes of a vector are shuffled as often whatever the number of tables, and an index row has 32 bytes. A large group that is
loose (its members' buckets hold far fewer pairs than it does) is compared bucket by bucket instead, a pair in the first
table in which it meets.

A piece of work gives back, per vector, its number of new links and the smallest vector it hangs together with: rows, not
pairs. Components are then joined over all pieces. Bits and tables follow from the number of vectors and the wanted
recall, whatever the size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import attach, group_stats, materialize, salt, ship
from lodestone.llm.components import connected_components

THRESHOLD = 0.98
#: Chance that a pair just at the threshold meets in no table, and that its sketches differ in too many bits.
MISS, SKETCH_MISS = 1e-8, 1e-9
#: Bits of a sketch, and vectors of the largest label that a bucket holds on average.
SKETCH, BUCKET = 128, 64
#: Sketches of a bucket that are compared in one piece, and vectors of a group.
INDEX_BLOCK, BLOCK = 8192, 2048
#: Groups of more vectors than this are compared by bucket if that takes less than half the products.
LOOSE = 16_384
#: Up to so many large buckets their list is broadcast (two numbers each); beyond, it is joined by shuffle.
BROADCAST_BUCKETS = 50_000
#: Up to so many ids of group members are broadcast to pick their vectors (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 500_000
SEED = 20_240

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def tables_for(vectors: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a code, tables) for so many vectors of the largest label."""
    bits = min(40, max(2, math.ceil(math.log2(max(1, vectors) / BUCKET))) if vectors > BUCKET else 2)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def sketch_slack(threshold: float = THRESHOLD, miss: float = SKETCH_MISS) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most, but for the given chance."""
    p, left = math.acos(threshold) / math.pi, 1.0
    for k in range(SKETCH):
        left -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if left <= miss:
            return k
    return SKETCH


def signs(vectors: np.ndarray, planes: int) -> np.ndarray:
    """n x planes signs (bool) of n vectors (double): first the sketch's, then the codes'."""
    normals = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((planes, vectors.shape[1]))
    return vectors @ normals.T > 0


def codes_of(packed: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """n x tables codes of n packed sign rows."""
    flat = np.unpackbits(packed, axis=1, count=SKETCH + bits * tables)[:, SKETCH:]
    return flat.reshape(len(packed), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _usable(embedding: list | None) -> np.ndarray | None:
    """The vector as doubles plus 0.0 (one zero), or None if it is null, zero or has null or non-finite components."""
    if not embedding or None in embedding:
        return None
    v = np.array(embedding, np.float64) + 0.0
    return v if np.isfinite(v).all() and v.any() else None


def _vectors(rows: DataFrame, bits: int | None = None, tables: int = 0) -> DataFrame:
    """vec_id, label, key, dim and vec (doubles) of every row, or with bits its packed signs instead of vec; key is a 128-bit
    digest. All but vec_id and label are null where the row can link with nothing."""
    last = "vec" if bits is None else "signs"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            found = [_usable(e) if i is not None and label is not None else None for i, label, e in known]
            raw = [None if v is None else v.tobytes() for v in found]
            keys = [None if x is None else xxhash.xxh3_128_digest(x) for x in raw]
            dims = [None if v is None else len(v) for v in found]
            if bits is not None:
                for dim in {d for d in dims if d}:
                    at = [i for i, d in enumerate(dims) if d == dim]
                    packed = np.packbits(signs(np.stack([found[i] for i in at]), SKETCH + bits * tables), axis=1)
                    for i, x in zip(at, packed, strict=True):
                        raw[i] = x.tobytes()
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "label", "key", "dim", last])

    return _typed(rows).mapInArrow(run, f"vec_id long, label string, key binary, dim int, {last} binary")


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))


def _runs(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of rows that agree in all keys."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    starts = np.r_[0, np.flatnonzero(change), n]
    yield from zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)


def union(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (a class number per place, the smallest place of the class) after joining the classes of all i with those of j."""
    while True:
        a, b = root[i], root[j]
        far = a != b
        if not far.any():
            return root
        i, j, a, b = i[far], j[far], a[far], b[far]
        to = np.arange(len(root))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to != (nxt := to[to])).any():
            to = nxt
        root = to[root]


def _sides(part: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of part a and of part b."""
    return np.flatnonzero(part == a), np.flatnonzero(part == b)


def compare_sketches(sketch: np.ndarray, part: np.ndarray, a: int, b: int, slack: int) -> np.ndarray:
    """root of each row of sketch (n x 2 words): what hangs together over the pairs of part a with part b."""
    x, y = _sides(part, a, b)
    root = np.arange(len(sketch))
    step = max(1, (1 << 20) // max(1, len(y)))
    for start in range(0, len(x), step):
        own = x[start : start + step]
        apart = np.bitwise_count(sketch[own, 0][:, None] ^ sketch[y, 0][None, :])
        apart += np.bitwise_count(sketch[own, 1][:, None] ^ sketch[y, 1][None, :])
        i, j = np.nonzero((apart <= slack) & (root[own][:, None] != root[y][None, :]))
        root = union(root, own[i], y[j])
    return root


def compare_block(ids: np.ndarray, copies: np.ndarray, vecs: np.ndarray, part: np.ndarray, a: int, b: int, threshold: float, code: np.ndarray | None = None, table: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(new links, smallest id hanging together) of each vector, over the pairs of part a with part b; with codes, only those
    that meet in this table first."""
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    x, y = _sides(part, a, b)
    linked = unit[x] @ unit[y].T >= threshold
    if a == b:
        linked[np.tril_indices(len(x))] = False
    i, j = np.nonzero(linked)
    i, j = x[i], y[j]
    if code is not None and table and len(i):
        new = ~(code[i, :table] == code[j, :table]).any(axis=1)
        i, j = i[new], j[new]
    links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    root = union(np.arange(len(ids)), place[i], place[j])
    return links.astype(np.int64), ids[order][root[place]]


def _pieces(work: DataFrame, by: list[str], compare, schema: str) -> DataFrame:  # noqa: ANN001
    """compare(rows, one piece's keys) over each run of rows that agree in the columns by (of numbers), which come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            if table.num_rows > 1 and (out := compare(table, [table[k][0].as_py() for k in by])) is not None:
                yield out

        last = None
        for batch in batches:
            for start, end in _runs([batch.column(k).to_numpy() for k in by]) if batch.num_rows else ():
                key = [batch.column(k)[start].as_py() for k in by]
                if key != last and held:
                    yield from flush()
                last = key
                held.append(batch.slice(start, end - start))
        if held:
            yield from flush()

    return work.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _split(rows: DataFrame, size: str, block: int, number: str) -> DataFrame:
    """rows with part, a and b: groups of more than block rows are cut into parts, and each pair of parts is a piece."""
    parts = F.greatest(F.ceil(F.col(size) / block), F.lit(1)).cast("int")
    each = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(number), F.col("parts")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least("part", x).alias("a"), F.greatest("part", x).alias("b"))))
    return each.withColumn("w", pairs).withColumns({"a": F.col("w.a"), "b": F.col("w.b")}).drop("w", "parts")


def find_groups(reps: DataFrame, threshold: float, bits: int, tables: int) -> DataFrame:
    """id, component: vectors whose sketches hang together in some bucket. reps: rep, label, dim, signs."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                packed = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                sketch = np.repeat(packed[:, : SKETCH // 8].copy().view(np.int64), tables, 0)
                own = [xxhash.xxh3_64_intdigest(f"{d} {k}") for k, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                spot = codes_of(packed, bits, tables).astype(np.uint64) * np.uint64(tables) + np.arange(tables, dtype=np.uint64)
                bucket = _mix(np.array(own, np.uint64)[:, None] + _mix(spot) * _GOLD).view(np.int64).reshape(-1)
                ids = np.repeat(batch.column(0).to_numpy(), tables)
                yield pa.record_batch([pa.array(bucket), pa.array(ids), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], names=["bucket", "id", "s0", "s1"])

    index = reps.select("rep", "label", "dim", "signs").mapInArrow(deal, "bucket long, id long, s0 long, s1 long")
    large = materialize(index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > INDEX_BLOCK), "emb-large")
    few = large.count() <= BROADCAST_BUCKETS
    work = _split(index.join(F.broadcast(large) if few else large, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1))), "n", INDEX_BLOCK, "id")
    slack = sketch_slack(threshold)

    def hang(rows: pa.Table, key: list) -> pa.RecordBatch | None:
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        sketch = np.stack([rows["s0"].to_numpy(), rows["s1"].to_numpy()], 1).view(np.uint64)[order]
        root = compare_sketches(sketch, rows["part"].to_numpy()[order], key[1], key[2], slack)
        far = np.flatnonzero(root != np.arange(len(ids)))
        return pa.record_batch([pa.array(ids[order][far]), pa.array(ids[order][root[far]])], names=["src", "dst"]) if len(far) else None

    return connected_components(_pieces(work.select("bucket", "a", "b", "part", "id", "s0", "s1"), ["bucket", "a", "b"], hang, "src long, dst long"))


def find_links(rows: DataFrame, reps: DataFrame, threshold: float, bits: int, tables: int) -> DataFrame:
    """rep, links, root: a row per piece of work and vector with links. reps: rep, label, key, dim, copies, signs."""
    found = materialize(find_groups(reps, threshold, bits, tables), "emb-groups")
    groups = found.unionByName(found.select(F.col("component").alias("id"), "component").distinct()).select(F.col("id").alias("rep"), F.col("component").alias("unit"))
    # A unit is a group's vectors of one label and length: others cannot link.
    near = reps.join(groups, "rep").withColumn("unit", F.xxhash64("unit", "label", "dim"))
    sizes = near.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    near = materialize(near.join(sizes, "unit"), "emb-near")
    ids = near.select("rep").distinct()
    picked = _typed(rows).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("vec_id") == ids["rep"], "left_semi")
    vectors = _vectors(picked).where("key is not null").select(F.col("vec_id").alias("rep"), "label", "key", "vec")
    near = near.join(vectors, ["rep", "label", "key"]).dropDuplicates(["rep", "label", "key"]).withColumns({"t": F.lit(-1), "code": F.lit(0).cast("long")})
    by = ["unit", "t", "code", "a", "b"]
    columns = [*by, "part", "rep", "copies", "vec", "signs"]
    if near.where(F.col("n") > LOOSE).limit(1).count():
        near = materialize(near, "emb-vectors-near")
        large, near = near.where(F.col("n") > LOOSE), near.where(F.col("n") <= LOOSE)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                packed = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                at = pa.array(np.repeat(np.arange(b.num_rows), tables))
                code = pa.array(codes_of(packed, bits, tables).reshape(-1))
                t = pa.array(np.tile(np.arange(tables, dtype=np.int32), b.num_rows))
                yield pa.record_batch([b.column(1).take(at), b.column(2).take(at), b.column(3).take(at), b.column(4).take(at), t, code], names=["unit", "rep", "label", "key", "t", "code"])

        spots = large.select("signs", "unit", "rep", "label", "key").mapInArrow(spread, "unit long, rep long, label string, key binary, t int, code long")
        counts = materialize(spots.groupBy("unit", "t", "code").agg(F.count(F.lit(1)).alias("m")), "emb-spots")
        cost = counts.groupBy("unit").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("products"))
        loose = materialize(cost.join(sizes, "unit").where(2 * F.col("products") < F.col("n").cast("double") * F.col("n")).select("unit"), "emb-loose")
        apart = spots.join(loose, "unit", "left_semi").join(counts.where("m > 1"), ["unit", "t", "code"])
        apart = apart.join(large.drop("t", "code", "unit", "n"), ["rep", "label", "key"]).withColumnRenamed("m", "n")
        near = near.unionByName(large.join(loose, "unit", "left_anti"))
        work = _split(near, "n", BLOCK, "rep").select(*columns).unionByName(_split(apart, "n", BLOCK, "rep").select(*columns))
    else:
        work = _split(near, "n", BLOCK, "rep").select(*columns)

    def compare(rows: pa.Table, key: list) -> pa.RecordBatch | None:
        ids, copies, part = (rows[k].to_numpy() for k in ("rep", "copies", "part"))
        vecs = np.frombuffer(b"".join(rows["vec"].to_pylist()), np.float64).reshape(len(ids), -1)
        code = None
        if key[1] > 0:
            code = codes_of(np.frombuffer(b"".join(rows["signs"].to_pylist()), np.uint8).reshape(len(ids), -1), bits, tables)
        links, root = compare_block(ids, copies, vecs, part, key[3], key[4], threshold, code, key[1])
        at = np.flatnonzero(links)
        return pa.record_batch([pa.array(ids[at]), pa.array(links[at]), pa.array(root[at])], names=["rep", "links", "root"]) if len(at) else None

    return _pieces(work, by, compare, "rep long, links long, root long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of rows (vec_id, embedding, label); other columns are ignored.

    Vectors link if their labels are equal and not null, their lengths agree and their cosine is at least the threshold.
    Null vectors, zero vectors, vectors with null or non-finite components and rows without a vec_id link with nothing.
    Repeated rows count as vectors of their own that link with each other; different vectors of one vec_id share their
    links. An empty table gives no rows.
    """
    ship(rows.sparkSession)
    largest = rows.where("embedding is not null and label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, threshold)
    every = materialize(_vectors(rows, bits, tables).withColumn("_salt", salt("vec_id")), "emb-signs")
    own = every.where("key is not null")
    stats = group_stats(own, ["label", "key"], {"rep": (F.min("vec_id"), F.min), "copies": (F.count(F.lit(1)), F.sum), "signs": (F.first("signs"), F.first), "dim": (F.first("dim"), F.first)})
    stats = materialize(stats, "emb-stats")
    found = materialize(find_links(rows, stats.drop("_salts"), threshold, bits, tables), "emb-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    known = stats.select("label", "key", "rep", "copies", "_salts").join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("label", "key", "_salts", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = attach(own.select("vec_id", "label", "key", "_salt"), known, ["label", "key"]).select("vec_id", "n_links", "component_id")
    alone = every.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
