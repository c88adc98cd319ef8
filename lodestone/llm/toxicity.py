"""Toxicity by a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A text's features are its distinct lower-case character n-grams of the orders NGRAMS, hashed. Executors count, over a
bounded sample of labelled rows (TRAIN_ROWS a class), how many texts of either class hold each hash; the FEATURES hashes
that tell the classes apart best are kept. Each present feature weighs its log-count ratio between the classes, the vector
has length 1, and a logistic regression is fitted over it. Margins become probabilities by a second regression in one
variable, over margins of rows that their classifier has not seen: each of FOLDS parts of the sample is judged by one that
was counted, chosen and fitted without it. The driver gets the kept hashes' counts and FOLDS + 1 bitmaps of FEATURES bits
per sampled row, whatever the texts' lengths. Scoring is one pass over all whole texts with the weights
broadcast (2 bytes a hash and FEATURES numbers, whatever the data).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_bucket, materialize, ship

#: Code points of a feature, bits of its hash, and hashes that the classifier keeps.
NGRAMS, BITS, FEATURES = (3, 4, 5, 6, 7, 8), 20, 4096
#: Labelled rows of each class that the fit uses, about; chosen by a hash of doc_id. Their texts are used whole.
TRAIN_ROWS = 2_000
#: Parts of the sample for the second regression.
FOLDS = 3
#: A hash is kept only if so many rows hold it.
LEAST_ROWS = 3
#: Code points that are hashed in one go.
CHUNK = 1 << 20
#: Steps of the fit, its learning rate and penalty.
STEPS, RATE, PENALTY = 80, 0.2, 1e-5
#: Texts that score at least this are predicted toxic.
THRESHOLD = 0.3

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes in [0, 2^BITS) of the n-grams of a text between blanks, in pieces; repeated ones repeat."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(points), CHUNK):
        own = min(CHUNK, len(points) - start)
        chars = points[start : start + own + max(NGRAMS) - 1].astype(np.uint64)
        h = np.zeros(len(chars), np.uint64)
        for k in range(max(NGRAMS)):
            n = min(own, len(chars) - k)
            if n < 1:
                break
            h = (h[:n] ^ chars[k : k + n]) * _GOLD
            h ^= h >> np.uint64(29)
            if k + 1 in NGRAMS:
                yield ((h * np.uint64(2 * k + 3)) >> np.uint64(64 - BITS)).view(np.int64)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text; none for null and empty texts."""
    found = np.zeros(1 << BITS, bool)
    for h in hashes(text) if text else ():
        found[h] = True
    return np.flatnonzero(found)


@dataclass
class Model:
    """number: hash to feature (from 1; 0: none); over a text's features, score = logistic(bias + sum of weight / length of
    ratio). prior: the score of texts without a feature."""

    number: np.ndarray
    ratio: np.ndarray
    prior: float
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def present(self, text: str | None) -> np.ndarray:
        """Numbers of the text's features, less 1, ascending."""
        mark = np.zeros(len(self.ratio) + 1, bool)
        for h in hashes(text) if text else ():
            mark[self.number[h]] = True
        return np.flatnonzero(mark[1:])

    def margin(self, x: np.ndarray) -> float:
        return self.bias + float(self.weight[x].sum()) / float(np.sqrt((self.ratio[x] ** 2).sum()))

    def score(self, text: str | None) -> float:
        if not len(self.weight) or not len(x := self.present(text)):
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30))))


def constant(share: float) -> Model:
    """Every text scores the share."""
    return Model(np.zeros(1 << BITS, np.int16), np.zeros(0), share)


def log_ratio(n0: np.ndarray, n1: np.ndarray, rows0: int, rows1: int) -> np.ndarray:
    """Log of the classes' smoothed shares of rows that hold a hash."""
    return np.log((n1 + 1) / (rows1 + 2)) - np.log((n0 + 1) / (rows0 + 2))


def _calibrate(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and bias of a logistic regression of y on z, classes weighted to their share, targets smoothed."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    a, b = 1.0, float(np.log(share / (1 - share)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(g * z).sum() + 1e-3 * (a - 1), g.sum()]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(max(a, 0.1)), float(b)


def fit(model: Model, rows: list[tuple[np.ndarray, int]]) -> Model:
    """The model with weights and bias of a logistic regression over rows of (features, 0 or 1) in which both classes weigh the
    same."""
    y = np.array([c for _, c in rows], np.float64)
    index = np.concatenate([x for x, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    value = model.ratio[index]
    value = value / np.sqrt(np.bincount(owner, value * value, len(rows)) + 1e-12)[owner]
    size, ones = len(model.ratio), max(1.0, y.sum())
    each = np.where(y == 1, 0.5 / ones, 0.5 / max(1.0, len(y) - y.sum()))
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, w[index] * value, len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * each
        gw = PENALTY * w + np.bincount(index, g[owner] * value, size)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        rate = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    model.weight, model.bias = w * model.ratio, float(b)
    return model


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame | None, float]:
    """(doc_id, toxic, text, fold of the sampled labelled documents, once each; the positive share of all labels)."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(crc_bucket(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not (total := sum(counts.values())):
        return None, 0.0
    most = [F.lit(int((1 << 31) * min(1, rows / counts.get(c, 1)))) for c in (0, 1)]
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < F.when(F.col("toxic") == 1, most[1]).otherwise(most[0]))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # about 2 * rows rows of an id and a label
    once = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return materialize(once.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "tox-sample"), (counts.get(1, 0) + 1) / (total + 2)


def _counts(sample: DataFrame) -> DataFrame:
    """hash, and per class c and part f of the sample the column nc_f: rows that hold the hash; hash -1 counts all rows."""
    names = [f"n{c}_{f}" for f in range(FOLDS) for c in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2 * FOLDS, (1 << BITS) + 1), np.int16 if 2 * TRAIN_ROWS < 30_000 else np.int32)
        for b in batches:
            for toxic, fold, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found[2 * fold + toxic, features(text.as_py())] += 1
                found[2 * fold + toxic, -1] += 1
        at = np.flatnonzero(found.any(axis=0))
        hashes_ = pa.array(np.where(at == 1 << BITS, -1, at).astype(np.int32))
        yield pa.record_batch([hashes_, *(pa.array(n[at].astype(np.int32)) for n in found)], names=["hash", *names])

    schema = ", ".join(["hash int", *(f"{n} int" for n in names)])
    return sample.select("toxic", "fold", "text").mapInArrow(run, schema).groupBy("hash").agg(*[F.sum(n).alias(n) for n in names])


def _choose(counts: DataFrame, share: float, without: int) -> Model | None:
    """A model without weights: the features that tell the classes apart best, leaving out one part of the sample."""
    of = lambda c: sum((F.col(f"n{c}_{f}") for f in range(FOLDS) if f != without), F.lit(0))
    seen = counts.select("hash", of(0).alias("n0"), of(1).alias("n1"))
    n0, n1 = seen.where("hash = -1").select("n0", "n1").first() or (0, 0)
    if not n0 or not n1:
        return None
    # Divergence of the classes' shares of rows that hold the hash.
    a, b = F.col("n0") / F.lit(n0), F.col("n1") / F.lit(n1)
    gain = sum(x * F.log((x + 1e-4) / ((a + b) / 2 + 1e-4)) for x in (a, b))
    kept = seen.where((F.col("hash") >= 0) & (F.col("n0") + F.col("n1") >= LEAST_ROWS)).withColumn("gain", gain).where("gain > 0")
    if not (best := kept.orderBy(F.desc("gain"), "hash").limit(FEATURES).collect()):
        return None
    number = np.zeros(1 << BITS, np.int16)
    number[[r["hash"] for r in best]] = np.arange(1, len(best) + 1)
    return Model(number, log_ratio(*(np.array([r[k] for r in best], float) for k in ("n0", "n1")), n0, n1), share)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled documents whose crc bucket is not 2.

    labels: doc_id, toxic; null ids and labels are ignored, of a document's repeated labels the largest counts, of its
    repeated rows one. With one class, or nothing that tells them apart, the score is the positive class's smoothed share,
    without labelled rows it is 0.
    """
    ship(docs.sparkSession)
    sample, share = _sample(docs, labels, rows)
    if sample is None:
        return constant(0.0)
    counts = materialize(_counts(sample), "tox-counts")
    models = [_choose(counts, share, k) for k in (-1, *range(FOLDS))]
    if models[0] is None:
        return constant(share)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = []
            for m in shared.value:
                none = [b""] * b.num_rows
                columns.append(none if m is None else [np.packbits(np.bincount(m.present(t.as_py()), minlength=len(m.ratio)).astype(bool)).tobytes() for t in b.column(3)])
            yield pa.record_batch([*b.columns[:3], pa.array(list(map(list, zip(*columns, strict=True))), pa.list_(pa.binary()))], names=["doc_id", "toxic", "fold", "bits"])

    found = sample.select("doc_id", "toxic", "fold", "text").mapInArrow(mark, "doc_id long, toxic int, fold int, bits array<binary>").collect()
    found.sort(key=lambda r: r["doc_id"])

    def rows_of(k: int, parts: set[int]) -> list[tuple[np.ndarray, int]]:
        size = len(models[k].ratio)
        return [(np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"][k], np.uint8), count=size)), r["toxic"]) for r in found if r["fold"] in parts]

    everything = set(range(FOLDS))
    model, unseen = fit(models[0], rows_of(0, everything)), []
    for k in everything:
        if models[k + 1] is not None:
            judge = fit(models[k + 1], rows_of(k + 1, everything - {k}))
            unseen += [(judge.margin(x), c) for x, c in rows_of(k + 1, {k}) if len(x)]
    if len({c for _, c in unseen}) == 2:
        slope, bias = _calibrate(np.array([z for z, _ in unseen]), np.array([c for _, c in unseen], float), share)
        model.weight *= slope
        model.bias = model.bias * slope + bias
    else:
        model.bias += float(np.log(share / (1 - share)))
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of that name (double, 0 to 1) appended; if there is one, it is replaced.

    Every whole text is scored once. Null and empty texts, and others that hold none of the classifier's n-grams, get the
    share of toxic labels. Repeated rows score alike. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = pa.array([m.score(t.as_py()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, name])

    schema = docs.select(*own).schema.add(name, "double")
    return docs.select(*own).mapInArrow(run, schema)
