"""Quality classifier by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from text labelled good, one from text labelled bad;
lines that both samples hold tell nothing and go into neither.  A text is compressed in blocks of ``block_bytes`` (all of it, block by block, so a
long text cannot become its own dictionary) once with each.  The normalised
difference of the sizes is

    (bytes with the bad dictionary - bytes with the good one) / (bytes of the text + short_bytes)

and a logistic curve, fitted on labelled texts that built no dictionary, turns it
into the probability that the text is good.  The curve has a second term,
``short_bytes / (bytes + short_bytes)``, because few bytes are little evidence.

Training is bounded: from each class at most ``dict_docs`` documents give blocks
for the dictionary (``blocks_per_doc`` pieces of lines spread evenly over each) and at most
``curve_docs`` others one feature each; they are those with the smallest hash of
doc_id.  Only those blocks and numbers reach the driver.  Class frequencies, which
set the curve's base rate, are counted over all labels that may be learnt from.

Defined results: a null or empty text has difference 0, so it gets the score of that
point of the curve; a label that is null, or a doc_id labelled both ways, is not
learnt from; with one class missing the score is the share of label 1 among the
labels (0.5 without any); repeated rows get equal scores; other columns pass
through and clashing names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    block_bytes: int = 512
    dict_bytes: int = 110_000
    level: int = 3
    dict_docs: int = 800
    blocks_per_doc: int = 16
    curve_docs: int = 1500
    short_bytes: int = 256
    seed: int = 5


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: np.ndarray  # weights of the difference, of the shortness and of 1
    settings: Settings

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:2] + self.curve[2], -30, 30)))


def _blocks(data: bytes, size: int) -> list[bytes]:
    return [data[k:k + size] for k in range(0, len(data), size)]


def _line_blocks(text: str | None, size: int) -> list[bytes]:
    """The lines of a text, long ones cut: equal lines of two texts give equal pieces."""
    return [b for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n") for b in _blocks(line, size)]


def _spread(blocks: list[bytes], n: int) -> list[bytes]:
    """At most n of the blocks, evenly spaced from first to last."""
    return [blocks[k] for k in sorted({int(k) for k in np.linspace(0, len(blocks) - 1, n)})] if blocks else []


def dictionary(blocks: list[bytes], settings: Settings) -> bytes:
    """A trained dictionary; the blocks themselves where they are too few to train one."""
    joined = b"".join(blocks)
    if len(blocks) >= 64 and len(joined) > 2 * settings.dict_bytes:
        return zstandard.train_dictionary(settings.dict_bytes, blocks, level=settings.level).as_bytes()
    return joined[-settings.dict_bytes:]


class Sizes:
    """Compressed sizes of a text with either dictionary."""

    def __init__(self, good: bytes, bad: bytes, settings: Settings):
        self.size, self.short = settings.block_bytes, settings.short_bytes
        self.good, self.bad = (self._compressor(d, settings) for d in (good, bad))

    @staticmethod
    def _compressor(data: bytes, settings: Settings):
        if not data:
            return zstandard.ZstdCompressor(level=settings.level, write_content_size=False)
        made = zstandard.ZstdCompressionDict(data)  # trained ones are known by their header, others are plain content
        made.precompute_compress(level=settings.level)
        return zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, text: str | None) -> tuple[float, float]:
        """The normalised difference and the shortness of a text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        good = bad = 0
        for block in _blocks(data, self.size):
            good += len(self.good.compress(block))
            bad += len(self.bad.compress(block))
        return (bad - good) / (len(data) + self.short), self.short / (len(data) + self.short)


def _samples(labels: DataFrame, settings: Settings, learn: Column, label: str) -> DataFrame:
    """doc_id, label and its place in its class, for the bounded sample of each class."""
    known = labels.where(learn).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_top")).where(F.col("label").isin(0, 1) & (F.col("label") == F.col("_top")))
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.col("doc_id"), F.lit(settings.seed)), "doc_id")
    return known.select("doc_id", "label", F.row_number().over(order).alias("place")).where(F.col("place") <= settings.dict_docs + settings.curve_docs)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the logistic curve: Newton steps with a ridge, halved while the loss would grow."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), (1e-3, 0.05))
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.array([0.1, 0.1, 1e-6])

    def loss(b: np.ndarray) -> float:
        z = a @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * b * b).sum() / 2)

    b = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge * b
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        while loss(b - step) > loss(b) and np.abs(step).max() > 1e-9:
            step = step / 2
        b = b - step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(b[:2] / scale, b[2] - (b[:2] * mean / scale).sum())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings(), label: str = "quality") -> Model:
    """Fit on the labelled documents for which ``learn`` (over doc_id) holds."""
    spark = docs.sparkSession
    seen = {int(r[label]): r["n"] for r in labels.where(learn & F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n")).collect()}
    rate = seen.get(1, 0) / sum(seen.values()) if seen else 0.5
    # at most 2 * (dict_docs + curve_docs) rows, so the documents aren't shuffled
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(_samples(labels, settings, learn, label)), "doc_id")
    source = chosen.where(F.col("place") <= settings.dict_docs)

    def some_blocks(batches):
        for batch in batches:
            found = [(label, place, block) for text, label, place in zip(*(batch.column(k).to_pylist() for k in range(3))) for block in _spread(_line_blocks(text, settings.block_bytes), settings.blocks_per_doc)]
            label, place, block = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(place, pa.int32()), pa.array(block, pa.binary())], names=["label", "place", "block"])

    rows = sorted(source.select("text", F.col("label").cast("int"), F.col("place").cast("int")).mapInArrow(some_blocks, "label int, place int, block binary").collect(), key=tuple)
    own = {k: [bytes(r["block"]) for r in rows if r["label"] == k] for k in (0, 1)}
    if not own[0] or not own[1]:
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return Model(b"", b"", np.array([0.0, 0.0, np.log(rate / (1 - rate))]), settings)
    both = set(own[0]) & set(own[1])
    if both < set(own[0]) and both < set(own[1]):
        own = {k: [b for b in blocks if b not in both] for k, blocks in own.items()}
    model = Model(dictionary(own[1], settings), dictionary(own[0], settings), np.zeros(3), settings)
    shared = spark.sparkContext.broadcast(model)

    def features(batches):
        sizes = Sizes(shared.value.good, shared.value.bad, shared.value.settings)
        for batch in batches:
            x = [sizes.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([f[k] for f in x], pa.float64()) for k in (0, 1))], names=["label", "x", "short"])

    rest = chosen.where(F.col("place") > settings.dict_docs)
    points = rest.select("text", F.col("label").cast("int")).mapInArrow(features, "label int, x double, short double").collect()
    if len({r["label"] for r in points}) < 2:  # too few labels for a second sample
        points = source.select("text", F.col("label").cast("int")).mapInArrow(features, "label int, x double, short double").collect()
    points = sorted(points, key=tuple)
    y, x = np.array([r["label"] for r in points], float), np.array([(r["x"], r["short"]) for r in points])
    share = y.mean()
    weight = np.where(y == 1, rate / share, (1 - rate) / (1 - share)) if 0 < share < 1 else np.ones(len(y))
    model.curve = _curve(x, y, weight)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted behind its own columns."""
    new = ("score", "predicted")
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        m = shared.value
        sizes = Sizes(m.good, m.bad, m.settings)
        for batch in batches:
            at = batch.schema.get_field_index
            score = m.score(np.array([sizes.features(t) for t in batch.column(at(text)).to_pylist()], float).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(at(n)) for n in names] + [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[*names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(task, f"{schema}, score double, predicted int")
