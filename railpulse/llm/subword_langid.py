"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and every run of characters that are not letters becomes
one blank.  Its subwords are the 1- to 4-grams of letters in which a blank may
stand only at an end, hashed into ``buckets`` rows of an embedding table; a text
is the mean of its subwords' embeddings and a linear softmax over it gives the
language.  Both are trained by stochastic gradient descent in numpy.

Training takes a bounded sample: at most ``per_lang`` documents a language, those
with the smallest hash of id and text, so the sample depends on neither order nor
partitioning.  The executors turn each sampled text into its subword histogram
(at most ``buckets`` entries, however long the text), and only that is collected.
A part of the sample calibrates: the temperature that minimises log loss there,
and a rejection threshold that keeps all but ``reject_share`` of its documents,
never above ``max_threshold``.

In a trained model a subword's share in the scores is its embedding times the
softmax weights, one row of a small table; prediction sums these rows over the
whole text, in blocks, so its memory doesn't grow with a text.

Defined results: a text that is null or has no letter is ``und`` with score 0 and
rejected; ties go to the language that sorts first; repeated rows get equal
predictions; other columns pass through and clashing names are replaced.  With
nothing to learn from, every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
BLOCK_CHARS = 1 << 16


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    dims: int = 16
    max_gram: int = 4
    per_lang: int = 600
    max_langs: int = 256
    steps: int = 1500
    batch: int = 16
    rate: float = 20.0
    calibration_share: float = 0.25
    reject_share: float = 0.001
    max_threshold: float = 0.4
    seed: int = 7


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x langs: each subword's share in the scores
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    settings: Settings = field(default_factory=Settings)


# --------------------------------------------------------------------------- subwords
_ALPHA = np.zeros(0x110000, bool)


def _alpha() -> np.ndarray:
    """A flag for every code point: is it a letter (Unicode category L)?"""
    if not _ALPHA[ord("a")]:
        _ALPHA[:] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _ALPHA


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs of others as one 0, with a 0 at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.zeros(len(raw) + 2, np.uint64)
    codes[1:-1] = np.where(_alpha()[raw], raw, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def subwords(codes: np.ndarray, settings: Settings) -> np.ndarray:
    """The hashed subwords of a sequence made by ``_letters``."""
    found = []
    h = np.zeros(len(codes), np.uint64)
    inner = np.ones(len(codes), bool)  # no blank strictly inside the gram that starts here
    letter = codes != 0
    shift = np.uint64(64 - int(settings.buckets).bit_length() + 1)
    for n in range(1, settings.max_gram + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x100000001B3) + codes[n - 1:]
        if n > 2:
            inner = inner[:size] & letter[n - 2:n - 2 + size]
        ok = inner[:size] & (letter[:size] | letter[n - 1:]) if n <= 2 else inner
        found.append(((h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift)
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def _blocks(text: str):
    """The text in blocks that overlap by nothing but end at a blank where one is near."""
    start = 0
    while start < len(text):
        end = min(len(text), start + BLOCK_CHARS)
        if end < len(text):
            blank = text.rfind(" ", start + BLOCK_CHARS // 2, end)
            end = blank if blank > 0 else end
        yield text[start:end]
        start = end


def histogram(text: str | None, settings: Settings) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    total = np.zeros(settings.buckets, np.int64)
    for block in _blocks(text or ""):
        codes = _letters(block)
        if len(codes) > 2 or codes.any():
            total += np.bincount(subwords(codes, settings), minlength=settings.buckets)
    return total


# --------------------------------------------------------------------------- training
def sample(docs: DataFrame, settings: Settings, learn: Column, lang: str = "lang") -> DataFrame:
    """At most ``per_lang`` documents a language: doc_id, text, lang."""
    labelled = docs.where(learn & F.col(lang).isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string"), F.col(lang).cast("string").alias("lang"))
    # the window keeps per_lang rows a language in each task before it shuffles
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ids = labelled.select("doc_id", "lang", F.xxhash64("doc_id", F.length("text"), F.lit(settings.seed)).alias("_h"))
    first = ids.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= settings.per_lang).select("doc_id", "lang")
    return labelled.join(F.broadcast(first.distinct()), ["doc_id", "lang"], "left_semi")


def _histograms(rows: DataFrame, settings: Settings) -> list:
    def task(batches):
        for batch in batches:
            at, n, langs, rid = [], [], [], []
            for i, text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                h = histogram(text, settings)
                own = np.flatnonzero(h)
                if len(own):
                    rid.append(i)
                    langs.append(lang)
                    at.append(own.astype("<i4").tobytes())
                    n.append(h[own].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.string()), pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["id", "lang", "at", "n"])

    return rows.select(F.col("doc_id").cast("string"), "text", "lang").mapInArrow(task, "id string, lang string, at binary, n binary").collect()


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], settings: Settings = Settings()) -> Model:
    """Fit on (lang, buckets, counts) of the sampled texts."""
    langs = sorted({lang for lang, _, _ in rows})
    if not langs:
        return Model([], np.zeros((settings.buckets, 0)), np.zeros(0), settings=settings)
    if len(langs) > settings.max_langs:
        raise ValueError(f"{len(langs)} languages; max_langs is {settings.max_langs}")
    rng = np.random.default_rng(settings.seed)
    y = np.array([langs.index(lang) for lang, _, _ in rows])
    held = rng.random(len(rows)) < settings.calibration_share
    if len(rows) < 20 or held.all():
        held[:] = False
    emb = rng.uniform(-1, 1, (settings.buckets, settings.dims)).astype(np.float32) / settings.dims
    weight = np.zeros((settings.dims, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    learn = np.flatnonzero(~held)
    step = 0
    while step < settings.steps:  # as many steps whatever the size of the sample
        order = rng.permutation(learn)
        for k in range(0, len(order), settings.batch):
            if step == settings.steps:
                break
            rate = settings.rate * (1 - step / settings.steps) / settings.batch
            step += 1
            own = order[k:k + settings.batch]
            mean = np.stack([(n / n.sum()).astype(np.float32) @ emb[at] for _, at, n in (rows[i] for i in own)])
            error = _softmax(mean @ weight + bias)
            error[np.arange(len(own)), y[own]] -= 1
            back = error @ weight.T
            weight -= rate * 0.1 * (mean.T @ error)
            bias -= rate * 0.01 * error.sum(axis=0)
            for i, g in zip(own, back):
                _, at, n = rows[i]
                emb[at] -= rate * (n / n.sum()).astype(np.float32)[:, None] * g
    model = Model(langs, (emb @ weight).astype(np.float64), bias.astype(np.float64), settings=settings)
    _calibrate(model, [rows[i] for i in (np.flatnonzero(held) if held.any() else learn)])
    return model


def _calibrate(model: Model, rows: list) -> None:
    z = np.stack([(n / n.sum()) @ model.table[at] for _, at, n in rows]) + model.bias
    y = np.array([model.langs.index(lang) for lang, _, _ in rows])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    p = _softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    if len(right):
        model.threshold = float(min(model.settings.max_threshold, right[int(len(right) * model.settings.reject_share)]))


def fit(docs: DataFrame, learn: Column, settings: Settings = Settings(), lang: str = "lang") -> Model:
    rows = sorted(_histograms(sample(docs, settings, learn, lang), settings), key=lambda r: (r["lang"], r["id"], r["at"], r["n"]))
    return train([(r["lang"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in rows], settings)


# --------------------------------------------------------------------------- prediction
def scores(model: Model, text: str | None) -> tuple[str, float]:
    """The most probable language of the whole text and its calibrated probability."""
    if not model.langs:
        return UNDETERMINED, 0.0
    total = histogram(text, model.settings)
    n = total.sum()
    if not n:
        return UNDETERMINED, 0.0
    p = _softmax((((total / n) @ model.table + model.bias) / model.temperature)[None, :])[0]
    best = int(p.argmax())
    return model.langs[best], float(p[best])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected behind its own columns."""
    new = ("lang_pred", "score", "rejected")
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        m = shared.value
        for batch in batches:
            at = batch.schema.get_field_index
            found = [scores(m, t) for t in batch.column(at(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(at(n)) for n in names] + [pa.array([a for a, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([a == UNDETERMINED or s < m.threshold for a, s in found], pa.bool_())],
                names=[*names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*docs.columns).mapInArrow(task, f"{schema}, lang_pred string, score double, rejected boolean")
