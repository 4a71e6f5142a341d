"""Operator 6: language identification with averaged hashed subword embeddings and a linear softmax, trained by gradient descent in numpy.

A text is the average of the embeddings of its subwords (byte n-grams of lower-cased words with their borders, and whole words), a linear
layer turns it into one logit per language. Because the average and the layer are both linear, prediction adds up one row of
embedding x layer per subword occurrence; texts of any length are read whole, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import U, Words, _lane, mix, text_slices
from .decontam import fold

BUCKET_BITS = 15
GRAMS = (2, 3, 4)
PER_LANGUAGE = 600
LANGUAGES = 256
SLICE = 1 << 20
UNKNOWN = "und"


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, buckets) of all subword occurrences. Bytes that are no letters part words."""
    words = Words(texts)
    data = fold(words.data)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    n = len(data)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[words.offsets] = True
    before = np.concatenate(([False], letter[:-1])) & ~border[:-1]
    after = np.concatenate((letter[1:], [False])) & ~border[1:]
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    size = end - start
    # the words once more, each between two border bytes, so that an n-gram is n neighbours that hold a border at most at their ends
    at = np.arange(len(start)) * 2 + np.concatenate(([0], np.cumsum(size)[:-1]))
    flat = np.full(int(size.sum()) + 2 * len(start), 32, np.uint8)
    inner = np.ones(len(flat), bool)
    inner[at] = inner[at + size + 1] = False
    flat[inner] = data[letter]
    doc_of_word = np.searchsorted(words.offsets, start, side="right") - 1
    owner = np.repeat(doc_of_word, size + 2)
    value = _lane(0)[0][flat]
    docs, buckets = [], []
    closed = np.concatenate(([0], np.cumsum(~inner)))
    for gram in GRAMS:
        m = len(flat) - gram + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for k in range(gram):
            h = h * U(0x9E3779B97F4A7C15) + value[k:k + m]
        # a border inside would be one that is neither the first nor the last byte; two neighbouring borders belong to two words
        inside = closed[gram - 1:gram - 1 + m] - closed[1:1 + m]
        ok = (inside == 0) & (inner[:m] | inner[gram - 1:gram - 1 + m]) if gram > 2 else (inner[:m] | inner[1:1 + m])
        docs.append(owner[:m][ok])
        buckets.append(mix(h[ok] + U(gram)) >> U(64 - BUCKET_BITS))
    # whole words: a hash of the bytes and their places inside the word
    place = np.arange(len(flat), dtype=np.uint64) - np.repeat(at, size + 2).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value + place * U(0xD1342543DE82EF95)))))
    docs.append(doc_of_word)
    buckets.append(mix(total[at + size + 2] - total[at]) >> U(64 - BUCKET_BITS))
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # embedding x layer: one row of logits per bucket
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        doc, bucket = subwords(texts)
        out = np.zeros((len(texts), len(self.labels)))
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(doc, self.table[bucket, k], minlength=len(texts))
        return out / np.maximum(np.bincount(doc, minlength=len(texts)), 1)[:, None] + self.bias

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def bags(sample: DataFrame) -> DataFrame:
    """(label, buckets, counts) of each text: whole texts in, at most 2**15 entries out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, SLICE):
            doc, bucket = subwords(b.column("text"))
            keys, counts = np.unique(doc << BUCKET_BITS | bucket, return_counts=True)
            cuts = np.searchsorted(keys >> BUCKET_BITS, np.arange(len(b.column("text")) + 1))
            rows = [(keys[i:j] & ((1 << BUCKET_BITS) - 1), counts[i:j]) for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<i4").tobytes() for r in rows], pa.binary())],
                ["doc_id", "label", "buckets", "counts"])

    return sample.mapInArrow(work, "doc_id long, label string, buckets binary, counts binary")


def draw(docs: DataFrame, per_label: int) -> DataFrame:
    """At most about ``per_label`` rows (doc_id, label, text) of each label, by a hash of the id; labels beyond the 256 most frequent are left out."""
    sizes = docs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(LANGUAGES).collect()
    share = F.coalesce(*[F.when(F.col("label") == r["label"], F.lit(min(1.0, per_label / r["n"]))) for r in sizes], F.lit(0.0)) if sizes else F.lit(0.0)
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)


def train(rows: list, dims: int = 16, steps: int = 1500, batch: int = 32, rate: float = 0.5, seed: int = 5) -> Model | None:
    """Fit on rows (doc_id, label, buckets, counts); every fifth is kept for calibration. None without rows."""
    rows = sorted((r for r in rows if len(r["buckets"])), key=lambda r: (r["doc_id"], r["label"]))
    if not rows:
        return None
    labels = sorted({r["label"] for r in rows})
    number = {label: i for i, label in enumerate(labels)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    kept, fitted = (order[::5], np.setdiff1d(order, order[::5])) if len(rows) >= 20 else (order, order)
    size = 1 << BUCKET_BITS
    embed = rng.normal(0, 1 / dims, (size, dims))
    layer, bias = np.zeros((dims, len(labels))), np.zeros(len(labels))
    data = []
    for r in rows:
        counts = np.frombuffer(r["counts"], "<i4").astype(float)
        data.append((np.frombuffer(r["buckets"], "<i4").astype(np.int64), counts / counts.sum(), number[r["label"]]))
    step = 0
    while step < steps:
        rng.shuffle(fitted)
        for at in range(0, len(fitted), batch):
            now = rate * max(0.0, 1 - step / steps)
            step += 1
            some = [data[i] for i in fitted[at:at + batch]]
            hidden = np.stack([w @ embed[b] for b, w, _ in some])
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(some)), [y for _, _, y in some]] -= 1
            back = error @ layer.T
            layer -= now * hidden.T @ error / len(some) * 4
            bias -= now * error.mean(0)
            for (b, w, _), g in zip(some, back):
                embed[b] -= now * np.outer(w, g) * 20
    model = Model(labels, embed @ layer, bias, 1.0, 0.0)
    z = np.stack([w @ model.table[b] for b, w, _ in (data[i] for i in kept)]) + bias
    y = np.array([data[i][2] for i in kept])
    loss = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.1, 5, 60)}
    model.temperature = float(min(loss, key=loss.get))
    sure = softmax(z / model.temperature).max(1)[z.argmax(1) == y]
    model.reject_below = min(0.95, float(np.quantile(sure, 0.01))) if len(sure) else 0.0
    return model


def identify(docs: DataFrame, learn: Column | None = None, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score and accepted for every document.

    Learns from about ``per_language`` whole texts of each language among the rows where ``learn`` holds (all if None) and the language
    is known. ``score`` is the probability of the prediction, calibrated by temperature on texts kept from training; ``accepted`` is
    false below the score that 99 of 100 right predictions reach there. A null text or one without a letter is ``und`` with score 0 and
    not accepted; so is every text if there is nothing to learn from. Only the ``LANGUAGES`` (256) most frequent languages are learned, so a rarer
    one is never predicted. Texts are judged whole, whatever their length. A null id stays null; repeated rows are judged each time; an empty
    table gives no rows; further columns are ignored.
    """
    text = docs[text_col].cast("string")
    known = docs.where(docs[lang_col].isNotNull() & text.rlike(r"\p{L}") & (learn if learn is not None else F.lit(True)))
    sample = draw(known.select(known[id_col].cast("bigint").alias("doc_id"), known[lang_col].cast("string").alias("label"), known[text_col].cast("string").alias("text")), per_language)
    model = train(bags(sample).collect())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, SLICE):
            n, legible = b.num_rows, b.column("legible").to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if model is not None and legible.any():
                p = model.probabilities(b.column("text"))
                best = p.argmax(1)
                pred = np.where(legible, np.array(model.labels, object)[best], UNKNOWN)
                score = np.where(legible, p[np.arange(n), best], 0.0)
            ok = legible & (score >= model.reject_below) if model is not None else legible & False
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(ok)], ["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("legible"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double, accepted boolean")
