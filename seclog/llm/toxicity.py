"""Toxicity: character n-grams scaled by naive Bayes log-count ratios under a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.llm.common import documents, mapped, texts
from seclog.sources.staging import staged

#: Lengths of the n-grams in characters and the number of hashed features.
ORDERS = (4, 5, 6)
FEATURES = 1 << 19
#: Labelled rows per class that the classifier is fitted on: those with the least hashes of their doc_id.
SAMPLE = 3000
#: Characters of a text that are turned into numbers at once.
PART = 1 << 20
_MULTIPLY, _STEP, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(64 - 19)


@dataclass
class Model:
    """Weight per feature (ratio times learnt weight) and the intercept; without examples of both classes, no weights."""

    weight: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.counts = self.weight != 0

    def score(self, text: str) -> float:
        found = [h[self.counts[h]] for h in _hashes(text)]
        z = float(self.weight[np.unique(np.concatenate(found))].sum()) + self.intercept if found else self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _hashes(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of the n-grams of a text in characters, lower-cased and with a space at both ends, in parts."""
    whole, longest = f" {text.lower()} ", max(ORDERS)
    for at in range(0, len(whole), PART):
        part = np.frombuffer(whole[at : at + PART + longest - 1].encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        code = part
        for n in range(2, longest + 1):
            if len(part) < n:
                break
            code = code[: len(part) - n + 1] * _STEP + part[n - 1 :]
            if n in ORDERS:
                yield ((code + np.uint64(n << 56)) * _MULTIPLY >> _SHIFT).astype(np.int32)[:PART]


def features(text: str) -> np.ndarray:
    """Numbers of the different n-grams of a text."""
    seen = np.zeros(FEATURES, bool)
    for h in _hashes(text):
        seen[h] = True
    return np.flatnonzero(seen).astype(np.int32)


def ratios(toxic: np.ndarray, other: np.ndarray, n1: int, n0: int, alpha: float = 1.0, errors: float = 3.5) -> np.ndarray:
    """Log of a feature's smoothed share in toxic texts over that in the others, from the texts that have it.

    0 where the difference is within ``errors`` standard errors, as chance gives for most features.
    """
    ratio = np.log((toxic + alpha) / (n1 + 2 * alpha)) - np.log((other + alpha) / (n0 + 2 * alpha))
    pooled = (toxic + other + alpha) / (n1 + n0 + 2 * alpha)
    error = np.sqrt((1 - pooled) / pooled * (1 / n1 + 1 / n0))
    return np.where(np.abs(ratio) > errors * error, ratio, 0.0)


def fit(rows: list[np.ndarray], toxic: np.ndarray, share: float, ratio: np.ndarray, ridge: float = 2e-3, steps: int = 150) -> Model:
    """Learn weights from the features of each row, all with a ratio; ``share`` is that of toxic rows among all labelled ones.

    Logistic regression on presence times ratio, each class weighed to its share, is minimised by accelerated
    gradient steps.
    """
    weight, b = np.zeros(FEATURES, np.float32), float(np.log(share / (1 - share)))
    flat = np.concatenate(rows)
    names, column = np.unique(flat, return_inverse=True)
    if not len(names):
        return Model(weight, b)
    n, owner, value = len(rows), np.repeat(np.arange(len(rows)), list(map(len, rows))), ratio[flat]
    y = toxic.astype(float)
    importance = np.where(toxic, share / toxic.sum(), (1 - share) / (~toxic).sum())
    norm = np.bincount(owner, weights=value * value, minlength=n)
    rate = 1 / (0.25 * float((importance * (norm + 1)).sum()) + ridge)
    w = np.zeros(len(names))
    look_w, look_b, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = np.bincount(owner, weights=value * look_w[column], minlength=n) + look_b
        g = importance * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        new_w = look_w - rate * (np.bincount(column, weights=value * g[owner], minlength=len(names)) + ridge * look_w)
        new_b = look_b - rate * float(g.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new_w + (t - 1) / t2 * (new_w - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new_w, new_b, t2
    weight[names] = w * ratio[names]
    return Model(weight, b)


def held_out(doc_id: Column, modulus: int = 5, rest: int = 0) -> Column:
    """crc32 of the doc_id as text; a null doc_id has no number and is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def _counted(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and other rows that have each feature; added up in tasks, then by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FEATURES), np.int64)
        for batch in batches:
            for toxic, own in zip(batch.column("is_toxic").to_pylist(), batch.column("found").to_pylist(), strict=True):
                counts[int(not toxic)][np.frombuffer(own, np.int32)] += 1
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(c[some]) for c in counts)], names=["feature", "toxic", "other"])

    sums = found.mapInArrow(run, "feature int, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    table = sums.toArrow()  # at most FEATURES rows
    out = np.zeros((2, FEATURES))
    for k, c in enumerate(("toxic", "other")):
        out[k][table.column("feature").to_numpy()] = table.column(c).to_numpy()
    return out[0], out[1]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on up to ``sample`` labelled rows of each class that are not held out.

    The chosen rows are at most 2 * sample doc_ids, so they are broadcast; texts stay where they are and become
    feature numbers there. Only the features whose ratio counts, of those rows, reach the driver. Rows with a null
    doc_id or label teach nothing; a doc_id with several labels is toxic if any of them is.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in known.groupBy(F.col("toxic") == 1).count().collect()}
    chosen = None
    for toxic in (1, 0):
        part = known.filter(F.col("toxic") == 1 if toxic else F.col("toxic") != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        part = part.select(F.col("doc_id"), F.lit(toxic == 1).alias("is_toxic"))
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kind = "is_toxic boolean, found binary"
    found = staged(mapped(rows, lambda b: {"is_toxic": b.column("is_toxic"), "found": [features(t).tobytes() for t in texts(b)]}, kind), "features")
    sizes = {r[0]: r[1] for r in found.groupBy("is_toxic").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return Model(np.zeros(FEATURES, np.float32), 60.0 if sizes.get(True) else -60.0)
    ratio = ratios(*_counted(found), sizes[True], sizes[False])
    counts_ = ratio != 0

    def only(b: pa.RecordBatch) -> dict:
        own = [np.frombuffer(x, np.int32) for x in b.column("found").to_pylist()]
        return {"is_toxic": b.column("is_toxic"), "found": [x[counts_[x]].tobytes() for x in own]}

    table = mapped(found, only, kind).toArrow().sort_by([("is_toxic", "ascending"), ("found", "ascending")])
    numbers = [np.frombuffer(x, np.int32) for x in table.column("found").to_pylist()]
    return fit(numbers, table.column("is_toxic").to_numpy(), counts[True] / (counts[True] + counts[False]), ratio)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (1 from 0.5 on).

    A score comes from the whole text alone. Null text counts as empty and gets the intercept's score; a null
    doc_id stays null; repeated rows each give a row; without labelled rows of both classes every score is next to 0
    (or to 1 if all are toxic). Other columns are not read; no rows give no rows. The model, a fixed number of
    weights, goes to the tasks with their code; texts are not moved.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, sample))

    def rows(batch: pa.RecordBatch) -> dict:
        score = [model.value.score(t) for t in texts(batch)]
        return {"doc_id": batch.column("doc_id"), "score": score, "predicted": [int(s >= 0.5) for s in score]}

    out = mapped(docs.select("doc_id", "text"), rows, f"doc_id {key}, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
