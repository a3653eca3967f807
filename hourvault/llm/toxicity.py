"""Toxicity by non-negative positive-unlabelled learning (operator 4).

A linear classifier over the distinct words and word beginnings of a text is
trained in numpy from confirmed toxic texts and unlabelled ones. With p the
share of toxic texts, its risk is p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)]):
the unlabelled texts stand for both classes, and what toxic ones among them add
is taken off. When the second part falls below 0, the step goes against it, so
that the estimate cannot reward overfitting.

Learned from, on the folds that may be learned from only: up to SAMPLE texts
labelled toxic, up to SAMPLE texts drawn by hash whatever their labels, and the
share of toxic among all labelled rows as p. Features are the FEATURES that tell
most, counted by Spark over the samples: p times how much more frequent a feature
is among the toxic texts is the share of toxic among all texts that have it.
Every word of every text is then looked up among them.

Defined cases: null and empty texts have the score of a text without features;
several labels of one id count as toxic if any does; of several texts of one id, one is
learned from, so that no more rows than 4 * SAMPLE reach the driver; without toxic examples all
scores are 0. Rows without an id are scored, never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourvault.llm import stored
from hourvault.llm.flat import U64, Words, byte_set, flat_bytes, mix, small_batches, span_hashes
from hourvault.llm.sample import drawn_ids, held_out, may_learn, one_text_each
from hourvault.llm.worker import lean

THRESHOLD = 0.3
SAMPLE = 4000
FEATURES = 8192
#: A feature must be in so many toxic texts, or in this share of them if that is more; and of
#: the texts that have it, by the class prior, so large a share must be toxic (less, with few examples).
LEAST_TEXTS, LEAST_SHARE = 3, 0.01
LEAST_TOXIC, FEW = 0.6, 50
#: Penalty on squared weights, divided by the number of toxic texts.
PENALTY = 0.15
BEGINNINGS = (3, 4, 5, 6, 7)
STEPS = 300
#: Text scored at a time.
BATCH_BYTES = 1 << 20
_LETTERS = byte_set((97, 122), (128, 255))
_FILTER_BITS = 20


def word_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the words of a batch of texts, then of their first 3, 4, ... bytes."""
    words = Words(*flat_bytes(column), _LETTERS)
    doc, length = words.doc, words.end - words.start
    yield doc, words.hash
    for n in BEGINNINGS:
        long = length >= n
        start = words.start[long]
        yield doc[long], mix(span_hashes(words.data, start, start + n) ^ U64(n << 8))


@dataclass
class Model:
    """`hashes`: sorted features; `weights` and `bias` of the linear score."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._place(self.hashes)] = True

    @staticmethod
    def _place(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - _FILTER_BITS)).astype(np.int64)

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) of a batch of texts."""
        n, pairs = max(1, len(self.hashes)), []
        for doc, hashes in word_features(column):
            maybe = np.flatnonzero(self.filter[self._place(hashes)])
            at = np.searchsorted(self.hashes, hashes[maybe])
            at[at == len(self.hashes)] = 0
            hit = self.hashes[at] == hashes[maybe] if len(self.hashes) else np.zeros(len(at), bool)
            pairs.append(doc[maybe[hit]] * n + at[hit])
        both = np.unique(np.concatenate(pairs))
        return both // n, both % n

    def scores(self, column: pa.Array) -> np.ndarray:
        row, feature = self.present(column)
        linear = self.bias + np.bincount(row, self.weights[feature], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(linear, -50, 50)))


def train(
    positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int],
    features: int, prior: float, steps: int = STEPS,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; samples are (row, feature, rows)."""
    weights, bias = np.zeros(features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(features + 1), np.zeros(features + 1)

    def linear(sample):
        row, feature, n = sample
        return bias + np.bincount(row, weights[feature], minlength=n)

    def gradient(sample, slope):
        row, feature, _ = sample
        return np.append(np.bincount(feature, slope[row], minlength=features), slope.sum())

    for step in range(1, steps + 1):
        fp, fu = linear(positive), linear(unlabelled)
        # l(f) = log(1 + exp(-f)); its slope is -sigmoid(-f), that of l(-f) is sigmoid(f).
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -50, 50))), 1 / (1 + np.exp(-np.clip(fu, -50, 50)))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        rest = gradient(unlabelled, su / len(su)) - prior * gradient(positive, sp / len(sp))
        if negative >= 0:
            g = prior * gradient(positive, (sp - 1) / len(sp)) + rest
        else:
            g = -rest
        g[:-1] += PENALTY / positive[2] * weights
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        rate = 0.1 * min(1.0, 2 * (1 - step / (steps + 1)))
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def _count_features(sample: DataFrame) -> DataFrame:
    """Texts of either kind that have each feature: hash, toxic, other."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            parts = list(word_features(batch.column("text")))
            doc, hashes = np.concatenate([d for d, _ in parts]), np.concatenate([h for _, h in parts])
            order = np.lexsort((doc, hashes))
            doc, hashes = doc[order], hashes[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
            doc, hashes = doc[new], hashes[new]
            found, place = np.unique(hashes, return_inverse=True)
            n = np.bincount(place, minlength=len(found))
            t = np.bincount(place, toxic[doc], minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(t), pa.array(n - t)], ["hash", "toxic", "other"])

    return sample.mapInArrow(lean(count), "hash long, toxic long, other long").groupBy("hash").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    )


def fit(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", toxic: str = "toxic",
    prior: float | None = None, sample: int = SAMPLE,
) -> Model | None:
    """The classifier learned from the learning folds; None without toxic examples."""
    spark = df.sparkSession
    stored.small_transfers(spark)
    known = labels.where(may_learn(label_key) & F.col(toxic).isNotNull()).groupBy(F.col(label_key).alias("id")).agg(F.max(toxic).alias("toxic"))
    if prior is None:
        prior = known.agg(F.avg("toxic")).head()[0]
    if not prior:
        return None
    prior = min(float(prior), 0.9)
    positives = drawn_ids(known.where("toxic = 1"), "id", sample, 41)
    others = drawn_ids(df.where(may_learn(key)).select(F.col(key).alias("id")), "id", sample, 42)
    # At most 4 * sample ids; a text may stand in both samples.
    chosen = positives.withColumn("toxic", F.lit(1.0)).unionByName(others.withColumn("toxic", F.lit(0.0))).toPandas()
    if not (chosen["toxic"] == 1).any():
        return None
    id_type = df.schema[key].dataType.simpleString()
    ids = spark.createDataFrame(chosen, f"id {id_type}, toxic double").distinct()
    rows = one_text_each(df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")), ids).select("toxic", "text")
    rows = stored.written(rows, "toxicity-sample")
    counts = _count_features(rows)
    n_toxic, n_other = (max(1, int((chosen["toxic"] == x).sum())) for x in (1, 0))
    lift = ((F.col("toxic") + 0.5) / n_toxic) / ((F.col("other") + 0.5) / n_other)
    certain = LEAST_TOXIC * n_toxic / (n_toxic + FEW)
    best = (
        counts.where((F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * n_toxic)) & (prior * lift >= certain))
        .orderBy(F.desc(F.col("toxic") * F.log(lift)), "hash")
        .limit(FEATURES)
        .select("hash")
        .toPandas()
    )
    hashes = np.sort(best["hash"].to_numpy(np.int64).view(U64))
    model = Model(hashes, np.zeros(len(hashes)), 0.0)
    if not len(hashes):
        if rows.where("toxic = 1").isEmpty():
            return None
        return Model(hashes, np.zeros(0), float(np.log(prior / (1 - prior))))
    empty = Model(hashes, np.zeros(len(hashes)), 0.0)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            row, feature = empty.present(batch.column("text"))
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists], ["toxic", "features"])

    sampled = rows.mapInArrow(lean(present), "toxic double, features array<int>").toPandas()

    def sparse(rows):
        sizes = [len(f) for f in rows]
        return np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), len(rows)

    parts = [sparse(sampled["features"][sampled["toxic"] == x].tolist()) for x in (1.0, 0.0)]
    if not parts[0][2] or not parts[1][2]:
        return None
    model.weights, model.bias = train(*parts, len(hashes), prior)
    return model


def score(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    stored.small_transfers(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most FEATURES features and a filter of a megabyte
    rows = df.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            found = shared.value.scores(batch.column("text")) if shared.value else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(lean(predict), f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(df: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of a frame, all columns as they are, that score below the threshold."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, BATCH_BYTES):
            found = shared.value.scores(batch.column(text)) if shared.value else np.zeros(batch.num_rows)
            yield batch.filter(pa.array(found < threshold))

    return df.mapInArrow(lean(keep), df.schema)
