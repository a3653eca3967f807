"""Language of whole texts by a convolutional network over bytes (operator 6).

A window of 256 bytes goes through filters of several widths; each filter's
largest response in the window (at least 0) feeds a softmax over the languages.
With bytes as one-hot vectors, a filter is a table of a weight for each byte
value at each of its places, and a response is a sum of looked-up rows, so no
product with the one-hot vectors is ever formed. The network is trained in numpy
on windows of a bounded, hash-drawn sample of labelled texts: SAMPLE_TEXTS a
language (fewer where they would be more than MOST_TEXTS in all; LEAST_TEXTS in
any case), WINDOWS_A_TEXT windows each; equal windows of a language count once. All windows of every text are scored, and
a text's language is the one with the highest mean probability over its windows,
weighted by their letters.

Defined cases: a text that is null or has no letter is `und` with score 0;
without any labelled text all are, and `with_language`, which could then tell
nothing, keeps the texts that have a letter. Rows without an id are scored, never learned
from. Only the text is an input; ASCII capitals count as small letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourvault.llm import stored
from hourvault.llm.flat import LOWER, byte_set, flat_bytes, small_batches
from hourvault.llm.sample import held_out, may_learn, text_hash
from hourvault.llm.worker import lean

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_TEXTS = 800
WINDOWS_A_TEXT = 3
#: Texts of all languages together, and of one at least: every label is learned, with fewer texts each if there are many.
MOST_TEXTS, LEAST_TEXTS = 60_000, 20
#: Text scored at a time.
BATCH_BYTES = 1 << 20
STEPS = 400
BATCH = 64
_LETTER = byte_set((65, 90), (97, 122), (128, 255))


@dataclass
class Model:
    """`filters`: by width, an array (width, 256, FILTERS); `weights`, `bias`: the softmax layer."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def responses(self, windows: np.ndarray) -> list[np.ndarray]:
        """Of each width, (windows, places, FILTERS) sums of looked-up rows."""
        out = []
        for width, table in self.filters.items():
            places = windows.shape[1] - width + 1
            total = np.take(table[0], windows[:, :places], axis=0)
            for k in range(1, width):
                total += np.take(table[k], windows[:, k : k + places], axis=0)
            out.append(total)
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for a in range(0, len(windows), 32):  # small enough for the processor's cache
            pooled = np.concatenate([np.maximum(r.max(1), 0) for r in self.responses(windows[a : a + 32])], axis=1)
            out[a : a + 32] = _softmax(pooled @ self.weights + self.bias)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Model:
    """Adam on the cross entropy; a pooled filter's gradient goes to the place of its largest response."""
    random = np.random.default_rng(seed)
    model = Model(
        languages,
        {w: random.normal(0, 0.5 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        random.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    for table in model.filters.values():
        table[:, 0] = 0  # the padding byte
    parameters = [*model.filters.values(), model.weights, model.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    by_label = [np.flatnonzero(labels == c) for c in range(len(languages))]
    for step in range(1, steps + 1):
        # Languages in equal parts, whatever their shares of the sample.
        picked = np.concatenate([random.choice(own, -(-BATCH // len(languages))) for own in by_label])
        x, y = windows[picked], labels[picked]
        pooled, where = [], []
        for r in model.responses(x):
            at = r.argmax(1)
            where.append(at)
            pooled.append(np.maximum(np.take_along_axis(r, at[:, None, :], 1)[:, 0], 0))
        h = np.concatenate(pooled, axis=1)
        error = _softmax(h @ model.weights + model.bias)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ model.weights.T) * (h > 0)
        gradients = []
        for i, (width, table) in enumerate(model.filters.items()):
            g = np.zeros_like(table)
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            filters = np.broadcast_to(np.arange(FILTERS), own.shape)
            for k in range(width):
                np.add.at(g[k], (np.take_along_axis(x, where[i] + k, 1), filters), own)
            g[:, 0] = 0
            gradients.append(g)
        gradients += [h.T @ error + 1e-4 * model.weights, error.sum(0)]
        rate = 0.02 if step < 0.7 * steps else 0.005
        for p, g, (m, v) in zip(parameters, gradients, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def cut_windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(windows, row of each): every text of a batch in full, the last window padded with 0."""
    data, offsets = flat_bytes(column)
    sizes = np.diff(offsets)
    number = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), number)
    first = np.cumsum(number) - number
    windows = np.zeros(int(number.sum()) * WINDOW, np.uint8)
    at = np.arange(len(data)) + np.repeat(first * WINDOW - offsets[:-1], sizes)
    windows[at] = LOWER[data]
    return windows.reshape(-1, WINDOW), row


def _sample(df: DataFrame, key: str, text: str, lang: str) -> tuple[np.ndarray, list[str]]:
    """Windows of the drawn texts, at places chosen by the text's hash, and their languages."""
    stored.small_transfers(df.sparkSession)
    own = F.col(lang).cast("string")
    rows = df.where(may_learn(key) & own.isNotNull()).select(
        F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"), own.alias("lang")
    )
    # One row a language: no more than the network has outputs.
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), []
    texts = max(LEAST_TEXTS, min(SAMPLE_TEXTS, MOST_TEXTS // len(counts)))
    shares = df.sparkSession.createDataFrame([(r["lang"], min(1.0, texts / r["n"])) for r in counts], "lang string, share double")
    # Drawn by id and text, so that texts of one id are drawn apart.
    drawn = rows.withColumn("seed", F.xxhash64("id", text_hash("text"), F.lit(6))).join(F.broadcast(shares), "lang")
    drawn = drawn.where(F.pmod("seed", F.lit(1 << 30)) / float(1 << 30) < F.col("share")).select("seed", "text", "lang")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            windows, row = cut_windows(batch.column("text"))
            seeds = batch.column("seed").to_numpy().view(np.uint64).tolist()
            letters = _LETTER[windows].sum(1)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            chosen = []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                some = np.random.default_rng(seeds[i]).permutation(np.arange(a, b))
                chosen += [w for w in some.tolist() if letters[w] > 8][:WINDOWS_A_TEXT]
            yield pa.RecordBatch.from_arrays(
                [pa.array([windows[w].tobytes() for w in chosen], pa.binary()), batch.column("lang").take(pa.array(row[chosen], pa.int64()))],
                ["window", "lang"],
            )

    # Rows of one id and text give the same windows. The limit only holds if the draw brings twice what it should.
    found = drawn.mapInArrow(lean(pick), "window binary, lang string").distinct().orderBy(F.xxhash64("window"), "window", "lang")
    found = found.limit(2 * texts * len(counts) * WINDOWS_A_TEXT).toPandas().sort_values(["lang", "window"])
    raw = b"".join(bytes(w) for w in found["window"])
    return np.frombuffer(raw, np.uint8).reshape(-1, WINDOW), found["lang"].tolist()


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """The network trained on the learning folds of a frame; None if no labelled text has letters."""
    windows, names = _sample(df, key, text, lang)
    languages = sorted(set(names))
    if not languages:
        return None
    return train(windows, np.searchsorted(languages, names), languages)


def _with_letters(column: pa.Array, windows: np.ndarray, row: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Which texts of a batch have a letter; letters outside ASCII are only known as such by their characters."""
    found = np.bincount(row, (_LETTER[windows] & (windows < 128)).sum(1), minlength=len(column)) > 0
    for i in np.flatnonzero(~found & (total > 0)).tolist():
        found[i] = any(ch.isalpha() for ch in column[i].as_py())
    return found


def _predict(column: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text its language, the score, and whether it has a letter."""
    n = len(column)
    windows, row = cut_windows(column)
    weight = _LETTER[windows].sum(1).astype(np.float64)
    total = np.bincount(row, weight, minlength=n)
    plain = _with_letters(column, windows, row, total)
    if model is None:
        return [UNKNOWN] * n, np.zeros(n), plain
    probability = model.probabilities(windows) * weight[:, None]
    mean = np.stack([np.bincount(row, probability[:, c], minlength=n) for c in range(len(model.languages))], axis=1)
    mean = mean / np.maximum(total, 1)[:, None]
    best = mean.argmax(1)
    names = [model.languages[c] if ok else UNKNOWN for c, ok in zip(best.tolist(), plain.tolist(), strict=True)]
    return names, np.clip(np.where(plain, mean[np.arange(n), best], 0.0), 0, 1), plain


def identify(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    stored.small_transfers(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few hundred kilobytes
    rows = df.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            names, score, _ = _predict(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(lean(predict), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def with_language(df: DataFrame, model: Model | None, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of a frame, all columns as they are, whose language is told with at least this score.

    Without a model (no labelled text had letters) the rows whose text has a letter.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, BATCH_BYTES):
            names, score, letters = _predict(batch.column(text), shared.value)
            if shared.value is not None:
                letters = np.array([n != UNKNOWN for n in names], bool) & (score >= least)
            yield batch.filter(pa.array(letters))

    return df.mapInArrow(lean(keep), df.schema)
