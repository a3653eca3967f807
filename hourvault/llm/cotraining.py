"""Document quality by co-training of two views (operator 1).

The text view sees the content: shares of byte-class pairs, of distinct words
and of repeated lines. The metadata view sees what a page's record says about
it: source, language, recorded length, and the layout of its lines. Each view
has a logistic classifier, fitted in numpy. In each round each view labels the
unlabelled texts it is most sure of, and the other view learns from them; then
both are fitted again. Each view's scores are calibrated on labelled texts that
neither learned from (Platt), and a last logistic fit on them weighs the
calibrated views. The result scores all documents.

Learned from, on the learning folds only: up to SAMPLE labelled ids and up to
SAMPLE unlabelled ids, drawn by hash. Features are computed in tasks over whole
texts; the driver sees their numbers for the samples.

Defined cases: null texts count as empty, null metadata as a value of its own;
several labels of one id count as good only if all are; with no label of one of
the classes all scores are the share of good labels (0 without labels). Rows
without an id are scored, never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourvault.llm.flat import U64, Words, byte_set, flat_bytes, small_batches, span_hashes, spans
from hourvault.llm.sample import draw, drawn_ids, held_out, may_learn, one_text_each

SAMPLE = 3000
ROUNDS = 5
#: Share of the unlabelled texts that a view labels in a round, and the least sureness for it.
TAKEN = 0.05
SURE = 0.9
#: Share of the labelled texts kept for calibration.
CALIBRATION = 0.3
RIDGE = 10.0
_SOURCES, _LANGUAGES = 64, 16
_SPACE = byte_set((9, 13), (32, 32))


def _byte_classes() -> np.ndarray:
    """Class of each byte value: letters by case, digits, white space, other bytes, and 9 groups of signs."""
    classes = np.zeros(256, np.uint8)
    for number, (low, high) in enumerate([(97, 122), (65, 90), (48, 57), (9, 13), (32, 32), (128, 255)], 1):
        classes[low : high + 1] = number
    for sign in range(33, 127):
        if classes[sign] == 0:
            classes[sign] = 7 + sign % 9
    return classes


_CLASSES = _byte_classes()


def text_view(column: pa.Array) -> np.ndarray:
    """Byte-class pairs as shares, share of distinct words, share of distinct lines, mean word length."""
    data, offsets = flat_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, 259), np.float64)
    if len(data):
        classes = _CLASSES[data]
        row = np.repeat(np.arange(n), np.diff(offsets))
        pair = classes[:-1].astype(np.int64) * 16 + classes[1:]
        same = row[:-1] == row[1:]
        out[:, :256] = np.bincount(row[:-1][same] * 256 + pair[same], minlength=256 * n).reshape(n, 256)
        out[:, :256] /= np.maximum(out[:, :256].sum(1, keepdims=True), 1)
        words = Words(data, offsets, ~_SPACE)
        out[:, 256] = _distinct(words.doc, words.hash, n)
        start, end = spans(data != 10, offsets)
        line_of = np.searchsorted(offsets, start, side="right") - 1
        out[:, 257] = _distinct(line_of, span_hashes(data, start, end), n)
        out[:, 258] = np.diff(offsets) / np.maximum(np.diff(words.first), 1)
        out[:, 258] = np.minimum(out[:, 258], 40) / 10
    return out


def _distinct(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct values as a share of all, by row."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(row[new], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)


def metadata_view(batch: pa.RecordBatch) -> np.ndarray:
    """Source and language (hashed, one place each), recorded length, lines and their mean length."""
    data, offsets = flat_bytes(batch.column("text"))
    n = batch.num_rows
    out = np.zeros((n, _SOURCES + _LANGUAGES + 4), np.float64)
    for name, first, places in (("source", 0, _SOURCES), ("lang", _SOURCES, _LANGUAGES)):
        values, bounds = flat_bytes(batch.column(name))
        full = np.flatnonzero(np.diff(bounds) > 0)
        out[full, first + (span_hashes(values, bounds[full], bounds[full + 1]) % U64(places)).astype(np.int64)] = 1
    length = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64)
    known = ~np.isnan(length)
    out[known, -4] = np.log1p(np.maximum(length[known], 0))
    out[:, -3] = ~known
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
    out[:, -2] = np.log(lines)
    out[:, -1] = np.log1p(np.diff(offsets) / lines)
    return out


@dataclass
class Logistic:
    """Standardised inputs, weights and bias."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> Logistic:
        """Newton steps on the ridge-penalised likelihood."""
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        a = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
        w = np.zeros(a.shape[1])
        penalty = np.full(a.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(penalty)
            w = w - np.linalg.solve(h, a.T @ (p - y) + penalty * w)
        return cls(mean, scale, w)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]


@dataclass
class Model:
    """One classifier a view, its calibration (slope and offset), and the weights of the calibrated views."""

    views: tuple[Logistic, Logistic]
    calibration: tuple[Logistic, Logistic]
    combined: Logistic
    taken: list[tuple[int, int]]

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of the text view, of the metadata view, and of both."""
        logits = [c.logits(v.logits(x)[:, None]) for v, c, x in zip(self.views, self.calibration, (text, metadata), strict=True)]
        return tuple(_sigmoid(z) for z in (*logits, self.combined.logits(np.stack(logits, 1))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, unlabelled: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> Model:
    """Exchange of sure pseudo-labels between the views, then calibration on labelled rows kept apart."""
    order = np.random.default_rng(11).permutation(len(y))
    kept = order[: max(2, int(CALIBRATION * len(y)))]
    rest = order[len(kept) :]
    if len(set(y[kept])) < 2 or len(set(y[rest])) < 2:  # too few labels to keep some apart
        kept = rest = order
    sets = [(x[rest], y[rest]) for x in labelled]
    views = [Logistic.fit(*s) for s in sets]
    free, taken = np.ones(len(unlabelled[0]), bool), []
    share = y.mean()
    for _ in range(rounds):
        picks = []
        for view, x in zip(views, unlabelled, strict=True):
            p = _sigmoid(view.logits(x)) if len(x) else np.zeros(0)
            n = int(TAKEN * len(x))
            good = np.flatnonzero(free & (p >= SURE))
            bad = np.flatnonzero(free & (p <= 1 - SURE))
            good = good[np.argsort(-p[good], kind="stable")][: int(np.ceil(n * share))]
            bad = bad[np.argsort(p[bad], kind="stable")][: int(np.ceil(n * (1 - share)))]
            picks.append((np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))])))
        # A text that the views label differently teaches neither.
        said = [dict(zip(i.tolist(), z.tolist(), strict=True)) for i, z in picks]
        torn = {i for i in said[0] if said[1].get(i, said[0][i]) != said[0][i]}
        taken.append(tuple(len(i) for i, _ in picks))
        for to, (index, z) in ((1, picks[0]), (0, picks[1])):
            sure = np.array([i not in torn for i in index.tolist()], bool)
            sets[to] = (np.concatenate([sets[to][0], unlabelled[to][index[sure]]]), np.concatenate([sets[to][1], z[sure]]))
            free[index] = False
        views = [Logistic.fit(*s) for s in sets]
        if not any(taken[-1]):
            break
    logits = [v.logits(x[kept]) for v, x in zip(views, labelled, strict=True)]
    calibration = [Logistic.fit(z[:, None], y[kept], 0.1) for z in logits]
    calibrated = np.stack([c.logits(z[:, None]) for c, z in zip(calibration, logits, strict=True)], 1)
    return Model(tuple(views), tuple(calibration), Logistic.fit(calibrated, y[kept], 0.1), taken)


_COLUMNS = ("text", "lang", "source", "n_chars")


def _rows(df: DataFrame, key: str) -> DataFrame:
    types = {"n_chars": "double"}
    return df.select(F.col(key).alias("id"), *(F.col(c).cast(types.get(c, "string")).alias(c) for c in _COLUMNS))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model | float:
    """The co-trained model; or the share of good labels if they are all alike."""
    spark = df.sparkSession
    known = labels.where(may_learn("doc_id") & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min(label).cast("double").alias("y"))
    n = known.count()
    # At most 2 * sample ids of either kind; then a few hundred numbers for each.
    some = known.where(draw("id", min(1.0, sample / max(1, n)), 11)).limit(2 * sample)
    others = df.where(may_learn(key)).select(F.col(key).alias("id")).distinct().join(known.select("id"), "id", "left_anti")
    chosen = some.unionByName(drawn_ids(others, "id", sample, 12).withColumn("y", F.lit(None).cast("double"))).toPandas()
    y = chosen["y"].dropna()
    if y.nunique() < 2:
        return float(y.mean()) if len(y) else 0.0
    id_type = df.schema[key].dataType.simpleString()
    ids = spark.createDataFrame([(i, None if v != v else float(v)) for i, v in zip(chosen["id"].tolist(), chosen["y"], strict=True)], f"id {id_type}, y double")

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            both = [text_view(batch.column("text")), metadata_view(batch)]
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32())) for x in both]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *arrays], ["id", "y", "a", "b"])

    rows = one_text_each(_rows(df, key), ids).select("id", "y", *_COLUMNS)  # no more rows than ids
    found = rows.mapInArrow(views, f"id {id_type}, y double, a array<float>, b array<float>").toPandas().sort_values("id", kind="stable")
    has = found["y"].notna().to_numpy()
    if len(set(found["y"][has])) < 2:
        return float(found["y"][has].mean()) if has.any() else 0.0
    a, b = (np.stack(found[c].to_numpy()).astype(np.float64) for c in "ab")
    return co_train((a[has], b[has]), found["y"].to_numpy()[has], (a[~has], b[~has]))


def score(df: DataFrame, model: Model | float, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, held_out, score_text, score_metadata, score, predicted (1: good)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    rows = _rows(df, key).withColumn("held_out", held_out("id"))
    kind = rows.schema["id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            own = shared.value
            if isinstance(own, float):
                found = [np.full(batch.num_rows, own)] * 3
            else:
                found = own.scores(text_view(batch.column("text")), metadata_view(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), *(pa.array(s, pa.float64()) for s in found), pa.array((found[2] >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score_text", "score_metadata", "score", "predicted"],
            )

    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, score_text double, score_metadata double, score double, predicted int")
