"""Language, toxicity and quality: held-out accuracy, folds, and odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from hourvault.llm import cotraining, language, toxicity
from hourvault.llm.sample import drawn_ids, held_out, one_text_each, text_hash

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "en", None, None, 1), (None, "words here", None, "s", 5, 2), (2, "", "", "", 0, 3), (2, "", "", "", 0, 3), (3, "?! 12 --", "en", "s", 8, 4)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def auc(scores, truth):
    order = np.argsort(np.argsort(scores, kind="stable")) + 1
    good = np.asarray(truth, bool)
    return (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_fold(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    for r in df.select("doc_id", held_out("doc_id").alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_drawn_samples_are_bounded(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    n = drawn_ids(ids, "doc_id", 400, 1).count()
    assert 300 < n < 500 and drawn_ids(ids.limit(10), "doc_id", 400, 1).count() == 10


# ------------------------------------------------------------------ language


def test_languages_of_held_out_documents(documents):
    model = language.fit(documents)
    got = {r.doc_id: r for r in language.identify(documents, model).collect()}
    rows = [r for r in documents.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_windows_hold_every_byte():
    texts = ["a" * 700, "", None, "é" * 129, "x"]
    windows, row = language.cut_windows(pa.array(texts))
    for i, text in enumerate(texts):
        assert windows[row == i].tobytes().rstrip(b"\0") == (text or "").encode()


def test_training_tells_two_kinds_apart():
    random = np.random.default_rng(0)
    windows = random.integers(97, 100, (40, language.WINDOW)).astype(np.uint8)
    windows[20:] += 10
    labels = np.repeat([0, 1], 20)
    model = language.train(windows, labels, ["x", "y"], steps=40)
    assert (model.probabilities(windows).argmax(1) == labels).mean() == 1


def test_first_step_goes_against_the_numerical_gradient():
    random = np.random.default_rng(4)
    windows = random.integers(97, 123, (3, language.WINDOW)).astype(np.uint8)  # one a label: every draw takes it
    labels = np.arange(3)
    start, after = (language.train(windows, labels, ["x", "y", "z"], steps=n) for n in (0, 1))

    def loss():
        return -np.log(start.probabilities(windows)[labels, labels].astype(np.float64)).mean()

    told = 0
    for old, new in zip([*start.filters.values(), start.weights, start.bias], [*after.filters.values(), after.weights, after.bias], strict=True):
        moved = (new - old).ravel()
        flat = old.reshape(-1)
        for i in random.permutation(np.flatnonzero(moved))[:60].tolist():
            before = flat[i]
            ends = []
            for step in (1e-3, -1e-3):
                flat[i] = before + np.float32(step)
                ends.append(loss())
            flat[i] = before
            slope = (ends[0] - ends[1]) / 2e-3
            if abs(slope) > 5e-3:
                told += 1
                assert np.sign(moved[i]) == -np.sign(slope)
    assert told > 60


def test_unknown_languages_and_odd_rows(spark, documents):
    model = language.fit(documents)
    got = language.identify(spark.createDataFrame(ODD, SCHEMA), model).collect()
    by_key = {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id is not None}
    assert by_key == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)}
    assert [r.lang_pred != "und" for r in got if r.doc_id is None] == [True]
    kept = language.with_language(spark.createDataFrame(ODD, SCHEMA), model, least=0.0).collect()
    assert [r.text for r in kept] == ["words here"]


def test_language_of_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert language.fit(none) is None and language.identify(none, None).collect() == []
    assert language.fit(spark.createDataFrame([(5, None, "en", None, None, 0)], SCHEMA)) is None
    assert [r.lang_pred for r in language.identify(spark.createDataFrame(ODD, SCHEMA), None).collect()] == ["und"] * 5


def test_every_labelled_language_is_learned_and_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_TEXTS", 300)
    monkeypatch.setattr(language, "LEAST_TEXTS", 2)
    rows = [(i, f"text number {i} tells little about its label", f"l{i % 290}") for i in range(2000)]
    windows, names = language._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert len(set(names)) > 256 and len(windows) == len(names) <= 2 * 2 * 290 * language.WINDOWS_A_TEXT


def test_texts_with_letters_stay_without_a_model(spark):
    kept = language.with_language(spark.createDataFrame(ODD, SCHEMA), None).collect()
    assert [r.text for r in kept] == ["words here"]


HOT = 3  # an id that may be learned from


def with_a_hot_id(spark, rows, hot, same_text):
    """`rows` documents of their own ids and twice as many of one id."""
    own = spark.range(1000, 1000 + rows).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text")
    text = "'a text that repeats'" if same_text else "concat('hot words of text ', id)"
    many = spark.range(2 * rows).selectExpr(f"{hot}L AS doc_id", f"{text} AS text")
    return own.unionByName(many).selectExpr("*", "'en' AS lang", "'s' AS source", "10L AS n_chars").repartition(8)


@pytest.mark.parametrize("same_text", [True, False])
def test_one_id_with_most_rows_keeps_samples_bounded(spark, monkeypatch, same_text):
    df = with_a_hot_id(spark, 6000, HOT, same_text)
    assert not df.where("doc_id = 3").select(held_out("doc_id").alias("h")).head().h
    windows, _ = language._sample(df, "doc_id", "text", "lang")
    assert 100 < len(windows) <= 2 * language.SAMPLE_TEXTS * language.WINDOWS_A_TEXT
    known = spark.range(1000, 3000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic", "CAST(id % 2 AS int) AS quality")
    known = known.unionByName(spark.createDataFrame([(HOT, 1, 1)], known.schema))
    seen = {}
    trained, taught = toxicity.train, cotraining.co_train
    monkeypatch.setattr(toxicity, "train", lambda p, u, *rest: seen.update(toxic=p[2], other=u[2]) or trained(p, u, *rest))
    monkeypatch.setattr(cotraining, "co_train", lambda x, y, u: seen.update(labelled=len(y), free=len(u[0])) or taught(x, y, u))
    monkeypatch.setattr(toxicity, "LEAST_TOXIC", 0.0)
    toxicity.fit(df, known, sample=300)
    cotraining.fit(df, known, sample=300)
    assert set(seen) == {"toxic", "other", "labelled", "free"} and all(20 < n <= 600 for n in seen.values()), seen


def test_of_one_id_the_text_of_the_smallest_hash_is_learned_from(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "b", 1), (2, None, 2), (2, None, 2), (5, "c", 3)], "id long, text string, n int")
    ids = spark.createDataFrame([(1, 0.0), (2, 1.0), (2, 0.0), (9, 1.0)], "id long, y double")
    got = sorted((r.id, r.text, r.y) for r in one_text_each(rows, ids).collect())
    first = rows.where("id = 1").orderBy(text_hash("text")).head().text
    assert got == [(1, first, 0.0), (2, None, 0.0), (2, None, 1.0)]


# ------------------------------------------------------------------ toxicity


def test_toxic_held_out_documents(documents, labels):
    model = toxicity.fit(documents, labels)
    got = {r.doc_id: r for r in toxicity.score(documents, model).collect()}
    rows = [r for r in labels.collect() if got[r.doc_id].held_out]
    assert auc([got[r.doc_id].score for r in rows], [r.toxic for r in rows]) >= 0.97
    assert np.mean([got[r.doc_id].predicted == r.toxic for r in rows]) >= 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())


def test_risk_steps_back_when_it_falls_below_zero():
    # Toxic rows have feature 0; a tenth of the unlabelled do too.
    rows = np.arange(400)
    weights, bias = toxicity.train((rows, np.zeros(400, int), 400), (np.arange(100), np.zeros(100, int), 1000), 2, 0.1)
    score = lambda x: 1 / (1 + np.exp(-x))
    assert score(bias + weights[0]) > 0.8 and score(bias) < 0.05 and weights[1] == 0


@pytest.mark.parametrize("toxic_rows", [3, 12])
def test_first_step_goes_against_the_numerical_slope_of_the_risk(toxic_rows):
    random = np.random.default_rng(toxic_rows)
    positive = (np.repeat(np.arange(toxic_rows), 2), random.integers(0, 4, 2 * toxic_rows), toxic_rows)
    unlabelled = (np.repeat(np.arange(40), 2), random.integers(2, 6, 80), 40)
    prior = 0.2 if toxic_rows == 3 else 0.8

    def parts(weights, bias):
        fp, fu = (bias + np.bincount(r, weights[f], minlength=n) for r, f, n in (positive, unlabelled))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        return prior * np.logaddexp(0, -fp).mean(), negative

    start = np.append(np.zeros(6), np.log(prior / (1 - prior)))

    assert parts(start[:-1], start[-1])[1] > 0  # no step back yet

    def aim(x):
        return sum(parts(x[:-1], x[-1]))

    weights, bias = toxicity.train(positive, unlabelled, 6, prior, steps=1)
    moved = np.append(weights, bias) - start
    slope = np.array([(aim(start + e) - aim(start - e)) / 2e-5 for e in np.eye(7) * 1e-5])
    clear = np.abs(slope) > 1e-6
    assert clear.sum() >= 5 and (np.sign(moved[clear]) == -np.sign(slope[clear])).all()


def test_toxicity_of_odd_rows(spark, documents, labels):
    model = toxicity.fit(documents, labels)
    got = toxicity.score(spark.createDataFrame(ODD, SCHEMA), model).collect()
    assert len(got) == 5 and all(0 <= r.score < 0.3 and r.predicted == 0 for r in got)
    assert toxicity.without_toxic(spark.createDataFrame(ODD, SCHEMA), model).count() == 5
    long = spark.createDataFrame([(9, "words " * 200_000 + "idiot", "en", "s", 0, 0)], SCHEMA)
    assert toxicity.score(long, model).head().predicted == 1


def test_toxicity_without_examples(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(documents, none) is None
    clean = spark.createDataFrame([(i, 1, 0) for i in range(50)], none.schema)
    assert toxicity.fit(documents, clean) is None
    assert {r.score for r in toxicity.score(spark.createDataFrame(ODD, SCHEMA), None).collect()} == {0.0}
    assert toxicity.fit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, 1)], none.schema)) is None
    assert toxicity.score(spark.createDataFrame([], SCHEMA), None).collect() == []


# ------------------------------------------------------------------- quality


def test_quality_of_held_out_documents(documents, labels):
    model = cotraining.fit(documents, labels)
    assert sum(map(sum, model.taken)) > 0
    got = {r.doc_id: r for r in cotraining.score(documents, model).collect()}
    rows = [r for r in labels.collect() if got[r.doc_id].held_out]
    assert auc([got[r.doc_id].score for r in rows], [r.quality for r in rows]) >= 0.93
    assert np.mean([got[r.doc_id].predicted == r.quality for r in rows]) >= 0.95


def test_sure_labels_pass_from_view_to_view():
    random = np.random.default_rng(3)
    y = (random.random(1000) < 0.5).astype(float)
    a = y[:, None] * 3 + random.normal(size=(1000, 3))
    b = y[:, None] * 1 + random.normal(size=(1000, 3))
    few = slice(0, 60)
    model = cotraining.co_train((a[few], b[few]), y[few], (a[60:], b[60:]))
    assert any(n for n, _ in model.taken)
    text, metadata, both = model.scores(a[60:], b[60:])
    assert auc(both, y[60:]) >= max(auc(text, y[60:]), auc(metadata, y[60:])) - 0.01


def test_quality_of_odd_rows(spark, documents, labels):
    model = cotraining.fit(documents, labels)
    odd = spark.createDataFrame([*ODD, (8, "word " * 100_000, "en", "s", 500_000, 0)], SCHEMA)
    got = cotraining.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert cotraining.score(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_quality_without_two_classes(spark, documents):
    schema = "doc_id long, quality int, toxic int"
    assert cotraining.fit(documents, spark.createDataFrame([], schema)) == 0.0
    good = cotraining.fit(documents, spark.createDataFrame([(i, 1, 0) for i in range(50)], schema))
    assert good == 1.0
    assert {r.score for r in cotraining.score(spark.createDataFrame(ODD, SCHEMA), good).collect()} == {1.0}
