from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from hourvault.llm import decontaminate, jaccard, language, stored, toxicity

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_each_stage_does_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "labels"))
    kept = [sorted(r.doc_id for r in docs.collect())]
    expected = [
        lambda d: {r.doc_id for r in language.identify(d, language.fit(d)).collect() if r.lang_pred != "und" and r.score >= 0.3},
        lambda d: {r.doc_id for r in toxicity.score(d, toxicity.fit(d, labels)).collect() if not r.predicted},
        lambda d: {r.doc_id for r in jaccard.similarity_classes(d, similarity=corpus_pipeline.NEAR)[0].collect() if r.doc_id == r.component_id},
        lambda d: {r.doc_id for r in decontaminate.find_leaks(d, benchmark).collect() if not r.contaminated},
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected, strict=False):
        before = docs
        docs = stored.written(stage(spark, before, SF), name)
        assert docs.columns == before.columns
        kept.append(sorted(r.doc_id for r in docs.collect()))
        assert kept[-1] == sorted(want(before)), name
    assert len(kept[-1]) < len(kept[0])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted({r.doc_id for r in pieces}) == kept[-1]


def test_near_copies_between_the_thresholds_of_the_operator_and_the_stage_go(spark):
    # 51 words, one inner word changed: 42 of 52 common 5-word n-grams, 44 of 52 common 4-word ones (0.808, 0.846).
    text = [f"w{i}" for i in range(51)]
    longer = [f"v{i}" for i in range(120)]  # 116 of 141 and 117 of 142 after 25 words more: 0.823 and 0.824
    far = [f"u{i}" for i in range(120)]  # 116 of 146 after 30 words more: 0.795
    texts = [text, [*text[:25], "x", *text[26:]], longer, [*longer, *(f"y{i}" for i in range(25))], far, [*far, *(f"z{i}" for i in range(30))]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in jaccard.similarity_classes(df)[0].collect() if r.doc_id == r.component_id} == set(range(6))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()) == [0, 2, 4, 5]


def test_empty_documents_pass_through(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("hidden, there", [(["hourvault.llm", "corpus_pipeline"], False), ([], True)])
def test_entry_without_this_folder(hidden, there):
    code = f"import sys; [sys.modules.__setitem__(m, None) for m in {hidden!r}]; import __spark_entry__ as e; q = e.queries(); " \
        "print('pipeline' in q, sum(n.startswith('op') for n in q), 'search_newest' in q, set(e.oracle_sql()) <= set(q))"  # fmt: skip
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert done.stdout.split()[-4:] == [str(there), "13" if there else "0", "True", "True"]
