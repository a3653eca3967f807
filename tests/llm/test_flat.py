from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from hourvault.llm import flat, tokens

TEXTS = [
    "one two  two", "", None, "\tlead\r\ntrail \x0b\x0c", "é à 日本 語", "x" * 300, "A a", " ", "two", "a\x1cb", "ab" * 200 + " " + "ab" * 200,
]
ODD = [
    *(t or "" for t in TEXTS), "a  b", "x\xa0 y", "it's  'tis we've.'s \n\n x\t\ty", "a<|endoftext|>b", "\x1c \x1d a\x85 b", "½ ¾ x",
    "3.14 1,000!x'll 's", "　 z", "… ! x", "a_b-c--d 'quoted' \r\n", "don't''s O'S", "a  b", "\U0001f600 smile!!", "a|b || c",
]


def test_words_are_those_of_the_pattern_and_equal_words_have_equal_hashes():
    data, offsets = flat.flat_bytes(pa.array(TEXTS))
    words = flat.Words(data, offsets, ~flat.byte_set((9, 13), (32, 32)))
    expected = [re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in TEXTS]
    got = [
        [words.data[a:b].tobytes() for a, b in zip(words.start[i:j], words.end[i:j], strict=True)]
        for i, j in zip(words.first[:-1], words.first[1:], strict=True)
    ]
    assert got == expected
    by_word: dict[bytes, set[int]] = {}
    for word, value in zip((w for row in got for w in row), words.hash.tolist(), strict=True):
        by_word.setdefault(word, set()).add(value)
    assert all(len(v) == 1 for v in by_word.values())
    assert len({v for s in by_word.values() for v in s}) == len(by_word)


def test_sliced_arrays_and_chunks_keep_their_own_bytes():
    whole = pa.chunked_array([pa.array(["ab", "c"]), pa.array([None, "def"])])
    data, offsets = flat.flat_bytes(whole.slice(1, 3))
    assert data.tobytes() == b"cdef" and offsets.tolist() == [0, 1, 1, 4]


def test_small_batches_keep_all_rows_in_order():
    texts = ["x" * n for n in (0, 5, 100, 1, 0, 0, 30, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    parts = list(flat.small_batches(iter([batch, batch.slice(0, 0)]), "t", 20))
    assert [x for p in parts for x in p.column("t").to_pylist()] == texts
    assert all(sum(map(len, p.column("t").to_pylist())) <= 20 or p.num_rows == 1 for p in parts)


@pytest.mark.parametrize("most", [4, 64, 1 << 12])
def test_ids_by_pieces_are_the_ids_of_the_whole_text(most):
    encoder = tokens.Encoder(tokens.default_tokenizer(), most)
    for texts in (ODD, ["", ""], [], ODD[::-1], [" ".join(ODD)]):
        ids, bounds = encoder.encode(*flat.flat_bytes(pa.array(texts, pa.string())))
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert len(bounds) == 2


def test_ids_of_random_texts():
    random = np.random.default_rng(1)
    alphabet = list("ab Z9'.,!|\n\t\xa0é 日<>") + ["'s", "  ", "ing "]
    texts = ["".join(random.choice(alphabet, 30)) for _ in range(400)]
    encoder = tokens.Encoder(tokens.default_tokenizer(), 1 << 12)
    ids, bounds = encoder.encode(*flat.flat_bytes(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_written_tables_can_be_cleaned(spark):
    from hourvault.llm import stored

    stored.clean(spark)
    table = stored.written(spark.range(5).toDF("n"), "numbers")
    path = stored._TABLES[0]
    assert table.count() == 5 and stored.clean(spark) == 1
    from hourvault.sources.storage import exists

    assert not exists(spark, path) and stored.clean(spark) == 0
