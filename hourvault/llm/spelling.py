"""Spelling variants: words at edit distance 1, found by variable-length grams (operator 12).

Words and their counts come from one pass over whole texts. Near words are then
found among the distinct words, through an index of variable-length grams:

- *Dictionary.* Grams of 2 to 6 code points are counted over all words (a sign
  for the end of the word included), and only those that occur more often than
  a threshold are kept. The threshold grows with the words, so that the
  dictionary has a fixed greatest size.
- *Decomposition.* From each place of a word, the gram is the shortest one that
  is not in the dictionary, or the longest possible. Such grams are the leaves
  of a trie cut off where grams get rare: which gram begins at a place depends
  on the gram's own signs alone, so an edit changes no gram but those around it.
  Frequent beginnings get long grams, and most lists of words by gram stay short.
- *Affected grams.* An edit changes only the grams that span its place; how many at
  most is bounded for each word, and a word has more grams than that. Put all
  grams in one order, the rare first: for each place of an edit, the first gram
  that it leaves is the same one in both words. Only the lists of these first
  grams are read; the longer ones, of frequent grams, are skipped.
- *Merging.* A gram that is left has the same place from the start (an edit after
  it) or from the end of the word (an edit before it). Lists are by gram and
  place; the words of a list meet, and each pair is verified by its edit distance.

Lists with more than `LIST_WORDS` words are split further: by the word without the
sign at the place of the edit for which it is in the list (or the whole word, for a
sign put in), which a near pair has in common too. Words that share all of that
differ by an inserted sign each, so there are no more of them than the alphabet and
their length allow, however the words look. Nothing is left out either way.

Defined cases: a null text has no words, a null key hashes as the empty text.
Repeated rows count each on its own, and those of one key lose the same signs.
Other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourvault.llm import stored
from hourvault.llm.flat import LOWER, U64, byte_set, flat_bytes, mix, small_batches, span_hashes, spans

#: Grams in the dictionary at most, and the least frequency above which a gram is in it.
DICTIONARY_GRAMS = 1 << 20
LEAST_FREQUENCY = 64
#: Words of a list whose pairs are looked at one by one.
LIST_WORDS = 256
#: Bytes of words that a task cuts into grams at once.
BATCH_BYTES = 1 << 19
#: Distinct words a task keeps counts of before it passes them on.
TASK_WORDS = 200_000

_ASCII = byte_set((65, 90), (97, 122))
#: The first byte, in UTF-8, of all code points from U+00C0 to U+00FF.
_LATIN = 0xC3
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
_CRC_STEPS = 48


@dataclass(frozen=True)
class Spelling:
    """Least code points and occurrences of a word; a run in `noise` loses a sign; how much more frequent a form is."""

    letters: int = 7
    occurrences: int = 2
    noise: int | None = 31
    ratio: int = 10
    shortest: int = 2
    longest: int = 6

    def __post_init__(self):
        # A word of the least length must keep a gram whatever one edit does.
        if not 1 < self.shortest <= self.longest < self.letters + 2 - self.shortest:
            raise ValueError("grams are too long for the shortest words")


# -------------------------------------------------------------------- counts


def continued_crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span of bytes, continued from the crc32 of what stands before it."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    start, length = starts[order], lengths[order]
    for step in range(min(_CRC_STEPS, int(length[0]) if len(length) else 0)):
        n = int(np.searchsorted(-length, -step, side="left"))
        state[:n] = _CRC[(state[:n] ^ data[start[:n] + step]) & 0xFF] ^ (state[:n] >> 8)
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > _CRC_STEPS).tolist():
        state[i] = zlib.crc32(data[start[i] + _CRC_STEPS : start[i] + length[i]].tobytes(), int(state[i]))
    out = np.empty(len(state), np.uint32)
    out[order] = state
    return out


def _batch_words(column: pa.Array, keys: list[str | None], rule: Spelling) -> tuple[list[bytes], list[int]]:
    """Words of a batch of texts with their counts; a word may be listed twice."""
    data, offsets = flat_bytes(column)
    data = LOWER[data]
    letter = _ASCII[data] | (data == _LATIN)
    letter[1:] |= data[:-1] == _LATIN
    starts, ends = spans(letter, offsets)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = points[ends] - points[starts] >= rule.letters
    starts, ends = starts[long], ends[long]
    length = points[ends] - points[starts]
    words, counts = [], []
    lost = np.zeros(len(starts), bool)
    if rule.noise is not None:
        before = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys], np.uint32)
        h = continued_crc(data, starts, ends, before[np.searchsorted(offsets, starts, side="right") - 1]).astype(np.int64)
        lost = h % rule.noise == 0
        for i in np.flatnonzero(lost & (length > rule.letters)).tolist():
            word = data[starts[i] : ends[i]].tobytes().decode()
            at = int(h[i] % length[i])
            words.append((word[:at] + word[at + 1 :]).encode())
            counts.append(1)
    starts, ends = starts[~lost], ends[~lost]
    _, first, n = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
    words += [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return words, counts + n.tolist()


def word_counts(df: DataFrame, key: str, text: str, rule: Spelling) -> DataFrame:
    """word, n of all words with enough signs and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in small_batches(batches, "text"):
            words, counts = _batch_words(batch.column("text"), batch.column("key").to_pylist(), rule)
            for word, n in zip(words, counts, strict=True):
                held[word] = held.get(word, 0) + n
            if len(held) > TASK_WORDS:
                yield out()
                held = {}
        if held:
            yield out()

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    found = rows.where(F.col("text").isNotNull()).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rule.occurrences)


# --------------------------------------------------------------------- grams


def _once(word: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (word, list) once."""
    order = np.lexsort((lists, word))
    word, lists = word[order], lists[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (lists[1:] != lists[:-1])
    return word[new], lists[new].view(np.int64)


class Grams:
    """Code points of a batch of words, each followed by the end sign 0, and hashes of all their grams."""

    def __init__(self, words: list[str], rule: Spelling):
        self.rule = rule
        self.length = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length + 1)])
        signs = "\0".join(words) + "\0"
        self.signs = np.frombuffer(signs.encode("utf-32-le"), np.uint32).astype(U64)
        self.word = np.repeat(np.arange(len(words)), self.length + 1)
        self.place = np.arange(len(self.signs)) - self.first[self.word]
        #: Signs from each place to the end of its word, the end sign included.
        self.room = self.length[self.word] + 1 - self.place

    def hashes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each gram length: places where such a gram begins, and its hash."""
        hashed = np.zeros(len(self.signs), U64)
        for size in range(1, self.rule.longest + 1):
            at = np.flatnonzero(self.room >= size)
            hashed[at] = mix(hashed[at] ^ (self.signs[at + size - 1] + U64(size << 32)))
            if size >= self.rule.shortest:
                yield size, at, hashed[at]

    def decompose(self, dictionary: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places, lengths, hashes of the words' grams, and their frequencies (0 if not in the dictionary)."""
        size_at = np.zeros(len(self.signs), np.int64)
        hash_at, often = np.zeros(len(self.signs), U64), np.zeros(len(self.signs), np.int64)
        for size, at, hashed in self.hashes():
            if size > self.rule.shortest:  # only frequent grams grow
                on = often[at] > 0
                at, hashed = at[on], hashed[on]
            slot = np.searchsorted(dictionary, hashed)
            slot[slot == len(dictionary)] = 0
            known = dictionary[slot] == hashed if len(dictionary) else np.zeros(len(at), bool)
            size_at[at], hash_at[at] = size, hashed
            often[at] = np.where(known, frequency[slot] if len(dictionary) else 0, 0)
        at = np.flatnonzero(size_at)
        return at, size_at[at], hash_at[at], often[at]

    def affected(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each word, the most grams that one edit can change: those that span one sign."""
        change = np.zeros(len(self.signs) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
        return np.maximum.reduceat(np.cumsum(change[:-1]), self.first[:-1])

    def edits(self, dictionary: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, between, list) of all edits of the words; `between` where a sign is put in before that place.

        The list is the rarest gram that the edit leaves, at its place from the start or the end of the word.
        """
        at, size, hashed, often = self.decompose(dictionary, frequency)
        order = np.lexsort((at, hashed, often, self.word[at]))
        at, size, hashed = at[order], size[order], hashed[order]
        begin = np.searchsorted(self.word[at], np.arange(len(self.length)))
        inside = np.flatnonzero(self.room > 1)
        places = np.concatenate([inside, np.arange(len(self.signs))])
        between = np.arange(len(places)) >= len(inside)
        lists = np.zeros(len(places), U64)
        todo, tried = np.arange(len(places)), 0
        # An edit leaves one of the first `affected` and one more grams.
        while len(todo):
            place = places[todo]
            gram = begin[self.word[place]] + tried
            start, word = at[gram], self.word[place]
            before = start + size[gram] <= place
            left = before | (start > place) | (between[todo] & (start == place))
            from_start = mix(2 * self.place[start])
            from_end = mix(2 * (self.length[word] - self.place[start]) + 1)
            found = mix(hashed[gram] ^ np.where(before, from_start, from_end))
            lists[todo[left]] = found[left]
            todo = todo[~left]
            tried += 1
        return places, between, lists

    def postings(self, dictionary: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, list) of the lists each word is in, once each."""
        places, _, lists = self.edits(dictionary, frequency)
        return _once(self.word[places], lists)

    def rests(self, own: np.ndarray, dictionary: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, finer list) for the edits that put each word in its `own` list: that list, and what the edit leaves of the word."""
        places, between, lists = self.edits(dictionary, frequency)
        kept = lists == own[self.word[places]]
        places, between, lists = places[kept], between[kept], lists[kept]
        powers = np.cumprod(np.full(int(self.length.max()) + 1, _BASE), dtype=U64)
        values = np.where(self.room > 1, mix(self.signs) * powers[self.place], U64(0))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
        word = self.word[places]
        first, end = sums[self.first[word]], sums[self.first[word + 1]]
        without = (sums[places] - first) + (end - sums[places + 1]) * _INVERSE
        finer = mix(mix(np.where(between, end - first, without)) ^ lists)
        return _once(word, finer)


def build_dictionary(words: DataFrame, rule: Spelling, frequency: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the frequent grams, in order, and how often each occurs; at most DICTIONARY_GRAMS."""
    if frequency is None:
        signs = words.agg(F.sum(F.length("word") + 1)).head()[0] or 0
        grams = signs * (rule.longest - rule.shortest + 1)
        frequency = max(LEAST_FREQUENCY, -(-grams // DICTIONARY_GRAMS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "word"):
            grams = Grams(batch.column("word").to_pylist(), rule)
            found, n = np.unique(np.concatenate([h for _, _, h in grams.hashes()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

    counted = words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n") > frequency).toPandas()
    hashes = kept["gram"].to_numpy(np.int64).view(U64)
    order = np.argsort(hashes)
    return hashes[order], kept["n"].to_numpy(np.int64)[order]


# --------------------------------------------------------------------- pairs


def _lists(words: DataFrame, rule: Spelling, dictionary) -> DataFrame:
    """list, word, n: each word in the lists it is to be met in; `dictionary` is a broadcast of the frequent grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "word", BATCH_BYTES):
            word, place = Grams(batch.column("word").to_pylist(), rule).postings(*dictionary.value)
            rows = batch.take(pa.array(word))
            yield pa.RecordBatch.from_arrays([pa.array(place), *rows.columns], ["list", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "list long, word string, n long")


def _split(lists: DataFrame, rule: Spelling, dictionary) -> DataFrame:
    """list, word, n: words of long lists in finer ones, by what their edits leave of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "word", BATCH_BYTES):
            own = batch.column("list").to_numpy().view(U64)
            word, finer = Grams(batch.column("word").to_pylist(), rule).rests(own, *dictionary.value)
            rows = batch.select(["word", "n"]).take(pa.array(word))
            yield pa.RecordBatch.from_arrays([pa.array(finer), *rows.columns], ["list", "word", "n"])

    return lists.mapInArrow(run, "list long, word string, n long")


def _verified(lists: DataFrame) -> DataFrame:
    """Pairs of words in one list whose edit distance is 1."""
    a = lists.select("list", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = lists.select("list", F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, "list").where(near).select("a", "a_n", "b", "b_n")


def near_words(
    words: DataFrame, rule: Spelling = Spelling(), list_words: int = LIST_WORDS, frequency: int | None = None
) -> DataFrame:
    """Pairs a < b of words (`word`, `n`; distinct) at edit distance 1, with their counts: a, a_n, b, b_n."""
    dictionary = words.sparkSession.sparkContext.broadcast(build_dictionary(words, rule, frequency))
    lists = stored.written(_lists(words, rule, dictionary), "gram_lists")
    sizes = lists.groupBy("list").agg(F.count("*").alias("size"))
    long = sizes.where(F.col("size") > list_words).select("list")
    short = sizes.where(F.col("size").between(2, list_words)).select("list")
    finer = _split(lists.join(long, "list", "left_semi"), rule, dictionary)
    pairs = _verified(lists.join(short, "list", "left_semi")).unionByName(_verified(finer))
    return pairs.distinct()


def variants(
    df: DataFrame, key: str = "doc_id", text: str = "text", rule: Spelling = Spelling(), **options
) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = stored.written(word_counts(df, key, text, rule), "words")
    pairs = stored.written(near_words(words, rule, **options), "near_words")
    either = pairs.unionByName(pairs.selectExpr("b AS a", "b_n AS a_n", "a AS b", "a_n AS b_n"))
    best = F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best")
    near = either.groupBy("a", "a_n").agg(F.count("*").alias("n_near"), best).select(
        F.col("a").alias("word"), "n_near",
        F.when(-F.col("best.less") >= rule.ratio * F.col("a_n"), F.col("best.b")).alias("form"),
        F.when(-F.col("best.less") >= rule.ratio * F.col("a_n"), -F.col("best.less")).alias("form_n"),
    )
    near = stored.written(near, "forms")
    most = words.agg(F.max("n")).head()[0] or 0
    found = words.join(near, "word", "left").join(roots(near.where("form IS NOT NULL"), most, rule), "word", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"
    )


def roots(forms: DataFrame, most: int, rule: Spelling) -> DataFrame:
    """word, root of the words that have a form: the end of the chain of forms.

    Counts grow by `ratio` at each step, so no chain has more steps than that
    allows; each round doubles the steps taken.
    """
    steps = 1 + int(math.log(max(most, 1), rule.ratio))
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps.bit_length()):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        found = stored.written(
            found.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots"
        )
    return found
