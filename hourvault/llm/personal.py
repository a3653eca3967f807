"""Personal data: fixed patterns as seeds, and contexts learned from them (operator 13).

Seeds are e-mail addresses, IP addresses, card numbers and phone numbers in the
fixed forms below, each checked (parts up to 255, Luhn's rule, numbers of digits).
They say which words stand around such data. Bootstrapping goes on from there:

- *Instances* are the values of the seeds and, without a kind, of all other
  identifier-like words: those with at least `DIGITS` digits, trimmed of
  punctuation, number groups beside each other taken as one.
- *Patterns* are the words around an instance: the word before it, the two words
  before it, the words before and after it.
- Patterns and instances that occur together form a graph, which Spark scores in
  rounds. A pattern's confidence for a kind is the sum of its instances' scores
  for the kind, over all its instances and one; only patterns with enough
  evidence and confidence count. An instance without a kind is as sure as any of
  its patterns being right; those sure enough join the instances of the kind,
  and so make further patterns confident in the next round.

Every place of an accepted value is reported, beside the seeds, which all stay.
Values count once in a pattern however often they occur, so copies of a document
add no evidence.

One pass over whole texts writes the spans of each row; the rounds read only
these. Sums are partial before they are shuffled; the accepted values and
confident patterns are broadcast when they are small.

Defined cases: a null or empty text has no spans. Repeated rows, and rows of one
key or without one, are each read on their own. Positions are code points.
Words of over `WORD` code points are no context. Other columns play no part. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourvault.llm import stored
from hourvault.llm.flat import byte_set, flat_bytes, small_batches, spans
from hourvault.session import broadcast_if_small

KINDS = ("email", "ip", "card", "phone")
#: Digits of a word that may be an identifier, code points of a word that may be context, of a value kept as text.
DIGITS = 4
WORD = 40
VALUE = 80

_LOCAL = byte_set((48, 57), (65, 90), (97, 122), *[(ord(c), ord(c)) for c in "._%+-"])
_DIGIT = byte_set((48, 57))
_SPACE = byte_set((9, 13), (32, 32))
#: All signs that an IP address, a card or a phone number may have.
_NUMBER = byte_set((48, 57), *[(ord(c), ord(c)) for c in " .()+-"])

# The forms of the four kinds. A group of digits is never left half read, so
# that a match begins at a group's start and long runs of digits are read once.
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")

_GROUPS = re.compile(rb"[0-9()./+-]+")
_TRIMMED = "".join(map(chr, range(33, 48))) + ":;<=>?[\\]^_`{|}~"
_MARKS = ".,;:!?\"'[]{}<>*#%&$=|".encode()

Span = tuple[int, int, int]  # start, kind, end: in order, as they are listed


@dataclass(frozen=True)
class Bootstrap:
    """Rounds, evidence (sum of scores) and confidence a pattern needs, score an instance needs."""

    rounds: int = 3
    evidence: float = 5.0
    confidence: float = 0.8
    accepted: float = 0.9


# --------------------------------------------------------------------- seeds


def luhn(digits: bytes) -> bool:
    values = [d - 48 for d in digits[::-1]]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _digits(text: bytes) -> bytes:
    return bytes(c for c in text if 48 <= c <= 57)


def _small_parts(text: bytes) -> bool:
    return all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in text.split(b"."))


def _is_card(text: bytes) -> bool:
    # Between two digits stands one sign at most.
    return len(text) <= 37 and 14 <= len(digits := _digits(text)) <= 19 and luhn(digits)


def _is_phone(text: bytes) -> bool:
    return 10 <= sum(48 <= c <= 57 for c in text) <= 15


_NUMBERS = ((1, _IP, _small_parts), (2, _CARD, _is_card), (3, _PHONE, _is_phone))


class Batch:
    """Seeds and other identifier-like words of a batch of texts, as byte ranges of the batch."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = flat_bytes(column)
        self.raw = self.data.tobytes()
        self.digits = np.concatenate([[0], np.cumsum(_DIGIT[self.data])])
        self.points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        self.words = spans(~_SPACE[self.data], self.offsets)

    def text_of(self, at: int) -> int:
        return int(np.searchsorted(self.offsets, at, side="right")) - 1

    def seeds(self) -> list[Span]:
        found = [*self._emails(), *self._numbers()]
        return sorted(found)

    def _emails(self) -> Iterator[Span]:
        ats = np.flatnonzero(self.data == 64)
        if not len(ats):
            return
        stops = np.flatnonzero(~_LOCAL[self.data])
        before = np.searchsorted(stops, ats) - 1
        last = 0
        for at, stop in zip(ats.tolist(), before.tolist(), strict=True):
            doc = self.text_of(at)
            start = max(last, int(self.offsets[doc]), int(stops[stop]) + 1 if stop >= 0 else 0)
            domain = _DOMAIN.match(self.raw, at + 1, int(self.offsets[doc + 1])) if start < at else None
            if domain:
                last = domain.end()
                yield start, 0, last

    def _numbers(self) -> Iterator[Span]:
        starts, ends = spans(_NUMBER[self.data], self.offsets)
        some = self.digits[ends] - self.digits[starts] >= 4
        for start, end in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
            for kind, form, holds in _NUMBERS:
                for match in form.finditer(self.raw[start:end]):
                    if holds(match.group()):
                        yield start + match.start(), kind, start + match.end()

    def others(self, seeds: list[Span]) -> list[tuple[int, int]]:
        """Identifier-like words that no seed touches."""
        starts, ends = self.words
        some = np.flatnonzero(self.digits[ends] - self.digits[starts] >= 1)
        found: list[list[int]] = []
        last = None
        for i in some.tolist():
            start, end = int(starts[i]), int(ends[i])
            while start < end and self.raw[start] in _MARKS:
                start += 1
            while end > start and self.raw[end - 1] in _MARKS:
                end -= 1
            number = _GROUPS.fullmatch(self.raw, start, end) is not None
            # Groups of one number: both only of digits and their marks, one blank between them.
            if number and last == i - 1 and start == found[-1][1] + 1 and self.raw[start - 1] == 32:
                found[-1][1] = end
            else:
                found.append([start, end])
            last = i if number else None
        taken = sorted((a, b) for a, _, b in seeds)
        begins = np.array([a for a, _ in taken], np.int64)
        reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else begins
        kept = []
        for start, end in found:
            if self.digits[end] - self.digits[start] < DIGITS:
                continue
            before = int(np.searchsorted(begins, end)) - 1
            if before < 0 or reach[before] <= start:
                kept.append((start, end))
        return kept

    def _word(self, start: int, end: int) -> str | None:
        """A context word: lower case, without marks, its digits alike; None if it is too long."""
        if self.points[end] - self.points[start] > WORD:
            return None
        word = self.raw[start:end].decode().lower()
        return re.sub("[0-9]", "0", word.strip(_TRIMMED) or word)

    def patterns(self, start: int, end: int) -> list[str]:
        """The contexts of a range of bytes."""
        starts, ends = self.words
        doc = self.text_of(start)
        low, high = int(self.offsets[doc]), int(self.offsets[doc + 1])
        first = int(np.searchsorted(starts, start, side="right")) - 1
        before: list[str | None] = []
        # What stands before the instance in its own word, if there is a letter or digit in it.
        if starts[first] < start and self.raw[starts[first] : start].decode().strip(_TRIMMED):
            before.append(self._word(int(starts[first]), start))
        i = first - 1
        while len(before) < 2:
            if i < 0 or starts[i] < low:
                before.append("^")
            else:
                before.append(self._word(int(starts[i]), int(ends[i])))
                i -= 1
        last = int(np.searchsorted(starts, end - 1, side="right"))
        after = self._word(int(starts[last]), int(ends[last])) if last < len(starts) and starts[last] < high else "$"
        one, two = before[:2]
        if one is None or one == "^":
            return []
        found = [f"{one} _"]
        if two is not None:
            found.append(f"{two} {one} _")
        if after is not None:
            found.append(f"{one} _ {after}")
        return found

    def value(self, start: int, end: int) -> str:
        text = self.raw[start:end].decode().lower()
        return text if len(text) <= VALUE else hashlib.sha256(text.encode()).hexdigest()


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_MENTION = pa.struct(
    [("value", pa.string()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.string()))]
)
_SPANS_SQL = "array<struct<start: long, kind: int, end: long>>"
_MENTIONS_SQL = "array<struct<value: string, kind: int, start: long, end: long, patterns: array<string>>>"


def read_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: row (a number of its own), doc_id, seeds, mentions (seeds and identifier-like words in context)."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind_of_key = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for table in small_batches(batches, "text"):
            batch = Batch(table.column("text"))
            seeds: list[list[dict]] = [[] for _ in range(table.num_rows)]
            mentions: list[list[dict]] = [[] for _ in range(table.num_rows)]
            found = batch.seeds()
            for start, kind, end in [*found, *((a, None, b) for a, b in batch.others(found))]:
                doc = batch.text_of(start)
                zero = batch.points[batch.offsets[doc]]
                at = {"start": int(batch.points[start] - zero), "kind": kind, "end": int(batch.points[end] - zero)}
                if kind is not None:
                    seeds[doc].append(at)
                mentions[doc].append({**at, "value": batch.value(start, end), "patterns": batch.patterns(start, end)})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(number, number + table.num_rows)), table.column("doc_id"),
                    pa.array(seeds, pa.list_(_SPAN)), pa.array(mentions, pa.list_(_MENTION)),
                ],
                ["row", "doc_id", "seeds", "mentions"],
            )
            number += table.num_rows

    return rows.mapInArrow(run, f"row long, doc_id {kind_of_key}, seeds {_SPANS_SQL}, mentions {_MENTIONS_SQL}")


# -------------------------------------------------------------------- rounds


def confident_patterns(edges: DataFrame, accepted: DataFrame | None, rule: Bootstrap) -> DataFrame:
    """pattern, kind, confidence of the patterns that count, from `edges` (pattern, value, kind) and values accepted so far."""
    score = F.when(F.col("kind").isNotNull(), 1.0)
    kind = F.col("kind")
    if accepted is not None:
        small, _ = broadcast_if_small(accepted.select("value", F.col("kind").alias("found"), F.col("score").alias("found_score")))
        edges = edges.join(small, "value", "left")
        score, kind = F.coalesce(score, F.col("found_score")), F.coalesce("kind", "found")
    totals = edges.groupBy("pattern").agg(
        F.count("*").alias("instances"),
        *[F.round(F.sum(F.when(kind == k, score).otherwise(0.0)), 6).alias(f"_{k}") for k in range(len(KINDS))],
    )
    best = F.greatest(*[F.struct(F.col(f"_{k}").alias("evidence"), F.lit(-k).alias("less")) for k in range(len(KINDS))])
    return (
        totals.withColumn("_best", best)
        .select(
            "pattern", (-F.col("_best.less")).alias("kind"), F.col("_best.evidence").alias("evidence"),
            (F.col("_best.evidence") / (F.col("instances") + 1)).alias("confidence"),
        )
        .where((F.col("evidence") >= rule.evidence) & (F.col("confidence") >= rule.confidence))
        .select("pattern", "kind", "confidence")
    )


def accepted_values(edges: DataFrame, patterns: DataFrame, rule: Bootstrap) -> DataFrame:
    """value, kind, score of the values without a kind that confident patterns make sure enough."""
    small, _ = broadcast_if_small(patterns.select("pattern", F.col("kind").alias("_kind"), "confidence"))
    doubt = F.exp(F.sum(F.log1p(-F.col("confidence"))))
    scored = (
        edges.where(F.col("kind").isNull()).join(small, "pattern").groupBy("value", "_kind")
        .agg(F.round(1 - doubt, 6).alias("score"))
    )
    best = F.max(F.struct("score", (-F.col("_kind")).alias("less"))).alias("best")
    return (
        scored.groupBy("value").agg(best)
        .select("value", (-F.col("best.less")).alias("kind"), F.col("best.score").alias("score"))
        .where(F.col("score") >= rule.accepted)
    )


def bootstrap(mentions: DataFrame, rule: Bootstrap = Bootstrap()) -> DataFrame:
    """value, kind, score: the values that are no seed anywhere they stand, but are taken for a kind by their contexts."""
    edges = stored.written(
        mentions.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.min("kind").alias("kind")),
        "pattern_edges",
    )
    accepted, n = None, 0
    for _ in range(rule.rounds):
        patterns = stored.written(confident_patterns(edges, accepted, rule), "patterns")
        accepted = stored.written(accepted_values(edges, patterns, rule), "accepted")
        before, n = n, accepted.count()
        if n == before:
            break
    return accepted


def _listed(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    name = F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(name, ",")


def find_personal(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Bootstrap = Bootstrap()) -> DataFrame:
    """Per row: doc_id, seeds and spans (arrays of start, kind, end), the latter with those found by context."""
    rows = stored.written(read_spans(df, key, text), "spans")
    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    small, _ = broadcast_if_small(bootstrap(mentions, rule).select("value", F.col("kind").alias("_kind")))
    more = mentions.where(F.col("kind").isNull()).join(small, "value")
    more = more.groupBy("row").agg(F.collect_list(F.struct("start", F.col("_kind").alias("kind"), "end")).alias("more"))
    spans_of = F.array_sort(F.concat("seeds", F.coalesce("more", F.array().cast(_SPANS_SQL))))
    return rows.drop("mentions").join(more, "row", "left").select("doc_id", "seeds", spans_of.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Numbers of seeds by kind, their digest, and the list of all spans."""
    def count(kind: int) -> Column:
        return F.size(F.filter("seeds", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    digest = F.sha2(_listed(F.col("seeds")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, _listed(F.col("spans")).alias("spans"))
