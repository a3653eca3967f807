"""Fill-in-middle texts, cut by an indexable skip list (operator 11).

A text is a sequence of units: code points, or the matches of a regular
expression, taken from left to right. Both cuts are ranks, numbers of units; a
rank's place in the text is found by an indexable skip list. Its lowest lane
holds every unit, and each higher lane about one in eight of the lane below.
A link carries two widths, the units and the code points it passes over. From
the highest lane down, a search follows links while the units passed stay
within the rank, adds up both widths, and so ends at the rank exactly, with
the place in code points at hand. Where a unit is one code point, both widths
are equal and the lowest lane need not be stored.

The ranks and the form come from the hex sha256 of `<seed>:<key>`, whose first
four groups of 8 digits are read as h1 to h4: the prefix ends after the smaller
of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger; h3 decides
whether the text is transformed, h4 in which order. So a row's result depends on
nothing but the row.

- `plain`: the text as it is
- `psm`: `<P>` prefix `<S>` suffix `<M>` middle
- `spm`: `<S>` suffix `<P>` prefix `<M>` middle

The whole text is rebuilt from output and form alone: a text that holds a
marker stays plain, and as no marker's first sign occurs again inside a marker,
none can arise where parts meet. Texts are read once and not shuffled.

Defined cases: a null text counts as empty; an empty text is plain, with no
part lengths. A null key hashes as the empty text. Repeated rows, and rows of
one key, are transformed each on its own; equal rows alike. Other columns of the
table play no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourvault.llm.flat import U64, mix, small_batches

#: The base-2 logarithm of how many nodes of a lane go by one node of the next.
LANE_BITS = 3
#: Ranks whose heights are drawn at once, so that a very long text needs no large work arrays.
HEIGHT_ROWS = 1 << 20


class SkipList:
    """Units of one text behind lanes of links, each with its width in units and in code points."""

    def __init__(self, units: int, points: np.ndarray | None = None):
        """`points` holds the code points of each unit; None if each is one."""
        self.units = units
        self.ends = None if points is None else np.concatenate([[0], np.cumsum(points, dtype=np.int64)])
        # Lane k holds the ranks of its nodes, from the head to the end of the list, the place of
        # each in code points, and the place of each among the nodes of the lane below.
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ranks, heights = self._draw()
        below, kept_heights = None, heights
        level = 1
        while len(ranks):
            nodes = np.concatenate([[0], ranks, [units]])
            down = nodes if below is None else np.searchsorted(below, nodes)
            units_wide = np.diff(nodes)
            points_wide = units_wide if self.ends is None else np.diff(self.ends[nodes])
            self.lanes.append((units_wide, points_wide, down))
            below = nodes
            level += 1
            on = kept_heights >= level
            ranks, kept_heights = ranks[on], kept_heights[on]

    def _draw(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranks that rise above the lowest lane, and how many lanes each is in; a fixed draw by rank."""
        ranks, heights = [], []
        mask = U64((1 << LANE_BITS) - 1)
        for first in range(1, self.units, HEIGHT_ROWS):
            rank = np.arange(first, min(self.units, first + HEIGHT_ROWS), dtype=np.int64)
            draw = mix(rank)
            up = np.flatnonzero((draw & mask) == 0)
            rank, draw = rank[up], draw[up]
            height = np.zeros(len(rank), np.int64)
            on = np.ones(len(rank), bool)
            while on.any():
                height += on
                draw >>= U64(LANE_BITS)
                on &= (draw & mask) == 0
                on &= draw != 0
            ranks.append(rank)
            heights.append(height)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *ranks]), np.concatenate([none, *heights])

    def place(self, rank: int) -> int:
        """Code points before the unit of this rank (all of them for the rank after the last)."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        at, units, points = 0, 0, 0
        for units_wide, points_wide, down in reversed(self.lanes):
            while at < len(units_wide) and units + units_wide[at] <= rank:
                units += int(units_wide[at])
                points += int(points_wide[at])
                at += 1
            at = int(down[at])
        # The lowest lane: a link for each unit.
        while units < rank:
            points += 1 if self.ends is None else int(self.ends[units + 1] - self.ends[units])
            units += 1
        return points


@dataclass(frozen=True)
class Rule:
    """How texts are transformed: seed, markers, shares in percent, and what a unit is (None: a code point)."""

    seed: str = "1"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    transformed: int = 90
    suffix_first: int = 20
    unit: str | None = None

    def __post_init__(self):
        markers = (self.prefix, self.suffix, self.middle)
        if len(set(markers)) < 3 or any(not m or m[0] in other[1:] for m in markers for other in markers):
            raise ValueError("markers must differ, and the first sign of none may occur again inside a marker")


def unit_points(text: str, unit: str | None) -> tuple[int, np.ndarray | None]:
    """Number of units, and the code points of each; signs between matches belong to the unit before them."""
    if unit is None:
        return len(text), None
    starts = [m.start() for m in re.finditer(unit, text) if m.end() > m.start()]
    if not starts:
        return (1, np.array([len(text)])) if text else (0, np.zeros(0, np.int64))
    starts[0] = 0
    return len(starts), np.diff(np.array([*starts, len(text)], np.int64))


def draws(key: str, seed: str) -> tuple[int, int, int, int]:
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in range(0, 32, 8))


def transform_text(text: str, key: str, rule: Rule) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and the output."""
    n, points = unit_points(text, rule.unit)
    h1, h2, h3, h4 = draws(key, rule.seed)
    if not text or h3 % 100 >= rule.transformed or any(m in text for m in (rule.prefix, rule.suffix, rule.middle)):
        return n, "plain", None, None, text
    units = SkipList(n, points)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = units.place(low), units.place(high)
    before, between, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < rule.suffix_first:
        return n, "spm", a, b - a, f"{rule.suffix}{after}{rule.prefix}{before}{rule.middle}{between}"
    return n, "psm", a, b - a, f"{rule.prefix}{before}{rule.suffix}{after}{rule.middle}{between}"


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars, output."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(key).cast("string").alias("_key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            keys, texts = batch.column("_key").to_pylist(), batch.column("text").to_pylist()
            found = [transform_text(t or "", k or "", rule) for k, t in zip(keys, texts, strict=True)]
            n, form, prefix, middle, output = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string()),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, schema)


def restored(form: Column | str, output: Column | str, rule: Rule = Rule()) -> Column:
    """The whole text, from an output and its form alone."""
    form = F.col(form) if isinstance(form, str) else form
    output = F.col(output) if isinstance(output, str) else output

    def after(marker: str) -> Column:
        """What follows the only place of a marker."""
        return F.substring_index(output, marker, -1)

    def until(value: Column, marker: str) -> Column:
        return F.substring_index(value, marker, 1)

    middle = after(rule.middle)
    psm = F.concat(until(after(rule.prefix), rule.suffix), middle, until(after(rule.suffix), rule.middle))
    spm = F.concat(until(after(rule.prefix), rule.middle), middle, until(after(rule.suffix), rule.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(transformed: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Outputs, and the texts rebuilt from them, as sha256 of their UTF-8 bytes."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored("form", "output", rule).cast("binary"), 256).alias("restored_sha256"),
    )
