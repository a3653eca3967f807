"""Similarity join on word n-grams by vertical partitioning (operator 8).

A document is the set of its distinct n-grams, as 64-bit hashes. Hash order is
the global n-gram order; ranges of it are its fragments. Every overlap is
counted fragment by fragment, and the partial counts are summed per pair
(`overlaps`); pairs that a quarter of the fragments rules out are not counted in
the others. Which pairs are counted is decided by fragments too:

- Two similar sets of sizes up to a size class's limit differ in at most d
  n-grams. Cut into more than d fragments, they agree wholly in at least one of
  those that are not empty. So each document gives a key for each fragment's
  content, and similar documents share one (documents with so few non-empty
  fragments that this fails also give keys for the empty ones).
- Fragments are a quarter more than that needs. A document with f non-empty ones
  shares at least f - d keys of a size class with any similar one; so of its f - d most
  frequent keys all but one are not compared (`rare_keys`), and what many documents
  have in common brings them together only if they have little else.
- A pair is dropped if its sizes cannot reach the threshold, or if the parities
  of its sets in 2,048 hash classes differ in more places than its n-grams may.
  Neither drops a pair that is similar.

Links are needed only to tell the components. First each key's documents meet
the one of them that shares the most keys; the links found give components; then,
in keys whose documents are still in several components, those of different
components meet.
Pairs within a component never do, so a large group of near copies costs in
proportion to its size, and every link between components is found.

Equal sets are one class from the start: their members are never paired. Keys
that one task sees often are written aside from the partition of the key, so
that no task gathers a hot key. A 64-bit class hash that two sets share stops
the run (a second hash is compared); another `seed` then tells them apart.
Equal n-gram hashes of different n-grams (2^-64 for two) count as equal, and so do
equal hashes of two fragments of one document (2^-56).

Defined cases: a text with fewer than n words, but not none, has one n-gram, of
all its words; a null or wordless text has none and is linked with nothing. Rows
of one key are rows of their own; a component's id is its smallest key, null
only if no row of it has one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourvault.llm import stored
from hourvault.llm.flat import U64, Words, byte_set, flat_bytes, mix, small_batches
from hourvault.llm.worker import lean

SPACE = byte_set((9, 13), (32, 32))
#: Parity bits of a set, in words: so many that pairs which differ in a few n-grams too many are told apart.
SKETCH_WORDS = 32
SKETCH_ROWS = 1024
#: Ratio of the largest to the smallest size in a class.
CLASS_RATIO = 1.25
#: One fragment more than must agree for each so many n-grams that may differ.
SPARE_FRAGMENTS = 4
#: The last bits of a key are its size class.
KIND_BITS = 8
#: Rows of a key that one task sends to the key's own partition.
KEY_ROWS = 64
#: Keys that a task sorts at once.
SORT_ROWS = 1_000_000
#: Text cut at a time.
BATCH_BYTES = 1 << 20
#: Fragments of the order in which overlaps are counted, and those of them that are counted first.
FRAGMENTS, FIRST_FRAGMENTS = 8, 2
_LABELS = "node long, label long"


@dataclass(frozen=True)
class Similarity:
    """Words in an n-gram; linked when intersection / union >= numerator / denominator."""

    n: int = 4
    numerator: int = 85
    denominator: int = 100
    seed: int = 0

    def most_different(self, size_sum):
        """The most n-grams in which two linked sets of this size together may differ."""
        return size_sum * (self.denominator - self.numerator) // (self.denominator + self.numerator)

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each size class: smallest and largest size of a pair's smaller set, largest of its other, most differing n-grams."""
        low, rows = 1, []
        while low < 1 << 40:
            high = max(low, int(low * CLASS_RATIO))
            rows.append((low, high, high * self.denominator // self.numerator, high * (self.denominator - self.numerator) // self.numerator))
            low = high + 1
        return tuple(np.array(column, np.int64) for column in zip(*rows, strict=True))


# ---------------------------------------------------------------------- sets


class Sets:
    """Sorted distinct n-gram hashes of each text of a batch: `hash`, and `first` (n + 1) by text."""

    def __init__(self, column: pa.Array, n: int, seed: int = 0):
        words = Words(*flat_bytes(column), ~SPACE)
        count = np.diff(words.first)
        grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        first = np.concatenate([[0], np.cumsum(grams)])
        begin = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], grams)
        length = np.repeat(np.minimum(count, n), grams)
        hashes = mix(length.astype(U64) + U64(seed << 8))
        for k in range(n):
            has = length > k if k else slice(None)
            hashes[has] = mix(hashes[has] ^ words.hash[begin[has] + k]) + U64(0x9E3779B97F4A7C15)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            hashes[a:b].sort()
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        new[first[:-1][grams > 0]] = True
        kept = np.concatenate([[0], np.cumsum(new)])
        self.hash, self.first = hashes[new], kept[first]

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.size)

    def sums(self, salt: int) -> np.ndarray:
        """One 64-bit hash of each whole set."""
        running = np.concatenate([np.zeros(1, U64), np.cumsum(mix(self.hash ^ U64(salt)), dtype=U64)])
        return mix((running[self.first[1:]] - running[self.first[:-1]]) ^ self.size.astype(U64))

    def sketches(self) -> np.ndarray:
        """Parity of the set's n-grams in each of 64 * SKETCH_WORDS hash classes, as words a set; some sets at a time."""
        bits, n = 64 * SKETCH_WORDS, len(self.first) - 1
        at = self.row() * bits + (mix(self.hash ^ U64(0x51ED)) & U64(bits - 1)).astype(np.int64)
        out = np.zeros((n, SKETCH_WORDS), np.int64)
        for low in range(0, n, SKETCH_ROWS):
            high = min(n, low + SKETCH_ROWS)
            counts = np.bincount(at[self.first[low] : self.first[high]] - low * bits, minlength=bits * (high - low))
            out[low:high] = np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8").reshape(-1, SKETCH_WORDS)
        return out


def fragment_keys(sets: Sets, similarity: Similarity, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the content of each fragment of each set, in its own size class and in lower ones it may pair in."""
    return keys_and_spares(sets, similarity, skip)[:2]


def keys_and_spares(sets: Sets, similarity: Similarity, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`fragment_keys`, and (row, spare): how many of its most frequent keys of a size class a set need not compare.

    A spare has its size class in its last bits, as a key has. Similar sets differ in at most
    as many fragments as n-grams, so one with more non-empty fragments shares the rest of them.
    """
    low, high, widest, differ = similarity.classes()
    size = sets.size
    own = np.searchsorted(low, size, side="right") - 1
    scattered = mix(sets.hash ^ U64(0xA5A5))
    rows, keys, spare_rows, spares = [], [], [], []
    named = lambda hashes, kind: (hashes & ~U64((1 << KIND_BITS) - 1)) | kind.astype(U64)
    for down in range(len(low)):
        kind = np.maximum(own - down, 0)
        reach = (size > 0) & (own >= down) & (size <= widest[kind])
        if not reach.any():
            break
        use = reach & ~skip & (differ[kind] > 0)  # where nothing may differ, only equal sets pair
        if not use.any():
            continue
        picked = np.flatnonzero(use)
        limit = differ[kind[picked]]
        pieces = limit + 1 + np.maximum(1, limit // SPARE_FRAGMENTS)
        inside = use[sets.row()]
        row = np.repeat(np.arange(len(picked)), size[picked])
        base = np.cumsum(pieces) - pieces
        piece = ((sets.hash[inside] >> U64(32)) * pieces[row].astype(U64)) >> U64(32)
        place = base[row] + piece.astype(np.int64)
        change = np.flatnonzero(np.diff(place, prepend=-1))
        sums = np.add.reduceat(scattered[inside], change)
        place = place[change]
        row = row[change]
        name = mix((kind[picked][row].astype(U64) << U64(40)) + (place - base[row]).astype(U64))
        rows.append(picked[row])
        keys.append(named(mix(sums ^ name), kind[picked][row]))
        full = np.bincount(row, minlength=len(picked))
        many = np.flatnonzero(full - limit > 1)
        spare_rows.append(picked[many])
        spares.append(named(((full - limit - 1)[many] << KIND_BITS).astype(U64), kind[picked][many]))
        few = np.flatnonzero(full <= limit)
        for r in few.tolist():
            begin = base[r]
            empty = np.setdiff1d(np.arange(pieces[r]), place[row == r] - begin)
            rows.append(np.full(len(empty), picked[r]))
            hashes = mix(mix((U64(int(kind[picked[r]])) << U64(40)) + empty.astype(U64)) ^ U64(0xE3B0C4))
            keys.append(named(hashes, np.full(len(empty), kind[picked[r]])))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in (rows, keys, spare_rows, spares))


_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def summarise(df: DataFrame, key: str, text: str, similarity: Similarity, row: str | None = None) -> DataFrame:
    """Per row: doc_id, row (its number, or again its key), n_shingles, class hashes f1 and f2, parity sketch, spares.

    Of equal sets in one task, only the first gives spares.
    """
    rows = df.select(
        F.col(key).cast("long").alias("doc_id"), F.col(row or key).cast("long").alias("row"), F.col(text).cast("string").alias("text")
    )

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small_batches(batches, "text", BATCH_BYTES):
            sets = Sets(batch.column("text"), similarity.n, similarity.seed)
            f1, f2 = sets.sums(0x1F1F), sets.sums(0x2F2F2F)
            _, _, spare_row, spares = keys_and_spares(sets, similarity, _repeated(f1, seen))
            sketch = sets.sketches()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row"), pa.array(sets.size, pa.int64()), pa.array(f1.view(np.int64)),
                    pa.array(f2.view(np.int64)), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH_WORDS)),
                    _lists(spare_row, spares, len(f1)),
                ],
                ["doc_id", "row", "n_shingles", "f1", "f2", *_SKETCH, "spares"],
            )

    schema = "doc_id long, row long, n_shingles long, f1 long, f2 long, " + "".join(f"{s} long, " for s in _SKETCH) + "spares array<long>"
    return rows.mapInArrow(lean(of_batch), schema)


def _repeated(f1: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which sets the task has seen before; it has seen these from now on."""
    skip = np.zeros(len(f1), bool)
    for i, f in enumerate(f1.tolist()):
        skip[i] = f in seen
        seen.add(f)
    return skip


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of n rows."""
    order = np.argsort(row, kind="stable")
    first = np.searchsorted(row[order], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values[order].view(np.int64)))


# -------------------------------------------------------------------- buckets


def shared_keys(df: DataFrame, text: str, similarity: Similarity) -> DataFrame:
    """(k, node): the classes of each key that at least two have.

    Keys are made where they are dealt, from the texts once more: stored with the
    sets, they would take as much room as the texts while their copies travel.
    Of equal sets in one task, only the first gives keys. Tasks deal sorted keys to ranges of the key; a range's rows travel as one
    value. Beyond KEY_ROWS rows of a key, a task hands its rows on as they are,
    dealt anywhere: the key is shared, so they need not meet the others.
    """
    spark = df.sparkSession
    ranges = 4 * stored.parts(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, n = [], 0
        for batch in small_batches(batches, "text", BATCH_BYTES):
            sets = Sets(batch.column("text"), similarity.n, similarity.seed)
            f1 = sets.sums(0x1F1F)
            row, keys = fragment_keys(sets, similarity, _repeated(f1, seen))
            held.append((keys, f1[row]))
            n += len(keys)
            if n >= SORT_ROWS:
                yield from _dealt(held, ranges)
                held, n = [], 0
        if n:
            yield from _dealt(held, ranges)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for spread, raw in zip(batch.column("spread").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                pair = np.frombuffer(raw, U64).reshape(2, -1)
                if spread:
                    yield _key_rows(*pair)
                else:
                    held.append(pair)
        if held:
            keys, nodes = np.concatenate(held, axis=1)
            del held
            order = np.argsort(keys)
            keys, nodes = keys[order], nodes[order]
            equal = keys[1:] == keys[:-1]
            several = np.append(equal, False) | np.concatenate([[False], equal])
            keys, nodes = keys[several], nodes[several]
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            keys, nodes = keys[new], nodes[new]
            # A key of one class may still have rows that were handed on: it stays.
            for first in range(0, len(keys), SORT_ROWS):
                yield _key_rows(keys[first : first + SORT_ROWS], nodes[first : first + SORT_ROWS])

    blobs = df.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(deal), "range int, spread boolean, raw binary")
    return blobs.repartition(stored.parts(spark), "range").mapInArrow(lean(gather), "k long, node long")


def rare_keys(buckets: DataFrame, summary: DataFrame) -> DataFrame:
    """The rows of the buckets but the most frequent keys of each class, as many as it can spare in each size class.

    Similar classes share more keys than either spares, and all order keys alike: the rarest key that they share stays in both.
    """
    kind, spare = F.lit((1 << KIND_BITS) - 1), F.shiftright("spare", KIND_BITS)
    spares = (
        summary.select(F.col("f1").alias("node"), F.explode("spares").alias("spare"))
        .groupBy("node", F.col("spare").bitwiseAND(kind).alias("kind"))
        .agg(F.max(spare).alias("spare"))
    )
    held = buckets.groupBy("k").agg(F.count("*").alias("held"))
    counted = buckets.join(held, "k").withColumn("kind", F.col("k").bitwiseAND(kind)).join(spares, ["node", "kind"], "left")
    frequent = Window.partitionBy("node", "kind").orderBy(F.desc("held"), F.desc("k"))
    ranked = counted.withColumn("place", F.row_number().over(frequent))
    return ranked.where((F.col("place") > F.coalesce("spare", F.lit(0))) & (F.col("held") > 1)).select("k", "node")


def _key_rows(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes.view(np.int64))], ["k", "node"])


def _dealt(held: list[tuple[np.ndarray, np.ndarray]], ranges: int) -> Iterator[pa.RecordBatch]:
    keys = np.concatenate([k for k, _ in held])
    nodes = np.concatenate([n for _, n in held]).view(U64)
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    rank = np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys))))
    near = rank < KEY_ROWS
    rows: list[tuple[int, bool, bytes]] = []
    k, a = keys[near], nodes[near]
    to = ((k >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
    bounds = np.searchsorted(to, np.arange(ranges + 1))
    for r in range(ranges):
        low, high = bounds[r], bounds[r + 1]
        if high > low:
            rows.append((r, False, k[low:high].tobytes() + a[low:high].tobytes()))
    k, a = keys[~near], nodes[~near]
    for i, low in enumerate(range(0, len(k), 1 << 14)):
        rows.append((int(k[low] % U64(1 << 30)) + i, True, k[low : low + (1 << 14)].tobytes() + a[low : low + (1 << 14)].tobytes()))
    for first in range(0, len(rows), 256):
        to, spread, raw = zip(*rows[first : first + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(spread), pa.array(raw, pa.binary())], ["range", "spread", "raw"])


# ---------------------------------------------------------------------- pairs


def _may_link(similarity: Similarity, a: str, b: str) -> Column:
    """Sizes and parity sketches allow the link."""
    size = lambda x: F.col(f"{x}_n")
    differ = sum((F.bit_count(F.col(f"{a}_{s}").bitwiseXOR(F.col(f"{b}_{s}"))) for s in _SKETCH), F.lit(0))
    most = (size(a) + size(b)) * (similarity.denominator - similarity.numerator)
    return (
        (F.least(size(a), size(b)) * similarity.denominator >= F.greatest(size(a), size(b)) * similarity.numerator)
        & (differ * (similarity.denominator + similarity.numerator) <= most)
    )


def _side(classes: DataFrame, name: str) -> DataFrame:
    return classes.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), *(F.col(s).alias(f"{name}_{s}") for s in _SKETCH))


def overlaps(
    df: DataFrame, row: str, text: str, classes: DataFrame, pairs: DataFrame, similarity: Similarity, first: int = FRAGMENTS, short: bool = False
) -> DataFrame:
    """(a, b, overlap, a_part, b_part) of pairs of classes: counts in each of the first fragments of the global order, summed.

    The parts are the n-grams each has in these fragments. Only the texts of one document of each class in a pair are read again.
    With `short`, n-grams are compared by 16 bits of their hashes, a quarter of the bytes that travel with
    each pair, and `overlap` is what it can be at most: n-grams of a set that fall together count as common.
    """
    wanted = stored.written(
        pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "first_row"), "node"), "wanted"
    )
    rows = df.select(F.col(row).cast("long").alias("row"), F.col(text).cast("string").alias("text"))
    docs = wanted.select(F.col("first_row").alias("d")).distinct()
    rows = rows.join(docs, rows["row"].eqNullSafe(docs["d"]), "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            sets = Sets(batch.column("text"), similarity.n, similarity.seed)
            piece = sets.row() * FRAGMENTS + ((sets.hash >> U64(32)) * U64(FRAGMENTS) >> U64(32)).astype(np.int64)
            nodes, counted = sets.sums(0x1F1F).view(np.int64), piece % FRAGMENTS < first
            piece, grams = piece[counted], sets.hash[counted]
            part = np.diff(np.append(np.flatnonzero(np.diff(piece, prepend=-1)), len(piece)))
            if short:
                both = np.unique((piece << 16) | (grams & U64(0xFFFF)).astype(np.int64))
                piece, grams = both >> 16, (both & 0xFFFF).astype(np.uint16)
            begin = np.flatnonzero(np.diff(piece, prepend=-1))
            values = pa.array(grams.view(np.int16 if short else np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(piece)), pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[piece[begin] // FRAGMENTS]), pa.array(piece[begin] % FRAGMENTS, pa.int32()), pa.array(part, pa.int64()), lists],
                ["node", "fragment", "part", "grams"],
            )

    fragments = stored.written(
        rows.mapInArrow(lean(cut), f"node long, fragment int, part long, grams array<{'short' if short else 'long'}>")
        .join(wanted.select("node"), "node", "left_semi")
        .groupBy("node", "fragment")
        .agg(F.first("part").alias("part"), F.first("grams").alias("grams")),
        "fragments",
    )
    left, right = (
        fragments.select(F.col("node").alias(x), "fragment", F.col("part").alias(f"{x}_part"), F.col("grams").alias(f"{x}_grams")) for x in "ab"
    )
    # Of n-grams that fall together, one is in the list; at most the others are common too.
    fallen = F.least(*(F.col(f"{x}_part") - F.size(f"{x}_grams") for x in "ab"))
    common = F.coalesce(F.size(F.array_intersect("a_grams", "b_grams")) + fallen, F.lit(0))
    part = lambda x: F.sum(F.coalesce(f"{x}_part", F.lit(0))).alias(f"{x}_part")
    return (
        pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(first - 1))).alias("fragment"))
        .join(left, ["a", "fragment"], "left")
        .join(right, ["b", "fragment"], "left")
        .groupBy("a", "b")
        .agg(F.sum(common).alias("overlap"), part("a"), part("b"))
    )


def _links(df, row, text, classes, pairs, similarity) -> DataFrame:
    """The pairs that are similar, of written candidates with sizes.

    Pairs that could not be similar if all else were common are dropped after the first fragments.
    """
    most = F.col("overlap") + F.least(F.col("a_n") - F.col("a_part"), F.col("b_n") - F.col("b_part"))
    similar = lambda common: common * similarity.denominator >= (F.col("a_n") + F.col("b_n") - common) * similarity.numerator
    counted = overlaps(df, row, text, classes, pairs.select("a", "b"), similarity, FIRST_FRAGMENTS, short=True)
    pairs = stored.written(pairs.join(counted, ["a", "b"]).where(similar(most)).select(*pairs.columns), "possible")
    counted = overlaps(df, row, text, classes, pairs.select("a", "b"), similarity)
    return stored.written(pairs.join(counted, ["a", "b"]).where(similar(F.col("overlap"))).select("a", "b", "overlap"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of the edges (a, b).

    Alternates joining larger and smaller neighbours to the smallest one known;
    a few rounds, each written to the shared folder.
    """
    edges = stored.written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        edges = stored.written(smaller.select("e.u", "e.v").where("u != v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def similarity_classes(
    df: DataFrame, key: str = "doc_id", text: str = "text", similarity: Similarity = Similarity()
) -> tuple[DataFrame, DataFrame]:
    """(rows, links): doc_id, n_shingles, component_id of each row; and the links that join classes.

    Links are those that tell the components: every class is joined to the rest of its component.
    """
    rows, links = _classified(df, key, text, similarity)
    return rows.select("doc_id", "n_shingles", "component_id"), links


def _classified(df: DataFrame, key: str, text: str, similarity: Similarity, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of `similarity_classes` with `row`, class (f1) and component (label; null without n-grams); and the links."""
    summary = stored.written(summarise(df, key, text, similarity, row), "sets")
    classes = stored.written(
        summary.where("n_shingles > 0")
        .groupBy(F.col("f1").alias("node"))
        .agg(
            F.min("n_shingles").alias("n"), F.min("doc_id").alias("first_doc"), F.min("row").alias("first_row"),
            (F.min("f2") != F.max("f2")).alias("two"), *(F.min(s).alias(s) for s in _SKETCH),
        ),
        "classes",
    )
    if classes.where("two").limit(1).count():
        raise ValueError("two sets have one class hash: use another seed")
    shared = stored.written(shared_keys(df, text, similarity), "buckets")
    buckets = stored.written(rare_keys(shared, summary), "rare")
    # Round 1: each key's classes meet its centre, the class that shares the most keys. What
    # copies have been made from shares all of its keys, each copy only those it left as they were.
    shares = shared.groupBy("node").agg(F.count("*").alias("shares"))
    ranked = buckets.join(shares, "node")
    centres = ranked.groupBy("k").agg(F.max_by("node", "shares").alias("centre"), F.count("*").alias("n")).where("n > 1")
    stars = (
        buckets.join(centres, "k")
        .where("node != centre")
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        .distinct()
    )
    tested = stored.written(_candidates(stars, classes, similarity), "stars")
    links = _links(df, row or key, text, classes, tested, similarity)
    labels = stored.written(components(links), "labels")
    # Round 2: classes of one key that are in different components.
    known = buckets.join(labels, "node", "left").select("k", "node", F.coalesce("label", "node").alias("label"))
    open_keys = known.groupBy("k").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("k")
    members = known.join(open_keys, "k", "left_semi").join(classes.drop("first_doc", "first_row", "two"), "node")
    members = stored.written(members, "members")
    a, b = (members.select("k", F.col("label").alias(f"{x}_l"), F.col("node").alias(x), F.col("n").alias(f"{x}_n"),
                           *(F.col(s).alias(f"{x}_{s}") for s in _SKETCH)) for x in "ab")
    crossing = a.join(b, (a["k"] == b["k"]) & (F.col("a_l") < F.col("b_l")) & _may_link(similarity, "a", "b"))
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    sizes = [F.when(F.col("a") < F.col("b"), F.col(f"{x}_n")).otherwise(F.col(f"{y}_n")).alias(f"{x}_n") for x, y in ("ab", "ba")]
    more = stored.written(crossing.select(*pair, *sizes).distinct().join(tested, ["a", "b"], "left_anti"), "crossing")
    if more.limit(1).count():
        further = _links(df, row or key, text, classes, more, similarity)
        if further.limit(1).count():
            links = links.unionByName(further)
            labels = stored.written(components(links), "labels")
    # A component's id is the smallest key of its classes.
    named = classes.select("node", "first_doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    joined = named.join(labels.select("label").distinct(), "label", "left_semi")
    smallest = joined.groupBy("label").agg(F.min("first_doc").alias("smallest"))
    ids = named.join(smallest, "label", "left").select(
        F.col("node").alias("f1"), "label", F.coalesce("smallest", "first_doc").alias("component_id")
    )
    own = ["doc_id", "row", "n_shingles", "f1"]
    filled = summary.where("n_shingles > 0").select(*own).join(ids, "f1")
    empty = summary.where("n_shingles = 0").select(*own, F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty), links


def _candidates(pairs: DataFrame, classes: DataFrame, similarity: Similarity) -> DataFrame:
    sized = pairs.join(_side(classes, "b"), "b").join(_side(classes, "a"), "a")
    return sized.where(_may_link(similarity, "a", "b")).select("a", "b", "a_n", "b_n")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: Similarity = Similarity()) -> DataFrame:
    """The rows of a frame, one for each component: of its smallest key, and there of the smallest class.

    Rows of one key are rows of their own, as in `similarity_classes`. Of the rows
    of a component that have no key, one stays as well. Rows without words stay.
    """
    row = "hv_row"
    while row.lower() in {c.lower() for c in df.columns}:  # a name that no column has
        row += "_"
    numbered = stored.written(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows, _ = _classified(numbered, key, text, similarity, row)
    best = rows.where("n_shingles > 0").groupBy("label", F.col("doc_id").isNull().alias("keyless")).agg(
        F.min(F.struct("doc_id", "f1", "row")).alias("best")
    )
    kept = best.select(F.col("best.row").alias(row)).unionByName(rows.where("n_shingles = 0").select(F.col("row").alias(row)))
    return numbered.join(kept, row, "left_semi").drop(row)
