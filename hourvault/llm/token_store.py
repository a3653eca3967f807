"""Token-id shards with a minimal perfect hash index (operator 2).

`write_tokens` encodes every text, appends an end id, and writes raw ids (16-bit
little-endian where the vocabulary fits, else 32-bit), documents in ascending
key order, one file a range of keys: nothing but ids, so a shard can be mapped
as one array. `build_index` maps each key to its shard and offset: keys are
dealt to blocks by a hash; in each block a minimal perfect hash (levels of
collision-free bits with ranks) numbers the n keys 0 to n - 1, and slot i of
the block's entry table holds a fingerprint, the shard, the offset, the length
and the number of rows of its key. A lookup hashes the key, tests one bit a
level (1.6 levels on average), counts bits before it by a stored rank, and
compares the fingerprint.

Files are written under names that no other attempt uses, and count only when a
Spark-written table of this store names them: a task that is run again, or an
executor that is lost, leaves a file that nobody reads.

Defined cases: a null text has no ids but the end id. Rows without a key come
first in key order and are not in the index. Rows of one key stand side by side
and its entry gives the first and their number. An empty table gives no files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourvault.llm import stored
from hourvault.llm.flat import U64, flat_bytes, mix, small_batches
from hourvault.llm.tokens import default_tokenizer, encoder
from hourvault.session import scratch_path
from hourvault.sources.storage import join_path, open_storage

END_ID = 2
#: Keys a block of the index is made for; a lookup loads whole blocks. A file holds many blocks.
BLOCK_KEYS = 2_000
#: Bits for each key that is left, at each level.
GAMMA = 2
LEVELS = 48
_RECORDS = "shard string, first_key long, first_row long, doc_id long, n_tokens long, offset long"
_PLACES = "doc_id long, shard_no int, offset long, n_tokens long, rows int"
#: Bytes of a shard read at once.
READ_BYTES = 8 << 20
_ENTRY = np.dtype([("print", "<u4"), ("rows", "<u4"), ("shard", "<u4"), ("n", "<u4"), ("offset", "<u8")])


@dataclass
class TokenStore:
    """`root`: folder; `records`: key, shard file, offset and length of each row; `shards`: file, first token, tokens."""

    spark: SparkSession
    root: str
    width: int
    records: DataFrame
    shards: DataFrame


# ------------------------------------------------------------------- writing


def write_tokens(
    df: DataFrame, root: str, key: str = "doc_id", text: str = "text",
    tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None,
) -> TokenStore:
    """Encode all rows and write them in key order to `shards` files (default: as many as shuffle partitions)."""
    spark = df.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    folder = join_path(root, "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        name, out, at, first_key, first_row = stored.attempt_name("shard"), None, 0, None, None
        filesystem, base = open_storage(folder)
        for batch in small_batches(batches, "text"):
            data, offsets = flat_bytes(batch.column("text"))
            ids, bounds = ids_of.encode(data, offsets)
            n = np.diff(bounds)
            whole = np.full(len(ids) + len(n), end_id, ids_of.dtype)
            inside = np.ones(len(whole), bool)
            inside[bounds[1:] + np.arange(len(n))] = False
            whole[inside] = ids
            if out is None:
                filesystem.create_dir(base, recursive=True)
                out = filesystem.open_output_stream(f"{base}/{name}")
            out.write(whole.astype(whole.dtype.newbyteorder("<")).tobytes())
            keys = batch.column("doc_id")
            if first_row is None:
                first_key, first_row = keys[0].as_py(), batch.column("row")[0].as_py()
            starts = at + bounds[:-1] + np.arange(len(n))
            at += len(whole)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(n)), pa.array([first_key] * len(n), pa.int64()),
                    pa.array([first_row] * len(n), pa.int64()), keys.cast(pa.int64()),
                    pa.array(n + 1, pa.int64()), pa.array(starts, pa.int64()),
                ],
                ["shard", "first_key", "first_row", "doc_id", "n_tokens", "offset"],
            )
        if out is not None:
            out.close()

    # The row number lets a key that many rows share be spread over several shards.
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    rows = (
        df.select(
            F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
            F.monotonically_increasing_id().alias("row"),
        )
        .repartitionByRange(shards or stored.parts(spark), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(write, _RECORDS)
    )
    path = join_path(root, "records")
    rows.write.parquet(path)
    records = spark.read.schema(_RECORDS).parquet(path)
    # Shards in key order: one row a shard, so the running sum is over file names, never documents.
    per_shard = records.groupBy("shard").agg(
        F.min(F.coalesce("first_key", F.lit(-(2**63)))).alias("first_key"),
        F.min("first_row").alias("first_row"),
        F.max(F.col("offset") + F.col("n_tokens")).alias("tokens"),
    )
    found = per_shard.toPandas().sort_values(["first_key", "first_row"]).reset_index(drop=True)
    found["shard_no"] = np.arange(len(found), dtype=np.int32)
    found["start"] = found["tokens"].cumsum() - found["tokens"]
    shard_path = join_path(root, "shards")
    spark.createDataFrame(
        found[["shard", "shard_no", "start", "tokens"]].astype({"start": "int64", "tokens": "int64", "shard_no": "int32"}),
        "shard string, shard_no int, start long, tokens long",
    ).coalesce(1).write.parquet(shard_path)
    return open_store(spark, root, encoder(tokenizer).dtype().itemsize)


def open_store(spark: SparkSession, root: str, width: int) -> TokenStore:
    return TokenStore(
        spark, root, width,
        spark.read.schema(_RECORDS).parquet(join_path(root, "records")),
        spark.read.schema("shard string, shard_no int, start long, tokens long").parquet(join_path(root, "shards")),
    )


# ------------------------------------------------------- minimal perfect hash


def _level_bits(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes ^ U64((level + 1) * 0x632BE59BD9B4E019 % 2**64)) % U64(size)).astype(np.int64)


class PerfectHash:
    """Numbers n distinct 64-bit hashes 0 to n - 1.

    A level has GAMMA bits for each key that is left; a key that alone falls on
    a bit is numbered by it, the others go to the next level.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.flags = np.unpackbits(bits, count=int(self.base[-1]), bitorder="little").astype(bool)
        self.rank = np.concatenate([[0], np.cumsum(self.flags)])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, sizes, levels = hashes, [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = GAMMA * len(left) + 1
            at = _level_bits(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("two keys have one hash: hash the keys with another seed")
        flags = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flags, bitorder="little"))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 where no level has a bit for it (then it was not among the keys)."""
        found = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = self.base[level] + _level_bits(hashes[todo], level, size)
            hit = self.flags[at]
            found[todo[hit]] = self.rank[at[hit]]
            todo = todo[~hit]
        return found


def key_hashes(keys: np.ndarray) -> np.ndarray:
    """One 64-bit hash a key; distinct keys never share one."""
    return mix(keys.astype(np.int64).view(U64))


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ U64(0xD6E8FEB86659FD93)) >> U64(32)).astype(np.uint32)


def pack_block(keys, rows, shard, n, offset) -> bytes:
    """One block: counts, level sizes, level bits, and the entry table by number."""
    hashes = key_hashes(keys)
    table = PerfectHash.build(hashes)
    entries = np.zeros(len(keys), _ENTRY)
    at = table.numbers(hashes)
    for name, values in (("print", _fingerprints(hashes)), ("rows", rows), ("shard", shard), ("n", n), ("offset", offset)):
        entries[name][at] = values
    head = np.array([len(keys), len(table.sizes), len(table.bits)], "<u8")
    return head.tobytes() + table.sizes.astype("<u8").tobytes() + table.bits.tobytes() + entries.tobytes()


def unpack_block(raw: bytes) -> tuple[PerfectHash, np.ndarray]:
    n, levels, n_bits = np.frombuffer(raw, "<u8", 3).astype(int)
    sizes = np.frombuffer(raw, "<u8", levels, 24).astype(np.int64)
    at = 24 + 8 * levels
    bits = np.frombuffer(raw, np.uint8, n_bits, at)
    return PerfectHash(sizes, bits), np.frombuffer(raw, _ENTRY, n, at + n_bits)


def find(raw: bytes, keys: np.ndarray) -> np.ndarray:
    """Entries of keys in a block; rows = 0 where the key is not there (by its fingerprint)."""
    table, entries = unpack_block(raw)
    hashes = key_hashes(keys)
    at = table.numbers(hashes)
    found = np.zeros(len(keys), _ENTRY)
    known = at >= 0
    found[known] = entries[at[known]]
    found["rows"][found["print"] != _fingerprints(hashes)] = 0
    return found


def _block_of(key: str, blocks: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))


def build_index(store: TokenStore, block_keys: int = BLOCK_KEYS) -> None:
    """Write the index of all keys: one file a task, with whole blocks end to end."""
    keyed = store.records.where("doc_id is not null")
    blocks = max(1, -(-keyed.count() // block_keys))
    rows = (
        keyed.groupBy("doc_id")
        .agg(F.count("*").cast("int").alias("rows"), F.min(F.struct("first_row", "offset", "shard", "n_tokens")).alias("at"))
        .select("doc_id", "rows", "at.shard", "at.offset", "at.n_tokens")
        .join(store.shards.select("shard", "shard_no"), "shard")
        .withColumn("block", _block_of("doc_id", blocks))
        .repartition(stored.parts(store.spark), "block")
        .sortWithinPartitions("block")
    )
    folder = join_path(store.root, "index")

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = open_storage(folder)
        name, out, at = stored.attempt_name("blocks"), None, 0
        for block, part in _whole_groups(frames, "block"):
            raw = pack_block(*(part[c].to_numpy() for c in ("doc_id", "rows", "shard_no", "n_tokens", "offset")))
            if out is None:
                filesystem.create_dir(base, recursive=True)
                out = filesystem.open_output_stream(f"{base}/{name}")
            out.write(raw)
            yield pd.DataFrame({"block": [block], "blocks": [blocks], "file": [name], "at": [at], "length": [len(raw)]})
            at += len(raw)
        if out is not None:
            out.close()

    rows.mapInPandas(build, _BLOCKS).write.parquet(join_path(store.root, "blocks"))


_BLOCKS = "block long, blocks long, file string, at long, length long"


def _whole_groups(frames: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[int, pd.DataFrame]]:
    """Runs of equal values of a column in which the rows are in order, across batches."""
    held: list[pd.DataFrame] = []
    value = None
    for frame in frames:
        for v, part in frame.groupby(column, sort=True):
            if held and v != value:
                yield value, pd.concat(held)
                held = []
            value = v
            held.append(part)
    if held:
        yield value, pd.concat(held)


# -------------------------------------------------------------------- reading


def look_up(store: TokenStore, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Shard, offset, length and rows of each distinct key of a frame that the index holds.

    Keys are dealt to the index's blocks; a task reads the blocks of its keys.
    """
    directory = store.spark.read.schema(_BLOCKS).parquet(join_path(store.root, "blocks"))
    blocks = directory.agg(F.max("blocks")).head()[0] or 1
    folder = join_path(store.root, "index")

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = open_storage(folder)
        at, raw = None, b""
        for frame in frames:
            for place, part in frame.groupby(["file", "at", "length"]):
                if place != at:
                    with filesystem.open_input_file(f"{base}/{place[0]}") as source:
                        at, raw = place, source.read_at(int(place[2]), int(place[1]))
                keys = part["doc_id"].to_numpy(np.int64)
                found = find(raw, keys)
                known = found["rows"] > 0
                yield pd.DataFrame({
                    "doc_id": keys[known], "shard_no": found["shard"][known].astype(np.int32),
                    "offset": found["offset"][known].astype(np.int64), "n_tokens": found["n"][known].astype(np.int64),
                    "rows": found["rows"][known].astype(np.int32),
                })

    asked = keys.select(F.col(key).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return (
        asked.withColumn("block", _block_of("doc_id", blocks))
        .join(directory.drop("blocks"), "block")
        .sortWithinPartitions("file", "at")
        .mapInPandas(probe, _PLACES)
    )


def places_of_rows(store: TokenStore, found: DataFrame) -> DataFrame:
    """Every row's place: by the index where its key has one row; a key's further rows, and rows without a key, by the records."""
    rows = store.records.join(store.shards.select("shard", "shard_no"), "shard")
    many = found.where("rows > 1").select("doc_id")
    rest = rows.join(many, "doc_id", "left_semi").unionByName(rows.where("doc_id is null"))
    columns = ["doc_id", "shard_no", "offset", "n_tokens"]
    return found.where("rows = 1").select(columns).unionByName(rest.select(columns))


def read_documents(store: TokenStore, places: DataFrame, ids: bool = False) -> DataFrame:
    """start (ids of all documents before), n_tokens and crc32 of the ids of each place, read from the shard files.

    With `ids`, the ids too. Rows of a shard are read in offset order, neighbours at once.
    """
    folder, width = join_path(store.root, "ids"), store.width
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = open_storage(folder)
        for frame in frames:
            for shard, part in frame.groupby("shard"):
                with filesystem.open_input_file(f"{base}/{shard}") as source:
                    yield from _read_places(source, part, width, ids)

    return (
        places.join(store.shards.select("shard_no", "shard", "start"), "shard_no")
        .repartitionByRange(stored.parts(store.spark), "shard_no", "offset")
        .sortWithinPartitions("shard_no", "offset")
        .mapInPandas(read, schema)
    )


def _read_places(source, part: pd.DataFrame, width: int, with_ids: bool) -> Iterator[pd.DataFrame]:
    begins = part["offset"].to_numpy(np.int64) * width
    ends = begins + part["n_tokens"].to_numpy(np.int64) * width
    crcs, all_ids = [], []
    raw, low, high = b"", 0, 0
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b > high or a < low:
            low, high = a, max(b, a + READ_BYTES)
            raw = source.read_at(high - low, low)
        found = np.frombuffer(raw, f"<u{width}", (b - a) // width, a - low)
        crcs.append(zlib.crc32(found.astype("<u4").tobytes()))
        if with_ids:
            all_ids.append(found.astype(np.int32))
    out = {
        "doc_id": part["doc_id"].astype("Int64"), "start": part["start"].to_numpy() + part["offset"].to_numpy(),
        "n_tokens": part["n_tokens"].to_numpy(), "ids_crc32": crcs,
    }
    yield pd.DataFrame(out | ({"ids": all_ids} if with_ids else {}))


def token_table(df: DataFrame, root: str | None = None, **options) -> DataFrame:
    """Write a frame's ids, index them, look every key up, and read all documents back."""
    store = write_tokens(df, root or scratch_path(df.sparkSession, "tokens"), **options)
    build_index(store)
    found = stored.written(look_up(store, store.records), "places")
    return read_documents(store, places_of_rows(store, found))
