"""Shards of bounded size by extendible hashing (operator 9).

A shard is a bucket of all rows whose key hash begins with some bits. Only a
bucket over the byte limit splits, on the next bit, until each fits; the
directory, indexed by hash-prefix bits, names the bucket of each prefix. Bytes
are summed once by a prefix somewhat longer than needed, and a row's bucket is
the shortest prefix whose bytes fit. Prefixes that even so are over the limit
go on with more bits, on their own rows only. Prefixes, buckets and rows meet
by shuffles alone, so the driver gathers none of them.

Rows that share a whole hash cannot be split by it (one key, or one row over
the limit): such a bucket is cut into overflow pages, filled row by row up to
the limit; a row that is larger by itself has a page of its own.

Defined cases: null texts have 0 bytes; a null key is hashed as the empty text;
repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourvault.llm import stored

HASH_BITS = 60
#: Bits beyond those that equal buckets would need.
SPARE_BITS = 6
LIMIT = 1 << 20


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column | int) -> Column:
    """The leading bits of the hash, as a number."""
    return F.expr(f"shiftright(h, {HASH_BITS} - ({bits}))")


def assign_shards(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add shard (bits of the prefix, and the overflow page if any), depth, shard_bytes, shard_rows.

    `rows` has h (60-bit hash) and n_bytes, and is read several times: pass a written table.
    """
    total = rows.agg(F.sum("n_bytes")).head()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS if total > limit else 0
    left, done, first, more = rows, None, 0, SPARE_BITS
    while True:
        depth = min(depth, HASH_BITS)
        fine = left.groupBy(_prefix(depth).alias("p")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
        fine = stored.written(fine, "prefixes")
        directory = stored.written(_directory(fine, first, depth, limit), "directory")
        placed = left.withColumn("p", _prefix(depth))
        found = placed.join(_sorted(directory), "p").drop("p")
        done = found if done is None else done.unionByName(found)
        oversized = fine.where(F.col("n_bytes") > limit).select("p")
        if not oversized.limit(1).count():
            break
        left = stored.written(placed.join(_sorted(oversized), "p", "left_semi").select(*left.columns), "oversized")
        if depth == HASH_BITS:
            return _named(done).unionByName(_named(_pages(left, limit), F.concat(F.lit("+"), F.col("page"))))
        first, depth, more = depth + 1, depth + more, 2 * more
    return _named(done)


def _sorted(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast. Left to itself, Spark goes by the size of the files below it, and a few
    MB of them hold millions of prefixes, which the driver would have to gather.
    """
    return df.hint("merge")


def _directory(fine: DataFrame, first: int, depth: int, limit: int) -> DataFrame:
    """By prefix of `depth` bits that fits: its bucket, the shortest of its prefixes of `first` bits or more that fits."""
    shorter = fine.select("p", "n_bytes", "n", F.explode(F.sequence(F.lit(first), F.lit(depth))).alias("depth"))
    # Each prefix counts towards all shorter ones.
    sums = shorter.groupBy("depth", F.expr(f"shiftright(p, {depth} - depth)").alias("q"))
    sums = stored.written(sums.agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows")), "sums")
    # Bytes never grow with the bits, so the shortest that fits is the one whose parent does not: a bucket.
    halves = F.explode(F.array(F.col("q") * 2, F.col("q") * 2 + 1)).alias("q")
    split = sums.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), halves)
    fits = sums.where(F.col("shard_bytes") <= limit)
    below = fits.join(_sorted(split), ["depth", "q"], "left_semi")
    buckets = stored.written(fits.where(F.col("depth") == first).unionByName(below), "buckets")
    depths = [r.depth for r in buckets.select("depth").distinct().collect()]  # 61 at most
    ways = fine.select("p", F.explode(F.array(*map(F.lit, depths)).cast("array<int>")).alias("depth"))
    ways = ways.withColumn("q", F.expr(f"shiftright(p, {depth} - depth)"))
    return ways.join(_sorted(buckets), ["depth", "q"]).select("p", "depth", "q", "shard_bytes", "shard_rows")


def _pages(left: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash in pages: a running sum within each of many slices of the hash, each of which opens its own pages."""
    # A slice is what one input task holds, so a hash that a third of all rows share is not one window.
    sliced = left.withColumn("slice", F.spark_partition_id())
    order = Window.partitionBy("h", "slice").orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_bytes").over(order), F.lit(0))
    # Half-limit steps: a page holds the rows that begin in its step, the last of which may reach into the next.
    step = max(1, limit // 2)
    big = F.col("n_bytes") > step
    page = F.when(
        big, F.concat(F.lit("b"), F.row_number().over(Window.partitionBy("h", "slice").orderBy("n_bytes")).cast("string"))
    ).otherwise(F.floor(before / step).cast("string"))
    paged = stored.written(sliced.withColumn("page", F.concat_ws(".", F.col("slice").cast("string"), page)), "pages")
    sums = paged.groupBy("h", "page").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    paged = paged.join(_sorted(sums), ["h", "page"])
    return paged.withColumn("depth", F.lit(HASH_BITS)).withColumn("q", F.col("h")).drop("slice")


def _named(rows: DataFrame, more: Column | None = None) -> DataFrame:
    bits = F.expr("CASE WHEN depth = 0 THEN '' ELSE lpad(bin(q), depth, '0') END")
    name = F.concat(bits, more) if more is not None else bits
    return rows.withColumn("shard", name).drop("q", "page").withColumn("depth", F.col("depth").cast("int"))


def shard_documents(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, shard, depth, shard_bytes, shard_rows."""
    sized = df.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        key_hash(F.col(key)).alias("h"),
    )
    return assign_shards(stored.written(sized, "sized"), limit).select(
        "doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Write the rows, all columns, below `path` in a folder a shard; the shards with their bytes and rows."""
    spark = df.sparkSession
    if "shard" in df.columns:  # the folder's name is its value: the table's own column keeps another name
        df = df.withColumnRenamed("shard", "in_shard")
    rows = stored.written(
        df.select(
            F.struct(*df.columns).alias("body"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
            key_hash(F.col(key)).alias("h"),
        ),
        "bodies",
    )
    placed = assign_shards(rows, limit)
    placed.select("shard", "body.*").repartition(stored.parts(spark), "shard").write.partitionBy("shard").parquet(path)
    return placed.select("shard", "depth", "shard_bytes", "shard_rows").distinct()

