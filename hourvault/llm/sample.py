"""Folds and bounded samples of labelled rows, drawn by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str | Column) -> Column:
    """True for the fold that is never learned from: crc32 of the id's text leaves 2 when divided by 4."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def may_learn(key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return key.isNotNull() & ~held_out(key)


def draw(key: str | Column, share: Column | float, seed: int) -> Column:
    """True for about this share of the ids, the same ones whatever the order of rows."""
    key = F.col(key) if isinstance(key, str) else key
    unit = F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return unit < share


def drawn_ids(ids: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """About `most` of a frame's ids, each once (never more than twice as many), as a frame of one column `key`.

    An id that many rows share counts once; where rows share ids, fewer are drawn.
    """
    n = ids.count()
    return ids.where(draw(key, min(1.0, most / max(1, n)), seed)).select(key).distinct().limit(2 * most)


def text_hash(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def one_text_each(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Of each id of `ids` (a bounded frame that the caller has counted), one row of `rows` (`id`, `text`, more columns).

    It is a row whose text has the smallest hash, so a result has no more rows than
    `ids`, however many rows and texts one id has; hashes meet before texts travel.
    """
    hashed = rows.withColumn("hv_text_hash", text_hash("text")).join(F.broadcast(ids.select("id").distinct()), "id")
    least = hashed.groupBy("id").agg(F.min("hv_text_hash").alias("hv_text_hash"))
    return hashed.join(F.broadcast(least), ["id", "hv_text_hash"]).drop("hv_text_hash").dropDuplicates(["id"]).join(F.broadcast(ids), "id")
