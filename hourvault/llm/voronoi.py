"""Exact top-k inner products by a Voronoi kNN join (operator 5).

Data vectors get one more component that brings all of them to one length M
(the longest); queries are scaled to M with 0 there. A query's inner products
then fall as Euclidean distances grow, so the kNN join of metric spaces holds:

1. Pivots are drawn from queries and from data, as many as each has rows for;
   every vector goes to the cell of its nearest pivot.
2. A summary of each cell is kept: its rows, largest and smallest distance to
   the pivot, and the k + 1 smallest. From the summaries each query group gets a
   bound on the distance of its k-th neighbours.
3. A data vector is replicated only to the query groups whose bound it may
   reach, by the triangle inequality on the pivots' distance and its own.
4. Each group meets its vectors in chunks of bounded size, by one integer
   matrix product, and keeps k of each query; the best k of these are the result.

Cells and groups are cut into chunks, so a cell that holds a third of all rows
is many tasks. Only summaries (a few numbers a cell) reach the driver.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part, nor rows without an id; shorter vectors count as padded with 0;
rows of one id are rows of their own (a query meets every row but itself);
equal scores go to the smaller id. Components beyond the long range saturate,
and scores are exact while they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourvault.llm import stored

K = 10
#: Data rows a cell is meant for, queries a group is meant for, and the most pivots of each.
CELL_ROWS = 2048
GROUP_ROWS = 256
MOST_PIVOTS = 2048
#: Rows of a cell, and of a group, that meet in one task.
DATA_CHUNK = 1024
QUERY_CHUNK = 512
EVERY = 100
_FOUND = "q_row long, query_id long, vec_id long, score long"


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """row, vec_id and v (array of long, floor(scale * x)) of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    return (
        df.where(x.isNotNull() & F.col(key).isNotNull() & finite)
        .select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(scale * e.cast("double"))).alias("v"))
        .withColumn("row", F.monotonically_increasing_id())
    )


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Rows of one length as a matrix of int64, padded with 0."""
    out = np.zeros((len(vectors), dim), np.int64)
    if len(vectors):
        lengths = np.array([len(v) for v in vectors])
        if (lengths == dim).all() and dim:
            return np.stack(vectors.to_numpy()).astype(np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
    return out


def _raised(v: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors of length `longest`: data with one more component, queries scaled with 0 there."""
    v = v.astype(np.float64)
    norm = np.sqrt((v * v).sum(1))
    if query:
        return np.hstack([v * (longest / np.where(norm > 0, norm, 1.0))[:, None], np.zeros((len(v), 1))])
    return np.hstack([v, np.sqrt(np.maximum(longest**2 - norm**2, 0.0))[:, None]])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def _assigned(rows: DataFrame, pivots: np.ndarray, dim: int, longest: float, query: bool) -> DataFrame:
    """Add the nearest pivot's number and distance."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            distance = _distances(_raised(_matrix(frame["v"], dim), longest, query), shared.value)
            frame["cell"] = distance.argmin(1).astype(np.int64)
            frame["distance"] = distance.min(1)
            yield frame

    return rows.mapInPandas(nearest, "vec_id long, v array<long>, row long, cell long, distance double")


def _pivots(rows: DataFrame, n: int, per: int, dim: int, longest: float, query: bool) -> np.ndarray:
    """Vectors chosen by the hash of their row number: one for each `per` rows."""
    few = rows.orderBy(F.xxhash64("row"), "row").limit(int(min(MOST_PIVOTS, max(1, -(-n // per))))).select("v").toPandas()
    return _raised(_matrix(few["v"], dim), longest, query)


def _summaries(cells: DataFrame, k: int) -> pd.DataFrame:
    """One row a cell: rows, largest, smallest, and the k smallest distances to the pivot."""
    nearest = cells.withColumn("no", F.row_number().over(Window.partitionBy("cell").orderBy("distance", "row")))
    smallest = nearest.where(F.col("no") <= k).groupBy("cell").agg(F.sort_array(F.collect_list("distance")).alias("smallest"))
    sums = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.min("distance").alias("near"))
    return sums.join(smallest, "cell").toPandas().sort_values("cell").reset_index(drop=True)


def _bounds(groups: pd.DataFrame, cells: pd.DataFrame, apart: np.ndarray, k: int) -> np.ndarray:
    """For each query group, a distance within which every query of it has k neighbours besides itself."""
    owner = np.repeat(np.arange(len(cells)), [len(s) for s in cells["smallest"]])
    near = np.concatenate([np.asarray(s) for s in cells["smallest"]])
    out = np.full(len(groups), np.inf)
    for i, far in enumerate(groups["far"].to_numpy()):
        reach = far + apart[i][owner] + near
        if len(reach) > k:
            out[i] = np.partition(reach, k)[k]
    return out


def top_inner_products(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, scale: int = 1024
) -> DataFrame:
    """Per query (a row whose id is divisible by `every`): query_id, rank, vec_id, score of its k highest inner products."""
    spark = df.sparkSession
    data = stored.written(whole_vectors(df, key, vector, scale), "vectors")
    is_query = F.col("vec_id") % every == 0
    facts = data.agg(
        F.max(F.size("v")).alias("dim"), F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("queries"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))).alias("square"),
        F.max(F.array_max(F.transform("v", lambda e: F.abs(e.cast("double"))))).alias("largest"),
    ).head()
    if not facts["queries"] or facts["n"] < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, longest = int(facts["dim"]), float(facts["square"]) ** 0.5
    exact_float = dim * float(facts["largest"] or 0.0) ** 2 < 2.0**53
    asked = data.where(is_query)
    query_pivots = _pivots(asked, facts["queries"], GROUP_ROWS, dim, longest, query=True)
    data_pivots = _pivots(data, facts["n"], CELL_ROWS, dim, longest, query=False)
    cells = stored.written(_assigned(data, data_pivots, dim, longest, query=False), "cells")
    groups = stored.written(_assigned(asked, query_pivots, dim, longest, query=True), "groups")
    of_cells, of_groups = _summaries(cells, k + 1), _summaries(groups, 1)
    apart = _distances(query_pivots, data_pivots)[np.ix_(of_groups["cell"], of_cells["cell"])]
    slack = 1e-6 * max(longest, 1.0)  # above the rounding of all distances
    bound = _bounds(of_groups, of_cells, apart, k) + slack
    least = np.maximum(apart - of_cells["far"].to_numpy()[None, :], of_cells["near"].to_numpy()[None, :] - apart)
    meets = least - of_groups["far"].to_numpy()[:, None] <= bound[:, None]
    i, j = np.nonzero(meets)
    plan = pd.DataFrame({
        "grp": of_groups["cell"].to_numpy()[i], "cell": of_cells["cell"].to_numpy()[j], "apart": apart[i, j],
        "reach": (bound + of_groups["far"].to_numpy())[i], "query_chunks": -(-of_groups["n"].to_numpy()[i] // QUERY_CHUNK),
        "data_chunks": -(-of_cells["n"].to_numpy()[j] // DATA_CHUNK),
    })
    plan = spark.createDataFrame(plan, "grp long, cell long, apart double, reach double, query_chunks long, data_chunks long")
    chunk = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    # The plan has a row for each pair of a group and a cell that may hold neighbours: at most MOST_PIVOTS ** 2.
    near = (
        cells.join(plan, "cell")
        .where(F.abs(F.col("apart") - F.col("distance")) <= F.col("reach"))
        .withColumn("data_chunk", chunk("data_chunks"))
        .withColumn("query_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_chunks") - 1)))
    )
    keys = ["grp", "query_chunk", "cell", "data_chunk"]
    spread = (
        groups.select("vec_id", "v", "row", F.col("cell").alias("grp"))
        .join(plan, "grp")
        .withColumn("query_chunk", chunk("query_chunks"))
        .withColumn("data_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("data_chunks") - 1)))
    )

    def solve(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("q_row", "query_id", "vec_id", "score")})
        rows = rows.sort_values("vec_id", kind="stable")
        q, v = _matrix(queries["v"], dim), _matrix(rows["v"], dim)
        if exact_float:
            score = (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
        else:
            score = q @ v.T
        own = queries["row"].to_numpy()[:, None] == rows["row"].to_numpy()[None, :]
        # Rows are in id order, so a stable sort puts equal scores in id order; own rows go last.
        order = np.lexsort((np.broadcast_to(np.arange(len(rows)), score.shape), -score, own), axis=1)[:, : k + 1]
        mine = np.take_along_axis(own, order, 1)
        at, place = np.nonzero(~mine & (np.arange(order.shape[1]) < k)[None, :])
        picked = order[at, place]
        return pd.DataFrame({
            "q_row": queries["row"].to_numpy()[at], "query_id": queries["vec_id"].to_numpy()[at],
            "vec_id": rows["vec_id"].to_numpy()[picked], "score": score[at, picked],
        })

    found = (
        spread.select(*keys, "vec_id", "v", "row")
        .groupBy(*keys)
        .cogroup(near.select(*keys, "vec_id", "v", "row").groupBy(*keys))
        .applyInPandas(lambda a, b: solve(a, b), _FOUND)
    )
    best = Window.partitionBy("q_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
