"""Keep expensive columns from being computed again by a filter above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters read instead of re-evaluating.

    A filter on a derived column is normally pushed below it by repeating its
    whole expression, which for a JSON parse costs more than it saves. Filters
    are not pushed below a generator, here over one-element arrays.
    """
    # Computed in a projection below, where the generated code is split into small
    # methods; the generator only carries the values.
    computed = df.select("*", *[value.alias(f"_{name}") for name, value in columns.items()])
    packed = F.struct(*[F.col(f"_{name}").alias(name) for name in columns])
    return computed.select(*df.columns, F.explode(F.array(packed)).alias("_once")).select(*df.columns, "_once.*")
