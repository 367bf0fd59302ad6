"""Sequential folds over ordered series, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def folded(df: DataFrame, group: str | list[str], order: list[str], value: str | Column, name: str, kind: str, f: Callable[[list], list]) -> DataFrame:
    """``df`` with ``name``: ``f`` of each group's ordered values, one result for each row.

    A group's rows meet in one task, and its values cross to Python once; so a group
    should be a bounded series (for example a series and day).
    """
    groups = [group] if isinstance(group, str) else group
    rows = df.withColumn("_fold", F.col(value) if isinstance(value, str) else value)

    def run(table):
        table = table.sort_by([(c, "ascending") for c in order])
        out = pa.array(f(table.column("_fold").to_pylist()), ARROW[kind])
        return table.drop_columns(["_fold"]).append_column(name, out)

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    return rows.groupBy(*groups).applyInArrow(run, f"{fields}, `{name}` {kind}")
