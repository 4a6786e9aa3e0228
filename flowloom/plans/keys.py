"""Joins in which an absent key is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """`left` joined with `right` on equal keys, NULL equal to NULL; the keys of `left` stay."""
    renamed, condition = right, None
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"__right{i}")
        part = F.col(k).eqNullSafe(F.col(f"__right{i}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__right{i}" for i in range(len(keys))])
