"""Constraint tables turned into violation rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``kind`` is required, enum, min, max, max_length, pattern, min_items, unique_items or const."""

    column: str
    kind: str
    arg: object = None

    def broken(self) -> Column:
        c = F.col(self.column)
        return {
            "required": lambda: c.isNull(),
            "enum": lambda: ~c.isin(*self.arg),
            "min": lambda: c < self.arg,
            "max": lambda: c > self.arg,
            "max_length": lambda: F.length(c) > self.arg,
            "pattern": lambda: ~c.rlike(self.arg),
            "min_items": lambda: F.size(c) < self.arg,
            "unique_items": lambda: F.size(F.array_distinct(c)) < F.size(c),
            "const": lambda: c != F.lit(self.arg),
        }[self.kind]()

    @property
    def name(self) -> str:
        return f"{self.column}.{self.kind}"


def violations(df: DataFrame, dataset: str, key: str, rules: list[Rule]) -> DataFrame:
    """``dataset, row_id, rule, value`` for each broken rule, in one pass. A null breaks only ``required``."""
    found = [F.when(r.broken(), F.struct(F.lit(r.name).alias("rule"), F.col(r.column).cast("string").alias("value"))) for r in rules]
    x = df.select(F.col(key).cast("string").alias("row_id"), F.explode(F.array_compact(F.array(*found))).alias("v"))
    return x.select(F.lit(dataset).alias("dataset"), "row_id", "v.rule", "v.value")
