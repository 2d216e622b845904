"""Many conditions counted in one pass."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 50  # conditions per aggregate: keeps the generated code of one stage small


def count_conditions(df: DataFrame, dims: Sequence[str], names: Sequence[str], applies: Sequence[Column],
                     hits: Sequence[Column]) -> DataFrame:
    """Long frame (*dims, name, n_rows, n_applicable, n_hit): per group, how many rows a condition applies to and
    how many of all rows satisfy it. A null condition counts as not satisfied."""
    out = None
    for at in range(0, len(names), WIDTH):
        part = range(at, min(at + WIDTH, len(names)))
        sums = df.groupBy(*dims).agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[c for i in part for c in (F.count_if(applies[i]).alias(f"_a{i}"), F.count_if(hits[i]).alias(f"_h{i}"))])
        cells = [F.struct(F.lit(names[i]).alias("name"), F.col(f"_a{i}").alias("n_applicable"), F.col(f"_h{i}").alias("n_hit"))
                 for i in part]
        rows = sums.select(*dims, "n_rows", F.inline(F.array(*cells)))
        out = rows if out is None else out.unionByName(rows)
    return out
