"""Bounded samples of labelled rows, for fitting classifiers only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, id_col: str, rows: int, seed: int = 17) -> DataFrame:
    """``rows`` rows of ``df`` at most: one for each of the ``rows`` ids of least hash, of rows that repeat an id the least.

    Null ids are not drawn.  The same rows come out on every run, whatever the partitions, and no part of it depends on
    how large the table is: the distinct ids are counted by 16384 ranges of their hash, and only those up to the range
    in which the last wanted one lies are sorted.  Rows are compared by their columns in order, so these must be sortable.
    """
    key, order = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed))
    ids = df.select(key.alias("__id"), order.alias("__order")).where("__id is not null").distinct()
    part = F.shiftright("__order", 50)
    reached, last = 0, None
    for r in sorted(ids.groupBy(part.alias("part")).count().collect()):  # 16384 rows at most
        if reached >= rows:
            break
        reached, last = reached + r["count"], r["part"]
    picked = ids.where(part <= F.lit(last)).orderBy("__order", "__id").limit(rows).select("__id")
    found = df.join(F.broadcast(picked), key == F.col("__id"), "left_semi")
    least = found.groupBy(key.alias("__id")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("__row"))
    return least.select("__row.*")
