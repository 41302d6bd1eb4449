"""The text functions for use in SQL text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import pytext


def register(spark: SparkSession) -> None:
    """``tabloom_fold(text)``, ``tabloom_contents(text)`` and ``tabloom_similarity(found, target)`` in the session."""

    @F.arrow_udf(T.StringType())
    def fold(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in column:
            yield pa.array([None if t is None else pytext.folded_text(t) for t in texts.to_pylist()], pa.string())

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def contents(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in column:
            yield pa.array([pytext.contents_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf(T.DoubleType())
    def similarity(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([None if x is None or y is None else pytext.similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    for name, function in (("tabloom_fold", fold), ("tabloom_contents", contents), ("tabloom_similarity", similarity)):
        spark.udf.register(name, function)
