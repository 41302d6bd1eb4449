"""Ratcliff-Obershelp similarity, which no built-in function measures, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import pytext

BLOCKS = T.StructType([T.StructField("matched", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_BLOCKS = pa.struct([("matched", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _pairs(batches: Iterator[tuple[pa.Array, pa.Array]], of, kind: pa.DataType) -> Iterator[pa.Array]:
    for left, right in batches:
        both = zip(left.to_pylist(), right.to_pylist(), strict=True)
        yield pa.array([None if a is None or b is None else of(a, b) for a, b in both], kind)


def ratio(left: Column, right: Column, autojunk: bool = False) -> Column:
    """The ratio of two texts as they are; the order matters.  Null if either is null."""

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _pairs(batches, lambda a, b: pytext.ratio(a, b, autojunk), pa.float64())

    return run(left, right)


def similarity(found: Column, target: Column) -> Column:
    """The ratio of two texts' folded forms: 1 for two empty ones, 0 for an empty and another.  Null if either is null."""

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _pairs(batches, pytext.similarity, pa.float64())

    return run(found, target)


def match_blocks(query: Column, window: Column) -> Column:
    """struct(matched, start, end): characters in common blocks, and the stretch of the window from first to last."""

    def of(q: str, w: str) -> dict[str, int]:
        blocks = pytext.matching_blocks(q, w)
        if not blocks:
            return {"matched": 0, "start": 0, "end": 0}
        return {"matched": sum(n for _, _, n in blocks), "start": blocks[0][1], "end": blocks[-1][1] + blocks[-1][2]}

    @F.arrow_udf(BLOCKS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _pairs(batches, of, _BLOCKS)

    return run(query, window)
