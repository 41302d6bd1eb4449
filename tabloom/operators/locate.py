"""Finding a folded table in a folded text: exact containment, and stretches around anchors' hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.columns import let
from tabloom.functions.pytext import Options


def exact_start(source: Column, query: Column) -> Column:
    """Where ``query`` begins in ``source``, from 0; -1 if it does not occur, or is empty."""
    return F.when(query == "", -1).otherwise(F.position(query, source) - 1)


def _hits(source: Column, anchor: Column, most: int) -> Column:
    """The first ``most`` places, overlapping ones too, from 1.  A -1 at the end of the work stops the search."""

    def step(found: Column, _: Column) -> Column:
        last = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(0))
        more = let(F.position(anchor, source, last + 1), lambda p: F.concat(found, F.array(F.when(p > 0, p).otherwise(-1))))
        return F.when(last < 0, found).otherwise(more)

    return F.filter(F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array().cast("array<int>"), step), lambda p: p > 0)


def candidate_windows(source: Column, query: Column, o: Options = Options()) -> Column:
    """array<struct(start, end)> in order: where the anchors of ``query`` say that a noisy copy may be."""
    least, most, part = o.anchor
    n = F.length(query)
    size = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(n / part).cast("int")))
    pad = F.greatest(F.lit(o.padding[0]), F.floor(n / o.padding[1]).cast("int"))

    def around(size: Column) -> Column:
        starts = F.array_distinct(F.array(F.lit(0), F.greatest(F.lit(0), F.floor(n / 2).cast("int") - F.floor(size / 2).cast("int")), F.greatest(F.lit(0), n - size)))

        def windows(at: Column) -> Column:
            def window(hit: Column) -> Column:
                begin = hit - 1 - at
                return F.struct(F.greatest(F.lit(0), begin - pad).alias("start"), F.least(F.length(source), begin + n + pad).alias("end"))

            return F.transform(_hits(source, F.substring(query, at + 1, size), o.hits), window)

        return F.array_sort(F.array_distinct(F.flatten(F.transform(starts, windows))))

    return F.when((source == "") | (query == ""), F.array().cast("array<struct<start:int,end:int>>")).otherwise(let(size, around))
