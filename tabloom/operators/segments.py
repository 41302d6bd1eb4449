"""Choosing among overlapping tables and cutting the text around the chosen ones: two folds over a record's array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.columns import let
from tabloom.operators.spans import slice_of

_SPAN = "struct<start:int,end:int,idx:int,score:double,similarity:double>"


def chosen_spans(matches: Column) -> Column:
    """array<struct(start, end, idx, score, similarity)>, disjoint and in order of place.

    By start, end and index; one that begins within the last chosen takes its place only if (score, similarity,
    length) is greater.
    """
    spans = F.transform(
        F.filter(matches, lambda m: m["body_start"].isNotNull()),
        lambda m: F.struct(m["body_start"].alias("start"), m["body_end"].alias("end"), m["table_idx"].alias("idx"), m["exact_score"].alias("score"), m["exact_similarity"].alias("similarity")).cast(_SPAN),
    )

    def rank(m: Column) -> Column:
        return F.struct(m["score"].alias("a"), m["similarity"].alias("b"), (m["end"] - m["start"]).alias("c"))

    def step(kept: Column, m: Column) -> Column:
        def against(last: Column) -> Column:
            instead = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(m))
            return F.when(last.isNull() | (m["start"] >= last["end"]), F.concat(kept, F.array(m))).when(rank(m) > rank(last), instead).otherwise(kept)

        return let(F.try_element_at(kept, F.lit(-1)), against)

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{_SPAN}>"), step)


def cut_text(text: Column, spans: Column, if_nothing: bool = True) -> Column:
    """array<struct(text, type)>: gaps and tail with type 0, spans with type 1; their texts add up to ``text``
    wherever the spans are disjoint.  Without any piece the whole text is one, if ``if_nothing``."""
    piece = "struct<text:string,type:int>"

    def one(start: Column, end: Column, kind: int) -> Column:
        return F.struct(slice_of(text, start, end).alias("text"), F.lit(kind).alias("type")).cast(piece)

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.array(one(acc["at"], s["start"], 0))).otherwise(F.array().cast(f"array<{piece}>"))
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.array(one(s["start"], s["end"], 1))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{piece}>").alias("out"))

    def finish(acc: Column) -> Column:
        tail = F.when(acc["at"] < F.length(text), F.concat(acc["out"], F.array(one(acc["at"], F.length(text), 0)))).otherwise(acc["out"])
        whole = F.array(F.struct(text.alias("text"), F.lit(0).alias("type")).cast(piece))
        return let(tail, lambda t: F.when(F.size(t) == 0, whole).otherwise(t)) if if_nothing else tail

    return F.aggregate(spans, zero, step, finish)
