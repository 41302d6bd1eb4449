"""The first version's rules: bodies only, no overlap resolution, a coarse and then a fine sweep for noisy copies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import pytext
from tabloom.functions.columns import barrier, let, strip
from tabloom.functions.normalize import legacy_body, legacy_foldable, legacy_folded_text, legacy_raw_offset, legacy_sizes, legacy_tokens
from tabloom.operators.segments import cut_text

RESULT = T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in (("segments", T.StringType()), ("types", T.IntegerType()), ("similarities", T.DoubleType()))])
_ARROW = pa.struct([("segments", pa.list_(pa.string())), ("types", pa.list_(pa.int32())), ("similarities", pa.list_(pa.float64()))])
_SPAN = "struct<start:int,end:int,idx:int>"
STRINGS = "array<string>"


def legacy_bodies(value: Column, kind: T.DataType) -> Column:
    """array<string> of the bodies of the tables in JSON text or in a VARIANT; whatever else there is has none."""
    if isinstance(kind, T.StringType):
        parsed = F.try_parse_json(value)
    elif isinstance(kind, T.VariantType):
        parsed = F.when(F.schema_of_variant(value) == "STRING", F.try_parse_json(F.try_variant_get(value, "$", "string"))).otherwise(value)
    else:
        parsed = F.to_variant_object(value)

    def texts(v: Column) -> Column:
        items = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.schema_of_variant(x), F.lit("")).startswith("OBJECT"))
        contents = F.transform(items, lambda x: F.try_variant_get(x, "$.content", "variant"))
        return F.transform(F.filter(contents, lambda c: F.coalesce(F.schema_of_variant(c), F.lit("")) == "STRING"), lambda c: F.try_variant_get(c, "$", "string"))

    def bodies(found: Column) -> Column:
        kept = F.transform(F.filter(found, lambda c: strip(c) != ""), legacy_body)
        return F.filter(kept, lambda b: strip(b) != "")

    return F.coalesce(bodies(let(parsed, texts)), F.array().cast(STRINGS))


def _dense(raw: Column) -> Column:
    """The first version's form of a foldable text, as its tokens spell it: what blanks part is still one ``<br>``."""
    return F.lower(F.regexp_replace(raw, F.lit(r"(?isU)<[ \n\r\t]*b[ \n\r\t]*r\s*/?\s*>|[ \n\r\t]+"), F.lit("")))


def _exact(raw: Column, bodies: Column) -> Column:
    """The result of a record whose tables all occur as they are; null for others."""

    def with_sizes(sizes: Column) -> Column:
        def with_source(source: Column) -> Column:
            def span(body: Column, i: Column) -> Column:
                def place(query: Column) -> Column:
                    at = F.position(query, source) - 1
                    offs = let(at, lambda a: F.struct(legacy_raw_offset(sizes, a).alias("p0"), legacy_raw_offset(sizes, a + F.length(query) - 1).alias("p1")))
                    hit = legacy_foldable(body) & (query != "") & (at >= 0)
                    return F.when(hit, let(offs, lambda o: F.struct(o["p0"].alias("start"), (o["p1"] + 1).alias("end"), i.alias("idx")).cast(_SPAN)))

                return let(legacy_folded_text(body), place)

            return F.transform(bodies, span)

        return let(_dense(raw), with_source)

    def cut(spans: Column) -> Column:
        # the same text on either side, so every similarity is 1
        ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["idx"] - b["idx"]))
        pieces = let(ordered, lambda s: cut_text(raw, s, if_nothing=False))
        row = let(pieces, lambda p: F.struct(F.transform(p, lambda x: x["text"]).alias("segments"), F.transform(p, lambda x: x["type"]).alias("types"), F.transform(spans, lambda s: F.lit(1.0)).alias("similarities")))
        return F.when(~F.exists(spans, lambda s: s.isNull()), row.cast("struct<segments:array<string>,types:array<int>,similarities:array<double>>"))

    whole = F.struct(F.array(raw).alias("segments"), F.array(F.lit(0)).alias("types"), F.array().cast("array<double>").alias("similarities"))
    return F.when(F.size(bodies) == 0, whole).when(legacy_foldable(raw), let(let(legacy_sizes(legacy_tokens(raw)), with_sizes), cut))


def with_legacy_segments(df: DataFrame, raw: str, bodies: str, least: float = 0.5, out: str = "__legacy") -> DataFrame:
    """``df`` and ``out``, struct(segments, types, similarities).

    Similarities come in order of place, and after them a zero for every table that was not found.
    """

    @F.arrow_udf(RESULT)
    def sweep(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            both = zip(texts.to_pylist(), lists.to_pylist(), strict=True)
            rows = [None if t is None else dict(zip(RESULT.names, pytext.legacy_cut(t, b, least), strict=True)) for t, b in both]
            yield pa.array(rows, _ARROW)

    stepped = df.withColumn("__exact", _exact(F.col(raw), F.col(bodies)))
    hard = F.col("__exact").isNull()
    stepped = stepped.withColumn("__swept", barrier(sweep)(F.when(hard, F.col(raw)), F.when(hard, F.col(bodies))))
    return stepped.withColumn(out, F.coalesce("__exact", "__swept")).drop("__exact", "__swept")
