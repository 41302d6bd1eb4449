"""The table contents that a peer supplies, from a value of any shape.

Text that parses as JSON, and real objects and arrays, are taken apart by VARIANT expressions.  The vectorised fallback
sees only what they cannot take: Python literals, broken text, contents that are neither texts nor whole numbers
(whose written form is Python's), and contents that need full Unicode folding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import pytext
from tabloom.functions.columns import barrier, let, strip
from tabloom.functions.normalize import foldable, visible

STRINGS = T.ArrayType(T.StringType())


@F.arrow_udf(STRINGS)
def _fallback(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Nulls, the rows of the expressions' path, cost nothing here."""
    for text, is_text in texts:
        out = [None if t is None else pytext.contents_of(t if s else json.loads(t)) for t, s in zip(text.to_pylist(), is_text.to_pylist(), strict=True)]
        # a lone surrogate cannot leave as UTF-8
        yield pa.array([x if x is None else [s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for s in x] for x in out], pa.list_(pa.string()))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _items(v: Column) -> Column:
    """The objects of a variant, as array<variant>; null if it is neither object nor array."""
    objects = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: _kind(x).startswith("OBJECT"))
    return F.when(_kind(v).startswith("OBJECT"), F.array(v)).when(_kind(v).startswith("ARRAY"), objects)


def peer_contents(value: Column, kind: T.DataType) -> Column:
    """array<string> of the contents that fold to something, in order; empty for anything without contents."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return _kept(F.coalesce(value, F.array().cast(STRINGS)))
    if isinstance(kind, T.VariantType):
        text = F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))
        parsed = F.when(text.isNull(), value).otherwise(F.try_parse_json(strip(text)))
        written = F.coalesce(text, F.to_json(value))
    elif isinstance(kind, T.StringType):
        text, parsed, written = value, F.try_parse_json(strip(value)), value
    else:
        text, parsed, written = F.lit(None).cast("string"), F.to_variant_object(value), F.to_json(value)

    def decide(p: Column) -> Column:
        items = _items(p)
        contents = F.transform(items, lambda x: F.try_variant_get(x, "$.content", "variant"))
        easy = F.forall(contents, lambda c: c.isNull() | _kind(c).isin("STRING", "BIGINT", "VOID"))
        strings = F.filter(F.transform(contents, lambda c: F.try_variant_get(c, "$", "string")), lambda s: s.isNotNull())
        # text that parses to no object may still hold contents for the loose scan
        loose = (F.coalesce(F.size(items), F.lit(0)) < 1) & F.coalesce(text.contains("content"), F.lit(False))
        return F.when(~loose & F.coalesce(easy, F.lit(True)) & F.forall(F.coalesce(strings, F.array().cast(STRINGS)), foldable), F.coalesce(strings, F.array().cast(STRINGS)))

    direct = let(parsed, decide)
    blank = value.isNull() | (F.coalesce(text.isNotNull(), F.lit(False)) & (strip(F.coalesce(text, F.lit(""))) == ""))
    hard = direct.isNull() & ~blank
    slow = barrier(_fallback)(F.when(hard, written), F.when(hard, text.isNotNull()))
    return F.when(blank, F.array().cast(STRINGS)).otherwise(F.coalesce(F.filter(direct, visible), slow, F.array().cast(STRINGS)))


@F.arrow_udf(STRINGS)
def _keep(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in lists:
        yield pa.array([None if x is None else [s for s in x if s is not None and pytext.folded_text(s)] for x in column.to_pylist()], pa.list_(pa.string()))


def _kept(contents: Column) -> Column:
    """Of a plain array of contents those that fold to something."""
    easy = F.forall(contents, lambda s: s.isNull() | foldable(s))
    return F.when(easy, F.filter(contents, lambda s: s.isNotNull() & visible(s))).otherwise(barrier(_keep)(F.when(~easy, contents)))
