"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python counts as white space: Unicode's, and the four separators of ASCII.
BLANK = r"[\s\x1c-\x1f]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, which a lambda's body does not get from common subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"(?U)^{BLANK}+|{BLANK}+$"), F.lit(""))


def leading_blank(text: Column) -> Column:
    return F.length(F.regexp_extract(text, rf"(?U)^{BLANK}*", 0))


def trailing_blank(text: Column) -> Column:
    return F.length(F.regexp_extract(text, rf"(?U){BLANK}*$", 0))


def barrier(function: Callable) -> Callable:
    """``function``, a UDF, so that the optimizer never moves its call into an expression above.

    A call that ends up in a lambda's body cannot be evaluated, and one that is copied runs twice.
    """
    return function.asNondeterministic()
