"""Header and body of a table, and the table's row, for texts that column expressions fold exactly.

A table that occurs as it is gets its row here without leaving the JVM; ``matching`` sends the others on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.columns import leading_blank, let, strip, trailing_blank
from tabloom.functions.normalize import BREAKS, foldable, folded_text, raw_offsets
from tabloom.functions.pytext import Options
from tabloom.operators.locate import candidate_windows, exact_start

ROW = (
    "table_idx int, peer_content string, peer_body string, matched boolean, extracted_table string, similarity double, match_score double, "
    "match_mode string, full_start int, full_end int, body_start int, body_end int, exact_similarity double, exact_score double"
)
ROW_TYPE = "struct<" + ", ".join(f"{n}: {t}" for n, t in (x.split() for x in ROW.split(", "))) + ">"


def slice_of(text: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` up to ``end``, from 0."""
    return F.substring(text, start + 1, end - start)


def trimmed(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) without the blanks at either end; both are ``end`` where all is blank."""
    part = slice_of(text, start, end)
    lead = leading_blank(part)
    return F.when(lead == end - start, F.struct(end.alias("start"), end.alias("end"))).otherwise(F.struct((start + lead).alias("start"), (end - trailing_blank(part)).alias("end")))


def header_and_body(content: Column, stripped: bool = True) -> Column:
    """struct(body, header): the text after the first break, and the folded length of what is before; null without one."""
    whole = strip(content)
    parts = F.split(whole if stripped else content, BREAKS, 2)

    def decide(body: Column) -> Column:
        there = (F.size(parts) > 1) & (folded_text(body) != "")
        return F.when(there, F.struct(body.alias("body"), F.length(folded_text(F.get(parts, F.lit(0)))).alias("header"))).otherwise(F.struct(whole.alias("body"), F.lit(None).cast("int").alias("header")))

    return let(strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), decide)


def first_break(span: Column) -> Column:
    """The end of the first break that has something visible on either side; null if there is none."""
    pieces, breaks = F.split(span, BREAKS, -1), F.regexp_extract_all(span, F.lit(BREAKS), F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(breaks)).alias("piece"), breaks.alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["stop"])
        both = (folded_text(slice_of(span, F.lit(0), start)) != "") & (folded_text(slice_of(span, end, F.length(span))) != "")
        return F.when(acc["found"].isNotNull(), acc).otherwise(F.struct(end.alias("at"), F.when(both, end).alias("found")))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("found")), step)["found"]


def _row(idx: Column, content: Column, body: Column, **found: Column) -> Column:
    none = F.lit(None).cast("int")
    where = {k: found.get(k, none) for k in ("full_start", "full_end", "body_start", "body_end")}
    hit = F.lit(bool(found))
    one = F.lit(1.0 if found else 0.0)
    values = {"table_idx": idx, "peer_content": content, "peer_body": body, "matched": hit, "extracted_table": found.get("text", F.lit("")), "similarity": one, "match_score": one, "match_mode": F.lit("exact" if found else "unmatched"), **where, "exact_similarity": one, "exact_score": one}
    return F.struct(*[v.alias(k) for k, v in values.items()]).cast(ROW_TYPE)


def plain_match(raw: Column, sizes: Column, source: Column, content: Column, idx: Column, o: Options) -> Column:
    """The row of a table that occurs as it is or cannot occur; null for whatever these expressions cannot decide.

    A position that comes from a visible character is never blank, so there is nothing to trim.  The header of a
    table without a break is not known; it is decided here only if its place in the text has no break either.
    """

    def placed(query: Column, peer: Column, at: Column) -> Column:
        n, header = F.length(query), peer["header"]
        skip = F.coalesce(header, F.lit(0))

        def cut(p: Column) -> Column:
            begin, end = p["p0"], p["p1"] + 1
            body = F.when(header.isNull(), begin).otherwise(p["p2"])
            text = slice_of(raw, body, end)
            clear = F.when(header.isNull(), ~slice_of(raw, begin, end).rlike(BREAKS)).otherwise(header < n)
            row = _row(idx, content, peer["body"], full_start=begin, full_end=end, body_start=body, body_end=end, text=text)
            # the text folds to its part of the source, unless an entity at its end is cut after its first character
            own = F.when(slice_of(raw, p["p1"], end) == "&", folded_text(text)).otherwise(slice_of(source, at + skip, at + n))
            return F.when(clear & (own == folded_text(peer["body"])), row)

        return let(raw_offsets(raw, sizes, at, at + n - 1, at + skip), cut)

    def found(query: Column) -> Column:
        def with_peer(peer: Column) -> Column:
            nowhere = F.when(F.size(candidate_windows(source, query, o)) == 0, _row(idx, content, peer["body"]))
            return let(exact_start(source, query), lambda at: F.when(at >= 0, placed(query, peer, at)).otherwise(nowhere))

        return let(header_and_body(content, o.stripped), with_peer)

    return F.when(foldable(content), let(folded_text(content), found))
