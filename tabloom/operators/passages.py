"""Which texts hold which passages: one automaton of all passages reads each text once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the passages that a task looks for at once; with more, the texts are read once for each block of them.
BLOCK_CHARS = 1 << 25


def _found(text: Column, passages: list[str]) -> Column:
    """array<struct(number, at)>: the passages that occur in ``text``, by number, and where each begins first."""
    import ahocorasick

    kind = T.ArrayType(T.StructType([T.StructField("__n", T.IntegerType()), T.StructField("at", T.LongType())]))
    arrow = pa.list_(pa.struct([("__n", pa.int32()), ("at", pa.int64())]))

    @F.arrow_udf(kind)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = ahocorasick.Automaton()
        for i, p in enumerate(passages):
            machine.add_word(p, (i, len(p)))
        machine.make_automaton()
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                first: dict[int, int] = {}
                for end, (i, n) in machine.iter(t) if t and passages else ():
                    first.setdefault(i, end + 1 - n)
                out.append([{"__n": i, "at": at} for i, at in sorted(first.items())])
            yield pa.array(out, arrow)

    return scan(text)


def passages_in(texts: DataFrame, passages: DataFrame, id_col: str, text_col: str, passage_id: str, passage_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, passage id, at): every text and every passage that it holds, with the first place, from 0.

    Empty and null passages are in no text, null texts hold none; equal passages are all reported.  Neither side is
    shuffled or joined: a block of passages of about ``block_chars`` characters goes to every task, and the blocks'
    results add up.
    """
    known = passages.where(f"`{passage_col}` <> ''").select(F.col(passage_id).alias("id"), F.col(passage_col).alias("p"))
    blocks = max(1, -(-(known.agg(F.sum(F.length("p"))).first()[0] or 0) // block_chars))
    out = None
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("id", "p"), F.lit(blocks)) == b).collect()  # of about ``block_chars`` characters
        names = sorted({r["p"] for r in rows})
        number = {p: i for i, p in enumerate(names)}
        owners = texts.sparkSession.createDataFrame([(number[r["p"]], r["id"]) for r in rows], T.StructType([T.StructField("__n", T.IntegerType()), T.StructField(passage_id, known.schema["id"].dataType)]))
        hits = texts.select(id_col, F.explode(_found(F.col(text_col), names)).alias("__x")).select(id_col, "__x.*")
        part = hits.join(F.broadcast(owners), "__n").select(id_col, passage_id, "at")
        out = part if out is None else out.unionByName(part)
    return out
