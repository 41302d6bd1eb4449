"""Near-duplicate documents: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Each text becomes the set of its word shingles.  One hash of a shingle gives both its bin (the top bits) and its
value (the low ones); a bin keeps its least value, so one pass makes the whole signature.  Empty bins borrow from
the bin that a fixed universal hash of (bin, attempt) points to, which keeps the estimator unbiased.  ``rows`` bins
make a band; the documents of a bucket are only compared with the bucket's least ``doc_id``: a star, so the pairs
compared stay linear in the bucket's size and none is dropped for the size of its bucket.  Two similar documents
share several buckets, so one whose centre is like neither does not part them (recall is tested against brute force).
The signatures' estimate only picks candidates: an edge stands if the shingle sets themselves are similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm._durable import checkpointed, discarded
from tabloom.llm._text import U64, Words, as_strings, mix, slices

#: LEAST bounds the estimate of a candidate, LEAST_EXACT the Jaccard similarity of an edge's shingle sets.
BINS, ROWS, SHINGLE, LEAST, LEAST_EXACT = 128, 3, 3, 0.45, 0.55
EMPTY = np.uint32(0xFFFFFFFF)


@lru_cache
def _borrow(bins: int) -> np.ndarray:
    """[attempt, bin] -> the bin to borrow from, the same for every document."""
    a = np.arange(1, 16 * bins + 1, dtype=U64)[:, None]
    i = np.arange(bins, dtype=U64)[None, :]
    return (mix(a * U64(0xD6E8FEB86659FD93) + i * U64(0xA0761D6478BD642F)) % U64(bins)).astype(np.int64)


def densified(sig: np.ndarray) -> np.ndarray:
    """``sig`` with each empty bin filled from the first full bin of its sequence; rows without a full bin stay."""
    full = sig != EMPTY
    some = full.any(axis=1)
    out = sig.copy()
    r, b = np.nonzero(~full & some[:, None])
    table = _borrow(sig.shape[1])
    for attempt in table:
        if not len(r):
            return out
        at = attempt[b]
        hit = full[r, at]
        out[r[hit], b[hit]] = sig[r[hit], at[hit]]
        r, b = r[~hit], b[~hit]
    # 16 x bins attempts failed: practically impossible; the nearest full bin to the right decides, as defined here
    for x, y in zip(r, b, strict=True):
        steps = np.roll(full[x], -y)
        out[x, y] = sig[x, (y + int(steps.argmax())) % sig.shape[1]]
    return out


def shingles(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each) of all shingles, repeats among them.  A text of fewer words than a shingle is one shingle."""
    w = Words(texts)
    h, doc = mix(w.hashes()), w.doc
    if not len(h):
        return h, doc
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    place = np.arange(len(h)) - first[doc]
    s = h.copy()
    for j in range(1, shingle):
        nxt = np.zeros_like(h)
        nxt[:-j] = h[j:]
        nxt[place + j >= count[doc]] = 0
        s = mix(s * U64(0x9FB21C651E98DF25) + nxt)
    use = (place + shingle <= count[doc]) | (place == 0)
    return s[use], doc[use]


def signatures(texts: pa.Array, bins: int = BINS, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """uint32 [n, bins], and whether the text has a word at all."""
    if bins < 2 or bins & (bins - 1):
        raise ValueError("bins must be a power of two")
    n, shift = len(texts), U64(64 - int(bins).bit_length() + 1)
    sig = np.full((n, bins), EMPTY, dtype=np.uint32)
    for at, part in slices(texts):
        s, d = shingles(part, shingle)
        np.minimum.at(sig.reshape(-1), (at + d) * bins + (s >> shift).astype(np.int64), (s & U64(0xFFFFFFFE)).astype(np.uint32) >> np.uint32(1))
    return densified(sig), (sig != EMPTY).any(axis=1)


def jaccard(a: pa.Array, b: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The Jaccard similarity of the shingle sets of ``a[i]`` and ``b[i]``; 0 where neither has a word."""
    out = np.zeros(len(a))
    for at, part in slices(a):
        for i, other in slices(b.slice(at, len(part))):
            x, y = (_sets(t, shingle) for t in (part.slice(i, len(other)), other))
            for j, (p, q) in enumerate(zip(x, y, strict=True)):
                both = len(np.intersect1d(p, q, assume_unique=True))
                out[at + i + j] = both / max(1, len(p) + len(q) - both)
    return out


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    s, doc = shingles(texts, shingle)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [np.unique(s[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """uint64 [n, bins // rows]: a hash of each band and its number."""
    bands = sig.shape[1] // rows
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(U64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), parts.shape[:2])
    for j in range(rows):
        h = mix(h + parts[:, :, j] * U64(0xC2B2AE3D27D4EB4F) + U64(j + 1))
    return h


def _signed(df: DataFrame, id_col: str, text_col: str, bins: int, rows: int, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, has = signatures(as_strings(batch.column(1)), bins, shingle)
            keep = np.flatnonzero(has)
            sig = np.ascontiguousarray(sig[keep])
            keys = band_keys(sig, rows).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(bins), len(keep), [None, pa.py_buffer(mix(sig.astype(U64)).astype(np.uint8))]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1))),
                    batch.column(2).take(pa.array(keep)),
                ],
                names=["id", "sig", "bands", "whole"],
            )

    picked = _texts(df, id_col, text_col).withColumn("whole", F.xxhash64("text"))
    return picked.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, sig binary, bands array<long>, whole long")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")


@F.arrow_udf(T.DoubleType())
def agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """An unbiased estimate of the Jaccard similarity from two signatures of one byte a bin.

    Bins agree when their values do, and one time in 256 by chance, which is taken off.
    """

    def matrix(x: pa.Array) -> np.ndarray:
        at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
        return np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(x), -1)

    if not len(a):
        return pa.array([], pa.float64())
    return pa.array(((matrix(a) == matrix(b)).mean(axis=1) - 1 / 256) / (1 - 1 / 256))


def similar_edges(signed: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, center, similarity, same) of the stars' edges whose estimate is ``least`` or more, ``same`` for equal texts; ``signed`` has id, sig, bands, whole."""
    left = signed.select("id", F.explode("bands").alias("key"))
    centers = left.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("last > center").drop("last")
    stars = left.join(centers, "key").where("id > center").select("id", "center").distinct()
    a, b = signed.select("id", F.col("sig").alias("sig_a"), F.col("whole").alias("whole_a")), signed.select(F.col("id").alias("center"), F.col("sig").alias("sig_b"), F.col("whole").alias("whole_b"))
    scored = stars.join(a, "id").join(b, "center").select("id", "center", agreement("sig_a", "sig_b").alias("similarity"), (F.col("whole_a") == F.col("whole_b")).alias("same"))
    return scored.groupBy("id", "center").agg(F.max("similarity").alias("similarity"), F.max("same").alias("same")).where(F.col("similarity") >= least)


def confirmed(edges: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST_EXACT) -> DataFrame:
    """(id, center) of the ``edges`` whose texts' shingle sets have a Jaccard similarity of ``least`` or more; ``texts`` has id, text.

    Equal texts need no look; only those of the other edges are brought together.  An edge may come more than once.
    """

    @F.arrow_udf(T.DoubleType())
    def exact(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(jaccard(as_strings(a), as_strings(b), shingle))

    edges = checkpointed(edges.select("id", "center", "same"))
    a, b = texts.select("id", F.col("text").alias("text_a")), texts.select(F.col("id").alias("center"), F.col("text").alias("text_b"))
    looked = edges.where("not same").select("id", "center").join(a, "id").join(b, "center").where(exact("text_a", "text_b") >= least)
    return edges.where("same").select("id", "center").unionByName(looked.select("id", "center"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of the undirected ``edges`` (id, center), root its component's least node.

    Alternating large-star and small-star steps; each is cut from its lineage, and the work is over when a round
    changes no edge.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Large: link every greater neighbour to the least of the neighbourhood; small: every lesser neighbour and the node."""
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        if large:
            out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        return out.where("u > v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = checkpointed(edges.select(F.greatest("id", "center").alias("u"), F.least("id", "center").alias("v")).where("u > v").distinct())
    before = mark(e)
    while before[0]:
        e, last = checkpointed(star(star(e, True), False)), e
        discarded(last)
        now = mark(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, rows: int = ROWS, shingle: int = SHINGLE, least: float = LEAST, least_exact: float = LEAST_EXACT) -> DataFrame:
    """(doc_id, group_id, kept): every document that has a near duplicate, with its group's least ``doc_id``.

    ``doc_id`` names a document: rows that repeat one are one document, as similar to another as the most similar
    of its rows, and may be of any type that sorts.  Rows with a null ``doc_id``, and null, empty or blank texts, are in no group.  Words are runs of
    anything but ASCII white space, in lower case; a text of fewer than ``shingle`` words counts as one shingle.
    Other columns are not looked at.  An empty table gives no rows.
    """
    signed = checkpointed(_signed(df, id_col, text_col, bins, rows, shingle))
    groups = components(confirmed(similar_edges(signed, least), _texts(df, id_col, text_col), shingle, least_exact))
    return groups.select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"), (F.col("id") == F.col("root")).alias("kept"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one document of each near-duplicate group: the least ``doc_id``.

    Rows that are in no group stay, those with a null ``doc_id`` or no words among them.  Of rows that repeat a
    ``doc_id`` one stays, that with the least text.
    """
    ids = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).count().where("count > 1").select("id", F.lit("repeat").alias("why"))
    gone = near_duplicates(df, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias("id"), F.lit("copy").alias("why"))
    verdict = checkpointed(gone.unionByName(ids).groupBy("id").agg(F.min("why").alias("why")))
    # the row as a struct, so that no name of its columns can clash with one of these
    rows = df.select(F.col(id_col).alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    stay = rows.join(verdict.select(F.col("id").alias("key")), "key", "left_anti").select("row.*")
    again = verdict.where("why = 'repeat'").select(F.col("id").alias("key"))
    if again.isEmpty():
        return stay
    least = F.min(F.struct(F.coalesce(F.col("row")[text_col], F.lit("")).alias("order"), F.col("row").alias("row"))).alias("least")
    return stay.unionByName(rows.join(again, "key", "left_semi").groupBy("key").agg(least).select("least.row.*"))
