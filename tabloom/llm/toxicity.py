"""Toxicity: a factorization machine over hashed terms.

A text is the set of its hashed terms: lower-case words, and word beginnings of 4, 5 and 6 bytes, which carry over
to inflected forms that the labels never show.  Of the 2^20 buckets the machine keeps those whose presence goes with
the label beyond chance (a likelihood-ratio test), so that the length of a text adds no noise.  The score is
``w0 + sum w_i + sum_{i<j} <v_i, v_j>``: the pairwise part learns what only a combination says, an insult together
with the mention of a group, which additive weights cannot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm._sample import bounded_sample
from tabloom.llm._text import NOT_TERM, U64, Words, as_strings, mix, slices

BITS = 20
PREFIXES = (4, 5, 6)
#: Rows of labelled text that the machine is fitted on, at most.
SAMPLE_ROWS = 6000
#: Below this G^2 (p = 1e-6) an association may be chance; LEAST_FEATURES are kept all the same.
SIGNIFICANT, LEAST_FEATURES = 24.0, 128
THRESHOLD = 0.5
#: Share of a text's terms that a training step sees.
KEEP_TERMS = 0.8


def bucket_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) for each term of each text, repeated terms repeated."""
    w = Words(texts, NOT_TERM)
    length = w.ends - w.starts
    docs, hashes = [w.doc], [w.hashes()]
    for k in PREFIXES:
        longer = length > k
        docs.append(w.doc[longer])
        hashes.append(w.hashes(k)[longer] + U64(k * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    return np.concatenate(docs), (mix(np.concatenate(hashes)) >> U64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Machine:
    """``buckets`` holds the kept buckets; ``w0``, ``w`` and ``v`` (features x rank) are the machine's weights."""

    buckets: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def table(self) -> np.ndarray:
        at = np.full(1 << BITS, -1, np.int32)
        at[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return at

    def logits(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` texts from their distinct (text, feature) pairs."""
        linear = np.bincount(doc, self.w[feature], n)
        pair = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[feature, f]
            pair += np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n)
        return self.w0 + linear + pair / 2

    def scores(self, texts: pa.Array, table: np.ndarray) -> np.ndarray:
        out = np.empty(len(texts))
        m = max(1, len(self.buckets))
        for at, part in slices(texts):
            doc, bucket = bucket_pairs(part)
            feature = table[bucket]
            hit = feature >= 0
            pairs = np.unique(doc[hit].astype(np.int64) * m + feature[hit])
            out[at : at + len(part)] = self.logits(pairs // m, pairs % m, len(part))
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def _g2(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Likelihood-ratio statistic of presence (a of na, b of nb)."""

    def xlogx(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    n = na + nb
    return 2 * (xlogx(a) + xlogx(b) + xlogx(na - a) + xlogx(nb - b) - xlogx(a + b) - xlogx(n - a - b) - xlogx(np.float64(na)) - xlogx(np.float64(nb)) + xlogx(np.float64(n)))


def train(rows: list[np.ndarray], labels: np.ndarray, rank: int = 8, epochs: int = 60, seed: int = 5, keep_terms: float = KEEP_TERMS) -> Machine:
    """From the distinct buckets of each text and its label.  Without both labels it is a machine that scores by the prior."""
    y = labels.astype(np.float64)
    n, positive = len(y), int(y.sum())
    if not n or positive in (0, n):
        prior = (positive + 0.5) / (n + 1)
        return Machine(np.zeros(0, np.int64), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, rank)))
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    bucket = np.concatenate(rows)
    seen = np.bincount(bucket, minlength=1 << BITS).astype(np.float64)
    with_label = np.bincount(bucket, y[doc], 1 << BITS)
    there = np.flatnonzero(seen >= 2)
    g = _g2(with_label[there], seen[there] - with_label[there], positive, n - positive)
    order = np.lexsort((there, -seen[there], -g))
    keep = max(int((g > SIGNIFICANT).sum()), LEAST_FEATURES)
    kept = np.sort(there[order[:keep]])
    table = np.full(1 << BITS, -1, np.int32)
    table[kept] = np.arange(len(kept))
    f = table[bucket]
    doc, f = doc[f >= 0], f[f >= 0]
    first = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w0, w, v = np.array([np.log(positive / (n - positive))]), np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), rank))
    weight = np.where(y == 1, min(10.0, (n - positive) / positive) ** 0.5, 1.0)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w0, w, v)]
    step, size = 0, 128
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // size)):
            # of a text's terms some are left out each time, so that each insult counts without the others, too
            xb = np.zeros((len(part), len(kept)), np.float32)
            for row, i in zip(xb, part, strict=True):
                row[f[first[i] : first[i + 1]]] = 1
            xb *= rng.random(xb.shape) < keep_terms
            xv = xb @ v
            z = w0[0] + xb @ w + ((xv**2).sum(1) - xb @ (v**2).sum(1)) / 2
            err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[part]) * weight[part] / len(part)
            back = xb.T @ err
            grads = (np.array([err.sum()]), back + 1e-4 * w, xb.T @ (err[:, None] * xv) - back[:, None] * v + 1e-4 * v)
            step += 1
            for p, gr, s in zip((w0, w, v), grads, state, strict=True):
                s[0] = 0.9 * s[0] + 0.1 * gr
                s[1] = 0.999 * s[1] + 0.001 * gr * gr
                p -= 0.03 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
    return Machine(kept, float(w0[0]), w, v)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fitted on ``rows`` labelled ids at most (those of least hash), whole texts each.

    Rows with a null id or label and null texts are not used.  An id counts once: of contradicting labels the least
    is believed, of several texts the least read.  The texts stay on the executors, which send only their hashed terms.
    """
    picked = bounded_sample(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null"), "id", rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, part in slices(as_strings(batch.column(1))):
                doc, bucket = bucket_pairs(part)
                pairs = np.unique(doc.astype(np.int64) << BITS | bucket)
                found += np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(pairs >> BITS, np.arange(1, len(part))))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([x for x in found], pa.list_(pa.int32()))], names=["y", "buckets"])

    # the sample has a fixed bound, so it may go to every executor; of rows that repeat an id the least text is read
    labelled = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text").mapInArrow(terms, "y int, buckets array<int>").toArrow()
    lists = labelled.column("buckets").combine_chunks()
    rows_ = [lists[i].values.to_numpy(zero_copy_only=False) for i in range(len(lists))]
    order = sorted(range(len(rows_)), key=lambda i: rows_[i].tobytes())  # the same whatever order the rows came in
    return train([rows_[i] for i in order], labelled.column("y").to_numpy()[order])


def toxicity(machine: Machine, text: Column) -> Column:
    """The probability that ``text`` is toxic; null for a null text, the prior's for one without known terms."""

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = machine.table()
        for texts in batches:
            yield pa.array(machine.scores(as_strings(texts), table), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return score(text)


def scored(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxicity, toxic) for each row; a null text has a null score and counts as not toxic.

    Rows are scored one by one: repeated rows get equal scores, null ids stay, other columns are not looked at.
    """
    out = df.select(F.col(id_col).alias("doc_id"), toxicity(machine, F.col(text_col)).alias("toxicity"))
    return out.withColumn("toxic", F.coalesce(F.col("toxicity") >= threshold, F.lit(False)))


def clean(df: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, unchanged, whose text is not toxic; null texts stay."""
    return df.where(F.coalesce(toxicity(machine, F.col(text_col)) < threshold, F.lit(True)))
