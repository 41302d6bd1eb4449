"""Language identification: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge regression.

Two texts are as close as the number of distinct character 1-, 2- and 3-grams they share (each length counts, hence
blended; presence only, so the length of a text does not matter), divided by the geometric mean of what each shares
with itself.  The alphabet is every character of the sample in lower case; those it never showed fold into one class,
so the grams have exact numbers and nothing is hashed.  Landmark texts span the Nystroem space; one ridge regression
for each language is solved there.  As the kernel is linear in the presence vectors, the landmarks fold into one
matrix of grams by languages, and a batch is scored by one matrix product.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm._sample import bounded_sample
from tabloom.llm._text import as_strings

LANDMARKS = 192
#: Numbers of grams up to which tables by number are kept.
DENSE = 1 << 24
#: Rows of labelled text that the regression is fitted on, at most.
SAMPLE_ROWS = 1600
#: Characters of a text that the regression may be fitted on; longer ones are scored like all others.
SAMPLE_CHARS = 100_000
RIDGE = 1e-3


def alphabet_of(texts: list[str]) -> np.ndarray:
    """Code point -> class, for the whole of Unicode: every character of the texts in lower case has one, others have 0.

    A capital has its small letter's.
    """
    table = np.zeros(0x110000, np.int32)
    for i, c in enumerate(sorted(set().union(*(t.lower() for t in texts)))):
        table[ord(c)] = i + 1
        if len(c.upper()) == 1 and c.upper().lower() == c:
            table[ord(c.upper())] = i + 1
    return table


class Grams:
    """The 1-, 2- and 3-grams over a folded alphabet, by number.

    A gram's number is exact: its characters' classes are the digits, and each length has a range of its own.
    """

    def __init__(self, table: np.ndarray, columns: np.ndarray | None = None) -> None:
        self.table, self.a, self.columns = table, int(table.max()) + 1, columns
        size = self.a + self.a**2 + self.a**3
        # few numbers are looked up, many are searched for: the same result either way
        self.last = np.zeros(size, np.int32) if size <= DENSE else None
        self.where = None
        if columns is not None and self.last is not None:
            self.where = np.full(size, -1, np.int32)
            self.where[columns] = np.arange(len(columns), dtype=np.int32)

    def of(self, text: str) -> np.ndarray:
        """The distinct grams that occur in the whole text."""
        a = self.a
        c = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        c = c if self.last is not None else c.astype(np.int64)
        two = c[:-1] * a + c[1:]
        n = len(c)
        codes = np.empty(n + max(0, n - 1) + max(0, n - 2), c.dtype)
        codes[:n] = c
        codes[n : n + len(two)] = two + a
        codes[n + len(two) :] = two[:-1] * a + c[2:] + (a + a * a)
        if self.last is None:
            return np.unique(codes)
        # of equal numbers the last one written stays
        order = np.arange(len(codes), dtype=np.int32)
        self.last[codes] = order
        return codes[self.last[codes] == order]

    def presence(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """float32 [sets, columns]: which of the columns each set has; and the root of each set's size, at least 1."""
        out = np.zeros((len(sets), len(self.columns)), np.float32)
        for row, s in zip(out, sets, strict=True):
            if self.where is not None:
                at = self.where[s]
                row[at[at >= 0]] = 1
            elif len(self.columns):
                at = np.minimum(np.searchsorted(self.columns, s), len(self.columns) - 1)
                row[at[self.columns[at] == s]] = 1
        return out, np.sqrt([max(1.0, len(s)) for s in sets])


@dataclass(frozen=True)
class Classifier:
    """``weights`` [grams, languages] over ``columns``, the grams that any landmark has."""

    languages: tuple[str, ...]
    alphabet: dict[int, int]
    columns: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def table(self) -> np.ndarray:
        t = np.zeros(0x110000, np.int32)
        t[list(self.alphabet)] = list(self.alphabet.values())
        return t

    def scores(self, texts: list[str], table: np.ndarray, batch: int = 32) -> np.ndarray:
        out, grams = np.zeros((len(texts), len(self.languages)), np.float32), Grams(table, self.columns)
        for i in range(0, len(texts), batch):
            p, size = grams.presence([grams.of(t) for t in texts[i : i + batch]])
            out[i : i + batch] = (p @ self.weights) / size[:, None]
        return out + self.bias


def train(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
    """One ridge regression per language, +1 for its texts and -1 for the others; landmarks are the first texts."""
    names = tuple(sorted(set(languages)))
    table = alphabet_of(texts)
    if not texts:
        return Classifier((), {}, np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    sets = [g.of(t) for g in [Grams(table)] for t in texts]
    columns = np.unique(np.concatenate(sets[:landmarks]))
    grams = Grams(table, columns)
    marks_c, self_marks = grams.presence(sets[:landmarks])
    k_nm = np.zeros((len(texts), len(marks_c)))
    for i in range(0, len(texts), 32):
        p, size = grams.presence(sets[i : i + 32])
        k_nm[i : i + 32] = (p @ marks_c.T) / size[:, None] / self_marks
    values, vectors = np.linalg.eigh(k_nm[: len(marks_c)])
    keep = values > 1e-6 * max(1.0, values.max())
    half = vectors[:, keep] / np.sqrt(values[keep])  # K_mm^(-1/2) on its range
    phi = k_nm @ half
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    mean = y.mean(axis=0)
    solved = np.linalg.solve(phi.T @ phi + ridge * len(texts) * np.eye(phi.shape[1]), phi.T @ (y - mean))
    weights = marks_c.T.astype(np.float64) @ ((half @ solved) / self_marks[:, None])
    used = np.flatnonzero(table)
    return Classifier(names, {int(c): int(table[c]) for c in used}, columns, weights.astype(np.float32), mean.astype(np.float32))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, most_chars: int = SAMPLE_CHARS) -> Classifier:
    """Fitted on ``rows`` labelled ids at most (those of least hash), one row and its whole text each.

    Rows with a null id or language and null or empty texts are not used, nor texts of more than ``most_chars``
    characters, so what the driver gets is bounded.  Without any row the classifier knows no
    language and answers null.
    """
    known = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = bounded_sample(known.where("id is not null and lang is not null").where(F.length("text").between(1, most_chars)), "id", rows).collect()
    sample.sort(key=lambda r: (hashlib.md5(r["text"].encode()).digest(), r["lang"]))
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


SCHEMA = T.StructType([T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())])


def language(model: Classifier, text: Column) -> Column:
    """struct(language, score, margin to the next); all null for a null or empty text.

    Of equal scores the alphabetically first language wins.
    """

    @F.arrow_udf(SCHEMA)
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = model.table()
        names = pa.array(model.languages, pa.string())
        for column in batches:
            texts = as_strings(column).to_pylist()
            none = np.array([not t or not model.languages for t in texts], dtype=bool)
            if model.languages:
                s = model.scores(texts, table).astype(np.float64)
                top = s.argmax(axis=1)
                score = s[np.arange(len(s)), top]
                s[np.arange(len(s)), top] = -np.inf
                margin = score - s.max(axis=1) if s.shape[1] > 1 else score
            else:
                top, score, margin = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            lang = names.take(pa.array(top, mask=none))
            yield pa.StructArray.from_arrays([lang, pa.array(np.round(score, 6), mask=none), pa.array(np.round(margin, 6), mask=none)], fields=[pa.field("language", pa.string()), pa.field("score", pa.float64()), pa.field("margin", pa.float64())])

    return best(text)


def identified(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, score, margin), one row for each of ``df``; other columns are not looked at.

    Repeated rows get equal answers, null ids stay, null and empty texts get nulls, an empty table gives no rows.  A very
    long text is read whole; its memory grows with its length.
    """
    return df.select(F.col(id_col).alias("doc_id"), language(model, F.col(text_col)).alias("x")).select("doc_id", "x.*")
