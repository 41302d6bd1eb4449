"""Personal data: a semi-Markov conditional random field over spans.

The text is read as islands: neighbouring white-space tokens that hold a digit or an ``@``, or belong to an IBAN in
groups whose check digits are right (no entity type here lacks them all, so everything outside is certain).  An island's units are runs of letters, runs of digits and single
other characters.  A segmentation covers the units by entities of at most ``LONGEST`` characters of their type and by single
outside units; features look at a candidate's whole span at once (its shape, check digits, what stands right before and
after it, the word before), which a field over single tokens cannot.  Bounded dynamic programming finds the best
segmentation, choosing boundaries and types together; the same recursion in sums gives the gradient in training.

No table labels personal data, so the field is trained on sentences written by a generator here, of which some
hold look-alikes: versions, dates, prices, order numbers, digests, keys.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm._text import SPACE, as_strings, slices, utf8

TYPES = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN")
#: Characters of the longest permitted entity of each type; all but EMAIL are bounded by their shapes as well.
LONGEST = (254, 44, 15, 23, 11, 42)

#: Bytes before an island in which the word that may name its type stands.
CONTEXT = 24

UNIT = re.compile(r"[^\W\d_]+|\d+|.", re.S)
EMAIL = re.compile(r"[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,}")
IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
PHONE = re.compile(r"\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,4})){2,5}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{1,4}(?:[ /-]\d{2,4}){2,4}")
CARD = re.compile(r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5}")
SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
SHAPES = (EMAIL, PHONE, IP, CARD, SSN, IBAN)
CUES = tuple(re.compile(p, re.I) for p in (r"e-?mail|mail|contact|write", r"tel|phone|call|fax|mobile|cell", r"ip|host|server|address|from", r"card|visa|master|credit|payment", r"ssn|social|security", r"iban|account|bank|konto"))
AGAINST = re.compile(r"version|v|release|section|chapter|license|order|invoice|ticket|isbn|part|serial|id|no|nr|build|by-nc|by-sa", re.I)

# per type: bias, own shape, check digits, clean left and right ends, cue before, look-alike word before, glued, length, whole island
FEATURES = 10


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _checked(kind: int, s: str) -> bool:
    """What the whole span must add up to, beyond its shape."""
    if kind == 2:
        return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in s.split("."))
    if kind == 3:
        d = re.sub(r"\D", "", s)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == 5:
        t = s.replace(" ", "")
        return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
    if kind == 1:
        return 7 <= sum(c.isdigit() for c in s) <= 15
    if kind == 4:
        return s[:3] not in {"000", "666"} and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
    return len(s) <= 254


class Island:
    """The units of a stretch of text and its candidate segments: (first unit, end unit, type, features)."""

    def __init__(self, text: str, word_before: str) -> None:
        self.bounds = [m.span() for m in UNIT.finditer(text)]
        begins, ends = {b: i for i, (b, _) in enumerate(self.bounds)}, {e: i + 1 for i, (_, e) in enumerate(self.bounds)}
        self.candidates: list[tuple[int, int, int, np.ndarray]] = []
        self.outside = [1.0 if text[b].isdigit() else 0.5 if text[b] == "@" else 0.0 for b, _ in self.bounds]
        # of an island: where its first character is that is no opening mark, and where its last is that is no closing one
        self.opens = len(text) - len(text.lstrip(" \"'([<"))
        self.opens_more = len(text) - len(text.lstrip(" \"'([<,;."))
        self.closes = len(text.rstrip(" \"')]>,;.!?:"))
        cue = word_before.rstrip(":").rsplit(None, 1)[-1] if word_before.strip() else ""
        at = -1  # of the next @
        for b, i in begins.items():
            if not (text[b].isalnum() or text[b] in "+(_"):
                continue
            if at < b:
                at = text.find("@", b)
                at = len(text) + LONGEST[0] if at < 0 else at
            for kind, shape in enumerate(SHAPES):
                if kind == 0 and at - b >= LONGEST[0]:
                    continue
                # every end at which the shape matches, the longest and each shorter one
                stop = min(len(text), b + LONGEST[kind])
                while (m := shape.match(text, b, stop)) and m.end() > b:
                    e = m.end()
                    if e in ends:
                        self.candidates.append((i, ends[e], kind, self._features(text, b, e, kind, cue, (self.opens, self.opens_more, self.closes))))
                    stop = e - 1

    @staticmethod
    def _features(text: str, b: int, e: int, kind: int, cue: str, edges: tuple[int, int, int]) -> np.ndarray:
        left, right = text[b - 1] if b else " ", text[e] if e < len(text) else " "
        after = text[e + 1] if e + 1 < len(text) else " "
        f = np.zeros(FEATURES)
        f[0] = f[1] = 1
        f[2] = _checked(kind, text[b:e])
        f[3] = not (left.isalnum() or left in "_@.+%-/=#")
        f[4] = not (right.isalnum() or right in "_@/=-+") and not (right in ".:," and after.isalnum())
        if b <= edges[0]:
            f[5] = bool(CUES[kind].fullmatch(cue.strip("\"'([<,;")))
            f[6] = bool(AGAINST.fullmatch(cue.strip("\"'([<,;.#")))
        f[7] = left.isalnum() or right.isalnum() or left in "=-_" or right in "=-_"
        f[8] = min(1.0, (e - b) / 24)
        f[9] = b <= edges[1] and e >= edges[2]
        return f


class Field:
    """Weights [types, FEATURES] and the score of an outside unit that is a digit run (half of it for an ``@``)."""

    def __init__(self, weights: np.ndarray, outside: float) -> None:
        self.weights, self.outside = weights, outside

    def best(self, island: Island) -> list[tuple[int, int, int]]:
        """The segmentation of greatest score, as (begin, end, type) in characters of the island.

        Of equal scores the one with the later entity start, then the first type, is taken.
        """
        n = len(island.bounds)
        top, back = np.zeros(n + 1), [None] * (n + 1)
        by_end: dict[int, list] = {}
        for i, j, kind, f in island.candidates:
            by_end.setdefault(j, []).append((-i, kind, float(self.weights[kind] @ f)))
        for j in range(1, n + 1):
            top[j] = top[j - 1] + self.outside * island.outside[j - 1]
            for minus_i, kind, s in sorted(by_end.get(j, ())):
                if top[-minus_i] + s > top[j]:
                    top[j], back[j] = top[-minus_i] + s, (-minus_i, kind)
        out, j = [], n
        while j:
            if back[j]:
                i, kind = back[j]
                out.append((island.bounds[i][0], island.bounds[j - 1][1], kind))
                j = i
            else:
                j -= 1
        return out[::-1]

    def gradient(self, island: Island, truth: set[tuple[int, int, int]]) -> tuple[float, np.ndarray, float]:
        """Log-likelihood of the true segmentation and its gradient: observed minus expected features."""
        n = len(island.bounds)
        s = [float(self.weights[k] @ f) for _, _, k, f in island.candidates]
        fwd, rev = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        fwd[0] = rev[n] = 0
        out = self.outside * np.array(island.outside)
        for j in range(1, n + 1):
            fwd[j] = np.logaddexp.reduce([fwd[j - 1] + out[j - 1], *(fwd[c[0]] + x for c, x in zip(island.candidates, s, strict=True) if c[1] == j)])
        for i in range(n - 1, -1, -1):
            rev[i] = np.logaddexp.reduce([rev[i + 1] + out[i], *(rev[c[1]] + x for c, x in zip(island.candidates, s, strict=True) if c[0] == i)])
        z, like, covered = fwd[n], 0.0, set()
        g, g_out = np.zeros_like(self.weights), 0.0
        for (i, j, k, f), x in zip(island.candidates, s, strict=True):
            p = np.exp(fwd[i] + x + rev[j] - z)
            hit = (i, j, k) in truth
            g[k] += (hit - p) * f
            if hit:
                like += x
                covered.update(range(i, j))
        for i in range(n):
            real = i not in covered
            like += real * out[i]
            g_out += (real - np.exp(fwd[i] + out[i] + rev[i + 1] - z)) * island.outside[i]
        return like - z, g, g_out


def examples(count: int, seed: int) -> list[tuple[str, str, list[tuple[int, int, int]]]]:
    """(island, word before, entities in characters) as the generator writes them."""
    r = random.Random(seed)
    word = lambda a=2, b=9: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(a, b)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))

    def card() -> str:
        d = r.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if r.random() < 0.7 else r.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        bban = num(r.choice((14, 16, 18)))
        c = r.choice(("DE", "FR", "ES", "NL", "GB"))
        if r.random() < 0.4:
            bban = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) + bban[4:]
        check = 98 - int("".join(str(int(x, 36)) for x in bban + c) + "00") % 97
        s = f"{c}{check:02d}{bban}"
        return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def phone() -> str:
        a, b, c = str(r.randint(200, 999)), num(3), num(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+{r.randint(20, 99)} {num(2)} {num(4)} {num(4)}", f"+{r.randint(30, 59)} {num(3)} {num(3)} {num(3)}", f"0{num(2)} {num(3)} {num(4)}"))

    def email() -> str:
        local = r.choice((word(), f"{word()}.{word()}", f"{word()}.{num(2)}", f"{word()}_{num(3)}", f"{word()}+{word()}"))
        return f"{local}@{r.choice((word(), f'mail{num(1)}.{word()}', f'{word()}-{word()}'))}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'example'))}"

    makers = (email, phone, lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), card, lambda: f"{r.choice(('219', '078', '457'))}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", iban)

    def no_card() -> str:
        d = next(d for d in iter(lambda: "4" + num(15), "") if not luhn(d))
        return d if r.random() < 0.5 else r.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    fakes = (lambda: f"{r.randint(1, 12)}.{r.randint(0, 30)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"${num(3)}.{num(2)}", lambda: num(r.choice((5, 6, 8, 10, 12))), lambda: f'"{hexa(40)}"', lambda: f'"{hexa(40).upper()}"', lambda: f"{hexa(r.choice((32, 64))).upper()}!!", lambda: f"password={hexa(18)}", lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"@{word()}", lambda: f"{num(2)}:{num(2)}", lambda: f"300.{num(3)}.{r.randint(256, 999)}.1", no_card, lambda: f"id={num(16)}", lambda: f"{num(3)}-{num(4)}", lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}", lambda: f"x{num(16)}y")
    out = []
    for _ in range(count):
        text, spans = "", []
        for k in range(r.choice((1, 1, 1, 2, 3))):
            text += " " * bool(k) + r.choice(("", "", "", "", "(", '"'))
            if r.random() < 0.6:
                kind = r.randrange(len(TYPES))
                s = makers[kind]()
                spans.append((len(text), len(text) + len(s), kind))
            else:
                s = r.choice(fakes)()
            text += s + r.choice(("", "", "", ".", ",", ")", ";"))
        before = r.choice(("", word(), word(), word(), "version", "order", "call", "mail", "card", "iban", "from:"))
        out.append((text, before, spans))
    return out


@lru_cache(maxsize=2)
def trained(count: int = 500, epochs: int = 12, seed: int = 11) -> Field:
    """The field of greatest penalised likelihood, nearly, on the generator's sentences (AdaGrad)."""
    data = []
    for text, before, spans in examples(count, seed):
        island = Island(text, before)
        begin, end = {b: i for i, (b, _) in enumerate(island.bounds)}, {e: i + 1 for i, (_, e) in enumerate(island.bounds)}
        truth = {(begin[b], end[e], k) for b, e, k in spans if b in begin and e in end}
        if truth <= {c[:3] for c in island.candidates} and len(truth) == len(spans):
            data.append((island, truth))
    weights, outside = np.zeros((len(TYPES), FEATURES)), 0.0
    sums, sum_out, order = np.full_like(weights, 1e-6), 1e-6, random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for island, truth in data:
            _, g, g_out = Field(weights, outside).gradient(island, truth)
            g -= 1e-4 * weights
            sums += g * g
            sum_out += g_out * g_out
            weights += 0.5 * g / np.sqrt(sums)
            outside += 0.5 * g_out / sum_out**0.5
    return Field(weights, outside)


TRIGGER = np.zeros(256, dtype=bool)
TRIGGER[[*range(48, 58), 64]] = True


CAPITAL, DIGIT = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"))
IBAN_BYTES = re.compile(IBAN.pattern.encode())


def _lettered(data: np.ndarray, offsets: np.ndarray, triggers: np.ndarray) -> np.ndarray:
    """Where, in bytes, letters stand that belong to an IBAN in groups with right check digits."""
    at, out = triggers[(triggers >= 2) & (triggers + 2 < len(data))], []
    at = at[CAPITAL[data[at - 2]] & CAPITAL[data[at - 1]] & DIGIT[data[at]] & DIGIT[data[at + 1]] & (data[at + 2] == 32)]
    for b in (at - 2).tolist():
        doc = int(np.searchsorted(offsets, b, side="right"))
        if b > offsets[doc - 1] and (CAPITAL | DIGIT)[data[b - 1]]:
            continue
        text, stop = data[b : min(b + LONGEST[5], int(offsets[doc]))].tobytes(), LONGEST[5]
        # the longest that adds up, as in Island
        while (m := IBAN_BYTES.match(text, 0, stop)) and not _checked(5, m[0].decode()):
            stop = m.end() - 1
        if m:
            out += [b + x.start() for x in re.finditer(rb"[A-Z]+", m[0])]
    return np.array(out, dtype=np.int64)


def islands(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, begin, end) in bytes: neighbouring tokens with a digit, an @ or letters of an IBAN, one space apart."""
    if not TRIGGER[data].any():
        return
    inside = ~SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    triggers = np.flatnonzero(TRIGGER[data])
    if len(letters := _lettered(data, offsets, triggers)):
        triggers = np.union1d(triggers, letters)
    token = np.searchsorted(starts, triggers, side="right") - 1
    token = token[np.r_[True, token[1:] != token[:-1]]]
    b = starts[token]
    stops = np.flatnonzero(~inside)
    doc = np.searchsorted(offsets, b, side="right") - 1
    gap = np.searchsorted(stops, b)
    e = np.minimum(np.where(gap < len(stops), stops[np.minimum(gap, len(stops) - 1)] if len(stops) else len(data), len(data)), offsets[doc + 1])
    joined = np.r_[False, (b[1:] == e[:-1] + 1) & (doc[1:] == doc[:-1])] if len(b) else np.zeros(0, bool)
    joined &= np.r_[False, (data[np.minimum(e[:-1], len(data) - 1)] == 32)] if len(b) else joined
    first = np.flatnonzero(~joined)
    last = np.r_[first[1:] - 1, len(b) - 1] if len(b) else first
    yield from zip(doc[first].tolist(), b[first].tolist(), e[last].tolist(), strict=True)


def spans(texts: pa.Array, field: Field) -> list[list[tuple[int, int, int]]]:
    """Per text its entities (begin, end, type), offsets in characters."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for at, part in slices(texts):
        data, offsets = utf8(part)
        chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        for doc, b, e in islands(data, offsets):
            before = data[max(int(offsets[doc]), b - CONTEXT) : b].tobytes().decode("utf-8", "ignore")
            text = data[b:e].tobytes().decode("utf-8", "replace")
            found = field.best(Island(text, before))
            if found:
                base = int(chars[b] - chars[offsets[doc]])
                out[at + doc] += [(base + x, base + y, k) for x, y, k in found]
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def entities(text: Column, field: Field | None = None) -> Column:
    """array<struct(type, start, end)>, offsets in characters, in order; empty for null and empty texts."""
    field = field or trained()

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([[{"type": TYPES[k], "start": b, "end": e} for b, e, k in x] for x in spans(as_strings(column), field)], _ARROW)

    return scan(text)


def redacted(text: Column, field: Field | None = None) -> Column:
    """The text with ``[TYPE]`` in place of each entity; null where there is nothing to replace."""
    field = field or trained()

    @F.arrow_udf(T.StringType())
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = as_strings(column)
            out: list[str | None] = [None] * len(texts)
            for i, found in enumerate(spans(texts, field)):
                if found:
                    t, parts, at = texts[i].as_py(), [], 0
                    for b, e, k in found:
                        parts += [t[at:b], f"[{TYPES[k]}]"]
                        at = e
                    out[i] = "".join(parts) + t[at:]
            yield pa.array(out, pa.string())

    return scan(text)


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(doc_id, type, start, end): one row per entity, offsets in characters.

    Rows are read one by one; a repeated row reports its entities again, a null id is kept.  Null and empty texts
    report none, an empty table gives no rows.  A very long text is read whole.  Other columns are not looked at.
    """
    return df.select(F.col(id_col).alias("doc_id"), F.explode(entities(F.col(text_col), field)).alias("x")).select("doc_id", "x.*")


def without_entities(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars", field: Field | None = None) -> DataFrame:
    """``df`` with its texts redacted and, if it has that column, their lengths brought up to date; every row stays.

    Null and empty texts stay as they are; other columns may have any name.
    """
    name = "redacted"
    while name in {c.lower() for c in df.columns}:
        name = f"_{name}"
    columns = {text_col: F.coalesce(F.col(name), F.col(text_col))}
    if chars_col in df.columns:
        columns[chars_col] = F.when(F.col(name).isNotNull(), F.length(name).cast(df.schema[chars_col].dataType)).otherwise(F.col(chars_col))
    return df.withColumn(name, redacted(F.col(text_col), field)).withColumns(columns).drop(name)
