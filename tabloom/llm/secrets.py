"""Secret scan by token efficiency: text that a tokenizer has never seen costs it many tokens.

Candidates are maximal runs of 16 or more of the characters that keys are made of.  Runs without a digit or a capital
after a small letter look like words: theirs is the stricter bound, unless a credential's name stands before, and it is
held against the letters between their hyphens and slashes, which alone cut names into short tokens.  A byte-pair vocabulary packs words, names and paths into few tokens; a random string gets
little more than its characters' pairs.  A candidate of fewer than 2.2 characters a token is reported, unless it is
known: digests (hexadecimal of a digest's length) and UUIDs, plain numbers, and what the caller lists as known.
A candidate that passes as a whole may be a path or a name with a secret in it: stretches of it that cost many tokens
are judged by themselves, up to the separators around them.
A digest-like string right after a credential's name (``token = "..."``) is no known digest and is reported.

What is assigned to a credential's name by ``=``, ``:`` or ``=>`` is a candidate from 8 characters on, and may hold the
punctuation that passwords do; other runs need 16.  A name counts if it ends within the 64 bytes before the value.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm._text import as_strings, slices, utf8

LEAST_LENGTH, MOST_RATIO = 16, 2.2
#: For runs of capitals only: shouted words, too, are cut into short tokens.
MOST_CAPITALS_RATIO = 1.7
#: For other runs without a digit or a capital after a small letter, most of them words and names.
MOST_PLAIN_RATIO = 1.8
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KEY_BYTES = np.zeros(256, dtype=bool)
KEY_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
NUMBER = re.compile(r"[-+]?[0-9]+(?:[-/_+][0-9]+)*")
LOOKS_RANDOM = re.compile(r"[0-9]|[a-z][A-Z]")
HAS_KEY = re.compile(r"[A-Za-z]|[0-9]{8}")
CAPITALS = re.compile(r"[A-Z]+")
LETTERS = re.compile(r"[A-Za-z]+")
PART = re.compile(r"[A-Za-z0-9]+")
#: Parts of a candidate that are no secret in whatever name or path they stand: UUIDs, digests, numbers.
HARMLESS = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern.removeprefix('(?i)').replace('a-f', 'a-fA-F')}|{DIGEST.pattern}|[0-9]+)(?![A-Za-z0-9])")
#: Tokens more than a readable text has that make a stretch, times MOST_RATIO; how far it may fall back within one.
LEAST_EXCESS, MOST_FALL = 4.0, 8.0
CREDENTIAL = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|key|auth|credential|bearer)[\"']?\s*(?:[:=]|=>)?\s*[\"']?$")
#: Of a value that is assigned to a name: characters, and those that a sentence may have put behind it.
VALUE = re.compile(rb"[A-Za-z0-9+/_=!@#$%^&*.~?:\x80-\xff-]{8,}")
NAMED = re.compile(rb"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|key|auth|credential|bearer)[\"']?[ \t]*$")
AFTER_NAME = re.compile(rb"(?:=|>)?[ \t]*([\"'])?")
_NAME_ENDS = np.zeros(256, dtype=bool)
_NAME_ENDS[[*b"nNtTdDyYhHlLrR\"' \t"]] = True
#: Bytes before a candidate in which a credential's name may stand.
CONTEXT = 64
ASSIGNED = re.compile(r"(?i)^((?:[a-z_-]*(?:token|secret|passw(?:or)?d|pwd|key|auth|credential)[a-z_-]*)=)(.+)$")


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def candidates(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, begin, end) in bytes of each long run of key characters within one text."""
    inside = KEY_BYTES[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    last = np.zeros(len(data), dtype=bool)
    last[:-1] = ~inside[1:]
    last[cuts[cuts > 0] - 1] = True
    if len(data):
        last[-1] = True
    ends = np.flatnonzero(inside & last) + 1
    long = ends - starts >= LEAST_LENGTH
    starts, ends = starts[long], ends[long]
    docs = np.searchsorted(offsets, starts, side="right") - 1
    yield from zip(docs.tolist(), starts.tolist(), ends.tolist(), strict=True)


def assigned(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, begin, end) in bytes of each value that is assigned to a credential's name, unless it is one long run of key characters."""
    marks = np.flatnonzero((data == 58) | (data == 61))
    marks = marks[marks > 0]
    marks = marks[_NAME_ENDS[data[marks - 1]]]
    for at in marks.tolist():
        doc = int(np.searchsorted(offsets, at, side="right")) - 1
        low, high = int(offsets[doc]), int(offsets[doc + 1])
        if not NAMED.search(data[max(low, at - CONTEXT) : at].tobytes()):
            continue
        # a value seldom is long: more is read only where it goes on
        for size in (256, high - at):
            text = data[at + 1 : min(high, at + 1 + size)].tobytes()
            m = AFTER_NAME.match(text)
            v = VALUE.match(text, m.end())
            if v is None or v.end() < len(text) or at + 1 + size >= high:
                break
        if v is None:
            continue
        value = v[0] if m[1] else v[0].rstrip(b".:?")
        if len(value) < 8 or (len(value) >= LEAST_LENGTH and KEY_BYTES[np.frombuffer(value, np.uint8)].all()):
            continue
        yield doc, at + 1 + v.start(), at + 1 + v.start() + len(value)


def judged(run: str, before: str, known: frozenset[str], encoding, most_ratio: float) -> tuple[int, int, int] | None:
    """(begin in the run, characters, tokens) of the secret that ``run`` holds, or None."""
    skip = len(run) - len(run.lstrip("=-_+/"))
    named = bool(CREDENTIAL.search(before))
    text = run[skip:].rstrip("=") if not skip else run[skip:]
    if m := ASSIGNED.match(text):
        skip, text, named = skip + len(m[1]), m[2], True
    if len(text) < (8 if named else LEAST_LENGTH) or text in known or NUMBER.fullmatch(text) or not HAS_KEY.search(text):
        return None
    if not named and (DIGEST.fullmatch(text) or UUID.fullmatch(text)):
        return None
    if CAPITALS.fullmatch(text):
        most_ratio = min(most_ratio, MOST_CAPITALS_RATIO)
    elif not LOOKS_RANDOM.search(text):
        parts = LETTERS.findall(text)
        letters = sum(map(len, parts))
        if letters < (8 if named else 12) or letters >= (most_ratio if named else min(most_ratio, MOST_PLAIN_RATIO)) * sum(len(encoding.encode_ordinary(x)) for x in parts):
            return None
    tokens = len(encoding.encode_ordinary(text))
    return (skip, len(text), tokens) if len(text) < most_ratio * tokens else None


def stretches(run: str, encoding, most_ratio: float) -> Iterator[tuple[int, int]]:
    """(begin, end) of the parts of ``run`` in which characters are short of ``most_ratio`` times the tokens by LEAST_EXCESS or more."""
    harmless = np.zeros(len(run) + 1, dtype=bool)
    for m in HARMLESS.finditer(run):
        harmless[m.start() : m.end()] = not CREDENTIAL.search(run[max(0, m.start() - CONTEXT) : m.start()])
    at = begin = end = 0
    excess = most = 0.0
    for size in [*(len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(run)), 0]:
        known = size == 0 or bool(harmless[at : at + size].any())
        excess += most_ratio - size
        at += size
        if excess > most and not known:
            most, end = excess, at
        elif known or excess <= 0 or most - excess > MOST_FALL:
            if most >= LEAST_EXCESS:
                yield begin, end
            excess, most, begin = 0.0, 0.0, at


def all_judged(run: str, before: str, known: frozenset[str], encoding, most_ratio: float) -> list[tuple[int, int, int]]:
    """What ``judged`` says of the whole ``run`` or, if that is no secret, of its stretches."""
    if whole := judged(run, before, known, encoding, most_ratio):
        return [whole]
    out, reached = [], 0
    for b, e in stretches(run, encoding, most_ratio):
        b, e = b + len(run[b:e]) - len(run[b:e].lstrip("=-_+/")), b + len(run[b:e].rstrip("=-_+/"))
        left, right = b, e
        while left > reached and PART.match(run[left - 1]):
            left -= 1
        while right < len(run) and PART.match(run[right]):
            right += 1
        for x, y in ((left, right), (b, e)):
            text = run[x:y].rstrip("=-_+/")
            if x < reached or text.lstrip("=-_+/") in known or max(map(len, PART.findall(text)), default=0) < 8:
                continue
            hit = judged(text, before if x == 0 else run[max(0, x - CONTEXT) : x], known, encoding, most_ratio)
            if hit:
                out.append((x + hit[0], *hit[1:]))
                reached = y
                break
    return out


FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("tokens", T.IntegerType()), T.StructField("ratio", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32()), ("ratio", pa.float64())]))


def secrets(text: Column, vocabulary: str = VOCABULARY, most_ratio: float = MOST_RATIO, known: frozenset[str] = frozenset()) -> Column:
    """array<struct(start, end, tokens, ratio)>, offsets in characters; empty for null and empty texts."""

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(vocabulary)
        for column in batches:
            out: list[list[dict]] = [[] for _ in range(len(column))]
            for at, part in slices(as_strings(column)):
                data, offsets = utf8(part)
                chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                hits: list[tuple[int, int, int, int, int]] = []  # text, begin and end in characters of the slice, tokens, 0 for a value with a name

                def judge(doc: int, b: int, e: int, of, rank: int, data=data, offsets=offsets, chars=chars, hits=hits) -> None:
                    before = data[max(int(offsets[doc]), b - CONTEXT) : b].tobytes().decode("utf-8", "ignore")
                    for x, n, tokens in of(data[b:e].tobytes().decode("utf-8", "replace"), before, known, encoding, most_ratio):
                        hits.append((doc, int(chars[b]) + x, int(chars[b]) + x + n, tokens, rank))

                for doc, b, e in assigned(data, offsets):
                    judge(doc, b, e, lambda *x: [h for h in [judged(*x)] if h], 0)
                for doc, b, e in candidates(data, offsets):
                    judge(doc, b, e, all_judged, 1)
                values = sorted((b, e) for _, b, e, _, rank in hits if rank == 0)
                for doc, b, e, tokens, rank in sorted(hits):
                    i = bisect.bisect_left(values, (e, 0))  # the last value that begins before this ends
                    if rank and i and values[i - 1][1] > b:
                        continue
                    base = int(chars[offsets[doc]])
                    out[at + doc].append({"start": b - base, "end": e - base, "tokens": tokens, "ratio": round((e - b) / tokens, 6)})
            yield pa.array(out, _ARROW)

    return scan(text)


def key_runs(text: Column) -> Column:
    """array<string>: the long runs of key characters that are judged; empty for null and empty texts."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out: list[list[str]] = [[] for _ in range(len(column))]
            for at, part in slices(as_strings(column)):
                data, offsets = utf8(part)
                for doc, b, e in candidates(data, offsets):
                    out[at + doc].append(data[b:e].tobytes().decode())
            yield pa.array(out, pa.list_(pa.string()))

    return scan(text)


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, start, end, tokens, ratio): one row per secret, offsets in characters.

    Rows are scanned one by one; a repeated row reports its secrets again, a null id is kept.  Null and empty texts
    report none, an empty table gives no rows.  A very long text is scanned whole, in time that grows with its length.
    Other columns are not looked at.
    """
    return df.select(F.col(id_col).alias("doc_id"), F.explode(secrets(F.col(text_col), **options)).alias("x")).select("doc_id", "x.*")
