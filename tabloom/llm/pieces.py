"""SentencePiece encoding that keeps track of the source, and decoding.

A text is normalised by the longest prefix that the compiled character map knows at each place; every step is a
chunk: so many source bytes became so many normalised bytes.  Spaces become U+2581, one is put in front.  The pieces
of the normalised text then project back: a piece spans from the begin of the chunk of its first byte to the end of
the chunk of its last one.  Where one source character became several pieces, they share its span; a byte piece of
an unknown character has that character's.

Merges never join a non-space to a following space, nor anything to a line feed, unless a piece of the vocabulary
does (checked when the model is read).  So texts are cut there, and each distinct stretch of a partition is
normalised and encoded once; the result is the same as encoding the whole text.  Texts for which this is not sure
(a map that touches spaces, a character that becomes one) are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm._text import as_strings, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RULES = "nfkc"
SPACE = "▁"
#: Distinct stretches that a task remembers before it starts anew (memory only: the result is the same).
REMEMBERED = 150_000
_CUT = re.compile(r"\n+| *[^ \n]+| +")


class CharacterMap:
    """A compiled map: a double-array trie over UTF-8 bytes whose values point into a block of replacements."""

    def __init__(self, compiled: bytes) -> None:
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.block = compiled[4 + size :]
        keys = self._all()
        texts = [k.decode() for k in keys]
        #: characters at which a key can change something: keys of one character, and all but the first of longer ones
        self.active = frozenset(k if len(k) == 1 else c for k in texts for c in (k if len(k) == 1 else k[1:]))
        self.to_space = frozenset(c for k, v in keys.items() if b" " in v or b"\n" in v for c in k.decode())
        self.plain = not any(b" " in k or b"\n" in k or not v for k, v in keys.items())

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _value(self, at: int) -> bytes:
        start = self.units[at] & 0x7FFFFFFF
        return self.block[start : self.block.index(b"\0", start)]

    def _all(self) -> dict[bytes, bytes]:
        """Every key and its replacement."""
        found: dict[bytes, bytes] = {}
        if not self.units:
            return found
        units, labels = np.array(self.units, np.int64), np.arange(1, 256)
        todo = [(np.array([self._offset(self.units[0])]), [b""])]
        while todo:
            bases, names = todo.pop()
            if len(bases) > 1024:  # a few MB at a time
                todo += [(bases[i : i + 1024], names[i : i + 1024]) for i in range(0, len(bases), 1024)]
                continue
            at = bases[:, None] ^ labels
            inside = at < len(units)
            parent, c = np.nonzero(inside & (units[np.where(inside, at, 0)] & 0x800000FF == labels))
            if not len(parent):
                continue
            at = at[parent, c]
            unit = units[at]
            inner = at ^ ((unit >> 10) << ((unit & 512) >> 6))
            names = [names[i] + bytes((x + 1,)) for i, x in zip(parent.tolist(), c.tolist(), strict=True)]
            for i in np.flatnonzero(unit >> 8 & 1).tolist():
                found[names[i]] = self._value(int(inner[i]))
            todo.append((inner, names))
        return found

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest key at ``at``."""
        if not self.units:
            return None
        best, node = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, node)
        return best and (best[0], self._value(best[1]))

    def chunks(self, text: str) -> list[tuple[int, bytes]]:
        """(source bytes, normalised bytes) from left to right; a character that no key begins at stays."""
        data = text.encode("utf-8", "replace")
        out, at = [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = (n, data[at : at + n])
            out.append(hit)
            at += hit[0]
        return out


class Encoder:
    """The model without its own normaliser, and the map that takes its place."""

    def __init__(self, model: str, rules: str | None) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        compiled = proto.normalizer_spec.precompiled_charsmap
        if rules is not None:
            own = pb.ModelProto()
            own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto())
            compiled = own.normalizer_spec.precompiled_charsmap
        if proto.normalizer_spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("models that drop spaces or put them behind words are not supported")
        self.map = CharacterMap(compiled)
        self.prefix = SPACE if proto.normalizer_spec.add_dummy_prefix else ""
        for field in ("precompiled_charsmap",):
            proto.normalizer_spec.ClearField(field)
        proto.normalizer_spec.name = "identity"
        proto.normalizer_spec.add_dummy_prefix = False
        proto.normalizer_spec.escape_whitespaces = False
        self.core = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        #: of ids that stand for one byte of a longer character, or for whatever is unknown, the id alone tells no span
        self.partial = np.array([p.type == 2 or (p.type == 6 and int(p.piece[3:5], 16) > 127) for p in proto.pieces])
        self.spans = np.array([1 if p.type == 6 else len(p.piece.encode()) - 2 * p.piece.count(SPACE) for p in proto.pieces], np.int64)
        self.length = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = self.core.unk_id()
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p.piece) or "\n" in p.piece for p in proto.pieces)
        self.cuttable = self.map.plain and not inner and proto.trainer_spec.model_type == 2

    def _slow(self, stretch: str, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(ids, begins, ends, source bytes) of one stretch, chunk by chunk."""
        chunks = self.map.chunks(stretch)
        normal = b"".join(c[1] for c in chunks).replace(b" ", SPACE.encode())
        source = np.array([c[0] for c in chunks], np.int64)
        made = np.array([len(c[1]) + 2 * c[1].count(b" ") for c in chunks], np.int64)
        stops = np.cumsum(source)
        begin, end = np.repeat(stops - source, made), np.repeat(stops, made)
        text = normal.decode()
        if first and text and self.prefix:  # the space in front has no source: an empty span at the begin
            text, begin, end = self.prefix + text, np.r_[0, 0, 0, begin], np.r_[0, 0, 0, end]
        ids = np.array(self.core.encode(text, out_type=int), np.int64)
        lengths = self.length[ids]
        if self.unknown in ids:
            lengths = np.array([len(p.surface.encode()) for p in self.core.encode(text, out_type="immutable_proto").pieces], np.int64)
        stop = np.cumsum(lengths)
        return ids, begin[stop - lengths], end[stop - 1], int(source.sum())

    def encode(self, stretches: list[tuple[str, bool]]) -> tuple[np.ndarray, ...]:
        """Pieces per stretch, ids, begins, ends, and source bytes per stretch; the flag puts the space in front.

        Stretches in which the map changes nothing are encoded in one call, their spans being the pieces' lengths.
        """
        active = self.map.active
        size = np.array([len(s) if s.isascii() else len(s.encode("utf-8", "replace")) for s, _ in stretches], np.int64)
        put = [self.prefix if first and s else "" for s, first in stretches]
        lists = self.core.encode([p + s.replace(" ", SPACE) for p, (s, _) in zip(put, stretches, strict=True)], out_type=int, num_threads=1) if stretches else []
        count = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum()))
        at = np.cumsum(count) - count
        spans = self.spans[ids]
        spans[at[np.array([bool(p) for p in put], bool) & (count > 0)]] -= 1
        stop = np.cumsum(spans)
        before = np.repeat((stop - spans)[np.minimum(at, max(0, len(spans) - 1))], count) if len(spans) else stop
        begin, end = stop - spans - before, stop - before
        hard = np.zeros(len(stretches), bool)
        hard[np.repeat(np.arange(len(stretches)), count)[self.partial[ids]]] = True
        hard |= np.array([not s.isascii() and not active.isdisjoint(s) or SPACE in s for s, _ in stretches], bool)
        if hard.any():
            cut = lambda x: np.split(x, at[1:])
            rows = list(zip(cut(ids), cut(begin), cut(end), size.tolist(), strict=True))
            for i in np.flatnonzero(hard).tolist():
                rows[i] = self._slow(*stretches[i])
            count = np.array([len(r[0]) for r in rows], np.int64)
            ids, begin, end = (np.concatenate([r[k] for r in rows]) for k in range(3))
            size = np.array([r[3] for r in rows], np.int64)
        return count, ids.astype(np.int32), begin.astype(np.int32), end.astype(np.int32), size


@lru_cache(maxsize=4)
def encoder(model: str = MODEL, rules: str | None = RULES) -> Encoder:
    return Encoder(model, rules)


class _Memory:
    """Encoded stretches of one task, as ragged arrays."""

    def __init__(self, enc: Encoder) -> None:
        self.enc = enc
        self.codes: tuple[dict, dict] = ({}, {})
        self.clear()

    def clear(self) -> None:
        for c in self.codes:
            c.clear()
        self.count = 0
        self.flat = [np.zeros(0, np.int32) for _ in range(3)]
        self.at, self.size, self.whole = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, new: list[tuple[str, bool]]) -> None:
        count, *flat, size = self.enc.encode(new)
        self.flat = [np.concatenate(x) for x in zip(self.flat, flat, strict=True)]
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(count)])
        self.size = np.concatenate([self.size, size])
        self.whole = np.concatenate([self.whole, [not self.enc.map.to_space.isdisjoint(s) for s, _ in new]]).astype(bool)

    def lists(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where each text's pieces begin, and ids, begins and ends of all."""
        if self.count > REMEMBERED:
            self.clear()
        rest, front = self.codes
        codes: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        new: list[tuple[str, bool]] = []

        def code(table: dict, s: str) -> int:
            table[s] = n = self.count
            self.count += 1
            new.append((s, table is front))
            return n

        for i, t in enumerate(texts):
            stretches = _CUT.findall(t) if self.enc.cuttable else [t] * bool(t)
            if stretches:
                counts[i] = len(stretches)
                first = stretches[0]
                codes.append(front[first] if first in front else code(front, first))
                codes += [rest[s] if s in rest else code(rest, s) for s in stretches[1:]]
        if new:
            self.add(new)
        all_codes = np.array(codes, np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        if self.enc.cuttable and self.whole[all_codes].any():
            keep = np.ones(len(all_codes), bool)
            special, extra = np.unique(doc[self.whole[all_codes]]), []
            for d in special:
                keep[doc == d] = False
                extra.append((texts[d], True))
            base = len(self.size)
            self.add(extra)
            self.count += len(extra)
            all_codes = np.concatenate([all_codes[keep], base + np.arange(len(extra))])
            doc = np.concatenate([doc[keep], special])
            order = np.argsort(doc, kind="stable")
            all_codes, doc = all_codes[order], doc[order]
        n = self.at[all_codes + 1] - self.at[all_codes]
        upto = np.cumsum(self.size[all_codes])
        start = upto - self.size[all_codes]
        first = np.searchsorted(doc, np.arange(len(texts)))
        base = np.concatenate([start, upto[-1:]])[first] if len(start) else np.zeros(len(texts), np.int64)
        start = start - base[doc] if len(start) else start
        total = np.cumsum(n)
        index = np.arange(total[-1] if len(total) else 0) - np.repeat(total - n, n) + np.repeat(self.at[all_codes], n)
        shift = np.repeat(start, n).astype(np.int32)
        per_text = np.bincount(doc, n, len(texts)).astype(np.int64)
        return per_text, [self.flat[0][index], self.flat[1][index] + shift, self.flat[2][index] + shift]


def _spelt(core, ids: pa.ListArray) -> pa.Array:
    """What each list of pieces spells.  All numbers are made at once, which takes a fraction of a list at a time."""
    flat, at = ids.values.to_pylist() if ids.values.null_count else ids.values.to_numpy().tolist(), ids.offsets.to_pylist()
    texts = [core.decode(flat[b:e]) if b < e else "" for b, e in zip(at[:-1], at[1:], strict=True)]
    return pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The normalised text that the pieces spell; null for null, empty for no pieces."""

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        core = sentencepiece.SentencePieceProcessor(model_file=model)
        for column in batches:
            yield _spelt(core, column)

    return run(ids)


def tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, rules: str | None = RULES, decode: bool = False) -> DataFrame:
    """(doc_id, ids, begins, ends), one row for each of ``df``: the pieces and their spans in bytes of the source.

    With ``decode`` the text that the pieces spell is one more column, as ``decoded`` gives it but slice by slice.
    ``rules`` names a map of the library (``nfkc`` keeps line feeds); None takes the model's own.  Null texts have
    null lists, empty ones empty lists; repeated rows and null ids stay; other columns are not looked at.  Batches
    go out as small as they are worked on, so the memory needed does not grow with the rows of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        memory, core = _Memory(encoder(model, rules)), sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for at, part in slices(as_strings(column)):
                counts, lists = memory.lists(part.to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                null = column.slice(at, len(part)).is_null()
                fields = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32()), mask=null) for x in lists]
                names = ["doc_id", "ids", "begins", "ends"]
                if decode:
                    fields.append(_spelt(core, fields[0]))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(part)), *fields], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decode)
