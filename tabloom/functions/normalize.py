"""Folding page text for comparison, and finding back from folded to raw positions, as column expressions.

A text is cut into tags, entities, runs of visible characters, and single other characters; one scan, so that what an
entity decodes to is never scanned again.  A run folds by ``lower`` alone if all of its characters keep their form
under NFKC and have one-character lower forms; ``foldable`` says so of a whole text, and the vectorised fallback takes
the other texts.  Positions are code points, counted from 0.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions import pytext
from tabloom.functions.columns import let

TOKEN = r"(?sU)<[^>]+>|&[#a-zA-Z0-9]+;|[^<&\s\p{Cc}\p{Cf}]+|."
GONE = r"(?sU)<[^>]+>|[\s\p{Cc}\p{Cf}]+"
LEGACY_BREAK = r"(?iU)<br\s*/?\s*>"
LEGACY_TOKEN = r"(?isU)<[ \n\r\t]*b[ \n\r\t]*r\s*/?\s*>|[ \n\r\t]+|[^< \n\r\t]+|."
#: Breaks between a table's lines: tags, literal escapes, real line ends, any number of them together.  Possessive,
#: which changes no match but keeps Java's matcher from recursing once for every break of a long run.
BREAKS = r"(?isU)(?:<\s*br\s*/?\s*>|</p>\s*<p>|\\[nr]|[\n\r])++"

_NAMES = "amp lt gt quot apos nbsp copy reg middot deg times laquo raquo lsquo rsquo ldquo rdquo ndash mdash bull euro pound yen sect para szlig agrave aacute acirc auml ccedil egrave eacute ecirc euml iacute ntilde oacute ouml uacute uuml Auml Ouml Uuml Eacute".split()
ENTITIES = {e: pytext.fold(html.unescape(e)) for e in [f"&{n};" for n in _NAMES] + ["&#39;", "&#34;", "&#38;", "&#160;", "&#x27;", "&#8217;"]}


def _stable() -> str:
    """A character class of what NFKC leaves alone and ``lower`` maps one to one, the same alone and in words."""
    import unicodedata

    parts, start, prev = [], None, None
    spans = [(0x20, 0x24F), (0x400, 0x45F), (0x2010, 0x2022), (0x20AC, 0x20AC), (0x3001, 0x3002), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
    good = []
    for a, b in spans:
        for c in range(a, b + 1):
            s = chr(c)
            if unicodedata.category(s) not in ("Cc", "Cf", "Cn") and not (s.isspace() and s != " ") and unicodedata.normalize("NFKC", s) == s and len(s.lower()) == 1 and unicodedata.normalize("NFKC", s.lower()) == s.lower():
                good.append(c)
    for c in [*good, None]:
        if start is None:
            start = prev = c
        elif c is not None and c == prev + 1:
            prev = c
        else:
            parts.append(f"\\x{{{start:X}}}" + (f"-\\x{{{prev:X}}}" if prev != start else ""))
            start = prev = c
    return "".join(parts)


FOLDABLE = rf"^[\t\n\r\f{_stable()}]*$"


#: An entity that is not in ``ENTITIES``.
UNKNOWN = "&(?!(?:" + "|".join(re.escape(e[1:]) for e in ENTITIES) + "))[#a-zA-Z0-9]+;"


#: No entity that a foldable text has is longer.
LONGEST_ENTITY = max(map(len, ENTITIES))


def _entity_map() -> Column:
    """A literal, once the optimizer has folded it."""
    return F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")


def foldable(text: Column) -> Column:
    """Whether ``folded_text`` and ``raw_offsets`` are exact for this text."""
    return text.rlike(FOLDABLE) & ~text.rlike(UNKNOWN)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _is_tag(t: Column) -> Column:
    return t.startswith("<") & (F.length(t) > 1)


def _is_entity(t: Column) -> Column:
    return t.startswith("&") & (F.length(t) > 1)


def token_kind(t: Column) -> Column:
    return F.when(_is_tag(t), "tag").when(_is_entity(t), "entity").when(t.rlike(r"(?sU)^[\s\p{Cc}\p{Cf}]$"), "blank").otherwise("text")


def folded_token(t: Column) -> Column:
    return F.when(_is_tag(t), "").when(_is_entity(t), F.coalesce(F.try_element_at(_entity_map(), t), F.lit(""))).when(t.rlike(r"(?sU)^[\s\p{Cc}\p{Cf}]$"), "").otherwise(F.lower(t))


def folded_text(text: Column) -> Column:
    """The comparison form of a foldable text; empty for null.

    Without entities two built-in functions do it: nothing that one scan removes can be made by what it leaves.
    """
    plain = F.lower(F.regexp_replace(text, F.lit(GONE), F.lit("")))
    return F.when(~text.rlike(r"&[#a-zA-Z0-9]+;"), plain).otherwise(_by_tokens(text))


def visible(text: Column) -> Column:
    """Whether a foldable text folds to something, which its first character that is not blank most often says."""
    return text.rlike(r"(?sU)^[\s\p{Cc}\p{Cf}]*+[^<&\s\p{Cc}\p{Cf}]") | (folded_text(text) != "")


def _by_tokens(text: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(tokens(text), folded_token), ""), F.lit(""))


def _folded_size(t: Column) -> Column:
    entity = F.length(F.coalesce(F.try_element_at(_entity_map(), t), F.lit("")))
    return F.when(_is_tag(t), 0).when(_is_entity(t), entity).when(t.rlike(r"(?sU)^[\s\p{Cc}\p{Cf}]$"), 0).otherwise(F.length(t))


#: Two lengths in one number, the folded one in front: texts are far shorter than 2^31.
_HALF = 31


def packed_sizes(toks: Column) -> Column:
    """array<bigint> of each token's folded and raw length in one number."""
    return F.transform(toks, lambda t: let(_folded_size(t), lambda n: F.shiftleft(n.cast("long"), _HALF) + F.length(t)))


def _token_of(sizes: Column, position: Column) -> Column:
    """The packed lengths of all tokens before the one that makes the folded character at ``position``; null if none does.

    One number is kept while the tokens pass; below zero it stands still.
    """

    def step(acc: Column, x: Column) -> Column:
        return F.when(acc < 0, acc).when(F.shiftright(acc + x, _HALF) > position, -acc - 1).otherwise(acc + x)

    return F.aggregate(sizes, F.lit(0).cast("long"), step, lambda acc: F.when((acc < 0) & (position >= 0), -acc - 1))


def raw_offset(raw: Column, sizes: Column, position: Column) -> Column:
    """Where the folded character at ``position`` comes from in ``raw``, whose tokens' ``packed_sizes`` are given; -1 if nowhere."""

    def place(before: Column) -> Column:
        at = before.bitwiseAND(F.lit((1 << _HALF) - 1)).cast("int")
        ahead = position - F.shiftright(before, _HALF).cast("int")
        # an entity folds as one unit, so whatever comes from it begins where it does
        entity = F.substring(raw, at + 1, F.lit(LONGEST_ENTITY)).rlike(r"^&[#a-zA-Z0-9]+;")
        return F.coalesce(at + F.when((ahead == 0) | entity, 0).otherwise(ahead), F.lit(-1))

    return let(_token_of(sizes, position), place)


def raw_offsets(raw: Column, sizes: Column, *positions: Column) -> Column:
    """struct(p0, p1, ...): where the folded characters at ``positions`` come from in the raw text; -1 if nowhere."""
    return F.struct(*[raw_offset(raw, sizes, p).alias(f"p{i}") for i, p in enumerate(positions)])


def token_offsets(t: Column, raw: Column) -> Column:
    """Where each folded character of the token ``t``, which begins at ``raw``, comes from in the raw text."""
    size = _folded_size(t)
    return F.when(size == 0, F.array().cast("array<bigint>")).when(_is_entity(t), F.array_repeat(raw, size)).otherwise(F.sequence(raw, raw + size - 1))


def legacy_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LEGACY_TOKEN), F.lit(0))


def legacy_sizes(toks: Column) -> Column:
    """``packed_sizes`` of the first version's tokens; exact where ``legacy_foldable`` holds."""

    def size(t: Column) -> Column:
        return F.when((t.startswith("<") & (F.length(t) > 1)) | t.rlike(r"^[ \n\r\t]+$"), 0).otherwise(F.length(t))

    return F.transform(toks, lambda t: F.shiftleft(size(t).cast("long"), _HALF) + F.length(t))


def legacy_raw_offset(sizes: Column, position: Column) -> Column:
    """As ``raw_offset``; this form knows no entities."""

    def place(before: Column) -> Column:
        return F.coalesce(before.bitwiseAND(F.lit((1 << _HALF) - 1)).cast("int") + position - F.shiftright(before, _HALF).cast("int"), F.lit(-1))

    return let(_token_of(sizes, position), place)


def legacy_foldable(text: Column) -> Column:
    """Whether lower case maps every character of the text to one."""
    return text.rlike(FOLDABLE)


def legacy_folded_text(text: Column) -> Column:
    """The first version's form: no blanks, no ``<br>``, lower case."""
    dense = F.regexp_replace(text, F.lit(r"[ \n\r\t]"), F.lit(""))
    return F.lower(F.regexp_replace(dense, F.lit(LEGACY_BREAK), F.lit("")))


def legacy_body(content: Column) -> Column:
    parts = F.split(content, LEGACY_BREAK, 2)
    return F.element_at(parts, -1)
