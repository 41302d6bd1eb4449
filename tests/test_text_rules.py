"""The worked cases of single values, and the column expressions against them."""

import html
import json
import math
import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.functions import pytext, sweep
from tabloom.functions.normalize import foldable, folded_text, legacy_folded_text, packed_sizes, raw_offset, tokens, visible
from tabloom.operators.locate import candidate_windows, exact_start
from tabloom.operators.spans import first_break, header_and_body, trimmed

FOLDS = [
    ("A B", "ab", [0, 2]), ("a&nbsp;b", "ab", [0, 7]), ("½", "1⁄2", [0, 0, 0]), ("&notit;", "¬it;", [0, 0, 0, 0]), ("x<b>y</b>", "xy", [0, 4]), ("1 < 2 > 3", "13", [0, 8]), ("&lt;b&gt;", "<b>", [0, 4, 5]),
    ("&am<b>p;", "&amp;", [0, 1, 2, 6, 7]), ("e\u0301", "e\u0301", [0, 1]), ("ＡＢ", "ab", [0, 1]), ("a\u200bb", "ab", [0, 2]), ("ΑΣ", "ασ", [0, 1]), ("", "", []), ("<>", "<>", [0, 1]), ("İ", "i̇", [0, 0]),
]
PIECES = ["<br>", "<BR />", "</p> <p>", "\\n", "\n", " ", "a", "Bob", "é", "&amp;", "&copy;", "&", "<", ">", "<td>", "5", "\t", "“", "-", ";"]
texts = st.lists(st.sampled_from(PIECES), max_size=14).map("".join)


@pytest.mark.parametrize(("raw", "text", "offsets"), FOLDS)
def test_folding(raw, text, offsets):
    assert pytext.folded(raw) == (text, offsets)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | texts)
def test_offsets_never_fall_and_folding_again_changes_no_plain_text(raw):
    text, offsets = pytext.folded(raw)
    assert len(text) == len(offsets) and offsets == sorted(offsets)
    if "<" not in text and "&" not in text:
        assert pytext.folded(pytext.folded(text).text).text == pytext.folded(text).text


@pytest.fixture(scope="module")
def many(spark):
    import random

    r = random.Random(5)
    rows = [x[0] for x in FOLDS] + ["".join(r.choice(PIECES) for _ in range(r.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, raw string").repartition(4).cache()
    yield rows, df
    df.unpersist()


def test_expressions_fold_as_the_rules_do(many):
    rows, df = many
    length = F.length(folded_text(F.col("raw")))
    out = df.select("i", foldable(F.col("raw")).alias("ok"), folded_text(F.col("raw")).alias("t"), F.transform(F.sequence(F.lit(0), length), lambda k: raw_offset(F.col("raw"), packed_sizes(tokens(F.col("raw"))), k)).alias("o"))
    decided = 0
    for r in out.collect():
        want = pytext.folded(rows[r["i"]])
        if r["ok"]:
            decided += 1
            assert (r["t"], r["o"][:-1], r["o"][-1]) == (want.text, want.offsets, -1), rows[r["i"]]
    assert decided > 300


def test_expressions_split_and_trim_as_the_rules_do(many):
    rows, df = many
    n = F.length("raw")
    cols = {"h": header_and_body(F.col("raw")), "u": header_and_body(F.col("raw"), False), "b": first_break(F.col("raw")), "t": trimmed(F.col("raw"), F.lit(0), n), "l": legacy_folded_text(F.col("raw"))}
    for r in df.where(foldable(F.col("raw"))).withColumns(cols).collect():
        raw = rows[r["i"]]
        assert tuple(r["h"]) == pytext.header_and_body(raw), raw
        assert tuple(r["u"]) == pytext.header_and_body(raw, False), raw
        assert r["b"] == pytext.first_break(raw), raw
        assert tuple(r["t"]) == pytext.trimmed(raw, 0, len(raw)), raw
        assert r["l"] == pytext.legacy_folded(raw).text, raw


def test_long_runs_of_breaks_do_not_overflow_the_matcher(spark):
    raw = "head" + "<br>\n\\n" * 20_000 + "body"
    row = spark.createDataFrame([(raw,)], "raw string").select(header_and_body(F.col("raw")).alias("h")).first()
    assert tuple(row["h"]) == ("body", 4)


def test_windows_and_places_as_the_rules_have_them(spark):
    import random

    r = random.Random(6)
    rows = []
    for _ in range(200):
        query = "".join(r.choice("ab") for _ in range(r.randrange(60)))
        rows.append(("".join(r.choice("ab") for _ in range(r.randrange(400))), query))
    rows += [("a" * 100, "a" * 9), ("", "x"), ("x", ""), ("xyz", "y")]
    out = spark.createDataFrame(rows, "s string, q string").select("s", "q", candidate_windows(F.col("s"), F.col("q")).alias("w"), exact_start(F.col("s"), F.col("q")).alias("at"))
    for x in out.collect():
        assert [tuple(w) for w in x["w"]] == pytext.windows(x["s"], x["q"])
        assert x["at"] == (x["s"].find(x["q"]) if x["q"] else -1)


@settings(max_examples=200, deadline=None)
@given(st.text("abc<", max_size=40), st.text("abc<", max_size=40))
def test_ratio_is_difflib_s(a, b):
    assert pytext.ratio(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()
    assert 0 <= pytext.similarity(a, b) <= 1
    if a and pytext._may_cover(a, b, 0.6) is False:
        assert sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a) < 0.6


def test_ratio_depends_on_the_order():
    assert pytext.ratio("tide", "diet") == 0.25 and pytext.ratio("diet", "tide") == 0.5


F09 = ("pre abcdefghij k lmnopqrst post", "abcdefghij9lmnopqrst")
CASES = [
    # text, contents, stripped, [(mode, full, body, peer_body, extracted, similarity)]
    ("前文 <p>Name Age<br>Bob 5</p> tail", ["Name Age<br>Bob 5"], True, [("exact", [6, 23], [18, 23], "Bob 5", "Bob 5", 1.0)]),
    ("x A<br>B y", ["\nA<br>B"], True, [("exact", [2, 8], [7, 8], "B", "B", 1.0)]),
    ("x A<br>B y", ["\nA<br>B"], False, [("exact", [2, 8], [2, 8], "A<br>B", "A<br>B", 1.0)]),
    ("T<br>a&amp; z", ["T<br>a&"], True, [("exact", [0, 7], [5, 7], "a&", "a&", 1.0)]),
    ("H\\nb", ["H\\nb"], True, [("exact", [0, 4], [1, 4], "b", "\\nb", 0.5)]),
    ("q A<br>B r", ["A<br>B", "A<br>B"], True, [("exact", [2, 8], [7, 8], "B", "B", 1.0)] * 2),
    ("H<br>abc<br>def", ["H<br>abc<br>def", "abc<br>def"], True, [("exact", [0, 15], [5, 15], "abc<br>def", "abc<br>def", 1.0), ("exact", [5, 15], [12, 15], "def", "def", 1.0)]),
    ("hello", ["zzz<br>yyy"], True, [("unmatched", None, None, "yyy", "", 0.0)]),
    ("H<br>b1 b2 tail", ["Hb1b2"], True, [("exact", [0, 10], [5, 10], "b1b2", "b1 b2", 1.0)]),
    (*F09[:1], [F09[1]], True, [("fuzzy", [4, 26], [4, 26], F09[1], "abcdefghij k lmnopqrst", 0.95)]),
    ("abcdefg", ["abcdefX"], True, [("unmatched", None, None, "abcdefX", "", 0.0)]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_worked_cases(case):
    raw, contents, stripped, rows = CASES[case]
    for got, (mode, full, body, peer, found, sim) in zip(pytext.matches(raw, contents, pytext.Options(stripped=stripped)), rows, strict=True):
        assert got["match_mode"] == mode and got["peer_body"] == peer and got["extracted_table"] == found and math.isclose(got["exact_similarity"], sim)
        assert ([got["full_start"], got["full_end"]] if full else full) == full and ([got["body_start"], got["body_end"]] if body else body) == body


PEERS = [
    ('[{"content": "A<br>B", bad}]', ["A<br>B"]), ("[{'content': 'A<br>B', 'n': None}]", ["A<br>B"]), ('[1,{"content":"z"},{"content":null},{"content":"<br>"},{"x":1},{"content":12}]', ["z", "12"]), ('{"content":"solo"}', ["solo"]),
    ("", []), ("[]", []), ('[[{"content":"x"}]]', ["x"]), ('[{"x":"content"}]', []), (None, []), ("5", []), ('{"content": "open', ["open"]), ('"content": null, "content": "\\u0041\\q\\n', ["Aq\n"]), ("[{'content': True}]", ["True"]), ('[{"content": 1.50}]', ["1.5"]),
    ('[{"content": ["a", 1]}]', ["['a', 1]"]), ("({'content': 'x'},)", ["x"]), ('[{"content": "½"}]', ["½"]),
]


@pytest.mark.parametrize(("value", "contents"), PEERS)
def test_contents_by_the_rules(value, contents):
    assert pytext.contents_of(value) == contents


def test_contents_by_expressions(spark):
    from tabloom.functions.peers import peer_contents

    rows = [(i, v, None if v is None else json.dumps(v)) for i, (v, _) in enumerate(PEERS)]
    df = spark.createDataFrame(rows, "i int, s string, j string").withColumn("v", F.parse_json("j"))
    for name in ("s", "v"):
        got = {r["i"]: r["c"] for r in df.select("i", peer_contents(F.col(name), df.schema[name].dataType).alias("c")).collect()}
        assert got == {i: c for i, (_, c) in enumerate(PEERS)}
    real = [('[[{"content":"x"}]]', []), ('[1,{"content":"z"}]', ["z"]), ('{"content":"solo"}', ["solo"]), ("5", []), ("null", [])]
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(real)], "i int, j string").withColumn("v", F.parse_json("j"))
    assert {r["i"]: r["c"] for r in df.select("i", peer_contents(F.col("v"), df.schema["v"].dataType).alias("c")).collect()} == {i: c for i, (_, c) in enumerate(real)}


def test_whole_offset_maps_are_those_of_the_rules(spark):
    from tabloom.plans import catalog

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    pages |= {-1: "<b>A &amp; b</b> x<br>y &copy;&nbsp;Z", -2: "", -3: "<p></p>"}
    df = spark.createDataFrame(list(pages.items()), "page_id long, ctt string")
    got = {r["page_id"]: r["offsets"] for r in catalog.offset_maps(df).collect()}
    assert got == {i: pytext.folded(t).offsets for i, t in pages.items() if pytext.folded(t).offsets}


def test_blocks_are_the_library_s(monkeypatch):
    r = random.Random(21)
    for alphabet, n in (("ab", 40), ("abcdef", 120), ("abcdefghijklmnopqrstuvwxyz é", 300), ("aé😀", 60)):
        for small in (0, 1 << 19):
            monkeypatch.setattr(pytext, "_SMALL", small)
            for _ in range(20):
                a = "".join(r.choice(alphabet) for _ in range(r.randrange(n)))
                b = "".join(r.choice(alphabet) for _ in range(r.randrange(n))) if r.random() < 0.5 else "".join(c for c in a if r.random() < 0.9) + "x" * r.randrange(5)
                want = SequenceMatcher(None, a, b, autojunk=False)
                got = pytext.matching_blocks(a, b)
                assert sum(n for _, _, n in got) == sum(m.size for m in want.get_matching_blocks())
                joined = []
                for x in got:
                    if joined and joined[-1][0] + joined[-1][2] == x[0] and joined[-1][1] + joined[-1][2] == x[1]:
                        joined[-1] = (*joined[-1][:2], joined[-1][2] + x[2])
                    else:
                        joined.append(x)
                assert joined == [tuple(m) for m in want.get_matching_blocks() if m.size]
                assert pytext.ratio(a, b) == want.ratio()


def _plain_sweep(source, body, least):
    """The first version's sweep, every window measured."""
    m = len(body)
    if (at := source.find(body)) >= 0:
        return at, at + m
    step, best, where = max(1, m // 4), 0.0, 0

    def over(starts):
        nonlocal best, where
        for s in starts:
            if (r := SequenceMatcher(None, body, source[s : s + m]).ratio()) > best:
                best, where = r, s

    last = len(source) - m + 1
    over(range(0, last, step))
    over(range(max(0, where - step), min(last, where + step + 1)))
    return (where, where + m) if best > least else None


def test_the_bounded_sweep_finds_what_the_whole_sweep_finds(monkeypatch):
    r = random.Random(23)
    measured, whole, windows = [], sweep._matched, 0
    monkeypatch.setattr(sweep, "_matched", lambda *a: measured.append(a) or whole(*a))
    for _ in range(300):
        letters = r.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz<>/5ß"])
        source = "".join(r.choice(letters) for _ in range(r.choice((0, 3, 40, 300, 900))))
        at = r.randrange(len(source) + 1)
        body = list(source[at : at + r.choice((1, 9, 60, 190, 230, 600))]) or ["a"]
        for _ in range(1 + len(body) // r.choice((2, 6, 11))):
            k = r.randrange(len(body) + 1)
            body[k : k + r.randrange(2)] = r.choice(("", "", "X", r.choice(letters)))
        body, least = "".join(body), r.choice((0.0, 0.3, 0.5))
        assert pytext.legacy_place(source, body, least) == _plain_sweep(source, body, least)
        assert sweep.ratio(body, source) == SequenceMatcher(None, body, source).ratio()
    measured.clear()
    source = "".join(f'<li><ahref="/{w}">{w}</a></li>' for w in ("".join(r.choice("etaoins") for _ in range(r.randrange(2, 9))) for _ in range(200)))
    body = "".join(c for i, c in enumerate(source[900:1090]) if (i + 1) % 11)
    windows = len(range(0, len(source), len(body) // 4)) + len(body) // 2
    assert pytext.legacy_place(source, body) == _plain_sweep(source, body, 0.5) is not None
    assert len(measured) < windows / 4


def _folded_one_by_one(raw):
    out, offsets = [], []
    for m in re.finditer(r"<[^>]+>|&[#0-9A-Za-z]+;|.", raw, re.S):
        token = m[0]
        if len(token) > 1 and token[0] == "<":
            continue
        low = unicodedata.normalize("NFKC", html.unescape(token) if len(token) > 1 else token).lower()
        piece = "".join(c for c in low if not c.isspace() and unicodedata.category(c) not in ("Cc", "Cf"))
        out.append(piece)
        offsets += [m.start()] * len(piece)
    return "".join(out), offsets


def test_only_what_folds_in_its_own_way_is_looked_at_piece_by_piece(monkeypatch):
    r = random.Random(26)
    pieces = ["a", "Z", "9", "<", ">", "&", ";", "#", " ", "\n", "\x0b", "\x1c", "\x7f", "\x85", "\xa0", "½", "é", "İ", "Σ", "́", "​", "\ud800", "Ａ", "𝔸", "&amp;", "&notit;", "&nbsp;", "&#13;", "&Eacute;", "&fjlig;", "<b>", "</p>"]
    for _ in range(3000):
        raw = "".join(r.choice(pieces) for _ in range(r.randrange(14)))
        assert tuple(pytext.folded(raw)) == _folded_one_by_one(raw), raw
        assert pytext.folded_text(raw) == pytext.folded(raw).text
    seen, piece = [], pytext._piece
    monkeypatch.setattr(pytext, "_piece", lambda token: seen.append(token) or piece(token))
    raw = "<p>Plain text, of 1 kind &amp;\n\tno é other.</p>" * 50
    assert tuple(pytext.folded(raw)) == _folded_one_by_one(raw)
    assert len(seen) == 200


def test_visible_texts_are_those_that_fold_to_something(spark):
    raws = ["", " ", "a", " \n a", "<b>", "<b>a", " <", "&nbsp;", "&nbsp;a", "&", "<b>\n</b>&nbsp;", "é", "　", "\x1c", "\x7fa"]
    rows = spark.createDataFrame([(x,) for x in raws], "raw string").select("raw", visible(F.col("raw")).alias("v")).collect()
    assert [r["v"] for r in rows] == [pytext.folded(r["raw"]).text != "" for r in rows]
