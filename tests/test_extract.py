"""Whole records: expressions and fallback together, files, streams and the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_text_rules import CASES, _plain_sweep

from tabloom.__main__ import beside, main
from tabloom.functions import pytext, sql
from tabloom.functions.similarity import match_blocks, ratio, similarity
from tabloom.operators.passages import passages_in
from tabloom.plans.extract import extract_tables, flat_metrics, legacy_lines, summary
from tabloom.sources.jsonl import numbered_lines, read_jsonl
from tabloom.streaming.extract import extract_stream, write_stream

SEGMENTS = {0: (["前文 <p>Name Age<br>", "Bob 5", "</p> tail"], [0, 1, 0]), 1: (["x A<br>", "B", " y"], [0, 1, 0]), 3: (["T<br>", "a&", "amp; z"], [0, 1, 0]), 4: (["H", "\\nb"], [0, 1]), 5: (["q A<br>", "B", " r"], [0, 1, 0]), 6: (["H<br>", "abc<br>def"], [0, 1]), 7: (["hello"], [0]), 8: (["H<br>", "b1 b2", " tail"], [0, 1, 0])}


def _frame(spark, records):
    return spark.createDataFrame([(i, t, c, "kept") for i, (t, c) in enumerate(records)], "i int, ctt string, tabel_info array<string>, other string")


@pytest.fixture(scope="module")
def random_records():
    r = random.Random(8)
    pieces = ["<br>", "\n", " ", "a", "Bob", "&amp;", "&", "<td>", "5", "½", "&hearts;", "\\n", "Name Age", "x y z", "-"]
    records = [(None, ["x"]), ("", ["x"]), ("abc", None), ("abc", []), ("abc", [None, "b", "<br>"])]
    for _ in range(150):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(4, 60)))
        peers = []
        for _ in range(r.randrange(4)):
            a = r.randrange(len(text))
            part = list(text[a : a + r.randrange(1, 60)])
            for _ in range(r.choice((0, 0, 0, 1, 3))):
                part[r.randrange(len(part))] = r.choice("qQ ")
            peers.append("".join(part))
        records.append((text, peers))
    return records


def _expected(text, peers, o):
    text = text or ""
    contents = [c for c in peers or [] if c is not None and pytext.folded(c).text]
    rows = pytext.matches(text, contents, o)
    chosen = []
    for m in sorted((m for m in rows if m["matched"]), key=lambda m: (m["body_start"], m["body_end"])):
        rank = lambda x: (x["exact_score"], x["exact_similarity"], x["body_end"] - x["body_start"])
        if not chosen or m["body_start"] >= chosen[-1]["body_end"]:
            chosen.append(m)
        elif rank(m) > rank(chosen[-1]):
            chosen[-1] = m
    out, kinds, at = [], [], 0
    for m in chosen:
        if m["body_start"] > at:
            out.append(text[at : m["body_start"]])
            kinds.append(0)
        out.append(text[m["body_start"] : m["body_end"]])
        kinds.append(1)
        at = m["body_end"]
    if at < len(text):
        out.append(text[at:])
        kinds.append(0)
    return rows, (out, kinds) if out else ([text], [0])


@pytest.mark.parametrize("mode", ["clean", "segments"])
def test_records_are_those_of_the_rules(spark, random_records, mode):
    got = extract_tables(_frame(spark, random_records).repartition(5), mode=mode).collect()
    modes = set()
    for r in got:
        text, peers = random_records[r["i"]]
        rows, (out, kinds) = _expected(text, peers, pytext.Options(stripped=mode == "clean"))
        assert (r["text_list"], r["type_list"]) == (out, kinds), (text, peers)
        assert "".join(r["text_list"]) == (text or "") and r["other"] == "kept"
        assert len(r["table_metrics"]) == len(rows)
        for m, w in zip(r["table_metrics"], rows, strict=True):
            modes.add(m["match_mode"])
            assert {k: m[k] for k in ("table_idx", "peer_content", "peer_body", "matched", "extracted_table", "match_mode")} == {k: w[k] for k in ("table_idx", "peer_content", "peer_body", "matched", "extracted_table", "match_mode")}, (text, peers)
            assert (m["similarity"], m["match_score"]) == (round(w["exact_similarity"], 6), round(w["exact_score"], 6))
            assert (m["full_span"], m["body_span"]) == (([w["full_start"], w["full_end"]], [w["body_start"], w["body_end"]]) if w["matched"] else (None, None))
            assert m["match_mode"] != "exact" or m["match_score"] == 1
    assert modes == {"exact", "fuzzy", "unmatched"} and len(got) == len(random_records)


def test_windows_dealt_out_give_the_same_records(spark, random_records):
    df = _frame(spark, random_records).repartition(3)
    by = lambda rows: sorted((str(r.asDict(recursive=True)) for r in rows))
    plain = by(extract_tables(df).collect())
    for most in (0, 12):
        assert by(extract_tables(df, long_tables=most).collect()) == plain
    assert any("fuzzy" in r for r in plain)


def test_worked_segments(spark):
    got = {r["i"]: (r["text_list"], r["type_list"]) for r in extract_tables(_frame(spark, [c[:2] for c in CASES])).collect()}
    assert {i: got[i] for i in SEGMENTS} == SEGMENTS


LEGACY = [("H A B T", ["H<br>A B"] * 2, (["H ", "A B", "A B", " T"], [0, 1, 1, 0], [1.0, 1.0])), (" x y ", ["H<br><br>"], ([" ", "x y", " "], [0, 1, 0], [0.0])), ("abc", [], (["abc"], [0], [])), ("abc", ["H<br>zzzzzz"], (["abc"], [0], [0.0])), ("", ["H<br>x"], ([], [], [0.0]))]


def test_legacy_records(spark, random_records):
    cases = [(t, p) for t, p, _ in LEGACY] + [(t, [c for c in p or [] if c]) for t, p in random_records if t is not None]
    rows = [(i, t, json.dumps([{"content": c} for c in p])) for i, (t, p) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, ctt string, tabel_info string")
    got = extract_tables(df.orderBy("i").coalesce(1), mode="legacy")
    assert got.columns == ["segments", "types", "similarities"]
    for (t, p), r in zip(cases, got.collect(), strict=True):
        want = pytext.legacy_extract(t, json.dumps([{"content": c} for c in p]))
        assert tuple(r) == want, (t, p)
    for (t, p, want), r in zip(LEGACY, got.limit(len(LEGACY)).collect(), strict=True):
        assert tuple(r) == want
    assert legacy_lines(got.limit(1)).first()["similarities"] == ["1.0000", "1.0000"]
    odd = spark.createDataFrame([("a", v) for v in (None, "null", "5", "{}", "bad", '["x"]', '[{"content":5}]')], "ctt string, tabel_info string")
    assert {tuple(map(tuple, r)) for r in extract_tables(odd, mode="legacy").collect()} == {(("a",), (0,), ())}


def test_other_modes_are_refused(spark):
    with pytest.raises(ValueError, match="mode"):
        extract_tables(_frame(spark, []), mode="new")


def test_names_that_exist_are_overwritten_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([("q A<br>B r", "[{'content': 'A<br>B'}]", 1, "t")], "ctt string, tabel_info string, text_list int, x string")
    r = extract_tables(df).first()
    assert r["text_list"] == ["q A<br>", "B", " r"] and r["x"] == "t" and set(r.asDict()) == {"ctt", "tabel_info", "text_list", "x", "type_list", "table_metrics"}
    assert extract_tables(df.limit(0)).count() == 0 and summary(extract_tables(df.limit(0))).first()["total_tables"] == 0


@pytest.fixture
def lines(tmp_path):
    first = {"ctt": CASES[0][0], "tabel_info": [{"content": CASES[0][1][0]}], "n": 1}
    fourth = {"ctt": CASES[5][0], "tabel_info": json.dumps([{"content": c} for c in CASES[5][1]]), "n": None}
    path = tmp_path / "in" / "pages.jsonl"
    path.parent.mkdir()
    path.write_text("\n".join([json.dumps(first, ensure_ascii=False), "  ", '{"ctt":"abc"}', json.dumps(fourth)]) + "\n", encoding="utf-8")
    return path


def test_files_and_command_line(spark, lines, capsys):
    assert main([str(lines)], spark) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (said["total_records"], said["total_tables"], said["matched_tables"]) == (3, 3, 3)
    read = lambda p: [json.loads(x) for f in sorted(p.glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]
    records, flat = read(lines.parent / "pages.table_segments.jsonl"), read(lines.parent / "pages.table_metrics.flat.jsonl")
    assert [(r["record_index"], r["line_no"], r["table_idx"]) for r in flat] == [(0, 1, 0), (2, 4, 0), (2, 4, 1)]
    assert [r["ctt"] for r in records] == [CASES[0][0], "abc", CASES[5][0]] and [r.get("n") for r in records] == [1, None, None]
    assert records[1]["text_list"] == ["abc"] and records[1]["table_metrics"] == [] and "record_index" not in records[0]
    assert list(map(set, records))[1] == {"ctt", "text_list", "type_list", "table_metrics"} and "n" not in records[1] and "n" in records[2]
    assert records[0]["tabel_info"] == [{"content": CASES[0][1][0]}] and flat[0]["full_span"] == [6, 23]
    assert not (lines.parent / "pages.table_segments.jsonl.staged").exists()


def test_fields_that_are_named_like_the_numbers_stay(spark, tmp_path, capsys):
    rows = [{"ctt": "x A<br>B", "tabel_info": [{"content": "A<br>B"}], "line_no": 99}, {"ctt": "q", "record_index": None}]
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = sorted(read_jsonl(spark, str(tmp_path / "in.jsonl")).collect(), key=lambda r: r["__record_index"])
    assert [(r["__record_index"], r["__line_no"], r["line_no"], r["record_index"]) for r in got] == [(0, 1, 99, None), (1, 2, None, None)]
    assert main([str(tmp_path / "in.jsonl")], spark) == 0
    capsys.readouterr()
    read = lambda p: [json.loads(x) for f in sorted(p.glob("part-*")) for x in f.read_text().splitlines()]
    records, flat = read(tmp_path / "in.table_segments.jsonl"), read(tmp_path / "in.table_metrics.flat.jsonl")
    assert [{k: r.get(k, "none") for k in ("line_no", "record_index", "tabel_info")} for r in records] == [{"line_no": 99, "record_index": "none", "tabel_info": [{"content": "A<br>B"}]}, {"line_no": "none", "record_index": None, "tabel_info": "none"}]
    assert [(r["record_index"], r["line_no"]) for r in flat] == [(0, 1)]


def test_table_info_is_another_name(spark):
    df = spark.createDataFrame([("q A<br>B r", "[{'content': 'A<br>B'}]")], "ctt string, table_info string")
    assert extract_tables(df).first()["text_list"] == ["q A<br>", "B", " r"]


def test_numbering_moves_no_text(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k} {i}\n" + "\n" * (i % 3 == k) for i in range(50)))
    df = numbered_lines(spark, str(tmp_path), "file")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in df._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0] and "Repartition" not in plan
    for k in range(3):
        text = (tmp_path / f"{k}.txt").read_text().split("\n")
        want = [(t, i + 1) for i, t in enumerate(text) if t]
        got = sorted((r["record_index"], r["value"], r["line_no"]) for r in df.where(F.col("file").endswith(f"/{k}.txt")).collect())
        assert got == [(n, t, i) for n, (t, i) in enumerate(want)]


def test_legacy_command_line(spark, lines, tmp_path, capsys):
    assert main([str(lines), "-o", str(tmp_path / "out"), "--mode", "legacy"], spark) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 3
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "out").glob("part-*")) == 3


def test_default_places():
    assert beside("/a/b/pages.jsonl", ".x") == "/a/b/pages.x" and beside("pages.jsonl", ".x") == "pages.x"


def test_a_bad_line_fails_the_job(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"ctt":"a"}\n{"ctt": broken\n')
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("ctt string, tabel_info variant")
    with pytest.raises(Exception, match="MALFORMED"):
        read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()


def test_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    text = ["" if i % 5 == 3 else f"line {i} " + "x" * (i % 37) for i in range(500)]
    path.write_text("\n".join(text) + "\n")
    want = [(t, i + 1) for i, t in enumerate(text) if t]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64b", "1k", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = sorted((r["record_index"], r["value"], r["line_no"]) for r in numbered_lines(spark, str(path)).collect())
            assert got == [(k, t, n) for k, (t, n) in enumerate(want)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_stream_gives_the_batch_rows(spark, tmp_path):
    _frame(spark, [c[:2] for c in CASES]).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("i int, ctt string, tabel_info array<string>, other string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = write_stream(extract_stream(source), str(tmp_path / "r"), str(tmp_path / "f"), str(tmp_path / "c"))
    assert query.awaitTermination(300)
    batch = extract_tables(spark.read.parquet(str(tmp_path / "in")))
    names = batch.columns
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "r")).select(names).collect())) == sorted(map(str, batch.collect()))
    assert spark.read.parquet(str(tmp_path / "f")).count() == flat_metrics(batch).count()


def test_functions_in_sql_and_as_columns(spark):
    sql.register(spark)
    r = spark.sql("""SELECT tabloom_fold('A <b>B</b>') AS f, tabloom_contents("[{'content': 'x'}]") AS c, tabloom_similarity('tide', 'diet') AS s""").first()
    assert tuple(r) == ("ab", ["x"], 0.25)
    df = spark.createDataFrame([("tide", "diet"), (None, "x")], "a string, b string")
    assert [x[0] for x in df.select(ratio(F.col("a"), F.col("b"))).collect()] == [0.25, None]
    assert [x[0] for x in df.select(similarity(F.col("a"), F.col("b"))).collect()] == [0.25, None]
    assert tuple(df.select(match_blocks(F.col("a"), F.col("b")).alias("m")).first()["m"]) == (1, 3, 4)


def test_passages_against_every_pair(spark):
    r = random.Random(22)
    texts = [(i, "".join(r.choice("abc") for _ in range(r.randrange(60)))) for i in range(80)] + [(80, None), (81, "")]
    passages = [(i, "".join(r.choice("abc") for _ in range(r.randrange(1, 6)))) for i in range(40)] + [(40, ""), (41, None), (42, "abc"), (43, "abc")]
    want = sorted((i, k, t.find(p)) for i, t in texts if t for k, p in passages if p and p in t)
    t, p = spark.createDataFrame(texts, "i int, s string"), spark.createDataFrame(passages, "k int, p string")
    for chars in (1 << 20, 30):
        assert sorted(map(tuple, passages_in(t, p, "i", "s", "k", "p", chars).collect())) == want
    assert passages_in(t, p.limit(0), "i", "s", "k", "p").count() == 0 and passages_in(t.limit(0), p, "i", "s", "k", "p").count() == 0


def test_of_a_title_and_a_navigation_that_lies_in_it_one_is_cut_out(spark):
    text = "<title>Home news and shop today.</title><nav><li>Home</li><li>news</li><li>and</li></nav> end"
    nav, title = "Home<br>news<br>and", "Home news and shop today."
    row = extract_tables(_frame(spark, [(text, [nav, title])])).collect()[0]
    assert [m["full_span"] for m in row["table_metrics"]] == [[7, 20], [7, 32]]
    assert (row["text_list"], row["type_list"]) == (["<title>", title, text[32:]], [0, 1, 0])
    assert "".join(row["text_list"]) == text


def test_the_first_version_s_sweep_may_end_beside_the_exact_place(spark):
    words = ["lyin", "lyin", "lyin", "andinly", "andinly", "lyin"]
    lines = [f'<li><a href="/{w}">{w}</a></li>' for w in words]
    text = f"<html><head><title>{' '.join(words)}</title></head><body><nav><ul>{''.join(lines)}</ul></nav><p>{'text ' * 30}</p></body></html>"
    wrong = "Head<br>" + lines[0] + lines[1].replace("<li>", "<¤i>") + lines[2]
    row = extract_tables(spark.createDataFrame([(text, json.dumps([{"content": wrong}]))], "ctt string, tabel_info string"), mode="legacy").collect()[0]
    folded, body = pytext.legacy_folded(text), pytext.legacy_folded(wrong[8:]).text
    place = _plain_sweep(folded.text, body, 0.5)
    assert place[0] != folded.text.find(pytext.legacy_folded("".join(lines[:3])).text)
    assert len(row["segments"][0]) == folded.offsets[place[0]]
