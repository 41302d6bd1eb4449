"""Odd input for every operator, and the pipeline's stages against brute force."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import audio, embeddings, html, langid, minhash, mixing, pieces, pii, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, key string, redacted string, label string"
LONG = " ".join(f"w{i % 977}x" for i in range(120_000))
SAMPLE = "Der schnelle Fuchs springt heute wieder einmal über den faulen alten Hund am Ufer"
ROWS = [
    (1, SAMPLE, "de", "a"),
    (2, SAMPLE, "de", "a"),
    (2, SAMPLE, "de", "a"),
    (3, None, None, None),
    (None, "no id at all but some words here", "en", "b"),
    (4, "", "en", None),
    (5, " \n\t ", "en", "b"),
    (6, LONG, "en", "b"),
    (7, "\u0000 á \U0001f600 ½ ﬁ ▁", None, "c"),
    (8, "Mail bob.smith@mail.example.com now", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, g, s, None if t is None else len(t), 1, "r", "k", "x", None) for i, t, g, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def machine():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 500, 20)).astype(np.int32) for _ in range(60)]
    return toxicity.train(rows, np.arange(60) % 2)


def _by_id(df, name):
    return {r["doc_id"]: r[name] for r in df.collect()}


def test_minhash_odd(odd, none):
    groups = {r["doc_id"]: (r["group_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()}
    assert groups == {1: (1, True), 2: (1, False)}
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, None, 4, 5, 6, 7, 8], key=str)
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicated(none).count() == 0


def test_minhash_of_repeated_ids_keeps_the_least_text(spark):
    df = spark.createDataFrame([(1, "b b b", 1), (1, "a a a", 2), (1, None, 3)], "doc_id long, text string, least int")
    assert [tuple(r) for r in minhash.deduplicated(df).collect()] == [(1, None, 3)]


def test_toxicity_odd(odd, none, machine):
    got = toxicity.scored(odd, machine)
    assert got.count() == len(ROWS)
    rows = {(r["doc_id"], r["toxicity"] is None, r["toxic"]) for r in got.where("doc_id = 3 or toxicity is null").collect()}
    assert rows == {(3, True, False)}
    assert toxicity.scored(none, machine).count() == 0
    kept = toxicity.clean(odd, machine)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 1


def test_toxicity_fit_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(toxicity.fit(odd, labels).w) == 0
    one = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(toxicity.fit(odd, one).w) == 0


def test_pii_odd(odd, none):
    assert [tuple(r) for r in pii.found(odd).collect()] == [(8, "EMAIL", 5, 31)]
    new = pii.without_entities(odd)
    assert new.columns == odd.columns and new.count() == len(ROWS)
    assert _by_id(new, "text")[8] == "Mail [EMAIL] now" and _by_id(new, "n_chars")[8] == len("Mail [EMAIL] now")
    assert _by_id(new, "text")[3] is None and _by_id(new, "redacted")[8] == "x"
    assert pii.found(none).count() == 0 and pii.without_entities(none).count() == 0


def test_mixing_odd(odd, none):
    got = mixing.mixture(odd)
    assert got.columns == odd.columns and got.count() == len(ROWS)
    assert mixing.mixture(none).count() == 0 and mixing.allocation(none).count() == 0
    assert mixing.mixture(odd, total=0).count() == 0
    only = mixing.mixture(odd, total=7, weights={"b": 1.0})
    assert only.count() == 7 and {r["source"] for r in only.collect()} == {"b"}


def test_pieces_odd(odd, none):
    rows = {r["doc_id"]: r for r in pieces.tokens(odd).collect()}
    assert rows[3]["ids"] is None and rows[4]["ids"] == [] and pieces.tokens(none).count() == 0
    assert pieces.tokens(odd).count() == len(ROWS)
    assert len(rows[6]["ids"]) == len(rows[6]["begins"]) == len(rows[6]["ends"]) and rows[6]["ends"][-1] == len(LONG)


def test_language_odd(odd, none):
    model = langid.train(["der hund und die katze", "the dog and the cat"] * 5, ["de", "en"] * 5)
    got = {r["doc_id"]: r["language"] for r in langid.identified(odd, model).collect()}
    assert got[3] is None and got[4] is None and got[1] == "de"
    assert langid.identified(none, model).count() == 0
    empty = langid.fit(none)
    assert {r["language"] for r in langid.identified(odd, empty).collect()} == {None}


def test_secrets_odd(odd, none):
    assert secrets.found(odd).count() == 0 and secrets.found(none).count() == 0


def test_audio_odd(spark, odd, none):
    clips = odd.withColumn("clip", F.encode("text", "UTF-8"))
    ids = {r["doc_id"] for r in audio.features(clips, rate=24_000, width=1).select("doc_id").collect()}
    assert not ids & {3, 4} and 6 in ids
    assert audio.features(none.withColumn("clip", F.encode("text", "UTF-8")), rate=24_000).count() == 0
    broken = spark.createDataFrame([(1, b"RIFF1234WAVEjunk"), (2, b"")], "doc_id long, clip binary")
    assert audio.features(broken).count() == 0


def test_html_odd(spark):
    model = html.train([html.parsed("<article><p>some words, indeed.</p></article><nav><a>x</a></nav>")] * 4)
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, 1), (2, "", 2), (3, deep, 3), (3, deep, 3), (None, "no tags", 4), (5, "<p>a<p>b</table></p><", 5)]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, html string, x int"), model)
    by = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(rows) and by[1]["text"] is None and by[2]["text"] == "" and by[3]["text_nodes"] == 1 and by[5]["text_nodes"] == 3
    assert html.extracted(spark.createDataFrame([], "page_id long, html string"), model).count() == 0


def test_embeddings_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (None, [1.0, 0.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [1.0, None], 1)]
    rows.append((2, [9.0, 1.0], 1))  # of rows that repeat an id the least vector counts
    got = embeddings.near_classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 1, 1), (8, 8, 0)]
    names = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "name string, x array<double>")
    assert sorted(map(tuple, embeddings.near_classes(names, "name", "x").collect())) == [("a", "a", 1), ("b", "a", 1), ("c", "c", 0)]
    assert embeddings.near_classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- stages ------------------------------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


def _write(df, tmp_path, name):
    df.write.mode("overwrite").parquet(str(tmp_path / name))
    return df.sparkSession.read.parquet(str(tmp_path / name))


def test_each_stage_takes_odd_documents(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        docs = _write(docs.select("doc_id", "text", "lang", "source", "n_chars"), tmp_path, name)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.columns
            docs = _write(stage(spark, docs, SF), tmp_path, f"{name}{i}")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == before
        assert docs.columns == ["doc_id", "ids", "begins", "ends"]
        assert (docs.count() == 0) == (name == "none")


def test_pipeline_against_brute_force(spark):
    """Every stage's result from the one before, by single-row versions of the operators."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    m = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    clean = [r for r in rows if m.scores(pa.array([r["text"] or ""]), m.table())[0] < toxicity.THRESHOLD]
    assert {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()} == {r["doc_id"] for r in clean} and len(clean) < len(rows)
    shingles = {}
    for r in clean:
        w = re.sub(r"[A-Z]", lambda x: x[0].lower(), r["text"] or "").lower().split()
        shingles[r["doc_id"]] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    root = {i: i for i in shingles}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in shingles if shingles[i])
    close = [(a, b, len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    for a, b, j in close:
        if j >= 0.6:
            root[find(b)] = find(a)
    groups = defaultdict(set)
    for i in ids:
        groups[find(i)].add(i)
    expected = {i for g in groups.values() if len(g) > 1 for i in g if i != min(g)}
    frame = docs.where(F.col("doc_id").isin([r["doc_id"] for r in clean]))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame, SF).collect()}
    gone = set(shingles) - kept
    assert len(gone & expected) >= 0.9 * len(expected)
    sure = {i for a, b, j in close if j >= 0.3 for i in (a, b)}
    assert gone <= sure
    field = pii.trained()
    frame = docs.where(F.col("doc_id").isin(list(kept)))
    redacted = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact_personal_data(spark, frame, SF).collect()}
    for r in rows:
        if r["doc_id"] in kept:
            t, at, parts = r["text"], 0, []
            for b, e, k in pii.spans(pa.array([t]), field)[0]:
                parts += [t[at:b], f"[{pii.TYPES[k]}]"]
                at = e
            assert redacted[r["doc_id"]] == "".join(parts) + t[at:]
    mixed = corpus_pipeline.mix_sources(spark, frame, SF)
    assert mixed.count() == frame.count()
    sizes = Counter(r["source"] for r in frame.select("source").collect())
    weight = {s: int(1e6 * n**0.5) for s, n in sizes.items()}
    got = Counter(r["source"] for r in mixed.select("source").collect())
    for s in sizes:
        assert abs(got[s] - weight[s] / sum(weight.values()) * frame.count()) <= 1


def test_pieces_stage_against_the_library(spark):
    from test_operators import _library

    library, docs = _library(), spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = corpus_pipeline.encode_pieces(spark, docs, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["ids"] == library.encode(texts[r["doc_id"]], out_type=int)
        assert len(r["begins"]) == len(r["ends"]) == len(r["ids"]) and (not r["ids"] or r["ends"][-1] == len(texts[r["doc_id"]].encode()))


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "ids", "begins", "ends"] and got.count() > 100
