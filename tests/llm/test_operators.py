"""Each operator against a brute-force version, a round trip or held-out labels."""

import io
import itertools
import math
import random
import re
import wave
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tabloom.llm import audio, embeddings, html, langid, minhash, mixing, pieces, pii, queries, secrets, toxicity
from tabloom.llm._sample import bounded_sample
from tabloom.llm._text import Words

SF = "/root/testdata/sf0.01"


# ---- 1 audio -----------------------------------------------------------------------------------------------------------


def test_resampling_is_the_direct_sum():
    x = np.random.default_rng(1).normal(size=700).astype(np.float32)
    for rate in (24_000, 8_000, 44_100):
        taps, half = audio._filter(16_000 // math.gcd(rate, 16_000), rate // math.gcd(rate, 16_000))
        up, down = 16_000 // math.gcd(rate, 16_000), rate // math.gcd(rate, 16_000)
        want = []
        for n in range(-(-len(x) * up // down)):
            base = n // up * down
            want.append(sum(taps[k, n % up] * x[base + k - half] for k in range(len(taps)) if 0 <= base + k - half < len(x)))
        assert np.allclose(audio.resampled(x, rate), want, atol=1e-4)


def test_a_tone_keeps_its_pitch():
    t = np.arange(24_000) / 24_000
    y = audio.resampled(np.sin(2 * np.pi * 1000 * t).astype(np.float32), 24_000)
    spectrum = np.abs(np.fft.rfft(y[2000:14_000]))
    assert len(y) == 16_000 and abs(spectrum.argmax() * 16_000 / 12_000 - 1000) < 2
    high = audio.resampled(np.sin(2 * np.pi * 11_000 * t).astype(np.float32), 24_000)
    assert np.abs(high[2000:14_000]).max() < 0.05


def test_hysteresis_is_the_state_machine():
    level = np.random.default_rng(2).uniform(-60, -10, 4000)
    on, start, want = False, 0, []
    for i, v in enumerate(level):
        if not on and v >= audio.HIGH:
            on, start = True, i
        elif on and v < audio.LOW:
            on = False
            want.append((start, i))
    assert audio.sounding(level) == want + ([(start, len(level))] if on else [])


def test_log_mel_is_the_direct_transform():
    frames = audio.framed(np.random.default_rng(3).normal(size=900).astype(np.float32))
    k = np.arange(audio.FFT // 2 + 1)[:, None] * np.arange(audio.WINDOW)[None, :]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.WINDOW) / audio.WINDOW)
    power = np.abs((frames * window) @ np.exp(-2j * np.pi * k / audio.FFT).T) ** 2
    assert np.allclose(audio.log_mel(frames), np.log(power @ audio.mel_filters() + 1e-6), atol=1e-2)


def test_features_of_a_wave_file_and_their_tensors(spark, tmp_path):
    rate, out = 8000, io.BytesIO()
    x = np.zeros(rate * 2)
    x[4000:9000] = 0.5 * np.sin(2 * np.pi * 440 * np.arange(5000) / rate)
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    df = audio.features(spark.createDataFrame([(7, out.getvalue())], "doc_id long, clip binary"))
    rows = df.orderBy("segment", "chunk").collect()
    assert {r["segment"] for r in rows} == {0} and abs(rows[0]["start_s"] - 0.5) < 0.05 and abs(rows[-1]["end_s"] - 1.125) < 0.05
    assert [r["chunk"] for r in rows] == list(range(len(rows))) and all(len(r["tensor"]) == audio.FRAMES * audio.MELS for r in rows)
    files = audio.store(df, str(tmp_path / "tensors")).collect()
    table = pa.concat_tables([pq.read_table(r["file"]) for r in files])
    assert table.num_rows == len(rows) and table.schema.field("tensor").type.shape == [audio.FRAMES, audio.MELS]


def _wav(x, width, rate=16_000):
    out, top = io.BytesIO(), 2 ** (8 * width - 1)
    ints = np.clip(np.rint(x * top), -top, top - 1).astype(np.int64)
    data = (ints + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(width, "little", signed=True) for v in ints)
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(data)
    return out.getvalue()


def test_every_width_of_pcm_is_read_and_wrong_calls_raise(spark):
    x = 0.5 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16_000)
    for width in (1, 2, 3, 4):
        assert np.allclose(audio.Pcm(_wav(x, width), None, 1).read(0, 8000), x, atol=2.0 ** (1 - 8 * width) + 1e-6)
    df = spark.createDataFrame([(f"w{w}", _wav(x, w)) for w in (1, 2, 3, 4)], "name string, clip binary")
    rows = audio.features(df, "name").collect()
    assert Counter(r["doc_id"] for r in rows) == {f"w{w}": 4 for w in (1, 2, 3, 4)}
    for options in ({"rate": 0}, {"rate": 8000, "width": 5}):
        with pytest.raises(ValueError):
            audio.features(df, "name", **options)
    with pytest.raises(Exception, match="needs a rate"):
        audio.features(spark.createDataFrame([(1, b"no wave file")], "doc_id long, clip binary")).collect()


def test_strips_give_what_one_pass_gives():
    rng = np.random.default_rng(17)
    x = rng.normal(size=120_000) * np.repeat(rng.choice([0, 0.001, 0.02, 0.3], size=200), 600)
    clip = (x.clip(-1, 0.99) * 128 + 128).astype(np.uint8).tobytes()
    y = audio.resampled(audio.Pcm(clip, 24_000, 1).read(0, len(clip)), 24_000)
    frames = audio.framed(y)
    mel, want = audio.log_mel(frames), []
    for s, (b, e) in enumerate(audio.sounding(audio.levels(frames))):
        for c, i in enumerate(range(b, e, audio.FRAMES)):
            n = min(audio.FRAMES, e - i)
            want.append((s, c, i * audio.HOP / audio.RATE, min(len(y), (i + n - 1) * audio.HOP + audio.WINDOW) / audio.RATE, n, mel[i : i + n]))
    for strip in (5, 16, 100, audio.STRIP):
        got = list(audio.clip_features(clip, 24_000, 1, strip))
        assert [g[:5] for g in got] == [w[:5] for w in want] and len(got) > 20
        assert all(np.allclose(g[5][: g[4]], w[5], atol=1e-3) and not g[5][g[4] :].any() for g, w in zip(got, want, strict=True))


def test_audio_query_against_one_clip_at_a_time(spark, tmp_path):
    texts = ["plain text that is one clip", "ÿ" * 3000, "", "x" * 90 + " é" * 500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["segment"], r["chunk"]): r for r in queries.op1_audio_features(spark, str(tmp_path)).collect()}
    want = {(i, s, c): (b, e, n, t) for i, x in enumerate(texts) if x for s, c, b, e, n, t in audio.clip_features(x.encode(), 24_000, 1)}
    assert got.keys() == want.keys() and got
    for k, (b, e, n, t) in want.items():
        assert (got[k]["start_s"], got[k]["end_s"], got[k]["frames"]) == (b, e, n) and np.allclose(got[k]["tensor"], t.reshape(-1))


# ---- 2 language --------------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 40")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = langid.identified(held, langid.fit(train)).join(held.select("doc_id", "lang").distinct(), "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.97


def test_scores_are_the_kernel_sums():
    texts = ["der hund", "die katze", "the dog", "the cat", "le chien", "la souris"]
    names = ["de", "de", "en", "en", "fr", "fr"]
    model = langid.train(texts, names, landmarks=6, ridge=1e-2)
    table = langid.alphabet_of(texts)

    def grams(t):
        c = table[[ord(x) for x in t]].tolist()
        return {tuple(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1)}

    k = np.array([[len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b))) for b in texts] for a in texts])
    y = np.where(np.array(names)[:, None] == np.array(model.languages)[None], 1.0, -1.0)
    # with every text a landmark this is kernel ridge regression itself
    alpha = np.linalg.solve(k + 1e-2 * len(texts) * np.eye(len(texts)), y - y.mean(0))
    assert np.allclose(model.scores(texts, model.table()), k @ alpha + y.mean(0), atol=1e-3)


def test_every_character_of_the_sample_tells_languages_apart():
    r = random.Random(18)
    drawn = lambda a, n: "".join(chr(r.randrange(a, a + n)) for _ in range(30))
    texts = [drawn(a, 300) for a in (0x4E00, 0x5000, 0x430) for _ in range(40)]
    names = [x for x in ("zh", "xx", "ru") for _ in range(40)]
    model = langid.train(texts, names, landmarks=120)
    fresh = [drawn(a, 300) for a in (0x4E00, 0x5000, 0x430) for _ in range(10)]
    got = [model.languages[i] for i in model.scores(fresh, model.table()).argmax(axis=1)]
    assert len(model.alphabet) > 700 and np.mean([g == n for g, n in zip(got, [x for x in ("zh", "xx", "ru") for _ in range(10)], strict=True)]) > 0.95


# ---- bounded samples ---------------------------------------------------------------------------------------------------


def test_samples_are_of_distinct_ids(spark):
    rows = [(i % 10, f"t{i % 30}", i) for i in range(4000)] + [(None, "x", 1)] * 5
    df = spark.createDataFrame(rows, "id long, text string, n long")
    got = [tuple(r) for r in bounded_sample(df, "id", 4).collect()]
    assert len(got) == len({g[0] for g in got}) == 4 and None not in {g[0] for g in got}
    assert all(g == min(r for r in rows if r[0] == g[0]) for g in got)
    assert bounded_sample(df, "id", 100).count() == 10 and bounded_sample(df.limit(0), "id", 4).count() == 0
    assert sorted(map(tuple, bounded_sample(df.repartition(7), "id", 4).collect())) == sorted(got)
    wide = spark.range(50_000).select("id")
    assert bounded_sample(wide, "id", 300).count() == 300


def test_ten_ids_repeated_teach_as_ten_rows(spark):
    even = pieces.F.col("doc_id") % 2 == 0
    docs = spark.range(40_000).select((pieces.F.col("id") % 10).alias("doc_id"))
    docs = docs.select("doc_id", pieces.F.when(even, "der hund und die katze").otherwise("the dog and the cat").alias("text"), pieces.F.when(even, "de").otherwise("en").alias("lang"), pieces.F.when(even, 1).otherwise(0).alias("toxic"))
    assert langid.fit(docs, rows=1600).languages == ("de", "en")
    machine = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert len(machine.w) and machine.scores(pa.array(["der hund und die katze"]), machine.table())[0] > 0.5 > machine.scores(pa.array(["the dog and the cat"]), machine.table())[0]
    page = "<nav><a>go home</a></nav><article><p>Some words, and more.</p></article>"
    pages = spark.range(6000).select((pieces.F.col("id") % 5).alias("page_id"), pieces.F.lit(page).alias("html"))
    few = html.fit(spark.createDataFrame([(i, page) for i in range(5)], "page_id long, html string"))
    assert np.allclose(html.fit(pages).weights, few.weights) and few.weights.any()
    assert not html.fit(pages.limit(0)).weights.any() and not html.fit(spark.createDataFrame([(1, None)], "page_id long, html string")).weights.any()
    assert not html.fit(pages, most_chars=10).weights.any() and langid.fit(docs, most_chars=3).languages == ()


# ---- 3 pages -----------------------------------------------------------------------------------------------------------


def test_marginals_are_those_of_all_labellings():
    page = html.parsed("<div><p>a b</p><p>c</p><ul><li>d</ul></div>")
    forest = html.Forest([page])
    rng = np.random.default_rng(4)
    own, couple = rng.normal(size=(len(page.parent), 2)), rng.normal(size=(2, 2, 2))
    kind, total, sums = forest.text.astype(int), 0.0, np.zeros(len(page.parent))
    for s in itertools.product((0, 1), repeat=len(page.parent)):
        w = math.exp(sum(own[i, v] for i, v in enumerate(s)) + sum(couple[kind[i], s[p], s[i]] for i, p in enumerate(page.parent) if p >= 0))
        total += w
        sums += w * np.array(s)
    one, _, z = html.marginals(forest, own, couple)
    assert np.allclose(one[:, 1], sums / total) and np.isclose(z[0], math.log(total))


def test_content_of_held_out_pages(spark):
    pages = [html.parsed(r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages = [p for p in pages if p.marked]
    model = html.train(pages[::2])
    forest = html.Forest(pages[1::2])
    p = model.content(forest)[forest.text] >= 0.5
    assert np.mean(p == forest.label[forest.text]) > 0.95


def test_self_closed_elements_do_not_swallow_the_page():
    texts = lambda page: [t for t in html.parsed(page).text if t]
    assert texts('<p>one</p><svg class="i"/><p>two</p>') == ["one", "two"]
    assert texts('<p>one</p><svg/><p>two</p><svg><text>no</text></svg><p>three</p>') == ["one", "two", "three"]
    strict = '<?xml version="1.0"?>\n<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN" "xhtml1-strict.dtd">'
    assert texts(strict + '<html><head><title/><script src="a.js"/></head><body><p>one</p></body></html>') == ["one"]
    assert texts('<!doctype html><script src="a.js"/><p>no</p></script><p>one</p>') == ["one"]


# ---- 4 toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_of_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    machine = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    held = toxicity.scored(docs, machine).join(labels.where("doc_id % 2 = 1").select("doc_id", labels["toxic"].alias("truth")), "doc_id").where("truth is not null").collect()
    said, true = np.array([r["toxic"] for r in held]), np.array([r["truth"] == 1 for r in held])
    assert (said & true).sum() / true.sum() > 0.9 and (said & ~true).sum() / (~true).sum() < 0.03


def test_pairs_are_learnt_that_no_sum_can_express():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 2, 2000), rng.integers(0, 2, 2000)
    rows = [np.array([11] * x + [22] * y + [33 + i % 7], np.int32) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    m = toxicity.train(rows, a & b)
    at = m.table()
    score = lambda *s: m.logits(np.zeros(len(s), int), at[list(s)], 1)[0]
    assert score(11, 22) > 0 > max(score(11), score(22)) and score(11, 22) - score(11) - score(22) + m.w0 > 1


def test_logits_are_the_double_sum():
    rng = np.random.default_rng(7)
    m = toxicity.Machine(np.arange(5), 0.3, rng.normal(size=5), rng.normal(size=(5, 3)))
    for s in ([], [2], [0, 3, 4], [0, 1, 2, 3, 4]):
        want = 0.3 + sum(m.w[i] for i in s) + sum(m.v[i] @ m.v[j] for i, j in itertools.combinations(s, 2))
        assert np.isclose(m.logits(np.zeros(len(s), int), np.array(s, int), 1)[0], want)


# ---- 5 personal data ---------------------------------------------------------------------------------------------------


def _all_segmentations(island, i=0):
    """Every way to cover the units from ``i`` on by candidates and outside units, as lists of candidates."""
    if i == len(island.bounds):
        yield []
        return
    for c in [None, *(c for c in island.candidates if c[0] == i)]:
        for rest in _all_segmentations(island, i + 1 if c is None else c[1]):
            yield ([] if c is None else [c]) + rest


def _score(field, island, chosen):
    covered = {u for i, j, _, _ in chosen for u in range(i, j)}
    return sum(float(field.weights[k] @ f) for _, _, k, f in chosen) + sum(field.outside * island.outside[u] for u in range(len(island.bounds)) if u not in covered)


TEXTS_OF_SPANS = ("a.b@c.de 1.2.3.4", "219-09-9999 (555) 234-5678", "DE89370400440532013000", "+1 415 555 2671 x")


def test_best_segmentation_is_the_best_of_all():
    rng = np.random.default_rng(8)
    for text in TEXTS_OF_SPANS:
        island = pii.Island(text, "call ")
        field = pii.Field(rng.normal(size=(len(pii.TYPES), pii.FEATURES)), 0.2)
        best = max(_score(field, island, s) for s in _all_segmentations(island))
        starts = {island.bounds[i][0]: i for i in range(len(island.bounds))}
        stops = {e: i + 1 for i, (_, e) in enumerate(island.bounds)}
        known = {c[:3]: c for c in island.candidates}
        chosen = [known[starts[b], stops[e], k] for b, e, k in field.best(island)]
        assert island.candidates and np.isclose(_score(field, island, chosen), best)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(19)
    for text in TEXTS_OF_SPANS[:2]:
        island = pii.Island(text, "mail ")
        segmentations = list(_all_segmentations(island))
        truth = segmentations[len(segmentations) // 2]
        weights, outside = rng.normal(size=(len(pii.TYPES), pii.FEATURES)) * 0.3, 0.2

        def like(w, o, island=island, segmentations=segmentations, truth=truth):
            f = pii.Field(w, o)
            return _score(f, island, truth) - np.logaddexp.reduce([_score(f, island, s) for s in segmentations])

        value, g, g_out = pii.Field(weights, outside).gradient(island, {c[:3] for c in truth})
        assert np.isclose(value, like(weights, outside))
        assert np.isclose(g_out, (like(weights, outside + 1e-5) - like(weights, outside - 1e-5)) / 2e-5, atol=1e-5)
        for k, i in ((0, 0), (0, 3), (1, 1), (2, 8), (4, 2)):
            step = np.zeros_like(weights)
            step[k, i] = 1e-5
            assert np.isclose(g[k, i], (like(weights + step, outside) - like(weights - step, outside)) / 2e-5, atol=1e-5)


def test_entities_of_fresh_sentences():
    field, right, made, said = pii.trained(), 0, 0, 0
    for text, before, spans in pii.examples(400, 99):
        found = set(pii.Field.best(field, pii.Island(text, before)))
        right, made, said = right + len(found & set(spans)), made + len(spans), said + len(found)
    assert right / made > 0.95 and right / said > 0.95


def test_offsets_count_characters_and_clean_text_stays():
    texts = pa.array(["é😀 mail a.b@c.org!", "version 1.2.3 of 2024-01-02, 12:30, page 7", "see 4111 1111 1111 1111 or 4111 1111 1111 1112"])
    got = pii.spans(texts, pii.trained())
    assert got[0] == [(8, 17, 0)] and got[1] == [] and [k for _, _, k in got[2]] == [3]


def test_addresses_of_many_units_are_read_whole():
    r = random.Random(15)
    local = lambda n: "".join(r.choice("abcdef") + r.choice("0123456789") for _ in range(n // 2))
    whole = ["reply+a1b2c3d4e5f6a7b8c9d0e1f2@reply.github.com", *(f"{local(n)}@{host}" for n in (28, 40, 64) for host in ("mail.example.org", "a1.b2.c3.d4.e5.example.com"))]
    whole.append(local(230) + "@" + "mail.example.organization"[: 254 - 231])
    got = pii.spans(pa.array([f"write to {x} now" for x in whole]), pii.trained())
    assert len(whole[-1]) == 254 and got == [[(9, 9 + len(x), 0)] for x in whole]


def test_ibans_in_groups_with_letters_are_read_whole():
    whole = ["GB29 NWBK 6016 1331 9268 19", "NL91 ABNA 0417 1643 00", "IE29 AIBK 9311 5212 3456 78", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "MU17 BOMM 0101 1010 3030 0200 000M UR", "DE89 3704 0044 0532 0130 00"]
    texts = [f"{before}{x}{after}" for x in whole for before in ("", "Please pay to ", "é IBAN: ") for after in ("", ".", " until Friday")]
    got = pii.spans(pa.array(texts), pii.trained())
    assert [[(t[b:e], k) for b, e, k in s] for t, s in zip(texts, got, strict=True)] == [[(x, 5)] for x in whole for _ in range(9)]
    # no more is taken in for a group that only looks like one, nor across texts
    plain = ["flight AB12 THEN gate", "GB29 NWBK", "6016 1331 9268 19"]
    assert all(k != 5 for s in pii.spans(pa.array(plain), pii.trained()) for _, _, k in s)


# ---- 6 MinHash ---------------------------------------------------------------------------------------------------------


def test_signatures_are_the_least_hashes_of_each_bin():
    texts = pa.array(["One two three four five six", "one two", "", "x"])
    sig, has = minhash.signatures(texts, 16)
    assert has.tolist() == [True, True, False, True] and (sig[:2] != minhash.EMPTY).all() and (sig[2] == minhash.EMPTY).all()
    w = Words(pa.array(["a b c"]))
    assert len(w.hashes()) == 3


def test_densification_follows_the_borrowing_sequence():
    rng = np.random.default_rng(9)
    sig = np.where(rng.random((50, 32)) < 0.15, rng.integers(1, 1000, (50, 32)), minhash.EMPTY).astype(np.uint32)
    table, out = minhash._borrow(32), minhash.densified(sig)
    for row, got in zip(sig, out, strict=True):
        if (row == minhash.EMPTY).all():
            assert (got == minhash.EMPTY).all()
            continue
        for b in range(32):
            want = row[b] if row[b] != minhash.EMPTY else next(row[t[b]] for t in table if row[t[b]] != minhash.EMPTY)
            assert got[b] == want


@pytest.fixture(scope="module")
def copies():
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(60):
        text = [r.choice(words) for _ in range(r.choice((30, 80, 300)))]
        rows.append(text)
        for _ in range(r.choice((0, 0, 1, 3))):
            copy = list(text)
            for _ in range(max(1, len(copy) // r.choice((20, 40)))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(copy)
    r.shuffle(rows)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def test_near_duplicates_against_all_pairs(spark, copies):
    shingles = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, t in copies for w in [t.split()]}
    group = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    close = {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(shingles.items(), 2) if x & y}
    want = [p for p, j in close.items() if j >= 0.6]
    found = [p for p in want if group.get(p[0], -1) == group.get(p[1], -2)]
    assert want and len(found) >= 0.95 * len(want)
    assert all(close.get(tuple(sorted((i, g))), 0) > 0.2 for i, g in group.items() if i != g)


def test_no_edge_stands_below_the_exact_similarity(spark):
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(150):
        shared, tails = words(22), (words(12), words(12))
        rows += [" ".join(shared + t) for t in tails]  # 20 of 44 shingles in common: 0.45
        rows += [" ".join(shared + shared[:1] + t[:3]) for t in tails]  # 21 of 27: 0.78
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in map(str.split, rows)]
    texts = pa.array(rows)
    pairs = [(i, j) for k in range(0, len(rows), 4) for i, j in itertools.combinations(range(k, k + 4), 2)]
    want = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in pairs]
    assert np.allclose(minhash.jaccard(texts.take([i for i, _ in pairs]), texts.take([j for _, j in pairs])), want)
    # each pair by itself, so that nothing but its own edge can join it
    far = [(2 * k + x, rows[4 * k + x]) for k in range(150) for x in (0, 1)]
    near = [(2 * k + x, rows[4 * k + 2 + x]) for k in range(150) for x in (0, 1)]
    groups = lambda rows: minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert groups(far) == 0 and groups(near) >= 0.95 * len(near)


def test_components_are_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["id"]: x["root"] for x in minhash.components(spark.createDataFrame(edges, "id long, center long")).collect()}
    assert got == {i: find(i) for i in root}


# ---- 7 mixing ----------------------------------------------------------------------------------------------------------


def test_mixture_is_the_sql_one(spark, tmp_path):
    rows = [(i // 2, "x" * (i * i % 91), ("a", "b", "c", "d")[i % 7 % 4]) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in queries.op7_source_mixing(spark, str(tmp_path)).select("doc_id", "source", "copies").collect())
    with duckdb.connect() as con:
        con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        assert got == Counter(con.sql(mixing.ORACLE).fetchall())


def test_inclusion_follows_the_odds(spark):
    rows = [(i, "x" * (4 if i % 2 else 100), "a") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = Counter()
    for seed in range(12):
        got = mixing.allocation(df, total=100, seed=seed).collect()
        assert sum(r["copies"] for r in got) == 100
        seen.update(len(rows[r["doc_id"]][1]) for r in got)
    assert abs(seen[100] / seen[4] - 11 / 3) < 0.7


def test_quotas_of_many_sources_are_those_of_one_order(spark):
    r = random.Random(23)
    docs = {f"s{i}": r.choice((1, 1, 1, 2, 7, 50)) for i in range(400)} | {None: 3}
    stats = spark.createDataFrame([(s, n, 5 * n) for s, n in docs.items()], "__source string, __docs long, __sizes long").repartition(7)
    w = {s: math.floor(1e6 * math.sqrt(n)) for s, n in docs.items()}
    for total in (None, 0, 101, 5000):
        want = sum(docs.values()) if total is None else total
        base = {s: want * x // sum(w.values()) for s, x in w.items()}
        order = sorted(docs, key=lambda s: (-(want * w[s] % sum(w.values())), s is not None, s or ""))
        for s in order[: want - sum(base.values())]:
            base[s] += 1
        assert {x["__source"]: x["__quota"] for x in mixing.quotas(stats, total, None).collect()} == base


def test_join_beyond_the_bound_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * i, f"s{i % 5}") for i in range(100)], "doc_id long, text string, source string")
    small = sorted(map(tuple, mixing.allocation(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, mixing.allocation(df).collect())) == small


# ---- 8 pieces ----------------------------------------------------------------------------------------------------------


def _library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, own = pb.ModelProto(), pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=pieces.RULES).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


TEXTS = ["Hello world", "  two  spaces ", "ﬁne ½ １２", "é é 가", "日本語 テスト", "a\nb\n\n c", "▁x", "　wide nbsp", "😀😀 ok", "", "x" * 300, "ſtop ㎏ ㍿", "tab\tand​zero"]


def test_ids_are_the_library_s_and_decode_to_the_normal_text(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    library, texts = _library(), TEXTS + docs
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pieces.tokens(df).withColumn("back", pieces.decoded(pieces.F.col("ids")))
    for r in out.collect():
        text = texts[r["doc_id"]]
        assert r["ids"] == library.encode(text, out_type=int), text[:80]
        assert r["back"] == library.decode(r["ids"])


def test_the_query_also_decodes(spark):
    library, rows = _library(), queries.op8_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["decoded"] == library.decode(r["ids"]) for r in rows) and any(r["decoded"] for r in rows)


def test_spans_cover_the_bytes_they_came_from(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pieces.tokens(df).collect():
        size = len(TEXTS[r["doc_id"]].encode())
        assert all(0 <= b <= e <= size for b, e in zip(r["begins"], r["ends"], strict=True)) and r["begins"] == sorted(r["begins"])
        reached = 0
        for b, e in zip(r["begins"], r["ends"], strict=True):
            assert b <= reached
            reached = max(reached, e)
        assert reached == size
    plain = pieces.tokens(spark.createDataFrame([(0, "Hello big world")], "doc_id long, text string")).first()
    core = pieces.encoder().core
    words = ["Hello big world"[b:e] for b, e in zip(plain["begins"], plain["ends"], strict=True)]
    assert [w.strip() for w in words] == [core.id_to_piece(i).replace("▁", "") for i in plain["ids"]]


def test_spans_are_those_of_a_map_by_single_characters(spark):
    """Source bytes of every normalised character, found with the library's own normaliser, prefix by prefix."""
    import sentencepiece

    normalizer, library = sentencepiece.SentencePieceNormalizer(rule_name=pieces.RULES), _library()
    texts = [t for t in TEXTS if t and len(t) < 60] + ["Straße ﬃ x", "naïve café", "ＡＢ１２ ok", "½ ¾ ㎏", "日本 語"]
    rows = {r["doc_id"]: r for r in pieces.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        # each source character's normal form by itself, where that adds up to the whole text's
        alone = [normalizer.normalize(c) if c != " " else " " for c in text]
        if "".join(alone) != normalizer.normalize(text):
            continue
        begins, ends, at = [0, 0, 0], [0, 0, 0], 0
        for c, made in zip(text, alone, strict=True):
            n = len(c.encode())
            size = len(made.replace(" ", pieces.SPACE).encode())
            begins, ends, at = begins + [at] * size, ends + [at + n] * size, at + n
        stops, want = 0, []
        for p in library.encode(text, out_type="immutable_proto").pieces:
            piece = p.piece
            size = 1 if piece.startswith("<0x") else len(piece.encode())
            want.append((begins[stops], ends[stops + size - 1]))
            stops += size
        assert list(zip(rows[i]["begins"], rows[i]["ends"], strict=True)) == want, text


# ---- 9 embeddings ------------------------------------------------------------------------------------------------------


def _brute_classes(x, least=embeddings.LEAST):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {i: (find(i), int(near[i].sum())) for i in range(len(x))}


def _vectors(spark, x):
    return spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("block,pivots", [(8192, 128), (37, 16)])
def test_classes_and_links_against_all_products(spark, block, pivots):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(500, 24))
    x[150:300] = x[:150] + rng.normal(size=(150, 24)) * rng.uniform(0, 0.5, 150)[:, None]
    x[300:400] = x[0] + rng.normal(size=(100, 24)) * 0.02  # a hot group, near one another
    x[400:] = x[1]  # and one of equal vectors
    x = x.astype(np.float32)
    got = {r["vec_id"]: (r["class_id"], r["links"]) for r in embeddings.near_classes(_vectors(spark, x), block_rows=block, pivots=pivots).collect()}
    assert got == _brute_classes(x) and len({c for c, _ in got.values()}) < 400


def test_block_pairs_leave_out_no_near_pair():
    rng = np.random.default_rng(16)
    centres = embeddings.unit(rng.normal(size=(12, 6)), 6)
    x = embeddings.unit(np.concatenate([c + rng.normal(size=(40, 6)) * s for c, s in zip(centres, [0.02, 0.1, 0.5] * 4, strict=True)]), 6)
    dots = x @ centres.T
    cell, turn = dots.argmax(1), np.arccos(dots.max(1))
    ring = (turn / np.pi * 64).astype(int)
    blocks = sorted(set(zip(cell.tolist(), ring.tolist(), strict=True)))
    of = np.array([blocks.index(b) for b in zip(cell.tolist(), ring.tolist(), strict=True)])
    pivot, low = np.array([b[0] for b in blocks]), np.array([b[1] * np.pi / 64 for b in blocks])
    angle, between = math.acos(0.95), np.arccos(np.clip(centres @ centres.T, -1, 1))
    np.fill_diagonal(between, 0)
    near, seen = x @ x.T >= 0.95, {}
    for a, look, whole in embeddings.block_pairs(pivot, low, low + np.pi / 64, between, angle, np.arange(len(blocks))):
        seen |= {(a, b): "look" for b in look.tolist()} | {(a, b): "near" for b in whole.tolist()}
    assert "near" in seen.values() and len(seen) < 0.7 * len(blocks) * (len(blocks) + 1) / 2
    for a in range(len(blocks)):
        for b in range(a, len(blocks)):
            part = near[np.ix_(of == a, of == b)]
            assert seen.get((a, b)) == "look" or (part.all() if seen.get((a, b)) == "near" else not part.any())


def test_bounds_hold():
    rng = np.random.default_rng(11)
    x = rng.standard_t(2, size=(200, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embeddings.quantised(x)
    y = q * s[:, None]
    assert (np.abs(x @ x.T - y @ y.T) <= e[None, :] + e[:, None] * (1 + e[None, :])).all()


# ---- 10 secrets --------------------------------------------------------------------------------------------------------


def test_secrets_are_found_and_known_strings_are_not():
    r = random.Random(12)
    token = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    encoding = secrets._encoding(secrets.VOCABULARY)
    hits = [secrets.judged(token(32), "", frozenset(), encoding, secrets.MOST_RATIO) for _ in range(300)]
    assert sum(h is not None for h in hits) > 0.97 * 300
    for known in ("d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "1234567890123456", "getElementsByClassName", "internationalization", "/usr/local/share/dict/words"):
        assert secrets.judged(known, "", frozenset(), encoding, secrets.MOST_RATIO) is None
    listed = token(32)
    assert secrets.judged(listed, "", frozenset([listed]), encoding, secrets.MOST_RATIO) is None
    assert secrets.judged("d41d8cd98f00b204e9800998ecf8427e", 'token = "', frozenset(), encoding, secrets.MOST_RATIO)


def test_lower_case_secrets_are_found_and_words_are_not():
    r, encoding = random.Random(13), secrets._encoding(secrets.VOCABULARY)
    drawn = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    hit = lambda run, before="": secrets.judged(run, before, frozenset(), encoding, secrets.MOST_RATIO) is not None
    assert sum(hit(drawn(16), 'token = "') for _ in range(300)) > 0.95 * 300 and sum(hit("password=" + drawn(16)) for _ in range(300)) > 0.95 * 300
    assert sum(hit(drawn(32)) for _ in range(300)) > 0.75 * 300 and sum(hit("-".join(drawn(4) for _ in range(4)), "password: ") for _ in range(300)) > 0.95 * 300
    for known in ("internationalization", "/usr/local/share/dict/words", "read_the_whole_table_from_disk", "uncharacteristically", "state-of-the-art-methods", "n---------------------"):
        assert not hit(known) and not hit(known, "key: ")


def test_secrets_within_paths_and_names_are_found_alone():
    r, encoding = random.Random(14), secrets._encoding(secrets.VOCABULARY)
    drawn = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    parts = lambda run: [run[b : b + n] for b, n, _ in secrets.all_judged(run, "", frozenset(), encoding, secrets.MOST_RATIO)]
    for before in ("/documents/shared/internal/project-management/reports/", "github/workflows/deploy/production/environment/", "connection_string_for_production="):
        for after in ("", "/documents/shared/internal/reports/summary"):
            right = 0
            for n in [20, 24, 32] * 40:
                key = drawn(n)
                found = parts(before + key + after)
                right += len(found) == 1 and key in found[0]
            assert right > 0.95 * 120
    one, two = drawn(24), drawn(24)
    assert parts(f"/documents/shared/internal/management/{one}/documents/shared/internal/project/management/reports/{two}/documents/shared/internal/management") == [one, two]
    for clean in ("/usr/local/share/dict/words", "archive/2024/01/02/internal/documents/12345678901234567890", "/shared/internal/documents/d41d8cd98f00b204e9800998ecf8427e/management/documents/reports", "/documents/internal/project/management/123e4567-e89b-12d3-a456-426614174000/shared/internal/documents/reports"):
        assert parts(clean) == []


def _plainly(text, encoding):
    """Secrets of whole runs and of assigned values, by regular expressions over characters and the tokenizer alone."""
    count = lambda x: len(encoding.encode_ordinary(x))
    name = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|key|auth|credential|bearer)"

    def secret(x, named):
        if not re.search(r"[A-Za-z]|[0-9]{8}", x) or re.fullmatch(r"[-+]?[0-9]+(?:[-/_+][0-9]+)*", x) or len(x) < (8 if named else 16):
            return False
        if not named and (re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", x) and len(x) in ((32, 40, 56, 64, 96, 128) if x.lower() == x else (32, 40, 64)) or re.fullmatch(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", x)):
            return False
        if re.fullmatch("[A-Z]+", x):
            return len(x) < 1.7 * count(x)
        if not re.search("[0-9]|[a-z][A-Z]", x):
            words = re.findall("[A-Za-z]+", x)
            return sum(map(len, words)) >= (8 if named else 12) and sum(map(len, words)) < (2.2 if named else 1.8) * sum(map(count, words)) and len(x) < 2.2 * count(x)
        return len(x) < 2.2 * count(x)

    out = set()
    for m in re.finditer(rf"(?i){name}[\"']?[ \t]*(?::|=>|=|:=)[ \t]*([\"']?)([A-Za-z0-9+/_=!@#$%^&*.~?:-]{{8,}})", text):
        value = m[2] if m[1] else m[2].rstrip(".:?")
        if len(value) >= 8 and not re.fullmatch("[A-Za-z0-9+/_=-]{16,}", value) and secret(value.lstrip("=-_+/").rstrip("=") if value[0] not in "=-_+/" else value.lstrip("=-_+/"), True):
            out.add((m.start(2), m.start(2) + len(value)))
    runs = set()
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
        lead = len(m[0]) - len(m[0].lstrip("=-_+/"))
        x = m[0][lead:] if lead else m[0].rstrip("=")
        named = bool(re.search(rf"(?i){name}[\"']?\s*(?:[:=]|=>)?\s*[\"']?$", text[max(0, m.start() - 64) : m.start()]))
        if a := re.match(r"(?i)([a-z_-]*(?:token|secret|passw(?:or)?d|pwd|key|auth|credential)[a-z_-]*=)(.+)", x):
            lead, x, named = lead + len(a[1]), a[2], True
        if secret(x, named):
            runs.add((m.start() + lead, m.start() + lead + len(x)))
    return out | {r for r in runs if not any(b < r[1] and r[0] < e for b, e in out)}


def test_every_run_against_regular_expressions_and_the_tokenizer(spark):
    """On the documents and on lines made up here; stretches within longer runs have a test of their own."""
    r, encoding = random.Random(20), secrets._encoding(secrets.VOCABULARY)
    drawn = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(r.choice(a) for _ in range(n))
    lines = [f"{a}{q}{v}{q}{z}" for a in ("password=", "the token = ", "api_key: ", "é pwd => ", "see ", "auth:") for q in ("", '"') for v in (drawn(10), drawn(20), drawn(14, "abcdefghijklmnopqrstuvwxyz"), drawn(12) + "!@#", "correcthorse", "12:30:45", "2024-01-02", drawn(40, "0123456789abcdef")) for z in ("", ".", " and so on")]
    texts = [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").collect()] + lines
    got = {i: set() for i in range(len(texts))}
    for x in secrets.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[x["doc_id"]].add((x["start"], x["end"]))
        assert x["tokens"] == len(encoding.encode_ordinary(texts[x["doc_id"]][x["start"] : x["end"]]))
    want = {i: _plainly(t, encoding) for i, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 150
    for i, t in enumerate(texts):
        extra = got[i] - want[i]
        # what else is found lies within a longer run that is no secret as a whole
        assert want[i] <= got[i] and all(re.search(r"[/=_+-]", t[max(0, b - 1) : e + 1]) for b, e in extra), (t, got[i], want[i])


def test_short_values_with_a_name_are_found(spark):
    rows = [(1, "password=aB3xY9kQ2z"), (2, 'token = "aB3xY9kQ2z"'), (3, "my pwd: q9Z!x7@Lk#2$ and"), (4, "key: 12:30:45, secret: everything is fine"), (5, "token aB3xY9kQ2z")]
    found = {r["doc_id"]: dict(rows)[r["doc_id"]][r["start"] : r["end"]] for r in secrets.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "aB3xY9kQ2z", 2: "aB3xY9kQ2z", 3: "q9Z!x7@Lk#2$"}


def test_secret_spans(spark):
    key = "q9Zt7Xw2Lk4Vb8Nc3Mf6"
    rows = [(1, f"é😀 key {key} end"), (2, "nothing here"), (3, key)]
    got = [(r["doc_id"], r["start"], r["end"]) for r in secrets.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(1, 7, 27), (3, 0, 20)]


# ---- queries with SQL --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    with duckdb.connect() as con:
        for t in ("documents", "embeddings"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        rel = con.sql(queries.ORACLES[name])
        assert sorted(rel.columns) == columns
        want = Counter(rel.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert Counter(tuple(r) for r in df.select(columns).collect()) == want and want


def test_tensor_files_hold_every_tensor(spark):
    got = {r["doc_id"]: (r["tensors"], r["frames"], r["floats"]) for r in queries.audio_tensor_files(spark, "/root/testdata/sf0.001").collect()}
    want = queries.op1_audio_features(spark, "/root/testdata/sf0.001").groupBy("doc_id").agg(pieces.F.count("*").alias("n"), pieces.F.sum("frames").alias("f")).collect()
    assert got == {r["doc_id"]: (r["n"], r["f"], audio.FRAMES * audio.MELS) for r in want} and got


def test_tensor_files_of_nothing_and_of_null_ids(spark, tmp_path):
    tone = _wav(0.5 * np.sin(2 * np.pi * 440 * np.arange(4000) / 16_000), 2)
    df = spark.createDataFrame([(None, tone), (1, None)], "doc_id long, clip binary")
    files = audio.store(audio.features(df), str(tmp_path / "one")).collect()
    table = pa.concat_tables([pq.read_table(r["file"]) for r in files])
    assert set(table.column("doc_id").to_pylist()) == {None} and table.schema.field("tensor").type.shape == [audio.FRAMES, audio.MELS]
    assert audio.store(audio.features(df.limit(0)), str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        audio.store(audio.features(df), "hdfs://somewhere/else")


def test_minhash_takes_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), ("c", "something else entirely here")], "name string, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df, "name").collect())) == [("a", "a", True), ("b", "a", False)]
    assert sorted(r["name"] for r in minhash.deduplicated(df, "name").collect()) == ["a", "c"]
    with pytest.raises(ValueError):
        minhash.signatures(pa.array(["x"]), 100)
