"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import audio, embeddings, html, langid, minhash, mixing, pieces, pii, secrets, toxicity
from tabloom.llm._durable import checkpointed, removed, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds sound, so each text's bytes stand for a clip: 8-bit PCM at 24 kHz, every byte of every text."""
    clips = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("clip"))
    return audio.features(clips, rate=24_000, width=1)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.fit(docs))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html.extracted(pages, html.fit(pages))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocation(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding, and decoding what was encoded."""
    return pieces.tokens(_table(spark, sf_dir, "documents"), decode=True)


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every vector."""
    return embeddings.near_classes(_table(spark, sf_dir, "embeddings"))


def near_vectors_at_040(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at a cosine of 0.4, which pairs of the small tables reach."""
    return embeddings.near_classes(_table(spark, sf_dir, "embeddings"), least=0.4)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(_table(spark, sf_dir, "documents"))


# ---- parts of the operators that SQL can state, over the same whole tables -------------------------------------------------


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document whose text others have: the least of them, and whether op6 has it in that one's group."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"), (F.trim("text") != "").alias("words")).where("words").drop("words")
    same = docs.groupBy("x", "y").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "group_id")
    copies = docs.join(same, ["x", "y"]).select("doc_id", "first_id").join(groups, "doc_id", "left")
    first = groups.select(F.col("doc_id").alias("first_id"), F.col("group_id").alias("group"))
    return copies.join(first, "first_id", "left").select("doc_id", "first_id", F.coalesce(F.col("group_id") == F.col("group"), F.lit(False)).alias("together"))


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of every document decode to, and how many bytes of the source their spans reach."""
    out = pieces.tokens(_table(spark, sf_dir, "documents"), decode=True)
    return out.select("doc_id", F.md5("decoded").alias("digest"), F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("bytes"))


def secret_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of key characters that the secret scan judges in every document."""
    runs = _table(spark, sf_dir, "documents").select("doc_id", secrets.key_runs(F.col("text")).alias("r"))
    return runs.select("doc_id", F.size("r").cast("long").alias("runs"), F.md5(F.array_join("r", " ")).alias("digest"))


def audio_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of sound of op1 with their spans, of the same clips at 16 kHz, where no resampling comes before."""
    clips = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("clip"))
    chunks = audio.features(clips, rate=audio.RATE, width=1).drop("tensor")
    return chunks.groupBy("doc_id", "segment").agg(F.sum("frames").alias("frames"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))


def audio_tensor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensors of op1 through files whose column has Arrow's fixed-shape type: how many a clip has, and their frames."""
    folder = f"{shared_folder(spark)}/tensors-{uuid.uuid4().hex}"
    files = [r["file"] for r in audio.store(op1_audio_features(spark, sf_dir), folder.removeprefix("file://").removeprefix("file:")).collect()]
    if not files:
        return op1_audio_features(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("tensors"), F.sum("frames").alias("frames"), F.max(F.size("tensor")).alias("floats"))
    back = spark.read.parquet(*[f"file://{f}" for f in files])
    out = checkpointed(back.groupBy("doc_id").agg(F.count("*").alias("tensors"), F.sum("frames").alias("frames"), F.max(F.size("tensor")).alias("floats")))
    removed(spark, folder)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_audio_features, op2_language_id, op3_html_extraction, op4_toxicity, op5_pii, op6_minhash_neardup, op7_source_mixing, op8_sentencepiece, op9_embedding_neardup, op10_secret_scan, near_vectors_at_040, exact_copies, piece_round_trip, secret_runs, audio_segments, audio_tensor_files)
}
ORACLES: dict[str, str] = {"op7_source_mixing": mixing.ORACLE, "op9_embedding_neardup": embeddings.ORACLE, "near_vectors_at_040": embeddings.oracle(0.4)}
ORACLES |= {
    "exact_copies": """WITH c AS (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE trim(text) <> '')
SELECT doc_id, first_id, true AS together FROM c WHERE n > 1""",
    # levels from running sums of whole numbers; a frame that decides nothing has the state of the last that did
    "audio_segments": f"""WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents WHERE text <> ''),
v AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, unnest(list_transform(h, lambda x: CAST('0x' || x AS BIGINT) - 128)) AS v FROM b),
s AS (SELECT doc_id, i, sum(v) OVER w AS s1, sum(v * v) OVER w AS s2 FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, len(h) AS n, unnest(range(0, CASE WHEN len(h) <= {audio.WINDOW} THEN 1 ELSE (len(h) - {audio.WINDOW} + {audio.HOP - 1}) // {audio.HOP} + 1 END)) AS f FROM b),
l AS (SELECT n.doc_id, n, f, (e.s2 - coalesce(a.s2, 0))::DOUBLE / 16384 / {audio.WINDOW} AS square, (e.s1 - coalesce(a.s1, 0))::DOUBLE / 128 / {audio.WINDOW} AS mean
  FROM n JOIN s e ON e.doc_id = n.doc_id AND e.i = least(n, f * {audio.HOP} + {audio.WINDOW}) LEFT JOIN s a ON a.doc_id = n.doc_id AND a.i = f * {audio.HOP}),
d AS (SELECT doc_id, n, f, 10 * log10(greatest(square - mean * mean, 1e-12::DOUBLE)) AS level FROM l),
o AS (SELECT doc_id, n, f, coalesce(last_value(CASE WHEN level >= {audio.HIGH} THEN 1 WHEN level < {audio.LOW} THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sound FROM d),
g AS (SELECT *, sum(CASE WHEN sound = 1 AND before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY f) AS k FROM (SELECT *, lag(sound, 1, 0) OVER (PARTITION BY doc_id ORDER BY f) AS before FROM o))
SELECT doc_id, CAST(k - 1 AS INTEGER) AS segment, count(*) AS frames, min(f) * {audio.HOP}::DOUBLE / {audio.RATE} AS start_s, least(any_value(n), max(f) * {audio.HOP} + {audio.WINDOW})::DOUBLE / {audio.RATE} AS end_s
FROM g WHERE sound = 1 GROUP BY doc_id, k""",
    # the map of compatibility forms changes none of these texts, so they come back as they are
    "piece_round_trip": "SELECT doc_id, md5(text) AS digest, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "secret_runs": """SELECT doc_id, CAST(len(r) AS BIGINT) AS runs, md5(array_to_string(r, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{16,}') AS r FROM documents)""",
}
