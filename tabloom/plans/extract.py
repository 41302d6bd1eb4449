"""The whole job: records in; records with segments, flat rows and a summary out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.peers import peer_contents
from tabloom.functions.pytext import Options
from tabloom.operators.legacy import legacy_bodies, with_legacy_segments
from tabloom.operators.matching import with_matches
from tabloom.operators.segments import chosen_spans, cut_text
from tabloom.sources.jsonl import numbers_of

METRIC = (
    "table_idx int, peer_content string, peer_body string, matched boolean, extracted_table string, similarity double, match_score double, "
    "match_mode string, full_span array<int>, body_span array<int>"
)
MODES = ("clean", "segments", "legacy")


def _metric(m):
    def span(a: str, b: str):
        return F.when(m[a].isNotNull(), F.array(m[a], m[b]))

    plain = ["table_idx", "peer_content", "peer_body", "matched", "extracted_table", "similarity", "match_score", "match_mode"]
    return F.struct(*[m[n].alias(n) for n in plain], span("full_start", "full_end").alias("full_span"), span("body_start", "body_end").alias("body_span"))


def with_contents(df: DataFrame, ctt: str = "ctt", peers: str = "tabel_info") -> DataFrame:
    """``df`` with ``__text``, never null, and ``__contents``."""
    return df.withColumns({"__text": F.coalesce(F.col(ctt).cast("string"), F.lit("")), "__contents": peer_contents(F.col(peers), df.schema[peers].dataType)})


def extract_tables(df: DataFrame, ctt: str = "ctt", peers: str = "tabel_info", mode: str = "clean", options: Options = Options(), least_ratio: float = 0.5, keep: tuple[str, ...] = (), long_tables: int | None = None) -> DataFrame:
    """``df`` with ``text_list``, ``type_list`` and ``table_metrics``; in ``legacy`` mode the three legacy columns, and those to ``keep``.

    ``segments`` looks for a table's header before it strips the content, ``clean`` after.  A null text counts as an
    empty one; tables may be null, text, an object, an array or a VARIANT; ``table_info`` counts where ``tabel_info`` is not there.  Columns of ``df`` that have one of the
    new names are overwritten, all others carried through.  ``long_tables``, for batches, deals the windows of noisy tables
    of more characters than that out over the tasks.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if peers == "tabel_info" and peers not in df.columns and "table_info" in df.columns:
        peers = "table_info"
    if mode == "legacy":
        base = df.select(*keep, F.coalesce(F.col(ctt).cast("string"), F.lit("")).alias("__text"), legacy_bodies(F.col(peers), df.schema[peers].dataType).alias("__bodies"))
        return with_legacy_segments(base, "__text", "__bodies", least_ratio).select(*keep, "__legacy.*")
    base = with_matches(with_contents(df, ctt, peers), "__text", "__contents", o=options._replace(stripped=mode == "clean"), long_tables=long_tables)
    pieces = base.withColumn("__pieces", cut_text(F.col("__text"), chosen_spans(F.col("__matches"))))
    new = {
        "text_list": F.transform("__pieces", lambda p: p["text"]),
        "type_list": F.transform("__pieces", lambda p: p["type"]),
        "table_metrics": F.transform("__matches", _metric),
    }
    return pieces.withColumns(new).drop("__text", "__contents", "__matches", "__pieces")


def flat_metrics(records: DataFrame, *keys: str) -> DataFrame:
    """One row for each table: the ``keys`` of its record (``record_index`` and ``line_no`` if it has them), its fields."""
    names = {k: k for k in keys} or numbers_of(records)
    return records.select(*[F.col(c).alias(k) for k, c in names.items()], F.explode("table_metrics").alias("__m")).select(*names, "__m.*")


def summary(records: DataFrame, source: str = "", output_records: str = "", output_flat: str = "") -> DataFrame:
    """One row of counts over all records, partial sums first."""
    counts = records.select(F.size("table_metrics").alias("n"), F.size(F.filter("table_metrics", lambda m: m["matched"])).alias("hit"))
    names = {"input": source, "output_records": output_records, "output_flat": output_flat}
    total = counts.agg(F.count("*").alias("total_records"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_tables"), F.coalesce(F.sum("hit"), F.lit(0)).alias("matched_tables"))
    return total.select(*[F.lit(v).alias(k) for k, v in names.items()], "total_records", "total_tables", "matched_tables")


def legacy_lines(records: DataFrame) -> DataFrame:
    """What the first version says of each record: segments, tables, similarities with four decimals."""
    return records.select(
        F.size("segments").alias("segments"),
        F.size(F.filter("types", lambda t: t == 1)).alias("tables"),
        F.transform("similarities", lambda s: F.format_string("%.4f", s)).alias("similarities"),
    )
