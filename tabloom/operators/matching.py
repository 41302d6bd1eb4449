"""All tables of a record: by expressions where they decide, by one vectorised UDF for the rest of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import pytext
from tabloom.functions.columns import barrier, let, strip
from tabloom.functions.normalize import BREAKS, foldable, folded_text, packed_sizes, tokens
from tabloom.functions.pytext import Options
from tabloom.operators.spans import ROW, ROW_TYPE, plain_match

_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
_ARROW = pa.list_(pa.struct([(n, _KINDS[t]) for n, t in (x.split() for x in ROW.split(", "))]))


def _rest(raw: Column, open_: Column, o: Options) -> Column:
    """Rows of the tables in ``open_``, array<struct(idx, content)>; null texts cost nothing."""

    @F.arrow_udf(T.ArrayType(T.StructType.fromDDL(ROW)))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for text, peers in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
                if text is None:
                    out.append(None)
                    continue
                source = pytext.folded(text)
                rows = [pytext.match(text, source, p["content"], p["idx"], o) for p in peers]
                out.append([r | {"similarity": round(r["exact_similarity"], 6), "match_score": round(r["exact_score"], 6)} for r in rows])
            yield pa.array(out, _ARROW)

    return barrier(run)(raw, open_)


_WINDOWS = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32()), ("query", pa.string()), ("window", pa.string())]))
_PLACE = "struct<score:double,start:int,end:int>"


def _key(text: Column) -> Column:
    return F.sha2(text, 256)


def _windows(raw: Column, content: Column, o: Options) -> Column:
    """array<struct(begin, stop, query, window)> of a table that is nowhere as it is, all of its texts folded."""

    @F.arrow_udf(T.ArrayType(T.StructType.fromDDL("begin int, stop int, query string, window string")))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, contents in batches:
            out = []
            for text, content in zip(texts.to_pylist(), contents.to_pylist(), strict=True):
                source, query = pytext.folded_text(text), pytext.folded_text(content)
                open_ = [] if pytext.exact(source, query) else pytext.open_windows(source, query, o)
                out.append([{"begin": b, "stop": e, "query": query, "window": source[b:e]} for b, e in open_])
            yield pa.array(out, _WINDOWS)

    return barrier(run)(raw, content)


def _scored(query: Column, window: Column, o: Options) -> Column:
    """struct(score, start, end) of the copy in a window; null if there is none."""

    @F.arrow_udf(T.StructType.fromDDL("score double, start int, end int"))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for queries, windows in batches:
            hits = [pytext.placed(q, w, o) for q, w in zip(queries.to_pylist(), windows.to_pylist(), strict=True)]
            yield pa.array([h and dict(zip(("score", "start", "end"), h, strict=True)) for h in hits], pa.struct([("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    return barrier(run)(query, window)


def _rest_of_long(raw: Column, open_: Column, places: Column, o: Options, long_tables: int) -> Column:
    """As ``_rest``, but long tables that are nowhere as they are have their place, or none, in ``places`` by content."""

    @F.arrow_udf(T.ArrayType(T.StructType.fromDDL(ROW)))
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists, maps in batches:
            out = []
            for text, peers, known in zip(texts.to_pylist(), lists.to_pylist(), maps.to_pylist(), strict=True):
                source, places = pytext.folded(text), {x["key"]: x["place"] for x in known or []}
                rows = []
                for p in peers:
                    if len(p["content"]) > long_tables:
                        at = places.get(hashlib.sha256(p["content"].encode()).hexdigest())
                        given = at and pytext.Place(at["start"], at["end"], at["score"], "fuzzy")
                        find = lambda s, q, o, given=given: pytext.exact(s, q) or given
                    else:
                        find = pytext.locate
                    rows.append(pytext.match(text, source, p["content"], p["idx"], o, find))
                out.append([r | {"similarity": round(r["exact_similarity"], 6), "match_score": round(r["exact_score"], 6)} for r in rows])
            yield pa.array(out, _ARROW)

    return barrier(run)(raw, open_, places)


def _with_windows_apart(hard: DataFrame, raw: str, o: Options, long_tables: int) -> DataFrame:
    """``hard`` and ``__rest``; every window of a long table is a row of its own and may be in any task.

    Windows and places are told by digests of the text and the content, so that equal ones are looked at once and no
    number that a repeated task might give anew is needed.
    """
    text = F.col(raw)
    long_ = hard.select(text.alias("text"), F.explode(F.filter("__open", lambda p: F.length(p["content"]) > long_tables)).alias("p")).select("text", F.col("p.content").alias("content"))
    jobs = long_.groupBy(_key(F.col("text")).alias("t"), _key(F.col("content")).alias("c")).agg(F.first("text").alias("text"), F.first("content").alias("content"))
    windows = jobs.select("t", "c", F.explode(_windows(F.col("text"), F.col("content"), o)).alias("w")).select("t", "c", "w.*")
    # one window may take seconds, so they are dealt out one by one
    tasks = max(32, 4 * hard.sparkSession.sparkContext.defaultParallelism)
    scored = windows.repartition(tasks, "t", "c", "begin", "stop").select("t", "c", "begin", "stop", _scored(F.col("query"), F.col("window"), o).alias("s")).where("s is not null")
    order = F.struct(F.col("s.score").alias("score"), (-F.col("begin")).alias("a"), (-F.col("stop")).alias("b"), (F.col("begin") + F.col("s.start")).alias("start"), (F.col("begin") + F.col("s.end")).alias("end"))
    best = scored.groupBy("t", "c").agg(F.max(order).alias("m"))
    place = F.struct("m.score", "m.start", "m.end").cast(_PLACE).alias("place")
    places = best.groupBy("t").agg(F.collect_list(F.struct(F.col("c").alias("key"), place)).alias("__places"))
    joined = hard.withColumn("__t", _key(text)).join(places.withColumnRenamed("t", "__t"), "__t", "left").drop("__t")
    return joined.withColumn("__rest", _rest_of_long(text, F.col("__open"), F.col("__places"), o, long_tables)).drop("__places")


def with_matches(df: DataFrame, raw: str, contents: str, out: str = "__matches", o: Options = Options(), long_tables: int | None = None) -> DataFrame:
    """``df`` and ``out``, an array of rows by ``table_idx``; ``raw`` and ``contents`` are columns without nulls.

    No shuffle: a record and its tables stay together from the scan to the sink.  With ``long_tables`` only records with an
    undecided table of more characters than that do not: its windows are dealt out, and the result is the same.
    """
    text, peers = F.col(raw), F.col(contents)
    empty = F.array().cast(f"array<{ROW_TYPE}>")

    def decide(sizes: Column) -> Column:
        return let(folded_text(text), lambda source: F.transform(peers, lambda c, i: plain_match(text, sizes, source, c, i, o)))

    # where such a table is, breaks of the text say where its body begins: mostly undecided, and dearer to look at twice
    unbroken = text.rlike(BREAKS) & F.forall(peers, lambda c: ~strip(c).rlike(BREAKS))
    easy = F.when(F.size(peers) == 0, empty).when(~unbroken & foldable(text), let(packed_sizes(tokens(text)), decide)).otherwise(F.transform(peers, lambda c: F.lit(None).cast(ROW_TYPE)))
    open_ = F.filter(F.transform(peers, lambda c, i: F.when(F.get(F.col("__easy"), i).isNull(), F.struct(i.alias("idx"), c.alias("content")))), lambda x: x.isNotNull())
    stepped = df.withColumn("__easy", easy).withColumn("__open", open_)
    hard = F.size("__open") > 0
    if long_tables is None:
        stepped = stepped.withColumn("__rest", _rest(F.when(hard, text), F.when(hard, F.col("__open")), o))
    else:
        apart = F.exists("__open", lambda p: F.length(p["content"]) > long_tables)
        others = stepped.where(~apart).withColumn("__rest", _rest(F.when(hard, text), F.when(hard, F.col("__open")), o))
        stepped = others.unionByName(_with_windows_apart(stepped.where(apart), raw, o, long_tables))
    known = F.filter("__easy", lambda x: x.isNotNull())
    merged = F.when(F.col("__rest").isNull(), known).otherwise(F.array_sort(F.concat(known, F.coalesce(F.col("__rest"), empty)), lambda a, b: a["table_idx"] - b["table_idx"]))
    return stepped.withColumn(out, merged).drop("__easy", "__open", "__rest")
