"""Mixing sources to target weights: Pareto order sampling after whole copies.

A source's quota is its share of the wanted total.  Within a source a document is wanted ``quota * size / sizes``
times, its size being ``1 + floor(sqrt(characters))``; the whole part is certain copies.  For the fraction ``p`` that
is left, documents are ranked by ``(u / (1 - u)) / (p / (1 - p))``, u uniform from a hash of the id: taking the
least ones, as many as the fractions add up to, is Pareto sampling, of fixed size and inclusion probabilities ~ p.

All shares are exact integers.  The cut of each source is found in two passes: counts by 65536 ranges of the rank
(map-side sums, so a hot source costs no more than others), then an exact order of the one range the cut lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm._durable import checkpointed

SEED = 20240
RANGES = 1 << 16
#: Bytes of the sources' names and quotas that may go to every executor.
BROADCAST_BYTES = 16 << 20


def _size(text: Column) -> Column:
    return F.floor(F.sqrt(F.coalesce(F.length(text), F.lit(0)).cast("double"))).cast("long") + 1


def _uniform(key: Column, seed: int) -> Column:
    """In (0, 1), 52 bits of an MD5; equal keys get equal numbers."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def quotas(stats: DataFrame, total: int | None, weights: dict[str, float] | None) -> DataFrame:
    """(__source, __sizes, __quota): whole numbers that add up to the total, by largest remainder.

    Without ``weights`` a source weighs the square root of its number of documents.  A source without a weight gets
    none.  Without ``total`` as many are wanted as there are documents.
    """
    if weights is None:
        weight = F.floor(F.lit(1e6) * F.sqrt(F.col("__docs").cast("double"))).cast("decimal(38,0)")
    else:
        pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(round(v * 1e6)))]
        weight = (F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("__source")), F.lit(0)) if pairs else F.lit(0)).cast("decimal(38,0)")
    stats = checkpointed(stats.withColumn("__w", weight))
    sums = stats.agg(F.sum("__w").alias("all"), F.sum("__docs").alias("docs")).first()
    if not sums["all"]:
        return stats.limit(0).select("__source", "__sizes", F.lit(0).cast("long").alias("__quota"))
    want = sums["docs"] if total is None else total
    share = f"cast({want} as decimal(38,0)) * __w"
    part = stats.withColumns({"__base": F.expr(f"cast(({share}) div cast({sums['all']} as decimal(38,0)) as long)"), "__rest": F.expr(f"({share}) % cast({sums['all']} as decimal(38,0))")})
    # places in one order over many tasks: a row's number within its task, and how many rows the tasks before have
    ordered = checkpointed(part.orderBy(F.col("__rest").desc(), F.col("__source").asc_nulls_first()).withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33)
    before, given = [], 0
    for r in sorted(ordered.groupBy(task.alias("task")).agg(F.count("*").alias("n"), F.sum("__base").alias("base")).collect()):
        before.append((r["task"], sum(n for _, _, n in before), r["n"]))
        given += r["base"]
    first = F.element_at(F.create_map(*[x for t, n, _ in before for x in (F.lit(t), F.lit(n))]), task)
    place = F.col("__at") - F.shiftleft(task, 33) + first
    return ordered.select("__source", "__sizes", (F.col("__base") + (place < want - given).cast("long")).alias("__quota"))


def drawn(df: DataFrame, total: int | None = None, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(row, copies): each row of ``df`` that is in the mixture, as a struct, and how often.

    A null source is a source of its own.  A null text has the size of an empty one.  Equal ranks (repeated ids) go by
    id and then by text; rows equal in all three are interchangeable.  Other columns may have any name.  An empty
    table gives no rows.
    """
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _size(F.col(text_col)).alias("__size"), _uniform(F.col(id_col), seed).alias("__u"), F.col(source_col).alias("__source"))
    stats = base.groupBy("__source").agg(F.count("*").alias("__docs"), F.sum("__size").alias("__sizes"))
    plan = checkpointed(quotas(stats, total, weights))
    # one row a source; beyond the bound the join shuffles, and adaptive execution splits what a hot source makes too large
    size = plan.agg(F.sum(F.coalesce(F.octet_length(F.col("__source").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    small = F.broadcast if size <= BROADCAST_BYTES else lambda x: x
    # sizes are small whole numbers, so quota x size stays far below 2^63
    share = {
        "__sure": F.expr("(__quota * __size) div __sizes"),
        "__p": F.expr("(__quota * __size) % __sizes").cast("double") / F.col("__sizes").cast("double"),
    }

    def ranked(rows: DataFrame, by: DataFrame) -> DataFrame:
        rows = rows.join(small(by.withColumnRenamed("__source", "__s")), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s").withColumns(share)
        q = F.when(F.col("__p") > 0, (F.col("__u") / (1.0 - F.col("__u"))) * ((1.0 - F.col("__p")) / F.col("__p")))
        return rows.withColumn("__q", q).withColumn("__range", F.floor(F.col("__q") / (1.0 + F.col("__q")) * RANGES))

    slim = ranked(base.select("__source", "__size", "__u"), plan)
    counts = slim.groupBy("__source", "__range").agg(F.count("*").alias("__n"), F.sum("__sure").alias("__sures"), F.first("__quota").alias("__quota"))
    one = Window.partitionBy("__source")
    upto = F.sum(F.when(F.col("__range").isNotNull(), F.col("__n")).otherwise(0)).over(one.orderBy(F.col("__range").asc_nulls_first()))
    cuts = counts.withColumn("__need", F.col("__quota") - F.sum("__sures").over(one)).withColumn("__upto", upto)
    # the first range that reaches the need; its lesser ranks are taken up to what the earlier ranges leave
    cut = cuts.where("__need > 0 and __range is not null and __upto >= __need").groupBy("__source").agg(F.min("__range").alias("__cut"), F.min_by(F.col("__need") - F.col("__upto") + F.col("__n"), "__range").alias("__left"))
    whole = checkpointed(plan.withColumnRenamed("__source", "__c").join(cut, F.col("__c").eqNullSafe(F.col("__source")), "left").drop("__source").withColumnRenamed("__c", "__source"))
    rows = ranked(base, whole).withColumn("__at_cut", F.coalesce(F.col("__range") == F.col("__cut"), F.lit(False)))
    clear = rows.where("not __at_cut").withColumn("__extra", F.coalesce((F.col("__range") < F.col("__cut")).cast("long"), F.lit(0)))
    order = Window.partitionBy("__source").orderBy("__q", F.col("row")[id_col].asc_nulls_first(), F.col("row")[text_col].asc_nulls_first())
    edge = rows.where("__at_cut").withColumn("__place", F.row_number().over(order)).withColumn("__extra", (F.col("__place") <= F.col("__left")).cast("long")).drop("__place")
    return clear.unionByName(edge).select("row", (F.col("__sure") + F.col("__extra")).alias("copies")).where("copies > 0")


def mixture(df: DataFrame, **options) -> DataFrame:
    """``df``'s rows, each as often as ``drawn`` says."""
    return drawn(df, **options).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def allocation(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """(doc_id, source, copies) of each row that is in the mixture."""
    out = drawn(df, id_col=id_col, source_col=source_col, **options)
    return out.select(F.col("row")[id_col].alias("doc_id"), F.col("row")[source_col].alias("source"), "copies")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, text, CAST(floor(sqrt(CAST(coalesce(length(text), 0) AS DOUBLE))) AS BIGINT) + 1 AS size,
         (CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, count(*) AS docs, CAST(sum(size) AS BIGINT) AS sizes, CAST(floor(1e6::DOUBLE * sqrt(CAST(count(*) AS DOUBLE))) AS HUGEINT) AS w FROM d GROUP BY source),
t AS (SELECT source, sizes, CAST((SELECT sum(docs) FROM s) AS HUGEINT) AS want, w, CAST((SELECT sum(w) FROM s) AS HUGEINT) AS everything FROM s),
b AS (SELECT source, sizes, want, (want * w) // everything AS base, (want * w) % everything AS rest FROM t),
q AS (SELECT source, sizes, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b),
p AS (SELECT d.*, quota, (quota * size) // sizes AS sure, CAST((quota * size) % sizes AS DOUBLE) / CAST(sizes AS DOUBLE) AS p FROM d JOIN q USING (source)),
r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) * ((1.0::DOUBLE - p) / p) END AS rank FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, text) AS place, quota - sum(sure) OVER (PARTITION BY source) AS need FROM r)
SELECT doc_id, source, CAST(sure + CASE WHEN place <= need THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM o WHERE sure + CASE WHEN place <= need THEN 1 ELSE 0 END > 0
"""
