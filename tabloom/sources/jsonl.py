"""JSON lines with line and record numbers, and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import strip

#: Files are read strictly, as a JSON parser would, and one bad line ends the job.
STRICT = {"mode": "FAILFAST", "allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}


#: Splits whose starts may go to every executor, about 60 bytes each.
MOST_SPLITS = 4_000_000


def numbered_lines(spark: SparkSession, path: str, file_col: str | None = None) -> DataFrame:
    """(value, line_no, record_index) of the lines that are not blank; lines count from 1, records from 0, in each file.

    With ``file_col`` the file is one more column.  The texts stay where they are read: rows of a task are numbered as they
    come, before and after blank ones are left out, and what a split's numbers begin with is added to them.  That takes a
    scan that counts the lines of each split, one row a split, which goes to every executor.
    """
    text = spark.read.text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"), (strip(F.col("value")) != "").alias("__full"))
    splits = lines.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.sum(F.col("__full").cast("long")).alias("__m"), F.min("__at").alias("__first"))
    splits = splits.withColumn("__task", F.shiftright("__first", 33))
    in_file, in_task = Window.partitionBy("__file").orderBy("__block"), Window.partitionBy("__task").orderBy("__first")

    def earlier(n: str, window) -> Column:
        return F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # a task's numbers begin at its own number times 2^33
    line = earlier("__n", in_file) - F.col("__first") + 1
    record = earlier("__m", in_file) - F.shiftleft("__task", 33) - earlier("__m", in_task)
    starts = splits.select("__task", F.struct(F.col("__first").alias("first"), line.alias("line"), record.alias("record")).alias("s"))
    starts = starts.groupBy("__task").agg(F.array_sort(F.collect_list("s")).alias("__starts"))
    # a file has as many splits as it is cut into, and every cut is made to fill a task
    if len(text.inputFiles()) + text.rdd.getNumPartitions() <= MOST_SPLITS:
        starts = F.broadcast(starts)
    full = lines.where("__full").withColumn("__record", F.monotonically_increasing_id()).withColumn("__of", F.shiftright("__at", 33))
    joined = full.join(starts, F.col("__of") == F.col("__task"))
    own = joined.withColumn("__s", F.element_at(F.filter("__starts", lambda s: s["first"] <= F.col("__at")), -1))
    file = [F.col("__file").alias(file_col)] if file_col else []
    return own.select("value", (F.col("__at") + F.col("__s.line")).alias("line_no"), (F.col("__record") + F.col("__s.record")).alias("record_index"), *file)


def record_schema(spark: SparkSession, path: str, ctt: str = "ctt", peers: str = "tabel_info") -> T.StructType:
    """The schema of a file's records, found in one scan; the text is a string and the tables any value."""
    seen = spark.read.options(**STRICT).json(path).schema
    fixed = {ctt: T.StringType(), peers: T.VariantType()}
    fields = [T.StructField(f.name, fixed.get(f.name, f.dataType)) for f in seen.fields]
    return T.StructType(fields + [T.StructField(n, t) for n, t in fixed.items() if n not in seen.names])


def number_columns(names: list[str]) -> dict[str, str]:
    """Where the numbers of a record are kept: under their own names, or under private ones if the record has those."""
    return {n: f"__{n}" if n in names else n for n in ("record_index", "line_no")}


def numbers_of(df: DataFrame) -> dict[str, str]:
    """Which of ``df``'s columns hold the numbers, by name; those it has."""
    return {n: c for n in ("record_index", "line_no") for c in [f"__{n}" if f"__{n}" in df.columns else n] if c in df.columns}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None, numbered: bool = True, ctt: str = "ctt", peers: str = "tabel_info", keys_col: str | None = None, file_col: str | None = None) -> DataFrame:
    """The records of JSON lines, with ``record_index`` and ``line_no`` if ``numbered``; blank lines are left out.

    Where records have fields of these names, they keep them, and the numbers are ``__record_index`` and ``__line_no``.
    With a ``schema`` there is no scan to find one.  ``keys_col`` gets the names of the fields that a record has, null or
    not, ``file_col`` (of numbered lines) its file.  A malformed line fails the job when it is read.
    """
    schema = schema or record_schema(spark, path, ctt, peers)
    lines = numbered_lines(spark, path, "__path") if numbered else spark.read.text(path).where(strip(F.col("value")) != "")
    more = [F.col(n).alias(c) for n, c in number_columns(schema.names).items()] if numbered else []
    more += [F.col("__path").alias(file_col)] if numbered and file_col else []
    more += [F.json_object_keys("value").alias(keys_col)] if keys_col else []
    parsed = lines.withColumn("__parsed", F.from_json("value", schema, STRICT))
    return parsed.select(*more, *[F.col("__parsed").getField(f).alias(f) for f in schema.names])


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, drop: list[str] | None = None, mode: str = "errorifexists", keys_col: str | None = None, optional: list[str] | None = None) -> None:
    """A folder of JSON lines, nulls written; with ``order``, names of the parts sort as their rows do.

    Columns in ``drop`` only serve the order.  With ``keys_col`` the ``optional`` columns that it does not name are left
    out of a line; it is not written itself.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    out = df.drop(*(drop or []))
    if keys_col is None:
        out.write.mode(mode).json(path, ignoreNullFields=False)
        return

    def field(name: str) -> Column:
        whole = F.to_json(F.struct(F.col(f"`{name}`")), {"ignoreNullFields": "false"})
        inner = F.substring(whole, F.lit(2), F.length(whole) - 2)
        return F.when(F.array_contains(F.col(keys_col), name), inner) if name in (optional or []) else inner

    fields = F.array_compact(F.array(*[field(c) for c in out.columns if c != keys_col]))
    out.select(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("value")).write.mode(mode).text(path)
