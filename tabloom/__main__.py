"""python -m tabloom INPUT [-o RECORDS] [--flat-output FLAT] [--mode clean|segments|legacy]"""

from __future__ import annotations

import argparse
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from tabloom.plans.extract import MODES, extract_tables, flat_metrics, legacy_lines, summary
from tabloom.sources.jsonl import numbers_of, read_jsonl, write_jsonl


def beside(path: str, ending: str) -> str:
    """``path`` with another ending in place of its last suffix."""
    head, _, name = path.rpartition("/")
    stem = PurePosixPath(name).stem + ending
    return f"{head}/{stem}" if head or path.startswith("/") else stem


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tabloom", description="Locate supplied tables in page texts and cut the texts around them.")
    parser.add_argument("input", help="JSON lines: a file, a folder or a pattern")
    parser.add_argument("-o", "--output", help="folder for the records with segments")
    parser.add_argument("--flat-output", help="folder for one row a table")
    parser.add_argument("--mode", choices=MODES, default="clean")
    return parser.parse_args(argv)


KEYS, FILE = "__keys", "__file"
#: Characters of a noisy table from which its windows are worked on apart.
LONG_TABLES = 4000


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("tabloom").getOrCreate()
    output, flat = args.output or beside(args.input, ".table_segments.jsonl"), args.flat_output or beside(args.input, ".table_metrics.flat.jsonl")
    # the tables are looked for once: all outputs and the counts come from what is staged beside the output
    staged = f"{output.rstrip('/')}.staged"
    source = read_jsonl(spark, args.input, keys_col=KEYS, file_col=FILE)
    numbers = numbers_of(source)
    order = [FILE, numbers["record_index"]]
    extract_tables(source, mode=args.mode, keep=tuple(order), long_tables=LONG_TABLES).write.mode("overwrite").parquet(staged)
    records = spark.read.parquet(staged)
    if args.mode == "legacy":
        # one line for every record, in order, a part at a time
        for i, r in enumerate(legacy_lines(records.orderBy(*order)).toLocalIterator()):
            print(f"record {i}: {r['segments']} segments, {r['tables']} tables, similarities [{', '.join(r['similarities'])}]")
        if args.output:
            write_jsonl(records, args.output, order=order, drop=order, mode="overwrite")
    else:
        given = [c for c in source.columns if c not in (*numbers.values(), KEYS, FILE)]
        new = ("text_list", "type_list", "table_metrics")
        write_jsonl(records, output, order=order, drop=[*numbers.values(), FILE], mode="overwrite", keys_col=KEYS, optional=[c for c in given if c not in new])
        write_jsonl(flat_metrics(records), flat, order=["record_index", "table_idx"], mode="overwrite")
        print(summary(records, args.input, output, flat).toJSON().first())
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
