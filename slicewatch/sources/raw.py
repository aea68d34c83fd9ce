"""A3: a delimited file as it is: every line kept as text, bad ones told apart, written back byte for byte.

Nothing is inferred or dropped. Fields are text; what does not fit is named in ``problems`` and the line stays. A
record is a line: one that breaks off inside quotes is ``ragged``, as is each line that goes on with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACE = ["file", "block", "line"]


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line, raw``: every line with its place. The order of (file, block, line) is the order of the bytes;
    a carriage return stays part of its line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("line"), F.col("value").alias("raw"))


def parse_raw(lines: DataFrame, schema: T.StructType, header: bool = True) -> DataFrame:
    """``lines`` with ``is_header`` (first line of a file), ``fields`` (struct of text) and ``problems``: ``ragged`` for another
    number of fields or an odd number of quotes, else the names of fields whose text is no value of the column's type.
    Header lines have no problems."""
    names = [f.name for f in schema.fields]
    bad = "_bad"
    while bad in names:
        bad = f"_{bad}"
    as_text = ", ".join(f"`{n}` string" for n in [*names, bad])
    row = F.from_csv(F.regexp_replace("raw", "\r$", ""), as_text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "escape": "\""})
    first = lines.groupBy("file").agg(F.min(F.struct("block", "line")).alias("_first"))     # one row per file
    read = lines.join(first, "file").withColumn("_row", row)
    is_header = (F.struct("block", "line") == F.col("_first")) & F.lit(header)
    unread = [F.when(F.col("_row")[f.name].isNotNull() & F.col("_row")[f.name].try_cast(f.dataType).isNull(), F.lit(f.name)) for f in schema.fields]
    quotes = F.length("raw") - F.length(F.replace(F.col("raw"), F.lit('"'), F.lit("")))
    empty = F.col("raw").isin("", "\r") & F.lit(len(names) > 1)
    ragged = empty | F.col("_row").isNull() | F.col("_row")[bad].isNotNull() | (quotes % 2 == 1)
    problems = F.when(ragged, F.array(F.lit("ragged"))).otherwise(F.array_compact(F.array(*unread)))
    return read.select(*lines.columns, is_header.alias("is_header"), F.struct(*[F.col("_row")[n].alias(n) for n in names]).alias("fields"),
                       F.when(is_header, F.array().cast("array<string>")).otherwise(problems).alias("problems"))


def typed(parsed: DataFrame, schema: T.StructType) -> DataFrame:
    """The good lines as typed columns."""
    good = parsed.where(~F.col("is_header") & (F.size("problems") == 0))
    return good.select(*[F.col("fields")[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields])


def write_back(lines: DataFrame, path: str) -> None:
    """The lines in their order; the files one after the other are the bytes that were read (a last line without
    a line feed gets one)."""
    order = [F.col(c) for c in PLACE]
    (lines.select(*PLACE, "raw").repartitionByRange(*order).sortWithinPartitions(*order).select("raw")
     .write.mode("overwrite").option("lineSep", "\n").text(path))
