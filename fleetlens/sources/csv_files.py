"""CSV files with a header row: columns bound by name, bad lines kept apart.

Files are grouped by their header, so one load may mix column orders; each group is one scan.  A column
of the schema that a header lacks is NULL, other columns are read but not returned.  A line is accepted
if it has one field for each header name and every field that is not empty has a value of its column's type;
all other lines are rejected, with a reason.  Every line that is not a header and not blank is either
accepted or rejected.  Empty fields are NULL.
"""

from __future__ import annotations

import csv
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.sources.sinks import materialize

REJECT_COLUMNS = ["file", "record", "reason"]


def read_header(spark: SparkSession, file: str) -> list[str]:
    """Names in the first line of a file, which may be compressed; none for an empty file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(file))
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    stream = path.getFileSystem(conf).open(path)
    try:
        plain = codec.createInputStream(stream) if codec else stream
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()
    return [n.strip() for n in next(csv.reader([line.removeprefix("﻿")]), [])] if line else []


def files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files that a scan of ``path`` reads, by header; one small read for each file."""
    groups = defaultdict(list)
    for file in spark.read.text(path).inputFiles():
        names = tuple(read_header(spark, file))
        if not names:
            continue
        if len(set(names)) != len(names) or "" in names:
            raise ValueError(f"{file}: header with repeated or empty names: {list(names)}")
        groups[names].append(file)
    return dict(groups)


def _checked(spark: SparkSession, files: list[str], names: tuple[str, ...], schema: T.StructType,
             multi_line: bool) -> DataFrame:
    """Fields of the schema, typed, and why a line is rejected (NULL: it is not)."""
    raw = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(len(names))]
                       + [T.StructField("_line", T.StringType())])
    # a scan cut to some columns would not see that a line has too few or too many fields
    lines = spark.read.option("columnPruning", False).csv(
        files, header=True, schema=raw, nullValue="", emptyValue="", multiLine=multi_line, escape='"',
        mode="PERMISSIVE", columnNameOfCorruptRecord="_line")
    fields = [F.nullif(F.col(f"_{k}"), F.lit("")) for k in range(len(names))]
    typed, wrong = [], []
    for f in schema:
        if f.name not in names:
            typed.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        text = fields[names.index(f.name)]
        value = text if isinstance(f.dataType, T.StringType) else F.trim(text).try_cast(f.dataType)
        typed.append(value.alias(f.name))
        if not isinstance(f.dataType, T.StringType):
            wrong.append(F.when(text.isNotNull() & value.isNull(), F.lit(f.name)))
    bad = F.concat_ws(", ", *wrong) if wrong else F.lit("")
    reason = F.when(F.col("_line").isNotNull(), f"not {len(names)} fields").when(
        bad != "", F.concat(F.lit("no value of the column's type: "), bad))
    record = F.coalesce("_line", F.to_csv(F.struct(*[c.alias(n) for c, n in zip(fields, names)])))
    return lines.select(F.struct(*typed).alias("row"), F.input_file_name().alias("file"),
                        record.alias("record"), reason.alias("reason"))


def csv_lines(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """All lines: ``row`` (the schema as a struct), ``file``, ``record`` and ``reason``."""
    out = None
    for names, files in files_by_header(spark, path).items():
        part = _checked(spark, files, names, schema, multi_line)
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = T.StructType([T.StructField("row", T.StructType(list(schema)))]
                             + [T.StructField(c, T.StringType()) for c in REJECT_COLUMNS])
        out = spark.createDataFrame([], empty)
    return out


def load_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """The accepted lines, with the columns of the schema.

    Large files are split.  Fields with quoted line breaks need ``multi_line``, for
    which Spark reads a file in one task: keep such files small.
    """
    lines = csv_lines(spark, path, schema, multi_line)
    return lines.where("reason IS NULL").select(*[F.col("row")[f.name].alias(f.name) for f in schema])


def csv_rejects(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """The rejected lines: file, record as read, and reason."""
    return csv_lines(spark, path, schema, multi_line).where("reason IS NOT NULL").select(*REJECT_COLUMNS)


def load_table(spark: SparkSession, path: str, schema: T.StructType, table: str,
               multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Replace ``table`` by the accepted lines and ``<table>_rejects`` by the others; returns both."""
    return (materialize(load_csv(spark, path, schema, multi_line), table),
            materialize(csv_rejects(spark, path, schema, multi_line), f"{table}_rejects"))
