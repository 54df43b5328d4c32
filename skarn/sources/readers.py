"""Readers: delimited text, JSON arrays, JDBC, LibSVM, IDX, labelled text; and ways to combine them."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOM = "^﻿"


def read_delimited(spark: SparkSession, path: str, sep: str = ",", quote: str = '"', header: list[str] | None = None, strict: bool = True) -> DataFrame:
    """All columns as text, quotes doubled inside quoted cells; the header is the first row, or ``header``.

    Blank lines are skipped, a byte order mark is dropped, a row of another
    width fails (strict) or is dropped.
    """
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "FAILFAST" if strict else "DROPMALFORMED", "multiLine": True, "enforceSchema": False, "nullValue": "\x00", "emptyValue": ""}
    if header:
        schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
        return spark.read.options(**options).schema(schema).csv(path, header=False)
    df = spark.read.options(**options).csv(path, header=True, inferSchema=False)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_numeric(spark: SparkSession, path: str, responses: list[str], **options) -> DataFrame:
    """Response columns as text, all others as doubles; a cell that is no number fails when it is read."""
    df = read_delimited(spark, path, **options)
    return df.select(*[F.col(f"`{c}`") if c in responses else F.col(f"`{c}`").cast("double").alias(c) for c in df.columns])


def read_json_array(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """A file of one array of flat objects, scalars as text, columns in name order (or ``fields``); nested values are left out, elements that aren't objects skipped."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).option("mode", "DROPMALFORMED").json(path)
    flat = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.select(*[F.col(f"`{c}`") for c in (fields or sorted(flat))])


def read_jdbc(spark: SparkSession, url: str, sql: str, properties: dict | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """The rows of a query as text, null as empty; ``partition``: (column, low, high, parts) for parallel reads."""
    reader = spark.read.format("jdbc").option("url", url).option("query" if not partition else "dbtable", sql if not partition else f"({sql}) q").options(**(properties or {}))
    if partition:
        column, low, high, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    df = reader.load()
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def parse_libsvm(lines: DataFrame, col: str = "value") -> DataFrame:
    """(output, features map of index -> value) of ``label i:v i:v`` lines; text after # is a comment; a repeated index fails."""
    text = F.trim(F.regexp_replace(F.col(col), "#.*$", ""))
    parts = F.split(text, r"\s+")
    pairs = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).cast("int").alias("i"), F.split_part(p, F.lit(":"), F.lit(2)).cast("double").alias("v")))
    return lines.where(text != "").select(F.element_at(parts, 1).alias("output"), F.map_from_entries(pairs).alias("features"))


def read_libsvm(spark: SparkSession, path: str, zero_indexed: bool | None = None) -> DataFrame:
    """(output, features map): names from 0, padded to the width of the greatest id; zero- or one-indexed by the least id unless told."""
    rows = parse_libsvm(spark.read.text(path))
    low, high = rows.agg(F.min(F.array_min(F.map_keys("features"))), F.max(F.array_max(F.map_keys("features")))).first()
    shift = 0 if (zero_indexed if zero_indexed is not None else low == 0) else 1
    width = len(str((high or 0) - shift))
    return rows.select("output", F.transform_keys("features", lambda k, v: F.lpad((k - shift).cast("string"), width, "0")).alias("features"))


_IDX = {0x08: ">u1", 0x09: ">i1", 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}


def decode_idx(data: bytes) -> np.ndarray:
    """The array of an IDX file: magic number, type, dimensions, big-endian data; too short or long fails."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if len(data) < 4 or data[:2] != b"\0\0" or data[2] not in _IDX:
        raise ValueError("no IDX file")
    n, kind = data[3], np.dtype(_IDX[data[2]])
    shape = np.frombuffer(data, ">i4", n, 4).tolist()
    body = data[4 + 4 * n :]
    if len(body) != int(np.prod(shape)) * kind.itemsize:
        raise ValueError("IDX data is shorter or longer than its dimensions")
    return np.frombuffer(body, kind).reshape(shape)


def read_idx(spark: SparkSession, features: str, outputs: str) -> DataFrame:
    """(output, features map) of IDX files of features (first dimension: rows) and outputs; zeros are left out.  Files are decoded by the tasks, one a file."""

    def rows(batches):
        for b in batches:
            for data in b["content"]:
                x = decode_idx(bytes(data))
                flat = x.reshape(len(x), -1).astype(float)
                yield pd.DataFrame({"i": range(len(x)), "values": list(flat)})

    read = lambda p: spark.read.format("binaryFile").load(p).select("content").mapInPandas(rows, "i long, values array<double>")
    x, y = read(features), read(outputs).select("i", F.element_at("values", 1).cast("int").cast("string").alias("output"))
    pairs = F.filter(F.transform("values", lambda v, i: F.struct(F.lpad(i.cast("string"), 5, "0").alias("name"), v.alias("value"))), lambda p: p["value"] != 0)
    return x.join(y, "i").select("output", F.map_from_entries(pairs).alias("features"))


def read_labelled_text(spark: SparkSession, path: str, separator: str = "##", upper: bool = True) -> DataFrame:
    """(output, text) of ``OUTPUT##document`` lines; lines of another form are skipped."""
    return parse_labelled_text(spark.read.text(path), separator=separator, upper=upper)


def parse_labelled_text(lines: DataFrame, col: str = "value", separator: str = "##", upper: bool = True) -> DataFrame:
    at = F.instr(F.col(col), separator)
    output = F.trim(F.substr(F.col(col), F.lit(1), at - 1))
    text = F.trim(F.substr(F.col(col), at + len(separator)))
    return lines.where(at > 1).select((F.upper(output) if upper else output).alias("output"), text.alias("text")).where("text <> ''")


def read_directories(spark: SparkSession, path: str) -> DataFrame:
    """(output, text, path): one folder for each output, a file for each document."""
    df = spark.read.text(f"{path}/*/*", wholetext=True).withColumn("path", F.input_file_name())
    return df.select(F.upper(F.element_at(F.split("path", "/"), -2)).alias("output"), F.col("value").alias("text"), "path")


def concatenate(sources: list[DataFrame]) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def round_robin(sources: list[DataFrame], orders: list[list[Column]]) -> DataFrame:
    """Rows of the sources in turn: ``turn`` (position in the source) and ``source`` give the order; exhausted sources drop out."""
    from skarn.operators.sampling import position

    return concatenate([position(s, o, "turn").withColumn("source", F.lit(i)) for i, (s, o) in enumerate(zip(sources, orders))])


def load(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """One door to the formats: parquet, libsvm, text, csv, json."""
    readers = {"libsvm": read_libsvm, "text": read_labelled_text, "csv": read_delimited, "json": read_json_array, "parquet": lambda s, p: s.read.parquet(p)}
    return readers[kind](spark, path, **options)


def sequence_rows(df: DataFrame, seq: str, order: list[str]) -> DataFrame:
    """Rows numbered within their sequence: ``pos`` from 0."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(seq).orderBy(*order)) - 1)
