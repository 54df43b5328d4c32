"""Sinks: wide delimited text, LibSVM lines, IDX files, evaluations as text and HTML."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_delimited(features: DataFrame, outputs: DataFrame, path: str, names: list[str], id_col: str = "id", output: str = "output", sep: str = ",") -> None:
    """Responses, then features in domain order; absent features are 0."""
    from skarn.operators.features import spread

    outputs.join(spread(features, id_col, names), id_col, "left").select(output, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names]).write.option("header", True).option("sep", sep).csv(path)


def libsvm_line(output: Column, names: list[str], zero_indexed: bool = False) -> Column:
    """``label i:v`` text of a wide row; zeros are left out."""
    start = 0 if zero_indexed else 1
    parts = [F.when(F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) != 0, F.concat(F.lit(f"{i + start}:"), F.col(f"`{n}`").cast("double").cast("string"))) for i, n in enumerate(names)]
    return F.concat_ws(" ", output, *parts)


def write_libsvm(df: DataFrame, output: str, names: list[str], path: str, zero_indexed: bool = False) -> None:
    df.select(libsvm_line(F.col(output), names, zero_indexed).alias("value")).write.text(path)


def encode_idx(array: np.ndarray) -> bytes:
    kinds = {"uint8": 0x08, "int8": 0x09, "int16": 0x0B, "int32": 0x0C, "float32": 0x0D, "float64": 0x0E}
    head = struct.pack(">HBB", 0, kinds[array.dtype.name], array.ndim) + struct.pack(f">{array.ndim}i", *array.shape)
    return head + array.astype(array.dtype.newbyteorder(">")).tobytes()


def evaluation_text(metrics: dict[str, float]) -> str:
    width = max(map(len, metrics), default=0)
    return "\n".join(f"{k:<{width}}  {v:.6f}" for k, v in metrics.items())


def evaluation_html(metrics: dict[str, float]) -> str:
    from html import escape

    return "<table>" + "".join(f"<tr><td>{escape(k)}</td><td>{v:.6f}</td></tr>" for k, v in metrics.items()) + "</table>"
