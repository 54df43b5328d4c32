"""Records of what was run on what: JSON that can be compared and replayed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def data_record(df: DataFrame, name: str) -> dict:
    """Name, schema, rows and an order-free hash of a table."""
    n, h = df.select(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return {"name": name, "schema": df.schema.simpleString(), "rows": n, "hash": str(h or 0)}


def run_record(operator: str, options: dict, inputs: list[dict], seed: int | None = None) -> dict:
    body = {"operator": operator, "options": options, "inputs": inputs, "seed": seed}
    return body | {"id": hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()}


def differences(a: dict, b: dict, path: str = "") -> list[tuple[str, object, object]]:
    """(path, value in a, value in b) wherever two records differ."""
    out = []
    for k in sorted({*a, *b}):
        x, y, at = a.get(k), b.get(k), f"{path}.{k}" if path else k
        if isinstance(x, dict) and isinstance(y, dict):
            out += differences(x, y, at)
        elif x != y:
            out.append((at, x, y))
    return out


def anonymised(record: dict) -> dict:
    """The record with the names and options hashed away."""
    return {"hash": hashlib.sha256(json.dumps(record, sort_keys=True, default=str).encode()).hexdigest(), "operator": record.get("operator")}


def model_card(title: str, run: dict, metrics: dict[str, float], notes: str = "") -> str:
    return json.dumps({"title": title, "training": run, "metrics": metrics, "notes": notes}, sort_keys=True, indent=2, default=str)
