"""Kernel machines on landmarks: rows are mapped to their kernel values with a bounded number of landmark rows, and a linear hinge model is trained on the map.

The map is K(x, landmarks) K(landmarks, landmarks)^(-1/2) (Nystrom), so inner products of mapped rows are kernel values,
exact where the landmarks span the rows.  ``landmarks`` is the documented bound on the sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators import linear

#: (rows, landmarks) -> kernel values
KERNELS = {
    "linear": lambda a, b, **o: a @ b.T,
    "polynomial": lambda a, b, degree=2, gamma=1.0, coefficient=1.0: (gamma * (a @ b.T) + coefficient) ** degree,
    "rbf": lambda a, b, gamma=1.0: np.exp(-gamma * np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T)),
    "sigmoid": lambda a, b, gamma=1.0, coefficient=0.0: np.tanh(gamma * (a @ b.T) + coefficient),
}


class KernelModel:
    def __init__(self, landmarks: np.ndarray, root: np.ndarray, kernel: str, options: dict, model: linear.Linear | None = None):
        self.landmarks, self.root, self.kernel, self.options, self.model = landmarks, root, kernel, options, model

    def mapped(self, features: str) -> Column:
        """Array column of the map; null for null features."""
        landmarks, root, kernel, options = self.landmarks, self.root, self.kernel, self.options

        @F.pandas_udf("array<double>")
        def run(s: pd.Series) -> pd.Series:
            known = s.dropna()
            mapped = KERNELS[kernel](np.array([np.asarray(x, float) for x in known]).reshape(len(known), landmarks.shape[1]), landmarks, **options) @ root
            return pd.Series(list(mapped), known.index, dtype=object).reindex(s.index)

        return run(features)

    def predict(self, df: DataFrame, features: str) -> DataFrame:
        out = self.model.predict(df.withColumn("_map", self.mapped(features)), "_map")
        return out.drop("_map")


def fit(df: DataFrame, features: str, target: str, outputs: list[str], kernel: str = "rbf", landmarks: int = 256, key: Column | None = None, optimiser: linear.Optimiser | None = None, epochs: int = 40, **options) -> KernelModel:
    """A multi-class support vector machine: hinge loss over the kernel's map.  Landmarks are the first rows by a hash of ``key`` (default: of the features); all rows are trained on."""
    known = df.where(F.col(features).isNotNull() & F.col(target).isNotNull())
    at = np.array([r[0] for r in known.select(F.col(features).cast("array<double>")).orderBy(F.xxhash64(key if key is not None else F.col(features))).limit(landmarks).collect()], float)
    if not len(at):
        raise ValueError("no rows to learn from")
    values, vectors = np.linalg.eigh(KERNELS[kernel](at, at, **options))
    some = values > 1e-9 * max(values.max(), 1e-300)
    model = KernelModel(at, vectors[:, some] / np.sqrt(values[some]), kernel, options)
    model.model = linear.fit(known.withColumn("_map", model.mapped(features)), "_map", target, outputs, "hinge", optimiser or linear.Optimiser("adam", 0.1, l2=1e-4), epochs)
    return model
