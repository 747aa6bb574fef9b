"""Reading of embedding tables, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for vectors that are not null or empty, hold only finite components and are not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, embedding, label``; other columns are left out so that names cannot clash. Floats stay floats, all else becomes double."""
    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    label = F.col("label") if "label" in embeddings.columns else F.lit(None)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), label.cast("string").alias("label"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))
