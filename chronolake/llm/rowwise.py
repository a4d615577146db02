"""Filters that decide each row of a table by its own text, without moving any row.

Only the texts go to Python, in Arrow batches, and only a verdict for each comes back.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Mask = Callable[[pa.Array], np.ndarray]


def _chosen(mask: Mask, id_column: str, text_column: str) -> Column:
    @F.arrow_udf("boolean")
    def verdict(texts: pa.Array) -> pa.Array:
        return pa.array(mask(texts))

    return F.col(id_column).isNotNull() & verdict(F.col(text_column))


def without(docs: DataFrame, drop: Mask, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text isn't dropped; rows with a null id stay."""
    return docs.where(~_chosen(drop, id_column, text_column))


def only(docs: DataFrame, keep: Mask, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The other rows: those that without() would drop."""
    return docs.where(_chosen(keep, id_column, text_column))
