"""Small Spark helpers shared by the operators of this package."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.arrays import slices
from tidemark.sources.lake import materialized

__all__ = ["LlmTables", "map_texts", "materialized", "table_batch"]


def LlmTables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_batch(columns: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    out = [c if isinstance(c, pa.Array) else pa.array(c, schema.field(i).type) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays([c.cast(schema.field(i).type) for i, c in enumerate(out)], schema=schema)


def map_texts(docs: DataFrame, keep: Sequence[str], text: str, fields: str,
              fn: Callable[[np.ndarray, np.ndarray], Sequence]) -> DataFrame:
    """One output row per row: the columns ``keep`` and what ``fn(bytes, offsets)`` gives for each.

    Only the columns named travel to Python. A null text counts as empty. Rows go through
    in slices of a few MB, in a plain map without a shuffle; a lost task is simply rerun.
    """
    taken = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = StructType([taken.schema[i] for i in range(len(keep))] + list(StructType.fromDDL(fields)))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for row, data, offsets in slices(batch.column(len(keep))):
                n = len(offsets) - 1
                yield table_batch([batch.column(i).slice(row, n) for i in range(len(keep))] + list(fn(data, offsets)), arrow)

    return taken.mapInArrow(run, schema)
