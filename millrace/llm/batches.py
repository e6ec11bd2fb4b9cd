"""Small helpers for operators that read texts as Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows, and about as many bytes of text, handled at once inside a batch, so that what a task holds doesn't follow the batch size.
SLICE, SLICE_BYTES = 512, 1_500_000


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The column's values as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, cut by rows and by bytes of text; one text is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_pylist()
    at = 0
    while at < batch.num_rows:
        end, room = at, size
        while end < batch.num_rows and end - at < rows and (end == at or room > 0):
            room -= sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def map_texts(docs: DataFrame, id_col: str, text_col: str, schema: str, per_slice: Callable[[list, list[bytes | None]], dict[str, list]]) -> DataFrame:
    """per_slice(ids, texts) -> columns of the result, over slices of every partition.

    Only the id and the text reach Python, under names of their own, so clashing extra columns don't matter.
    """
    spark = docs.sparkSession
    wanted: StructType = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = per_slice(part.column("id").to_pylist(), texts_of(part, "text"))
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, wanted)


def keep_rows(docs: DataFrame, text_col: str, wanted: Callable[[list[bytes | None]], list[bool]]) -> DataFrame:
    """The rows whose text is wanted, with all their columns: a row's verdict depends on nothing but itself, so no ids are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(wanted(texts_of(part, text_col)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
