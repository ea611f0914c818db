"""What the corpus operators share: words and Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica import tables
from lattica.tables import materialize, new_path, release, shared_folder

__all__ = ["WORDS", "id_text", "map_arrow", "materialize", "new_path", "pieces", "ready", "release", "shared_folder", "texts"]

#: Texts in an Arrow batch, where the session has Spark's own number: a task holds a batch several times over.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package, and has them get BATCH_ROWS rows at a time unless the session says otherwise."""
    tables.ready(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; batches over 4 MB are cut, so that memory follows the longest row, not the batch."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = fn(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices of about so many bytes, one row at least."""
    if batch.num_rows == 0:
        return
    step = max(1, batch.num_rows * most // max(most, batch.get_total_buffer_size()))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]
