"""What the operators of this package share: bare inputs, Arrow rows, stable keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.session import materialize

__all__ = ["add_columns", "documents", "bare", "free_name", "held_out", "map_rows", "materialize", "release", "text_key"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bare(docs: DataFrame, *also: str) -> DataFrame:
    """``doc_id``, the whole text (null: empty) and the named columns; whatever else the table has stays out."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *also)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores behind it as it takes to be no column's name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key() -> list[Column]:
    """128 bits that stand for a row's id and whole text."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2")]


def held_out(modulus: int, remainder: int = 2) -> Column:
    """Rows whose crc32 of the id as text has this remainder (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def release() -> None:
    """Hands memory that a task has freed back to the system: Python workers live on, and the next stage's needs would add to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def map_rows(df: DataFrame, fn: Callable[[list[dict]], list[dict]], schema: str, rows: int = 256) -> DataFrame:
    """``fn`` on slices of up to ``rows`` rows, given and returned as column lists.

    Slices are taken from Arrow batches as they come, so a worker holds one
    batch and one slice of results at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = fn(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)
        release()

    return df.mapInArrow(each, schema)


#: Bytes of texts that a slice of ``add_columns`` holds at most, unless one text has more.
SLICE_BYTES = 16_000_000


def _cuts(batch: pa.RecordBatch, inputs: list[str], rows: int) -> Iterator[tuple[int, int]]:
    """Slices of up to ``rows`` rows and ``SLICE_BYTES`` bytes of their binary and text columns."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in inputs:
        if pa.types.is_string(batch.column(c).type) or pa.types.is_binary(batch.column(c).type):
            sizes += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        end = min(batch.num_rows, at + rows, max(full, at + 1))
        yield at, end - at
        at = end


def add_columns(df: DataFrame, inputs: list[str], fn: Callable[[dict], dict], added: str, rows: int = 256) -> DataFrame:
    """``df`` with the columns ``added`` that ``fn`` makes of slices of its ``inputs``, given and returned as lists.

    Only the inputs become Python objects, a slice at a time; all other columns
    pass as they are.  Columns of the added names are replaced, and come last.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in names]
    types = to_arrow_schema(new)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _cuts(batch, inputs, rows):
                part = batch.slice(at, n)
                got = fn({c: part.column(c).to_pylist() for c in inputs})
                arrays = [part.column(f.name) for f in kept] + [pa.array(got[f.name], f.type) for f in types]
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + types.names)
        release()

    return df.mapInArrow(each, StructType([*kept, *new]))
