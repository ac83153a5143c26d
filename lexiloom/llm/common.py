"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lexiloom.storage import discard, fresh, materialize, ranked

__all__ = ["Batches", "WORD", "discard", "fresh", "give_back", "in_slices", "materialize", "ranked", "table", "thrifty"]

#: Words are runs of anything but these characters.
WORD = r"[^\x20\x09-\x0D]+"


Batches = Iterator[pa.RecordBatch]


def in_slices(batches: Batches, column: int | str, most: int = 1 << 22) -> Batches:
    """Batches cut so that a text or binary column has about `most` bytes in each; a longer value is one by itself."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def thrifty(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run for mapInArrow, whose task returns the memory it no longer uses: workers stay idle between stages, next to the executor's heap."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
