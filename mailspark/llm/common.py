"""Helpers shared by the operators: tables, scratch tables, word expressions.

Scratch tables are Parquet under the folder named by ``spark.checkpoint.dir``,
so they survive lost executors; ``drop_scratch`` removes one as soon as nothing
can read it again, and what a returned DataFrame still reads goes when the
driver process ends.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, remember_scratch, scratch_path

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at the same bytes.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh shared scratch table and read it back."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    remember_scratch(df.sparkSession, path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(df: DataFrame) -> None:
    """Remove a table made by ``scratch`` that no later plan reads; any other DataFrame is left alone."""
    if path := getattr(df, "_scratch_path", None):
        drop_path(df.sparkSession, path)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def words(c: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(c, r"[\x20\x09-\x0D]+"), "")


def batches(frames, limit: int = 8 << 20, column: str = "text"):
    """Cut Arrow-sized pandas frames further, so that one piece holds about ``limit``
    characters at most (or one row); bounds the memory of what a task does at once."""
    for f in frames:
        if not len(f):
            continue
        sizes = f[column].str.len().fillna(0).to_numpy()
        block = (sizes.cumsum() // limit).astype("int64")
        if block[-1] == block[0]:
            yield f
        else:
            for _, g in f.groupby(block, sort=True):
                yield g


def giving_back(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]):
    """``run``, after which a task's Python worker gives its free memory back: Spark uses the worker again, and
    what one stage has freed but kept would add to the next one's."""

    def wrapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(frames)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
