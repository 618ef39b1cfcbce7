"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from arlens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of ``spark.checkpoint.dir``: the plan
    below is cut, and later reads survive the loss of any executor.

    Nothing needs the shuffle files below the cut any more.  Spark removes them
    when the driver's JVM collects what refers to them, which an idle driver may
    not do for half an hour, so a job of many steps asks for it here.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    spark.sparkContext._jvm.System.gc()
    return out


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null reads as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """``texts`` as 64-bit strings, null as empty, in runs of about ``size`` bytes;
    a longer text is alone."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    edge = np.flatnonzero(np.diff(total // size)) + 1
    for a, z in zip([0, *edge], [*edge, len(texts)]):
        if z > a:
            yield texts.slice(a, z - a)
