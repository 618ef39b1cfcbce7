"""Lineage cuts and stored inputs of the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that later steps read several times.

    The frame is written as a parquet table into the shared folder named by
    ``spark.checkpoint.dir`` (set only when unset, as in local tests) and read
    back, so the data survives executor loss and later steps are planned over a
    scan, which prunes columns, instead of a copy of the whole upstream plan per
    reference.  A ``checkpoint()`` would hold the same rows uncompressed.
    """
    import uuid

    from arlens.session import ensure_checkpoint_dir

    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, *keys: str) -> DataFrame:
    """``materialize`` into a table bucketed by ``keys``: rows of equal keys are read
    back in one task, so that joins, windows and aggregates by these keys leave
    the table where it is.  There are as many buckets as shuffle partitions.  The
    catalog forgets the table at once; its files stay in the shared folder.
    """
    import uuid

    from arlens.session import ensure_checkpoint_dir

    spark = df.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


_INPUTS: dict = {}


def stored_input(spark, sf_dir: str, name: str, build) -> DataFrame:
    """A derived test input, materialised once per session and data folder.

    Stands in for a stored table: in production these inputs (equity rows,
    document spans, table pages) are tables that queries read; only the test
    fixtures derive them, so deriving them again per query would time the
    fixture instead of the operator.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _INPUTS:
        _INPUTS[key] = materialize(build(spark, sf_dir))
    return _INPUTS[key]
