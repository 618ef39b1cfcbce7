"""The ``;``-separated result ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from arlens.functions.text import ledger_text

# Fixed values of the ledger format.
SEP, NULL_TEXT, LINE = ";", "None", "\n"
#: Blanks at the ends of a text belong to it; Spark's writer drops them by default.
FORMAT = {"sep": SEP, "header": True, "lineSep": LINE, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_ledger(df: DataFrame, path: str, columns: list[str]) -> None:
    """B1: append rows as text (str() of each value, ``None`` for null, LF -> CR).

    The column list is checked against the frame first (the reference's width
    assertion); values holding ``;`` are quoted by the CSV writer, where the
    reference would corrupt the record.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"ledger columns missing from the frame: {missing}")
    from pyspark.sql import functions as F

    df.select(*[ledger_text(F.col(c)).alias(c) for c in columns]).write.mode("append").options(**FORMAT).csv(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed read of the ledger (Z7 fixed: no blank trailing record).  Records
    end at LF only, so the CR that stands for a newline stays in its value; text
    that reads ``None`` comes back as text."""
    from pyspark.sql import functions as F

    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.options(**FORMAT).option("nullValue", NULL_TEXT).schema(text).csv(path)
    return raw.select(*[F.regexp_replace(f.name, r"^\\(\\*None)$", "$1").cast(f.dataType).alias(f.name) for f in schema.fields])
