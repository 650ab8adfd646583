"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``data_dir`` with zone-less timestamps read as UTC instants."""
    df = spark.read.parquet(f"{data_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What was written at ``path``, or None if nothing was; every other fault in reading is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
