"""Writers. Every sink is a directory written by executors; nothing passes the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.scalars import NUMERIC, columns_of
from terrapanel.operators.sampling import first_rows


def write_panel(df: DataFrame, path: str, partition: Sequence[str] = ("year",), mode: str = "overwrite") -> None:
    """Snappy Parquet by year.

    The rebalance hint lets the runtime split a big year over many tasks and merge small
    ones, so neither one huge file nor a file per task and year comes out.
    """
    df.hint("rebalance", *partition).write.mode(mode).partitionBy(*partition).option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def metadata_row(df: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
    """One nested row: row count and min, max, mean, sd per measure."""
    measures = list(measures or columns_of(df, NUMERIC))
    stats = [
        F.struct(
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.count(c).alias("count"),
        ).alias(c)
        for c in measures
    ]
    return df.agg(F.count(F.lit(1)).alias("total_observations"), *stats)


def write_metadata(df: DataFrame, path: str, measures: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    metadata_row(df, measures).write.mode(mode).json(path)


def write_sample(df: DataFrame, path: str, keys: Sequence[str], n: int = 1000, mode: str = "overwrite") -> None:
    """First ``n`` rows in key order."""
    write_csv(first_rows(df, keys, n), path, mode)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All splits in one table; reading one split touches only its folder."""
    df.filter(F.col("split").isNotNull()).write.mode(mode).partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == split)


def write_selected(selected: DataFrame, path: str, mode: str = "overwrite") -> None:
    selected.write.mode(mode).parquet(path)


def read_selected(spark: SparkSession, path: str) -> list[str]:
    """Selected feature names in rank order: a few dozen."""
    return [r["feature"] for r in spark.read.parquet(path).orderBy("rank").select("feature").collect()]


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_boundaries(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
