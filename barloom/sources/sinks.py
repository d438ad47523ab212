"""Writers and readers for run outputs: logs, JSON summaries, artefacts and their integrity manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "path string, length bigint, sha256 string"


def append_log(rows: DataFrame, path: str, file_format: str = "parquet", partition: str | None = None) -> None:
    """Append to a log table, partitioned by ``partition`` when given."""
    writer = rows.write.mode("append").format(file_format)
    (writer.partitionBy(partition) if partition else writer).save(path)


def write_table(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(file_format)
    (writer.option("header", True) if file_format == "csv" else writer).save(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    as_json(df, "value").write.mode("overwrite").text(path)


def write_feature_list(selected: DataFrame, path: str) -> None:
    selected.select("ordinal", "feature").write.mode("overwrite").json(path)


def read_feature_list(spark: SparkSession, path: str, fallback: list[str]) -> list[str]:
    """The stored feature names in order, or ``fallback`` when nothing is stored. Short by nature."""
    try:
        rows = spark.read.schema("ordinal int, feature string").json(path).orderBy("ordinal").collect()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return fallback
    return [row["feature"] for row in rows] or fallback


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest_differences(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a recorded manifest."""
    current = manifest(spark, path).select("path", F.col("sha256").alias("_now"))
    joined = recorded.select("path", "sha256").join(current, "path", "full")
    status = (
        F.when(F.col("_now").isNull(), "missing").when(F.col("sha256").isNull(), "new")
        .when(F.col("sha256") != F.col("_now"), "changed")
    )
    return joined.select("path", status.alias("status")).where("status IS NOT NULL")


def metric_events(wide: DataFrame, run_id: str, event: str, metrics: list[str]) -> DataFrame:
    """(run_id, ts, event, key, metric, value) rows of a metric table, for the append-only event log."""
    keys = [c for c in wide.columns if c not in metrics]
    cells = ", ".join(f"'{m}', double({m})" for m in metrics)
    key = f"concat_ws('/', {', '.join(keys)})" if keys else "''"
    return wide.selectExpr(
        f"'{run_id}' AS run_id", "current_timestamp() AS ts", f"'{event}' AS event", f"{key} AS key",
        f"stack({len(metrics)}, {cells}) AS (metric, value)",
    )


def forecast_json(forecasts: DataFrame) -> DataFrame:
    """One JSON document per ticker with an array of model forecasts."""
    entry = F.struct(*[c for c in forecasts.columns if c != "ticker"])
    grouped = forecasts.groupBy("ticker").agg(F.array_sort(F.collect_list(entry)).alias("forecasts"))
    return grouped.select("ticker", F.to_json(F.struct("ticker", "forecasts")).alias("json"))
