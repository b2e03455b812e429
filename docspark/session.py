"""The session that the operators expect: UTC, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "docspark", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
