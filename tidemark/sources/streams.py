"""Connectors of message queues and files as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _messages(raw: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    return raw.select(F.from_json(F.col(column).cast("string"), schema).alias("r")).select("r.*")


def kafka_rows(spark: SparkSession, servers: str, topic: str, schema: T.StructType, options: dict | None = None) -> DataFrame:
    """JSON messages of a topic as rows; needs Spark's Kafka connector on the class path. Bad messages are rows of NULLs."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**(options or {})).load()
    return _messages(raw, "value", schema)


def pulsar_rows(spark: SparkSession, service: str, admin: str, topic: str, schema: T.StructType, options: dict | None = None) -> DataFrame:
    """The same for a Pulsar topic of JSON as bytes; needs the Pulsar connector of Spark on the class path."""
    raw = spark.readStream.format("pulsar").option("service.url", service).option("admin.url", admin).option("topic", topic).options(**(options or {})).load()
    return _messages(raw, "value", schema)


def rocketmq_rows(spark: SparkSession, servers: str, topic: str, schema: T.StructType, options: dict | None = None) -> DataFrame:
    """The same for a RocketMQ topic; needs the RocketMQ connector of Spark on the class path."""
    raw = spark.readStream.format("rocketmq").option("nameServer", servers).option("topic", topic).options(**(options or {})).load()
    return _messages(raw, "body", schema)


def file_rows(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)


def append_to(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet"):
    """Keeps a copy of a stream's rows in files; exactly once by the checkpoint."""
    return stream.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
