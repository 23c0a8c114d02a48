"""Packet sources (S1, S2, S12) and the ``packets`` view over ``events``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetspark import schema as S
from packetspark.functions.coerce import epoch_micros

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def packets_from_events(events: DataFrame) -> DataFrame:
    """Derive MQTT-shaped packet records from the ``events`` table.

    The rule is the shared test fixture: every packet column is a fixed
    function of ``event_id`` / ``value`` / ``event_type`` so that DuckDB can
    compute the same view.  Adds ``us`` (epoch microseconds).
    """
    eid = F.col("event_id")
    value = F.col("value")
    out = events.select(
        eid.alias("event_id"),
        F.col("ts"),
        F.col("user_id").alias("device_id"),
        F.floor(value).cast("bigint").alias("tcp_len"),
        F.when(eid % 3 == 0, F.lit("0x0018")).when(eid % 3 == 1, F.lit("0x0010"))
         .otherwise(F.lit("2")).alias("tcp_flags"),
        (value / F.lit(100.0)).alias("tcp_time_delta"),
        F.when(eid % 17 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.floor(value * 2).cast("bigint")).alias("mqtt_msg"),
        ((eid * 37) % 512).alias("mqtt_hdrflags"),
        F.when(eid % 5 == 0, F.lit(2)).otherwise(F.lit(0)).alias("mqtt_conflags"),
        F.when(eid % 11 == 0, F.lit(None).cast("bigint")).otherwise(eid % 2).alias("mqtt_conack_flags"),
        F.when(eid % 13 == 0, F.lit(None).cast("bigint")).otherwise(eid % 3).alias("mqtt_qos"),
        F.when(F.col("event_type") == "purchase", F.lit(0))
         .when(F.col("event_type") == "error", F.lit(1))
         .when(F.col("event_type") == "signup", F.lit(4))
         .otherwise(F.lit(3)).alias(S.LABEL),
    )
    return out.withColumn("us", epoch_micros(out, "ts"))


def read_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``packets`` view at one scale factor."""
    return packets_from_events(read_table(spark, sf_dir, "events"))


def read_packets_csv(spark: SparkSession, path: str, schema=S.PACKET) -> DataFrame:
    """S1 + S2: header CSV with an explicit schema; bad lines land in
    ``_corrupt_record`` instead of failing the job; ``us`` from ``timestamp``."""
    df = (spark.read.schema(schema).option("header", True)
          .option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record")
          .csv(path))
    df = df.withColumn("us", epoch_micros(df, "timestamp"))
    for c in df.columns:
        if c.lower() == S.LABEL.lower() and c != S.LABEL:
            df = df.withColumnRenamed(c, S.LABEL)
    if "event_id" not in df.columns:
        # Row identity from the content, whatever the file splits; rows that
        # are alike in every column are numbered among themselves.
        columns = df.columns
        same = Window.partitionBy("_content").orderBy("_content")
        df = (df.withColumn("_content", F.xxhash64(*columns)).withColumn("_copy", F.row_number().over(same))
                .withColumn("event_id", F.xxhash64("_content", "_copy")).drop("_content", "_copy"))
    return df
