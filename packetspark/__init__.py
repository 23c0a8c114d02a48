"""packetspark: MQTT / IoT attack-detection feature engineering, models and
evaluation expressed as Spark DataFrame, Spark ML and Structured Streaming jobs.

Sub-packages
------------
sources    readers (parquet / CSV packets, fault scenarios) and sinks
functions  column expressions: coercion, feature mapping, hash draws
operators  timeline windows, statistics, metrics, faults, models
plans      end-to-end jobs (preprocess, training, fault evaluation)
streaming  stateful streaming scorer
"""

__version__ = "0.1.0"
