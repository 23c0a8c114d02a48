"""Schemas and fixed vocabularies.

FIXED VALUES: the feature names, their order, the scaled-column lists and the
traffic class names below must equal the reference's for results (and saved
models) to line up, so they are stated literally.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# ML feature order (17 features) followed by the label.
FEATURES = [
    "frame_length",
    "protocol_flags",
    "mqtt_msgtype",
    "mqtt_qos",
    "mqtt_payload_len",
    "mqtt_retain",
    "mqtt_client_id_hash",
    "iat",
    "msg_rate_1s",
    "msg_rate_10s",
    "msg_rate_60s",
    "rolling_mean_payload_1s",
    "rolling_std_payload_1s",
    "rolling_mean_payload_10s",
    "rolling_std_payload_10s",
    "rolling_mean_payload_60s",
    "rolling_std_payload_60s",
]
LABEL = "target"

# Columns standardised by the batch preprocessing (14, raw copies included).
BATCH_SCALE_COLUMNS = [
    "tcp_len", "mqtt_msg", "iat",
    "frame_length", "mqtt_payload_len",
    "msg_rate_1s", "msg_rate_10s", "msg_rate_60s",
    "rolling_mean_payload_1s", "rolling_mean_payload_10s", "rolling_mean_payload_60s",
    "rolling_std_payload_1s", "rolling_std_payload_10s", "rolling_std_payload_60s",
]
# Columns standardised by the saved scaler / streaming path (12).
SERVE_SCALE_COLUMNS = [
    "frame_length", "mqtt_payload_len", "iat",
    "msg_rate_1s", "msg_rate_10s", "msg_rate_60s",
    "rolling_mean_payload_1s", "rolling_mean_payload_10s", "rolling_mean_payload_60s",
    "rolling_std_payload_1s", "rolling_std_payload_10s", "rolling_std_payload_60s",
]
# Traffic classes.
CLASS_NAMES = {
    0: "bruteforce",
    1: "dos",
    2: "flood",
    3: "legitimate",
    4: "malformed",
    5: "slowite",
}
NORMAL_CLASS = 3
DEFAULT_WINDOWS = (1, 10, 60)
# Raw columns capped before the temporal features, and after.
PRE_CAP_COLUMNS = ["tcp_len", "mqtt_msg"]
POST_CAP_COLUMNS = ["iat"]
IQR_FACTOR = 3.0
# ------------------------------------------------------------ end fixed values


def rate_col(w: int) -> str:
    return f"msg_rate_{w}s"


def mean_col(w: int) -> str:
    return f"rolling_mean_payload_{w}s"


def std_col(w: int) -> str:
    return f"rolling_std_payload_{w}s"


# Raw packet record as read from CSV files (batch). Flags may be hex text.
PACKET = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("tcp_len", T.DoubleType()),
    T.StructField("tcp_flags", T.StringType()),
    T.StructField("tcp_time_delta", T.DoubleType()),
    T.StructField("mqtt_msg", T.DoubleType()),
    T.StructField("mqtt_hdrflags", T.StringType()),
    T.StructField("mqtt_conflags", T.StringType()),
    T.StructField("mqtt_conack_flags", T.StringType()),
    T.StructField("mqtt_qos", T.StringType()),
    T.StructField("Target", T.IntegerType()),
    T.StructField("_corrupt_record", T.StringType()),
])

# Streaming source: every field arrives as text.
STREAM_RAW = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("tcp_len", T.StringType()),
    T.StructField("tcp_flags", T.StringType()),
    T.StructField("mqtt_msg", T.StringType()),
    T.StructField("mqtt_hdrflags", T.StringType()),
    T.StructField("mqtt_conflags", T.StringType()),
    T.StructField("mqtt_conack_flags", T.StringType()),
    T.StructField("mqtt_qos", T.StringType()),
])

# Persisted preprocessing state: one row per column.
STATS = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std_pop", T.DoubleType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("lower", T.DoubleType()),
    T.StructField("upper", T.DoubleType()),
    T.StructField("fitted_on", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("from_us", T.LongType()),
    T.StructField("to_us", T.LongType()),
])
# Layout of STATS; a saved state of another one is not read.
STATS_VERSION = 1

# Fault scenario document.
FAULT_CONFIG = T.StructType([
    T.StructField("scenario_id", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("corruption", T.StructType([
        T.StructField("rate", T.DoubleType()),
        T.StructField("noise_std", T.DoubleType()),
    ])),
    T.StructField("payload_loss", T.StructType([
        T.StructField("rate", T.DoubleType()),
        T.StructField("payload_feature", T.StringType()),
        T.StructField("drop_features", T.ArrayType(T.StringType())),
        T.StructField("zero_payload", T.BooleanType()),
        T.StructField("drop_features_mode", T.BooleanType()),
    ])),
    T.StructField("target", T.StringType()),
    T.StructField("random_state", T.LongType()),
])
