"""Packet -> feature mapping and scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetspark import schema as S
from packetspark.functions.coerce import coerce_int_column


def msgtype_expr(hdr: Column) -> Column:
    """M3: MQTT message type from the fixed-header flags.

    Type is bits 4-7.  When that is 0 but the flag value exceeds 16 the
    packet is taken as PUBLISH (3); with bits 4-7 clear this fires only for
    values >= 256.  (The CONNECT rule of the reference changes nothing.)
    """
    t = F.shiftright(hdr, 4).bitwiseAND(F.lit(15))
    return F.when((t == 0) & (hdr > 16), F.lit(3)).otherwise(t).cast("int")


def map_features(df: DataFrame, hex_mode: str = "parse") -> DataFrame:
    """M1-M6 in one projection.

    Absent source columns become 0 (the streaming rule, M7); the payload
    length stays null until vector assembly.
    """
    def have(c):
        return c in df.columns

    def icol(c):
        return coerce_int_column(df, c, hex_mode) if have(c) else F.lit(0).cast("bigint")

    hdr = icol("mqtt_hdrflags")
    new = {
        "frame_length": F.col("tcp_len").cast("double") if have("tcp_len") else F.lit(0.0),
        "protocol_flags": icol("tcp_flags"),
        "mqtt_qos": icol("mqtt_qos").cast("int"),
        "mqtt_payload_len": F.col("mqtt_msg").cast("double") if have("mqtt_msg") else F.lit(0.0),
        "mqtt_msgtype": msgtype_expr(hdr),
        "mqtt_retain": hdr.bitwiseAND(F.lit(1)).cast("int"),
        "mqtt_client_id_hash": icol("mqtt_conack_flags").cast("int"),
    }
    return df.withColumns(new)


def ml_projection(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """M8: keep the fixed feature list (those present) + label + extras.

    The label counts in any case (``Target``) and is named ``S.LABEL`` after."""
    for c in df.columns:
        if c.lower() == S.LABEL.lower() and S.LABEL not in df.columns:
            df = df.withColumnRenamed(c, S.LABEL)
    keep = [c for c in S.FEATURES + [S.LABEL] if c in df.columns]
    keep += [c for c in (extra or []) if c in df.columns and c not in keep]
    return df.select(*keep)


def binary_relabel(label: Column, normal_class: int = S.NORMAL_CLASS) -> Column:
    """1 for the normal class, -1 for every attack class."""
    return F.when(label == F.lit(normal_class), F.lit(1)).otherwise(F.lit(-1)).cast("int")


def class_name(label: Column) -> Column:
    """Class index -> name; unknown -> ``class_<n>``."""
    m = F.create_map(*[x for k, v in sorted(S.CLASS_NAMES.items()) for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[label], F.concat(F.lit("class_"), label.cast("string")))


def feature_map(cols: list[str]) -> Column:
    """Features as ``MAP<STRING, DOUBLE>``."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in cols]),
                             F.array(*[F.col(c).cast("double") for c in cols]))


def feature_map_text(m: Column) -> Column:
    """``name:value`` pairs sorted by name, 6 decimals, ``|``-joined."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(m)),
                    lambda e: F.format_string("%s:%.6f", e["key"], e["value"])), "|")


def sigmoid_confidence(score: Column) -> Column:
    """``1 / (1 + exp(score))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(score))


def max_probability(prob: Column) -> Column:
    """Highest class probability of an ML probability vector."""
    from pyspark.ml.functions import vector_to_array
    return F.array_max(vector_to_array(prob))
