"""Value coercion expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

HEX_RE = "^0[xX][0-9a-fA-F]+$"


def _text(c: Column) -> Column:
    return F.trim(c.cast("string"))


def _to_long(v: Column) -> Column:
    """DOUBLE -> BIGINT, truncated; null for NaN, infinities and what does not fit."""
    return F.when((v >= F.lit(-9.2e18)) & (v <= F.lit(9.2e18)), v).try_cast("bigint")


def _hex_value(t: Column, kind: str) -> Column:
    """Value of ``0x..`` text; null beyond 64 bits, where ``conv`` would fail."""
    digits = F.regexp_replace(F.substring(t, 3, 1 << 20), "^0+(?=.)", "")
    return F.when(t.rlike(HEX_RE) & (F.length(digits) <= 16), F.conv(F.substring(digits, 1, 16), 16, 10)).try_cast(kind)


def to_number(c: Column, default: float | None = 0.0) -> Column:
    """S3: numeric text -> DOUBLE, anything else -> ``default``."""
    v = _text(c).try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def to_int(c: Column, default: int = 0) -> Column:
    """S3: ``to_numeric(errors='coerce').fillna(default).astype(int)``.

    ``cast('bigint')`` truncates toward zero like ``astype(int)``.
    """
    return F.coalesce(_to_long(_text(c).try_cast("double")), F.lit(default).cast("bigint"))


def hex_int(c: Column, default: int = 0, hex_mode: str = "parse") -> Column:
    """Hex-aware integer coercion.

    ``0x..`` text is read base 16 (``hex_mode='parse'``) or taken as missing
    (``hex_mode='zero'``, the reference's streaming behaviour); other text is
    read as a number and truncated; failures give ``default``.
    """
    t = _text(c)
    numeric = _to_long(t.try_cast("double"))
    if hex_mode == "parse":
        v = F.when(t.rlike(HEX_RE), _hex_value(t, "bigint")).otherwise(numeric)
    elif hex_mode == "zero":
        v = numeric
    else:
        raise ValueError(f"hex_mode must be 'parse' or 'zero', got {hex_mode!r}")
    return F.coalesce(v, F.lit(default).cast("bigint"))


def hex_float(c: Column, default: float = 0.0, hex_mode: str = "parse") -> Column:
    """Hex-aware float coercion."""
    t = _text(c)
    numeric = t.try_cast("double")
    if hex_mode == "parse":
        v = F.when(t.rlike(HEX_RE), _hex_value(t, "double")).otherwise(numeric)
    else:
        v = numeric
    return F.coalesce(v, F.lit(float(default)))


def coerce_int_column(df, name: str, hex_mode: str = "parse", default: int = 0) -> Column:
    """Integer view of a column that may be numeric or text."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return hex_int(F.col(name), default, hex_mode)
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.coalesce(_to_long(F.col(name).cast("double")), F.lit(default).cast("bigint"))
    return F.coalesce(F.col(name).cast("bigint"), F.lit(default).cast("bigint"))


def epoch_micros(df, name: str) -> Column:
    """Microseconds since the epoch, independent of the session zone for
    TIMESTAMP_NTZ (read as UTC wall clock) and exact for TIMESTAMP."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return ntz_micros(F.col(name))
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(dtype, T.DateType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return normalise_timestamp_micros(F.col(name), days=isinstance(dtype, T.NumericType))


def ntz_micros(c: Column) -> Column:
    """Wall-clock TIMESTAMP_NTZ -> epoch microseconds read as UTC, built from
    the date and time fields so that no session time zone (or DST change)
    takes part."""
    day = F.unix_date(c.cast("date")).cast("bigint") * F.lit(86_400_000_000)
    hm = (F.hour(c).cast("bigint") * 3600 + F.minute(c).cast("bigint") * 60) * F.lit(1_000_000)
    sec = (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint")
    return day + hm + sec


def normalise_timestamp_micros(c: Column, days: bool = False) -> Column:
    """Text or number -> epoch microseconds (null when unparsable).

    * text that parses as a datetime (read as UTC wall clock);
    * a number > 1e9 is epoch seconds;
    * with ``days`` (a numeric column), a smaller number counts days since the
      epoch; small numbers in text are no timestamps.

    Numbers beyond the range of microseconds are unparsable too.
    """
    t = _text(c)
    num = t.try_cast("double")
    parsed = ntz_micros(t.try_cast("timestamp_ntz"))
    from_seconds = F.when(num > F.lit(1e9), _to_long(num * F.lit(1e6)))
    from_days = F.when(num <= F.lit(1e9), _to_long(num * F.lit(86400e6))) if days else F.lit(None).cast("bigint")
    return F.when(num.isNotNull(), F.coalesce(from_seconds, from_days)).otherwise(parsed)
