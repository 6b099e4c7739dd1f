"""Scalar functions: number grammar, number formatting, bit views, small texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_u64(text: Column) -> Column:
    """Digits only, up to 2^63 - 1; anything else is null (a plain cast would take signs and blanks)."""
    return F.when(text.rlike(r"^[0-9]+\z"), text.try_cast("decimal(38,0)").try_cast("bigint"))


#: Decimal numbers with optional exponent.
_DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
#: Hexadecimal floats: mantissa with a binary exponent.
_HEX = r"^([+-]?)0[xX]([0-9a-fA-F]*)\.?([0-9a-fA-F]*)[pP]([+-]?[0-9]+)\z"


def parse_f64(text: Column) -> Column:
    """Double of a decimal or hexadecimal number, NaN or an infinity by name; null for the rest and on overflow.

    Hexadecimal mantissas count up to 15 digits, which hold all 53 bits of a double and more.
    """
    word = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    negative = F.startswith(text, F.lit("-"))
    inf = F.when(negative, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    number = text.try_cast("double")
    whole, part = F.regexp_extract(text, _HEX, 2), F.regexp_extract(text, _HEX, 3)
    mantissa = F.conv(F.concat(whole, part), 16, 10).cast("double")
    exponent = F.regexp_extract(text, _HEX, 4).try_cast("int") - 4 * F.length(part)
    hexed = F.when(F.length(F.concat(whole, part)).between(1, 15), mantissa * F.pow(F.lit(2.0), exponent))
    hexed = F.when(F.startswith(text, F.lit("-")), -hexed).otherwise(hexed)
    finite = F.when(text.rlike(_DECIMAL), number).when(text.rlike(_HEX), hexed)
    return (
        F.when((word == "nan") & ~text.rlike(r"^[+-]"), F.lit(float("nan")))
        .when(word.isin("inf", "infinity"), inf)
        .when(F.abs(finite) < float("inf"), finite)
    )


@F.pandas_udf(T.StringType())
def format_g6(values: pd.Series) -> pd.Series:
    """Six significant digits, no trailing zeros, exponent below 1e-4 and from 1e6 on; NaN, +Inf, -Inf.

    Spark's own %g keeps zeros and rounds the decimal text of the number, not the number.
    """
    names = {"nan": "NaN", "inf": "+Inf", "-inf": "-Inf"}
    return values.map(lambda v: None if v is None else names.get(t := format(v, ".6g"), t))


@F.pandas_udf(T.StringType())
def number_text(values: pd.Series) -> pd.Series:
    """The shortest text that reads back as the same double, exponent below 1e-4 and from 1e16 on, as SQL engines cast it.

    Spark's own text has an exponent from 1e7 on and, by Java's version, digits too many.
    """
    return values.map(lambda v: None if pd.isna(v) else repr(float(v)))


@F.pandas_udf(T.LongType())
def float_bits(values: pd.Series) -> pd.Series:
    """The 64 bits of a double, as a long."""
    return pd.Series(np.ascontiguousarray(values.to_numpy(np.float64)).view(np.int64))


@F.pandas_udf(T.DoubleType())
def bits_float(values: pd.Series) -> pd.Series:
    """The double with these 64 bits."""
    return pd.Series(np.ascontiguousarray(values.to_numpy(np.int64)).view(np.float64))


def leading_zeros(bits: Column) -> Column:
    """Zero bits before the first one of a 64-bit value; 64 for zero."""
    return F.when(bits == 0, F.lit(64)).otherwise(64 - F.length(F.bin(bits)))


def trailing_zeros(bits: Column) -> Column:
    """Zero bits after the last one of a 64-bit value; 64 for zero."""
    digits = F.bin(bits)
    return F.when(bits == 0, F.lit(64)).otherwise(F.length(digits) - F.length(F.rtrim(digits, F.lit("0"))))


def uptime_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def bytes_text(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1048576, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.2f MB", n / 1048576))
    )


def ago_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    return (
        F.when(s < 60, F.format_string("%ds ago", s))
        .when(s < 3600, F.format_string("%dm ago", F.floor(s / 60)))
        .otherwise(F.format_string("%dh ago", F.floor(s / 3600)))
    )


def chunk_name(number: Column) -> Column:
    return F.format_string("chunk_%04d.dat", number)


def chunk_number(name: Column) -> Column:
    """Number of a chunk file of four or more digits; null for other names."""
    return F.when(name.rlike(r"^chunk_[0-9]{4,}\.dat\z"), F.regexp_extract(name, "([0-9]+)", 1).cast("int"))


def saved_percent(raw: Column, packed: Column) -> Column:
    """Percent of space saved, whole and between 0 and 100."""
    return F.greatest(F.least(F.round((1 - packed / raw) * 100), F.lit(100.0)), F.lit(0.0)).cast("int")
