"""Scalar functions as compositions of built-in columns; no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

_INSTANT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})\z"


def utc(spark: SparkSession) -> SparkSession:
    """The session, with instants shown in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def instant_epoch(text: Column) -> Column:
    """Epoch seconds of an instant with whole seconds and an offset of up to 23:59; else null."""
    wall = F.unix_seconds(F.try_to_timestamp(F.concat(F.substring(text, 1, 19), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    hours, minutes = F.substring(text, 21, 2).try_cast("int"), F.substring(text, 24, 2).try_cast("int")
    sign = F.when(F.substring(text, 20, 1) == "-", -1).otherwise(1)
    offset = F.when(F.substring(text, 20, 1) == "Z", 0).when((hours <= 23) & (minutes <= 59), sign * (hours * 3600 + minutes * 60))
    at = F.when(text.rlike(_INSTANT), wall - offset)
    return F.when(at.between(-62135596800, 253402300799), at)


def instant_text(epoch: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of epoch seconds; null stays null. Needs a session in UTC."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hours(seconds: Column) -> Column:
    return seconds / F.lit(3600.0)


def is_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[A-Za-z0-9_-]{1,64}\z"), F.lit(False))


def is_trimmed(text: Column) -> Column:
    """Not blank, and without white space at either end."""
    return F.coalesce(text.rlike(r"(?U)\A\S(.*\S)?\z"), F.lit(False))


def positive_int(text: Column) -> Column:
    """The value of a string of ASCII digits above 0; else null."""
    value = F.when(text.cast("string").rlike(r"\A[0-9]+\z"), text.cast("string").try_cast("bigint"))
    return F.when(value > 0, value)


def nonnegative_int(text: Column) -> Column:
    return F.when(text.cast("string").rlike(r"\A[0-9]+\z"), text.cast("string").try_cast("bigint"))


def finite_real(text: Column) -> Column:
    """The value of a finite number; else null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def bit(text: Column) -> Column:
    return F.when(text.cast("string").isin("0", "1"), text.cast("int"))


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def alert_id(case_id: Column, reason: Column) -> Column:
    """A stable id: 20 hex digits of the digest of the JSON list of both; ids need no escapes."""
    return F.concat(F.lit("ALERT-"), F.substring(F.sha2(F.concat(F.lit('["'), case_id.cast("string"), F.lit('","'), reason, F.lit('"]')), 256), 1, 20))
