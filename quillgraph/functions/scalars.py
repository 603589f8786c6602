"""Scalar column functions: URLs, numbers, contacts, durations, dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns and formats: results depend on them.
GROUP_URL = r"^(http?:\/\/.*\.meetup\.com\/[\w\-]+\/).*$"
GROUP_URL_HTTPS = r"^(https?:\/\/.*\.meetup\.com\/[\w\-]+\/).*$"
CONTACT = r"^(.*)\s+<(.*)>.*$"
DATE_FORMATS = (
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "MMM d, yyyy HH:mm:ss",
    "MMM d, yyyy",
)
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ssxxx"


def base_url(url: Column, *, accept_https: bool = False, pattern: str | None = None) -> Column:
    """The group part of an event URL, ``""`` where the URL has another shape.

    As in the source data's own rule, ``https`` only counts with ``accept_https``.
    """
    return F.regexp_extract(url, pattern or (GROUP_URL_HTTPS if accept_https else GROUP_URL), 1)


def int_or_zero(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(0))


def contact_name(contact: Column) -> Column:
    """``"Name" <address>`` gives the bare name; other shapes give ``""``."""
    return F.replace(F.regexp_extract(contact, CONTACT, 1), F.lit('"'), F.lit(""))


def contact_address(contact: Column) -> Column:
    return F.regexp_extract(contact, CONTACT, 2)


def url_position(url: Column, needle: str) -> Column:
    """0-based position of ``needle`` in ``url``, -1 if absent."""
    return F.instr(url, needle) - 1


def _span_seconds(first: Column, last: Column) -> Column:
    return F.floor((F.unix_micros(last) - F.unix_micros(first)) / 1_000_000)


def mixed_duration(first: Column, last: Column) -> Column:
    """Days, plus hours, plus minutes of the hour, summed as one number.

    The units do not mix well; ``duration_days`` is the plain measure.
    """
    seconds = _span_seconds(first, last)
    rest = F.pmod(seconds, F.lit(86400))
    return (
        F.floor(seconds / 86400).cast("double")
        + rest.cast("double") / 3600
        + F.pmod(rest.cast("double") / 60, F.lit(60.0))
    )


def duration_days(first: Column, last: Column) -> Column:
    return (F.unix_micros(last) - F.unix_micros(first)) / F.lit(86_400_000_000.0)


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Timestamp of a free-form date, null if no format fits."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s+", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats])


def iso_date(text: Column) -> Column:
    return F.date_format(parse_date(text), ISO_FORMAT)
