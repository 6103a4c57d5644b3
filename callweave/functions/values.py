"""Dates, lists kept as text, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.constants import ERROR_PREFIX, NO_SECONDARY, RUN_DATE_FORMAT, UNIDENTIFIED
from callweave.functions.literals import literal_list


def run_date(day: Column) -> Column:
    """The day as the ``run_date`` partition value."""
    return F.date_format(day, RUN_DATE_FORMAT)


def topic_list(text: Column) -> Column:
    """A list of names written as text, as Python or JSON writes it; null when it is not one."""
    return literal_list(text)


def error_text(message: Column) -> Column:
    return F.concat(F.lit(ERROR_PREFIX), message)


def primary_topic(labels: Column) -> Column:
    """First label of a best-first ``array<struct<label,score>>``."""
    return F.coalesce(F.try_element_at(labels, F.lit(1))["label"], F.lit(UNIDENTIFIED))


def secondary_topic(labels: Column) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(2))["label"], F.lit(NO_SECONDARY))
