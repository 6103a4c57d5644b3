"""Prompt texts. ``concat`` rather than a format string, so a call may hold braces and percent signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.constants import ACTIONS_PROMPT_HEAD, PROMPT_TAIL, SUMMARY_PROMPT_HEAD


def summary_prompt(text: Column) -> Column:
    return F.concat(F.lit(SUMMARY_PROMPT_HEAD), text, F.lit(PROMPT_TAIL))


def actions_prompt(text: Column) -> Column:
    return F.concat(F.lit(ACTIONS_PROMPT_HEAD), text, F.lit(PROMPT_TAIL))
