"""Checks of request fields as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siteloom.functions import constants as K
from siteloom.functions.text import collapse_ws


def page_limit(c: Column) -> Column:
    """Allowed crawl sizes are 5, 10 and 25; anything else means 10."""
    return F.when(c.isin(5, 10, 25), c).otherwise(10)


def valid_name(c: Column) -> Column:
    """Names have 2 to 80 characters."""
    return F.coalesce(F.length(collapse_ws(c)).between(2, 80), F.lit(False))


def valid_intent(c: Column) -> Column:
    return F.coalesce(c.isin(K.INTENTS), F.lit(False))


def valid_page_type(c: Column) -> Column:
    return F.coalesce(c.isin(list(K.OUTLINES)), F.lit(False))


def valid_status(c: Column) -> Column:
    return F.coalesce(c.isin(K.BRIEF_STATUSES), F.lit(False))


def valid_severity(c: Column) -> Column:
    return F.coalesce(c.isin(K.SEVERITIES), F.lit(False))
