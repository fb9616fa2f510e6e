"""Address checks over resolved hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import constants as K
from siteloom.functions.urls import in_ranges, ipv4_number


def blocked_address(ip: Column) -> Column:
    """Private, reserved or documentation addresses; anything that is not an address counts as blocked."""
    v6 = F.lower(F.regexp_replace(ip, r"^\[|\]$", ""))
    number = ipv4_number(ip)
    return (F.when(number.isNotNull(), in_ranges(number, K.RESOLVED_RANGES))
             .when(~v6.contains(":"), True).otherwise(v6.rlike(K.BLOCKED_V6_RESOLVED)))


def public_targets(hosts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Add ``public``: at least one resolved address and none of them blocked. ``resolutions``: host, ip."""
    checked = resolutions.groupBy("host").agg(F.count("ip").alias("n"), F.bool_or(blocked_address(F.col("ip"))).alias("bad"))
    return hosts.join(checked, "host", "left").withColumn(
        "public", F.coalesce((F.col("n") > 0) & ~F.col("bad"), F.lit(False))).drop("n", "bad")
