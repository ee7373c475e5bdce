"""What a part costs: four readings of "cheapest", kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_offers(listings: DataFrame, named: Column | None = None) -> DataFrame:
    """A row for each part that is listed.

    cheapest_* ignores stock; buy_* prefers what is in stock, else the cheapest
    at all; min_in_stock is null without stock; ties go to the smaller vendor_id.
    vendors are all who list the part; with a condition `named`, those it holds for and the least of all.
    """
    row = F.struct("vendor_id", "price_minor", "in_stock")
    return listings.groupBy("part_id").agg(
        F.count("*").alias("n_offers"),
        F.min_by(row, F.struct("price_minor", "vendor_id")).alias("cheapest"),
        F.min_by(row, F.struct(~F.col("in_stock"), "price_minor", "vendor_id")).alias("buy"),
        F.min(F.when(F.col("in_stock"), F.col("price_minor"))).alias("min_in_stock"),
        F.min("price_minor").alias("min_price"),
        F.bool_or("in_stock").alias("any_in_stock"),
        F.array_sort(F.collect_set("vendor_id") if named is None else F.array_union(F.array(F.min("vendor_id")), F.collect_set(F.when(named, F.col("vendor_id"))))).alias("vendors"),
    )
