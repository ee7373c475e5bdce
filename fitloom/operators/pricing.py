"""Prices of builds: purchases by vendor, totals, and orders that could be consolidated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.operators.offers import part_offers


def priced_items(slots: DataFrame, listings: DataFrame) -> DataFrame:
    """(build_id, slot, part_id, vendor_id, price_minor): each part at its offer to buy; unlisted parts drop out."""
    buy = part_offers(listings).select("part_id", F.col("buy.vendor_id").alias("vendor_id"), F.col("buy.price_minor").alias("price_minor"))
    return slots.join(buy, "part_id").select("build_id", "slot", "part_id", "vendor_id", "price_minor")


def vendor_groups(items: DataFrame, vendors: DataFrame) -> DataFrame:
    """(build_id, vendor_id, n_items, subtotal_minor, shipping_minor)."""
    groups = items.groupBy("build_id", "vendor_id").agg(F.count("*").alias("n_items"), F.sum("price_minor").alias("subtotal_minor"))
    return groups.join(vendors.select("vendor_id", F.col("shipping_flat_minor").alias("shipping_minor")), "vendor_id").select("build_id", "vendor_id", "n_items", "subtotal_minor", "shipping_minor")


def totals(groups: DataFrame) -> DataFrame:
    total = groups.groupBy("build_id").agg(F.sum("subtotal_minor").alias("parts_minor"), F.sum("shipping_minor").alias("shipping_minor"), F.count("*").alias("n_vendors"))
    return total.withColumn("total_minor", F.col("parts_minor") + F.col("shipping_minor"))


def savings(items: DataFrame, groups: DataFrame, listings: DataFrame) -> DataFrame:
    """(build_id, source, target, extra_minor, net_minor).

    A vendor's order can go to another vendor of the build that has all its items in
    stock, if the shipping saved exceeds the higher prices.  Of several such
    targets the one of the largest subtotal is named.  Relational division: items
    are counted, no set of items is gathered.
    """
    targets = groups.select("build_id", F.col("vendor_id").alias("target"), F.col("subtotal_minor").alias("target_subtotal"))
    there = listings.where("in_stock").select("part_id", F.col("vendor_id").alias("target"), F.col("price_minor").alias("target_price"))
    moved = items.join(targets, "build_id").where("target <> vendor_id").join(there, ["part_id", "target"])
    sums = moved.groupBy("build_id", F.col("vendor_id").alias("source"), "target", "target_subtotal").agg(F.count("*").alias("n"), F.sum(F.col("target_price") - F.col("price_minor")).alias("extra_minor"))
    own = groups.select("build_id", F.col("vendor_id").alias("source"), "n_items", "shipping_minor")
    good = sums.join(own, ["build_id", "source"]).where("n = n_items").withColumn("net_minor", F.col("shipping_minor") - F.col("extra_minor")).where("net_minor > 0")
    turn = F.row_number().over(W.partitionBy("build_id", "source").orderBy(F.desc("target_subtotal"), "target"))
    return good.withColumn("turn", turn).where("turn = 1").select("build_id", "source", "target", "extra_minor", "net_minor")
