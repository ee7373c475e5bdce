"""Checks of a catalog, each a DataFrame of the rows that fail it, and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Believable prices in minor units by slot.
PRICE_RANGE = {"movement": (2_000, 20_000), "case": (1_000, 60_000), "dial": (500, 20_000), "hands": (200, 10_000), "strap": (300, 20_000)}

#: Words in a name that speak for a family other than the one it is filed under.
MARKERS = (("small", "skx007"), ("large", "skx013"), ("red", "srpe"), ("old", "ssk-gmt"))


# Words in a name, the families that they speak for, and whether only parts that follow a case are meant.
NAME_MARKERS = ((r"(?i)skx007|srpd", "skx007-", True), (r"(?i)skx013", "skx013-", True), (r"(?i)\bnh35\b", "nh3x-", False), (r"(?i)\bnh36\b", "nh3x-", False))


def name_family_conflict(name: Column, family: Column, category: Column) -> Column:
    """The families that a part's name speaks for while it stands in another; null where they agree."""
    shaped = category.isin("case", "crown", "bezel", "bezel_insert", "strap", "crystal", "chapter_ring")
    return F.coalesce(*[F.when((shaped if of_case else F.lit(True)) & name.rlike(p) & ~family.startswith(prefix), F.lit(prefix)) for p, prefix, of_case in NAME_MARKERS])


def unknown_family(parts: DataFrame, families: DataFrame) -> DataFrame:
    return parts.join(families, "family", "left_anti")


def empty_attributes(parts: DataFrame, fields: list[str]) -> DataFrame:
    """Parts that state none of the fields."""
    return parts.where(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNull())


def unlisted(parts: DataFrame, listings: DataFrame) -> DataFrame:
    return parts.join(listings, "part_id", "left_anti")


def name_conflicts(parts: DataFrame) -> DataFrame:
    """Parts whose name speaks for another platform than theirs; the first marker that does is named."""
    said = F.coalesce(*[F.when(F.lower("name").contains(word) & (F.col("platform") != p) & (F.col("platform") != ""), F.lit(p)) for word, p in MARKERS])
    return parts.withColumn("says", said).where("says is not null")


def wrong_currency(listings: DataFrame, vendors: DataFrame) -> DataFrame:
    return listings.join(vendors.select("vendor_id", F.col("currency").alias("expected")), "vendor_id").where("currency <> expected")


def missing_rate(listings: DataFrame, vendors: DataFrame) -> DataFrame:
    return listings.join(vendors.where("fx_rate is not null"), "vendor_id", "left_anti")


def odd_prices(listings: DataFrame, parts: DataFrame) -> DataFrame:
    """Listings priced at nothing, or outside the range of their slot."""
    priced = listings.join(parts.select("part_id", "slot"), "part_id")
    outside = F.lit(False)
    for slot, (low, high) in PRICE_RANGE.items():
        outside = outside | ((F.col("slot") == slot) & ~F.col("price_minor").between(low, high))
    return priced.withColumn("problem", F.when(F.col("price_minor") <= 0, "not positive").when(outside, "out of range")).where("problem is not null")


def merge_conflicts(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, n_values): fields for which merged rows state different values; nulls don't count."""
    stacked = rows.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("s")).select(key, "s.field", "s.value").where("value is not null")
    return stacked.distinct().groupBy(key, "field").agg(F.count("*").alias("n_values")).where("n_values > 1")


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, failures): a row for each check, whether or not it fails."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
        out = one if out is None else out.unionByName(one)
    return out
