"""Attributes of parts filled from their families' constants and from what titles state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fitloom.functions import listing, text

# What a family of cases is known to measure (case, lugs, aperture, crystal in millimetres) and its crown's hour.
CASE_FAMILIES = [
    ("skx007-case", 42.5, 22.0, 28.5, 31.5, "3.8"),
    ("skx013-case", 37.8, 20.0, 28.5, 28.0, None),
    ("srpe-case", 43.8, 22.0, 28.5, None, "3.8"),
    ("alpinist-style-case", 39.5, 20.0, 28.5, None, None),
    ("srp-turtle-case", 44.3, 22.0, 28.5, None, "3.8"),
    ("nmk-n4-case", 40.0, 22.0, None, None, None),
]
# Dial families with feet, diameter in millimetres and subdials.
DIAL_FAMILIES = [
    ("nh3x-dial-standard", True, 28.5, False),
    ("nh34-gmt-dial", True, 28.5, False),
    ("nh3x-dial-feetless", False, 28.5, False),
    ("vk6x-dial", True, None, True),
]
# What a title says of a case.
RING_REQUIRED = r"(?i)ultra thin|\[nh34-ready\]|watch case - 3[689]mm|datejust watch case|gs watch case|gs diver watch case|explorer watch case|seikonaut watch case"
RING_INTEGRATED = r"^NMK9(12|26|3[1678]|39|4[015]|4[89]|5[0235]|58|63)\b"
RING_EXCLUDED = r"^NMK941\b"
BEZEL_INTEGRATED = r"^NMK9(26|3[1678]|52|55|58)\b"
OUTLINES = [("square", r"(?i)\bB&R\b|\bsquare\b"), ("octagonal", r"(?i)nautilus|royal oak"), ("shrouded", r"(?i)\btuna\b"), ("cushion", r"(?i)turtle")]
CROWN_AT_THREE = r"(?i)3 ?o'?clock|\b3H\b"
NO_CROWN_GUARD = r"(?i)no crown guard|\bNCG\b"
ONE_VENDOR = r"(?i)^(oyster|settimo|president|jubilee|gs|super engineer|beads of rice|milanese) bracelet \d+/\d+mm"
STRAP_MM = r"(?i)(\d{2})\s*/\s*\d{2}\s*mm|\b(\d{2})\s*mm\b"
HEIGHT_MM = 5.32


def _true(title: Column, pattern: str) -> Column:
    return F.when(title.rlike(pattern), True)


def backfilled(parts: DataFrame) -> DataFrame:
    """(part_id, then one column an attribute) of parts (part_id, category, family, title); null where nothing is known.

    A title's size comes before its family's; all else is either the title's or the
    family's.  Each attribute belongs to its categories and is null in others.  A row is told by
    its own columns and two tables of constants, which are broadcast.
    """
    spark, title = parts.sparkSession, F.col("title")
    cases = spark.createDataFrame(CASE_FAMILIES, "family string, c_case double, c_lug double, c_aperture double, c_crystal double, c_crown string")
    dials = spark.createDataFrame(DIAL_FAMILIES, "family string, d_feet boolean, d_mm double, d_subdials boolean")
    told = parts.join(F.broadcast(cases), "family", "left").join(F.broadcast(dials), "family", "left")
    only = lambda c, *categories: F.when(F.col("category").isin(*categories), c)
    windows, caliber = text.complication(title), text.caliber(title)
    skeleton = F.coalesce(caliber.startswith("NH7"), F.lit(False))
    strap = F.coalesce(F.nullif(F.regexp_extract(title, STRAP_MM, 1), F.lit("")), F.nullif(F.regexp_extract(title, STRAP_MM, 2), F.lit(""))).cast("double")
    outline = F.coalesce(*[F.when(title.rlike(p), F.lit(name)) for name, p in OUTLINES])
    return told.select(
        "part_id",
        only(F.coalesce(text.first_mm(title), "c_case"), "case").alias("case_mm"), only(F.coalesce(only(F.col("c_lug"), "case"), only(strap, "strap")), "case", "strap").alias("lug_mm"), only(F.col("c_aperture"), "case").alias("aperture_mm"), only(F.col("c_crystal"), "case").alias("crystal_mm"),
        only(_true(title, "(?i)double.?dome"), "case").alias("double_domed"), only(_true(title, RING_REQUIRED), "case").alias("requires_ring"), only(_true(title, RING_INTEGRATED), "case").alias("integrated_ring"), only(_true(title, RING_EXCLUDED), "case").alias("ring_excluded"),
        only(_true(title, BEZEL_INTEGRATED), "case").alias("integrated_bezel"), only(outline, "case").alias("outline"), only(_true(title, CROWN_AT_THREE), "case").alias("crown_at_three"), only(_true(title, NO_CROWN_GUARD), "case").alias("no_crown_guard"),
        only(F.col("d_mm"), "dial").alias("dial_mm"), only(F.col("d_feet"), "dial").alias("has_feet"), only(F.col("d_subdials"), "dial").alias("has_subdials"), only(windows["has_date"], "dial").alias("has_date_window"), only(windows["has_day"], "dial").alias("has_day_window"),
        only(listing.lumed(title, F.lit("")), "dial", "hands").alias("lumed"), only(text.material(title), "bezel_insert", "crystal", "strap", "chapter_ring", "crown", "bezel").alias("material"), only(text.profile(title), "bezel_insert", "crystal", "strap").alias("profile"),
        only(F.when(title.rlike(ONE_VENDOR), "luciusatelier"), "strap").alias("vendor_scope"), only(caliber, "movement").alias("caliber"), only(F.when(~skeleton & caliber.isNotNull(), caliber == "NH36"), "movement").alias("has_day"), only(F.when(~skeleton & caliber.isNotNull(), caliber != "NH38"), "movement").alias("has_date"),
        only(F.when(title.rlike("(?i)date @ 6h"), "6"), "movement").alias("date_position"), only(F.when(~skeleton & caliber.isNotNull(), HEIGHT_MM), "movement").alias("height_mm"),
        F.coalesce(only(F.col("c_crown"), "case"), only(listing.movement_crown(title), "movement")).alias("crown_position"),
    )


def hand_roles(hands: DataFrame, key: str, *ties: str) -> DataFrame:
    """hands (key, length, thickness) with a role: of three or more the most slender is the second hand, the longest of the rest the minute hand, the next the hour hand.

    Equal ones come in the order of `ties`; a hand without thickness has slenderness 0.
    """
    slim = F.when(F.col("thickness") > 0, F.col("length") / F.col("thickness")).otherwise(0.0)
    picture = W.partitionBy(key)
    told = hands.withColumn("_slim", F.row_number().over(picture.orderBy(slim.desc(), *ties))).withColumn("_second", (F.col("_slim") == 1) & (F.count("*").over(picture) >= 3))
    turn = F.row_number().over(picture.orderBy("_second", F.col("length").desc(), *ties))
    return told.withColumn("_turn", turn).withColumn("role", F.when(F.col("_second"), "second").when(F.col("_turn") == 1, "minute").when(F.col("_turn") == 2, "hour").otherwise("extra")).drop("_slim", "_second", "_turn")
