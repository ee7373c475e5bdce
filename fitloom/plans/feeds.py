"""Vendors' feeds that stand on the table of parts: each part is one product of one vendor.

Types, titles and tags are dealt by the part's key, so that each vendor's types
meet titles and tags of every kind.  The text is read by Spark and by the tests' SQL engine alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.plans import mapping
from fitloom.plans.titles import ENDINGS, choice

VENDORS = ["namoki", "lucius", "dlw", "watchandstyle"]
#: Types of each vendor's products, one among them that no rule names.
TYPES = {
    "namoki": ["Tools", "Gift Cards", "Modded Watches", "SKX007 Cases", "SKX013 Cases", "SRPE Cases", "VK Cases", "NMK Cases", "SRP Turtle Cases", "Casebacks", "Seiko Dials", "", "Seiko VK Dials", "Seiko Hands", "Seiko VK Hands", "Bezel Inserts", "SKX013 Bezel Inserts", "SRP Turtle Bezel Inserts",
               "Chapter Rings", "SRPE Chapter Rings", "Sapphire Crystals", "SKX013 Sapphire Crystals", "Movement Spare Parts", "Rotors", "Seiko Movements", "Movement Accessories", "Bezels", "SSK Crowns", "SKX007 Bracelets", "Bracelets", "Rubber Straps", "NATO", "Boxes"],
    "lucius": ["Watch Tools", "Gift Card", "Service", "Watches", "Cases", "Casebacks", "Dials", "Hands", "Bezel Inserts", "Crystals", "Chapter Rings", "Movements", "Rotors", "Bridges", "Bezels", "Crowns", "Bracelets", "Straps", "Boxes"],
    "dlw": ["Watch Tools", "Cases", "Dials", "Hands", "Ceramic Bezel Inserts", "Crystals", "Chapter Rings", "Bezels", "Crowns", "Straps", "", "", "Boxes"],
    "watchandstyle": ["Case Back", "Tools", "40mm Replacement Case", "SKX007/SRPD Replacement Case", "SRPE Case", "Dial", "Hands", "SKX007/SRPD Ceramic Insert", "Aluminum Insert", "Insert Gasket", "SNZF Chapter Ring", "SKX013 Chapter Ring", "SKX007/SRPD Chapter Ring", "SRPE Chapter Ring", "Sapphire Crystal",
                      "NH Movement", "NH Movement Rotor", "Daywheel", "SKX007/SRPD Bezel", "Crown", "Bracelet", "FKM Rubber", "NATO Strap", "Boxes"],
}
TAGS = ["", "Fits-SKX013", "SKX007 & SRPD (Slope)", "SRPE", "SRP Turtle,Sale", "GMT - NH34", "fits-nh35,fits-nh36", "Ultra-Thin", "Ultra-Thin,fits-SKX013", "SKX013", "Sale,New", "GMT,fits-nh34"]
#: Titles beside those of the listings.
TITLES = [
    *ENDINGS, "N4 Tool Case 40mm", "SRP Turtle Case Polished", "Watch Dial: 556 White", "Watch Dial: Spork", "Yard Sale - Dial (Random Design)", "Springbar Tool", "7S26 Movement", "Dial - Handcrafted Series Miyota", "Dial - Handcrafted Series Wave", "Hands - Handcrafted Series", "Chapter Ring - SKX007 Handcrafted Series",
    "Chapter Ring - Handcrafted Series", "Ceramic Insert Turtle", "Sapphire Insert - Sumo", "Steel Insert Diver", "Alpinist Style Case", "Laser Engraving Service", "SKX007 Display Caseback", "SSK GMT Ring", "SRP Turtle Crystal Double Dome", "Oyster Bracelet 20/16mm", "Jubilee Bracelet 22/18mm", "Mecaquartz VK63", "Ultra Thin Case",
    "SKX013 Submariner", "NH Stem and Corrector Wheel", "Explorer Style 36mm", "SNXS Replacement", "Installing a Rotor",
]


def _types(key: str) -> str:
    return "CASE v " + " ".join(f"WHEN '{v}' THEN {choice(key, TYPES[v])}" for v in VENDORS) + " END"


FEED_SQL = f"""
SELECT part_id, v AS vendor, {choice('CAST(floor(part_id / 4) AS BIGINT) * 5 + CAST(floor(part_id / 28) AS BIGINT)', TITLES)} AS title, {_types('CAST(floor(part_id / 4) AS BIGINT)')} AS product_type, {choice('CAST(floor(part_id / 4) AS BIGINT) * 7 + CAST(floor(part_id / 52) AS BIGINT)', TAGS)} AS tags
FROM (SELECT p_partkey AS part_id, {choice('p_partkey', VENDORS)} AS v FROM part) t"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part_id, vendor, title, product_type, tags)."""
    return mapping.view(spark, sf_dir, FEED_SQL).select(F.inline(F.array(F.struct("*"))))
