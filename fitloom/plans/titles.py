"""Listing texts that stand on the driver's tables: each part's title, tags, link and page are put together by rule.

The texts below are read by Spark and by the tests' SQL engine alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.plans import mapping

#: Endings of titles, among which every entry of the vocabularies occurs.
ENDINGS = [
    "Onyx Black Sunburst Dial", "Snow White Enamel Dial - No Date", "Ivory Matte Dial with Date", "Navy Blue Textured Dial Day-Date", "Olive Green Wave Dial (no lume)", "Gun Metal Grey Sandblasted Case 42.5mm", "Bronze Polished Case 37 mm case", "Burgundy Glossy Dial 28.5mm dial",
    "Amber Brushed Bezel Insert 38mm", "Mustard Yellow Ceramic Insert Flat", "Rose Gold Sword Hands BGW9", "Gilt Dauphine Hands", "Rhodium Syringe Hands C3 lume", "Mother of Pearl Roman Dial", "Vintage Patina Arabic Numeral Dial", "Sterile No Logo California Dial", "Pencil Hands Luminous",
    "Broad Arrow Hands 24 hour GMT hand", "Snowflake Facet Hands", "Mercedes Hands with cap", "Skeleton Baton Hands", "Cathedral Hands Aged", "Super Luminova Plongeur Hands", "Count Up Dive Timer Insert Slope", "GMT Dual Time Worldtime Insert", "Pepsi Blue/Red Two-Tone Insert", "Root Beer Coke Batman insert for bezel",
    "Smooth Fluted Yacht Bezel SKX007", "Aluminium Insert SRPD for flat crystals", "Retro Heritage Dress Dial", "Military Field Tool Dial nh34", "Flieger Pilot Aviator Dial chrono", "Onion Crown SSK/SRPD", "Bolt Crown SKX013", "Coin Edge Crown 4 o'clock crown", "Knurled Chunky Crown turtle", "Double Dome Sapphire Crystal 31.5mm",
    "Domed Glass Crystal SRPE", "Sloped Chapter Ring SKX007/SKX013", "Brushed Chapter Ring rehaut SRPE", "NATO Zulu Strap 22mm strap", "Beads of Rice President bracelet SKX007", "Super-Engineer Oyster Bracelet lug width: 20mm", "Milanese Mesh band 20 mm band", "FKM Rubber Waffle Strap for SKX007", "Seiko (TMI) NH35A Automatic Movement with date",
    "Seiko (TMI) NH36 Movement (3.8 o'clock crown case)", "NH34 GMT Movement @ 4H Crown", "VK63 Chrono Movement", "NH72 Skeleton Movement NH70", "NH Movement Rotor Cotes de Geneve", "Day Wheel Disc White", "Slim Case Back Sterile", "Case - Sub - Polished Steel (With Case Back)", "Case Bundle w Coil Bezel", "Miyota Hands set", "Orient Mako Bezel",
    "Bergeon Tweezers", "DIY Watchmaking Kit", "Crown Gasket", "SSK023 Case", "SNXS Crystal", "Sumo Case", "MM300 Insert", "Samurai Ceramic Insert", "Sea Urchin Crown", "62MAS Case crown at 3.8", "Feetless Dial no dial feet NH35", "Dial with feet at 3 NH36 / VK64", "Steel Bezel Insert Carbon", "Case for 28.5mm Dial", "seconds hand", "Hands + gmt hand set",
    "Alpinist Marinemaster Tuna", "Rolex Omega Tudor, Submariner", "Explorer Daytona Datejust", "GMT-Master Yacht-Master Sea-Dweller", "gmt master yacht master sea dweller", "Milgauss Hulk Kermit", "Black Bay Pelagos Speedmaster", "Seamaster Planet Ocean Railmaster", "Nautilus Aquanaut Royal Oak", "Fifty Fathoms Luminor Radiomir", "Monster Willard",
    "Captain Willard Spork Shogun", "Cocktail Time Milspec Divemaster", "Worldtimer Vantage B. Wayne", "plain",
]


def choice(key: str, values: list[str]) -> str:
    """SQL for the value at key modulo their number."""
    return f"CASE ({key}) % {len(values)} " + " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values)) + " END"


CATEGORIES = ["movement", "case", "dial", "hands", "bezel_insert", "crystal", "chapter_ring", "crown", "bezel", "strap"]

TITLE_SQL = f"""
SELECT part_id, category, concat(CASE j % 6 WHEN 0 THEN 'Namoki ' WHEN 1 THEN 'DLW ' WHEN 2 THEN 'Watch & Style ' WHEN 3 THEN 'Lucius Atelier ' WHEN 4 THEN 'CI1707 ' ELSE '' END, e) AS title, e AS ending,
  concat(p_name, CASE j % 4 WHEN 0 THEN ', lumed' WHEN 1 THEN ', Black Date Wheel' WHEN 2 THEN ', c3' ELSE '' END) AS tags,
  CASE j % 9 WHEN 0 THEN concat('https://www.Shop', j % 7, '.com/products/Item-', part_id, '?variant=1') WHEN 1 THEN concat('Shop', j % 7, '.com/collections/all/products/item-', part_id, '#top') WHEN 2 THEN concat('https://www.ebay.co.uk/itm/some-title/', 100000000 + part_id)
    WHEN 3 THEN concat('https://de.aliexpress.com/item/', 1000000 + part_id, '.html?spm=1') WHEN 4 THEN concat('https://u:p@ebay.com/itm/', 100000000 + part_id) WHEN 5 THEN concat('http://m.ebay.com.au/b/', part_id) WHEN 6 THEN concat('ftp://ebay.com/itm/', 100000000 + part_id) WHEN 7 THEN concat('https://aliexpress.us/store/', part_id) ELSE 'https://a.aliexpress.com/_x' END AS url,
  CASE WHEN j % 5 = 0 THEN 'low' WHEN j % 5 < 3 THEN 'medium' ELSE 'high' END AS confidence, CASE j % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS review_state, j
FROM (SELECT p_partkey AS part_id, p_name, CAST(floor(p_partkey / 10) AS BIGINT) AS j, {choice('p_partkey', CATEGORIES)} AS category, {choice('CAST(floor(p_partkey / 10) AS BIGINT) * 7 + p_partkey % 10', ENDINGS)} AS e FROM part) t"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the text above; a generator of one row keeps its long expressions from being copied into each that reads them."""
    return mapping.view(spark, sf_dir, TITLE_SQL).select(F.inline(F.array(F.struct("*"))))
