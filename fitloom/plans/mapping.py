"""The catalog that stands on the driver's tables: parts, listings and builds.

A part is a row of `part`, a vendor a `supplier`, a listing the latest
`lineitem` of a part and supplier, and a build an order whose parts each
fill the slot they belong to.  Attributes follow from the part's key by rule, with unknown ones
among them.  The texts below are read by Spark and by the tests' SQL engine alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = ("movement", "case", "dial", "hands", "bezelInsert", "crystal", "chapterRing", "crown", "bezel", "strap")


def _tri(expr: str) -> str:
    """True, false or unknown."""
    return f"CASE ({expr}) % 3 WHEN 0 THEN true WHEN 1 THEN false END"


_PLATFORM = "CASE j % 5 WHEN 0 THEN 'skx007' WHEN 1 THEN 'skx013' WHEN 2 THEN 'srpe' WHEN 3 THEN 'ssk-gmt' ELSE '' END"

CATALOG_SQL = f"""
SELECT *, CASE slot
    WHEN 'movement' THEN CASE j % 3 WHEN 0 THEN 'nh3x-movement' WHEN 1 THEN 'vk6x-movement' ELSE 'nh3x-movement-accessory' END
    WHEN 'dial' THEN 'nh3x-dial' WHEN 'hands' THEN 'nh3x-hands'
    WHEN 'strap' THEN CASE WHEN j % 3 = 0 THEN 'generic-strap' WHEN platform = '' THEN 'loose' ELSE concat(platform, '-bracelet') END
    ELSE CASE WHEN platform = '' THEN 'unknown' ELSE concat(platform, CASE slot WHEN 'case' THEN '-case' WHEN 'bezelInsert' THEN '-insert' WHEN 'crystal' THEN '-crystal' WHEN 'chapterRing' THEN '-chapter-ring' WHEN 'crown' THEN '-crown' ELSE '-bezel' END) END
  END AS family
FROM (
  SELECT p_partkey AS part_id, p_name AS name, p_type AS category, p_brand AS brand, p_size AS size, j,
    CASE p_partkey % 10 WHEN 0 THEN 'movement' WHEN 1 THEN 'case' WHEN 2 THEN 'dial' WHEN 3 THEN 'hands' WHEN 4 THEN 'bezelInsert' WHEN 5 THEN 'crystal' WHEN 6 THEN 'chapterRing' WHEN 7 THEN 'crown' WHEN 8 THEN 'bezel' ELSE 'strap' END AS slot,
    {_PLATFORM} AS platform,
    CASE j % 7 WHEN 0 THEN 'family-inferred' WHEN 1 THEN 'marketplace-stated' WHEN 2 THEN 'user-entered' WHEN 3 THEN 'manual' ELSE 'vendor-stated' END AS spec_source,
    CASE j % 4 WHEN 0 THEN true WHEN 3 THEN NULL ELSE false END AS has_subdials,
    CASE WHEN j % 5 < 3 THEN true WHEN j % 5 = 3 THEN false END AS has_feet,
    CASE WHEN j % 6 = 0 THEN NULL ELSE 26.0e0 + (j % 8) * 0.5e0 END AS diameter_mm,
    CASE WHEN j % 5 = 0 THEN NULL ELSE 26.5e0 + (j % 6) * 0.5e0 END AS aperture_mm,
    CASE j % 5 WHEN 0 THEN 'NH34' WHEN 1 THEN 'NH35' WHEN 2 THEN 'NH72' WHEN 4 THEN 'NH38' END AS caliber,
    {_tri("j")} AS gmt, {_tri("j + 1")} AS double_domed, {_tri("j + p_size")} AS has_date_window, {_tri("j + 1 + p_size")} AS has_date,
    CASE j % 5 WHEN 1 THEN '3' WHEN 2 THEN '3.8,4:30' WHEN 3 THEN 'tilted' WHEN 4 THEN '' END AS date_cuts,
    CASE p_size % 4 WHEN 0 THEN '3' WHEN 1 THEN '6' WHEN 3 THEN '4:30' END AS date_position,
    CASE j % 4 WHEN 0 THEN '3' WHEN 1 THEN '3.8' WHEN 3 THEN 'left' END AS crown_position,
    {_tri("p_size")} AS has_day, {_tri("p_size + 2")} AS has_day_window, {_tri("j + 2")} AS lumed,
    CASE WHEN j % 2 = 0 THEN 12.5e0 END AS length_set_mm,
    CASE j % 3 WHEN 0 THEN 20.0e0 WHEN 1 THEN 22.0e0 END AS lug_width_mm,
    CASE p_size % 4 WHEN 0 THEN 'flat' WHEN 1 THEN 'domed' WHEN 2 THEN 'slope' END AS profile,
    CASE j % 3 WHEN 1 THEN 'skx007-case,srpe-case' WHEN 2 THEN '' END AS excluded_cases,
    {_tri("p_size + 1")} AS requires_ring, {_tri("j + p_size + 1")} AS integrated_ring, {_tri("j + p_size + 2")} AS ring_excluded, {_tri("j + p_size")} AS integrated_bezel,
    CASE WHEN j % 4 = 1 THEN j % 10 + 1 END AS vendor_scope
  FROM (SELECT *, CAST(floor(p_partkey / 10) AS BIGINT) AS j FROM part) p
) c"""

#: Only the columns that some rule reads go into the wide rows.
PART_FIELDS = (
    "part_id name family spec_source has_subdials has_feet diameter_mm aperture_mm caliber gmt double_domed has_date_window has_date date_cuts date_position crown_position "
    "has_day has_day_window lumed length_set_mm lug_width_mm profile excluded_cases requires_ring integrated_ring ring_excluded integrated_bezel vendor_scope"
).split()

LISTING_SQL = """
SELECT part_id, vendor_id, price_minor, in_stock FROM (
  SELECT l_partkey AS part_id, l_suppkey AS vendor_id, CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS price_minor, l_returnflag <> 'R' AS in_stock,
    row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_returnflag DESC) AS turn
  FROM lineitem) x WHERE turn = 1"""

BUILD_SLOT_SQL = f"""
SELECT build_id, slot, min(part_id) AS part_id FROM (
  SELECT DISTINCT l.l_orderkey AS build_id, c.slot, c.part_id FROM lineitem l JOIN ({CATALOG_SQL}) c ON c.part_id = l.l_partkey) x
GROUP BY build_id, slot"""

#: Exceptions: some parts carry one by rule.
EXCEPTION_SQL = """
SELECT p_partkey AS part_id, concat('exception-', p_brand) AS rule_key, CASE p_size % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity
FROM part WHERE p_size % 11 = 0"""

VENDOR_SQL = """
SELECT s_suppkey AS vendor_id, s_name AS vendor, n_name AS country, r_name AS region, CAST(floor(abs(s_acctbal)) AS BIGINT) AS shipping_flat_minor,
  CASE r_name WHEN 'ASIA' THEN 1.7225e0 WHEN 'AMERICA' THEN 1.25e0 WHEN 'EUROPE' THEN 1.0e0 WHEN 'AFRICA' THEN 84.5e0 END AS fx_rate,
  CASE r_name WHEN 'ASIA' THEN 'SGD' WHEN 'AMERICA' THEN 'USD' WHEN 'EUROPE' THEN 'GBP' WHEN 'AFRICA' THEN 'PHP' ELSE 'XXX' END AS currency
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the texts above over the tables of sf_dir; only named tables are opened."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem", "supplier", "nation", "region") if re.search(rf"(FROM|JOIN) {t}\b", sql)}
    return spark.sql(re.sub(rf"(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", sql), **tables)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over all cores by key: a small file that stands for much work would be a single task, and a number is given since small partitions would be merged again."""
    session = rows.sparkSession
    return rows.repartition(max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), key)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CATALOG_SQL)


def listings(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """The latest line of each part and supplier wins; an aggregate, so lines combine before they are shuffled, and price and stock are read off the winner alone.

    own: the parts (part_id) whose listings are wanted, if not all.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if own is not None:
        lines = lines.join(own.select(F.col("part_id").alias("l_partkey")), "l_partkey", "left_semi")
    turn = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")
    won = lines.groupBy(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("vendor_id")).agg(F.max(turn).alias("turn"))
    return won.select("part_id", "vendor_id", F.round(F.col("turn.l_extendedprice") * 100 / F.col("turn.l_quantity")).cast("long").alias("price_minor"), (F.col("turn.l_returnflag") != "R").alias("in_stock"))


def build_slots(spark: SparkSession, sf_dir: str, slots: tuple[str, ...] = SLOTS) -> DataFrame:
    """(build_id, slot, part_id) of the slots: of several parts of one slot the smallest key; a build is one row of its slots while it is shuffled."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("build_id"), F.col("l_partkey").alias("part_id"))
    parts = catalog(spark, sf_dir).where(F.col("slot").isin(*slots)).select("part_id", "slot")
    least = lines.join(parts, "part_id").groupBy("build_id").agg(*[F.min(F.when(F.col("slot") == s, F.col("part_id"))).alias(f"least_{s}") for s in slots])
    return least.select("build_id", F.expr(f"stack({len(slots)}, {', '.join(f"'{s}', least_{s}" for s in slots)}) AS (slot, part_id)")).where("part_id IS NOT NULL")


def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EXCEPTION_SQL)


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, VENDOR_SQL)
