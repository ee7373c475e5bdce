"""Registered query of claims that listings are one part, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.operators import submissions
from fitloom.operators.matching import CLOSE, hash_words
from fitloom.plans import mapping
from fitloom.plans.titles import choice
from fitloom.queries import query

COLOURS = ["black", "black,blue", "", "green"]
_HEX = "concat(md5(concat(p_type, CAST(p_size AS VARCHAR(9)))), md5(concat(CAST(p_size AS VARCHAR(9)), p_type)))"
_CUT = "CASE WHEN p_partkey % 4 = 0 THEN 20 ELSE 4 END"
_RESOLVED = "floor(p_partkey / 10) % 9 <> 4"
_COLOURS = choice("p_size * 7 + CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE 0 END", COLOURS)
_PICTURE = f"CASE WHEN p_partkey % 13 <> 0 THEN concat(substr(md5(CAST(p_partkey AS VARCHAR(19))), 1, {_CUT}), substr({_HEX}, {_CUT} + 1)) END"
_CLAIMS = """SELECT l_orderkey * 2 AS claim, CAST(l_linenumber AS BIGINT) AS position, l_partkey AS k FROM lineitem
  UNION ALL SELECT p_size * 12 + CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 3 WHEN 'PROMO' THEN 5 WHEN 'SMALL' THEN 7 WHEN 'MEDIUM' THEN 9 ELSE 11 END, p_partkey, p_partkey FROM part"""
#: A claim is an order, or all parts of one look; of some parts the link leads nowhere, and some have no picture.
LINK_SQL = f"""SELECT claim, position, CASE WHEN {_RESOLVED} THEN p_partkey END AS part_id, p_type AS category, p_brand AS vendor, {_COLOURS} AS colours,
  {_PICTURE} AS picture
FROM ({_CLAIMS}) l JOIN part ON p_partkey = k"""
#: What a link leads to, a row a part and not a link.
PART_SQL = f"SELECT p_partkey AS part_id, {_RESOLVED} AS resolved, p_type AS category, p_brand AS vendor, {_COLOURS} AS colours, {_PICTURE} AS picture FROM part"
_BITS = " + ".join(f"bit_count(xor(('0x' || substr(x.picture, {8 * i + 1}, 8))::BIGINT, ('0x' || substr(y.picture, {8 * i + 1}, 8))::BIGINT))::INTEGER" for i in range(8))


@query(f"""WITH l AS MATERIALIZED ({LINK_SQL}), p AS MATERIALIZED (SELECT claim, part_id, min(position) AS position, any_value(category) AS category, any_value(vendor) AS vendor, any_value(colours) AS colours, any_value(picture) AS picture FROM l WHERE part_id IS NOT NULL GROUP BY claim, part_id),
n AS (SELECT claim, count(*) AS n_links, count(part_id) AS n_resolved FROM l GROUP BY claim), g AS (SELECT claim, count(*) AS n_parts, count(DISTINCT category) AS n_categories, count(DISTINCT vendor) AS n_vendors FROM p GROUP BY claim),
r AS MATERIALIZED (SELECT n.*, coalesce(n_parts, 0) AS n_parts, CASE WHEN n_resolved = 0 THEN 'nothing resolved' WHEN n_parts < 2 THEN 'one part' WHEN n_categories > 1 THEN 'several categories' WHEN n_vendors < 2 THEN 'one vendor' END AS refused FROM n LEFT JOIN g USING (claim)),
ok AS MATERIALIZED (SELECT p.*, row_number() OVER (PARTITION BY claim ORDER BY position, part_id) AS turn FROM p JOIN r USING (claim) WHERE refused IS NULL),
d AS (SELECT claim, max({_BITS})::BIGINT AS distance FROM ok x JOIN ok y USING (claim) WHERE x.part_id < y.part_id GROUP BY claim),
c AS (SELECT claim, max(CASE WHEN x.colours = '' OR y.colours = '' THEN 1 WHEN x.colours = y.colours THEN 0 ELSE 2 END) AS worst FROM ok x JOIN ok y USING (claim) WHERE x.turn = 1 AND y.turn > 1 GROUP BY claim)
SELECT r.*, distance, ['agree', 'unknown', 'differ'][worst + 1] AS colour, CASE WHEN refused IS NULL THEN CASE WHEN distance <= {CLOSE} THEN 'both' ELSE 'user-link' END END AS source FROM r LEFT JOIN d USING (claim) LEFT JOIN c USING (claim)""")
def match_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by order and by look: the gate that refuses one, the largest distance of its images, and its colours together."""
    links = mapping.view(spark, sf_dir, _CLAIMS).withColumnRenamed("k", "part_id")
    parts = mapping.view(spark, sf_dir, PART_SQL).select(F.inline(F.array(F.struct("*"))))
    parts = parts.withColumn("colours", F.filter(F.split("colours", ","), lambda c: c != "")).withColumn("bits", hash_words(F.col("picture"))).drop("picture")
    return submissions.submit(links, parts)
