"""Registered queries of vendors' feeds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.ingest_queries import _MODEL
from fitloom.operators import vendor_rules
from fitloom.plans.feeds import FEED_SQL, products
from fitloom.queries import query


def _by_model(category: str, suffix: str) -> str:
    return f"CASE WHEN m IS NOT NULL THEN 'T:{category}:' || m || '-{suffix}:H' WHEN s IS NOT NULL THEN 'R:' || s ELSE 'R:no case model' END"


# Words of goods out of scope, as the scope functions take them.
_BRAND = r"""CASE WHEN regexp_matches(x, '\bmiyota\b') THEN 'miyota' WHEN regexp_matches(x, '\borient\b') THEN 'orient' WHEN regexp_matches(x, '\btweezers?\b|\bbergeon\b|\bscrewdriver|\bhand.?press|\bcase.?opener|\bmovement holder') THEN 'tool' WHEN regexp_matches(x, '\bdiy watchmaking kit\b') THEN 'kit' WHEN regexp_matches(x, '\bgasket\b') THEN 'gasket' END"""
_SHAPE = r"""CASE WHEN regexp_matches(x, '\bssk023\b') THEN 'ssk023' WHEN regexp_matches(x, '\bsnxs\b') THEN 'snxs' WHEN regexp_matches(x, '\bsumo\b') THEN 'sumo' WHEN regexp_matches(x, '\bmm300\b') THEN 'mm300' WHEN regexp_matches(x, '\bsamurai\b') THEN 'samurai' WHEN regexp_matches(x, '\burchin\b|\bsnzf\b') THEN 'sea urchin' WHEN regexp_matches(x, '\b62mas\b') THEN '62mas' WHEN regexp_matches(x, '\bmako\b|\bray\b') THEN 'mako or ray' END"""
_SPARE = r"day.?wheel|date.?wheel|\brotor\b|\bbridge\b|corrector|\bwheel\b|washer|\bscrews?\b|\bbarrel\b|mainspring|\bc clip\b|\bsnap\b|\bspacer\b|\bpinion\b|\bgasket\b|movement stem|\bstem\b|holding spacer"

#: T: tagged category, family, trust and attribute; R: rejected and why; U: unmatched; D: nothing said.
_VERDICTS = rf"""
WITH f AS ({FEED_SQL}), l AS (SELECT *, lower(product_type) AS pt, lower(title) AS ti, lower(tags) AS tg, lower(title || ' ' || product_type || ' ' || tags) AS x FROM f),
w AS (SELECT *, {_MODEL.format('x')} AS m, {_BRAND} AS b, coalesce({_BRAND}, {_SHAPE}) AS s, regexp_matches(ti, '{_SPARE}') AS spare, regexp_matches(tg, 'ultra-thin') OR regexp_matches(ti, 'ultra thin') AS thin,
  regexp_matches(tg, 'fits-nh3[456]') AS nh, ti LIKE '%turtle%' AS turtle, regexp_matches(tg, 'skx007|srpd') AS t7 FROM l),
namoki AS (SELECT part_id, CASE
  WHEN pt IN ('tools', 'gift cards') THEN 'R:not a part' WHEN pt = 'modded watches' THEN 'R:whole product' WHEN regexp_matches(pt, '^(skx007|skx013|srpe) cases$') THEN 'T:case:' || split_part(pt, ' ', 1) || '-case:H' WHEN pt = 'vk cases' THEN 'T:case:vk6x-case:H'
  WHEN pt = 'nmk cases' AND ti LIKE '%n4 tool case%' THEN 'T:case:nmk-n4-case:H' WHEN pt = 'srp turtle cases' OR (ti LIKE '%srp turtle%' AND ti LIKE '%case%') THEN 'T:case:srp-turtle-case:H'
  WHEN pt = 'casebacks' THEN 'T:case:' || CASE WHEN ti LIKE '%skx013%' THEN 'skx013' ELSE 'skx007' END || '-case:M' WHEN pt = 'seiko dials' OR (pt = '' AND ti LIKE 'watch dial:%') THEN CASE WHEN regexp_matches(ti, 'spork|556 white') THEN 'T:dial:nh3x-dial-standard:H:hasFeet' ELSE 'T:dial:nh3x-dial-standard:M' END
  WHEN pt = 'seiko vk dials' THEN 'T:dial:vk6x-dial:H' WHEN pt = 'seiko hands' THEN 'T:hands:nh3x-hands-standard:M' WHEN pt = 'seiko vk hands' THEN 'T:hands:vk6x-hands:H'
  WHEN pt IN ('bezel inserts', 'skx013 bezel inserts') THEN CASE WHEN ti LIKE '%skx013%' THEN 'T:bezel_insert:skx013-insert:H' WHEN regexp_matches(ti, 'skx007|srpd') THEN 'T:bezel_insert:skx007-insert:H' ELSE 'D' END
  WHEN pt = 'srp turtle bezel inserts' THEN 'T:bezel_insert:srp-turtle-insert:H' WHEN pt LIKE '%chapter ring%' THEN {_by_model('chapter_ring', 'chapter-ring')}
  WHEN pt LIKE '%sapphire crystal%' THEN CASE WHEN s IS NOT NULL THEN 'R:' || s WHEN m IS NOT NULL THEN 'T:crystal:' || m || '-crystal:H' WHEN pt = 'sapphire crystals' THEN 'T:crystal:skx007-crystal:M' ELSE 'R:no case model' END
  WHEN pt IN ('movement spare parts', 'rotors', 'bridges', 'seiko movements', 'movement accessories') THEN CASE WHEN regexp_matches(ti, 'vk6|mecaquartz') THEN 'T:movement:vk6x-movement:H' WHEN spare AND (ti LIKE '%nh%' OR pt LIKE '%movement%') THEN 'T:movement:nh3x-movement-accessory:H'
    WHEN regexp_matches(ti, 'nh3[4568]|nh ') THEN 'T:movement:nh3x-movement:H' WHEN b IS NOT NULL THEN 'R:' || b ELSE 'R:no caliber' END
  WHEN pt LIKE '%bezels' THEN {_by_model('bezel', 'bezel')} WHEN pt LIKE '%crowns' THEN {_by_model('crown', 'crown')} WHEN pt LIKE '%bracelets' THEN {_by_model('strap', 'bracelet')} WHEN regexp_matches(pt, 'strap|nato') THEN 'T:strap:generic-strap:M'
  WHEN b IS NOT NULL THEN 'R:' || b ELSE 'U' END AS v FROM w WHERE vendor = 'namoki'),
lucius AS (SELECT part_id, CASE
  WHEN pt IN ('watch tools', 'gift card', 'service') THEN 'R:not a part' WHEN pt = 'watches' THEN 'R:whole product' WHEN pt = 'casebacks' THEN 'T:case:skx007-case:M' WHEN pt = 'movements' THEN 'T:movement:nh3x-movement:H' WHEN pt = 'straps' THEN 'T:strap:generic-strap:M'
  WHEN pt = 'cases' AND thin THEN 'T:case:lucius-ultra-thin-case:H' WHEN pt = 'cases' AND tg LIKE '%fits-skx013%' THEN 'T:case:skx013-case:M'
  WHEN pt = 'dials' AND tg LIKE '%gmt - nh34%' THEN 'T:dial:nh34-gmt-dial:H' WHEN pt = 'dials' AND regexp_matches(tg, 'fits-skx013|skx007') THEN 'T:dial:nh3x-dial-standard:M'
  WHEN pt = 'hands' AND tg LIKE '%gmt%' AND tg LIKE '%nh34%' THEN 'T:hands:nh3x-hands-standard:H:gmt' WHEN pt = 'hands' AND nh THEN 'T:hands:nh3x-hands-standard:H' WHEN pt IN ('rotors', 'bridges') AND nh THEN 'T:movement:nh3x-movement-accessory:H'
  WHEN pt = 'bezel inserts' AND thin THEN 'T:bezel_insert:skx013-insert:G' WHEN pt = 'chapter rings' AND thin THEN 'T:chapter_ring:lucius-ultra-thin-chapter-ring:M' WHEN pt = 'bezels' AND thin THEN 'T:bezel:skx013-bezel:G' WHEN pt = 'bracelets' AND thin THEN 'R:other maker''s case'
  WHEN pt IN ('bezel inserts', 'crystals', 'chapter rings') AND tg LIKE '%fits-skx013%' AND NOT thin THEN 'T:' || replace(rtrim(pt, 's'), ' ', '_') || ':skx013-' || replace(regexp_replace(rtrim(pt, 's'), '^bezel ', ''), ' ', '-') || ':H'
  WHEN pt IN ('bezel inserts', 'crystals', 'chapter rings') AND tg LIKE '%skx007%' THEN 'T:' || replace(rtrim(pt, 's'), ' ', '_') || ':skx007-' || replace(regexp_replace(rtrim(pt, 's'), '^bezel ', ''), ' ', '-') || ':H'
  WHEN pt IN ('bezels', 'crowns', 'bracelets') AND (tg LIKE '%fits-skx013%' OR m IS NOT NULL) THEN 'T:' || CASE pt WHEN 'bracelets' THEN 'strap' ELSE rtrim(pt, 's') END || ':' || CASE WHEN tg LIKE '%fits-skx013%' THEN 'skx013' ELSE m END || '-' || rtrim(pt, 's') || ':H'
  WHEN pt = 'bracelets' AND regexp_matches(ti, '^(oyster|settimo|president|jubilee|gs|super engineer|beads of rice|milanese) bracelet \d+/\d+mm') THEN 'T:strap:skx013-bracelet:S'
  WHEN pt IN ('cases', 'bezel inserts', 'crystals', 'chapter rings', 'bezels', 'crowns', 'bracelets') AND s IS NOT NULL THEN 'R:' || s WHEN b IS NOT NULL THEN 'R:' || b WHEN pt IN ('rotors', 'bridges') THEN 'D' ELSE 'U' END AS v FROM w WHERE vendor = 'lucius'),
dlw AS (SELECT part_id, CASE
  WHEN pt = 'watch tools' THEN 'R:not a part' WHEN pt = 'cases' THEN CASE WHEN tg LIKE '%srpe%' THEN 'T:case:srpe-case:H' WHEN t7 THEN 'T:case:skx007-case:H' WHEN s IS NOT NULL THEN 'R:' || s ELSE 'U' END
  WHEN ti LIKE '%movement%' AND regexp_matches(ti, 'nh3[456]') THEN 'T:movement:nh3x-movement:H' WHEN pt IN ('dials', 'hands') THEN CASE WHEN b IS NOT NULL THEN 'R:' || b WHEN pt = 'dials' THEN 'T:dial:nh3x-dial-standard:M' ELSE 'T:hands:nh3x-hands-standard:M' END
  WHEN pt = 'ceramic bezel inserts' OR regexp_matches(ti, '^(ceramic|sapphire|steel) insert') THEN CASE WHEN turtle OR tg LIKE '%srp turtle%' THEN 'T:bezel_insert:srp-turtle-insert:H' WHEN t7 THEN 'T:bezel_insert:skx007-insert:H' WHEN s IS NOT NULL THEN 'R:' || s ELSE 'U' END
  WHEN pt = 'crystals' THEN CASE WHEN tg LIKE '%srpe%' THEN 'T:crystal:srpe-crystal:H' WHEN turtle OR tg LIKE '%srp turtle%' THEN 'T:crystal:srp-turtle-crystal:H' WHEN tg LIKE '%skx013%' THEN 'T:crystal:skx013-crystal:H' WHEN t7 THEN 'T:crystal:skx007-crystal:H' WHEN s IS NOT NULL THEN 'R:' || s ELSE 'R:no case model' END
  WHEN pt = 'chapter rings' THEN CASE WHEN tg LIKE '%srpe%' THEN 'T:chapter_ring:srpe-chapter-ring:H' WHEN turtle THEN 'T:chapter_ring:srp-turtle-chapter-ring:H' WHEN t7 THEN 'T:chapter_ring:skx007-chapter-ring:H' WHEN tg LIKE '%skx013%' THEN 'T:chapter_ring:skx013-chapter-ring:H' WHEN s IS NOT NULL THEN 'R:' || s ELSE 'R:no case model' END
  WHEN pt = 'bezels' THEN {_by_model('bezel', 'bezel')} WHEN pt = 'crowns' THEN {_by_model('crown', 'crown')} WHEN pt = 'straps' THEN coalesce('T:strap:' || m || '-bracelet:M', 'T:strap:generic-strap:M')
  WHEN ti LIKE 'yard sale%' THEN 'R:design left open' WHEN ti = 'springbar tool' THEN 'R:not a part' WHEN ti LIKE '7s26 movement%' THEN 'R:other movement line'
  WHEN regexp_matches(ti, '^(dial|hands) - handcrafted series') THEN CASE WHEN b IS NOT NULL THEN 'R:' || b WHEN ti LIKE 'dial%' THEN 'T:dial:nh3x-dial-standard:M' ELSE 'T:hands:nh3x-hands-standard:M' END
  WHEN ti LIKE 'chapter ring%handcrafted series%' THEN CASE WHEN regexp_matches(ti, 'skx007|srpd') THEN 'T:chapter_ring:skx007-chapter-ring:H' WHEN s IS NOT NULL THEN 'R:' || s ELSE 'R:no case model' END
  WHEN b IS NOT NULL THEN 'R:' || b ELSE 'U' END AS v FROM w WHERE vendor = 'dlw'),
style AS (SELECT part_id, CASE
  WHEN regexp_matches(ti, 'snxs|ssk023') AND s IS NOT NULL THEN 'R:' || s WHEN pt = 'case back' THEN CASE WHEN regexp_matches(ti, 'service|engraving') THEN 'R:a service' WHEN ti LIKE '%skx007%' THEN 'T:case:skx007-case:H' WHEN s IS NOT NULL THEN 'R:' || s ELSE 'R:no case model' END
  WHEN pt = 'tools' THEN 'R:not a part' WHEN ti LIKE '%alpinist%' AND pt LIKE '%case%' THEN 'T:case:alpinist-style-case:H' WHEN pt LIKE '%skx007/srpd%' AND pt LIKE '%case%' THEN 'T:case:skx007-case:H' WHEN ti LIKE '%skx013%' AND pt LIKE '%case%' THEN 'T:case:skx013-case:H'
  WHEN pt LIKE '%srpe%' AND pt LIKE '%case%' THEN 'T:case:srpe-case:H' WHEN pt LIKE '%replacement case%' THEN 'R:' || coalesce(s, 'no case model') WHEN pt IN ('dial', 'hands') THEN CASE WHEN b IS NOT NULL THEN 'R:' || b WHEN pt = 'dial' THEN 'T:dial:nh3x-dial-standard:W' ELSE 'T:hands:nh3x-hands-standard:W' END
  WHEN pt LIKE '%insert%' AND pt NOT LIKE '%gasket%' THEN {_by_model('bezel_insert', 'insert')} WHEN pt LIKE '%snzf%' AND pt LIKE '%chapter ring%' THEN coalesce('R:' || s, 'D') WHEN pt LIKE '%skx013%chapter ring%' THEN 'T:chapter_ring:skx013-chapter-ring:H'
  WHEN pt LIKE '%skx007/srpd%chapter ring%' THEN CASE WHEN ti LIKE '%ssk%' THEN 'T:chapter_ring:ssk-gmt-chapter-ring:M' ELSE 'T:chapter_ring:skx007-chapter-ring:H' END WHEN pt LIKE '%srpe%chapter ring%' THEN 'T:chapter_ring:srpe-chapter-ring:H'
  WHEN pt LIKE '%sapphire crystal%' OR ti LIKE '%srp turtle%' THEN CASE WHEN ti LIKE '%srp turtle%' OR (turtle AND pt LIKE '%sapphire%') THEN 'T:crystal:srp-turtle-crystal:H' ELSE {_by_model('crystal', 'crystal')} END
  WHEN pt LIKE '%nh movement%' OR pt = 'daywheel' THEN CASE WHEN b IS NOT NULL THEN 'R:' || b WHEN spare OR pt = 'daywheel' THEN 'T:movement:nh3x-movement-accessory:H' ELSE 'T:movement:nh3x-movement:H' END
  WHEN pt LIKE '%bezel%' AND NOT regexp_matches(pt, 'insert|gasket') THEN {_by_model('bezel', 'bezel')} WHEN pt LIKE '%crown%' THEN {_by_model('crown', 'crown')} WHEN pt LIKE '%bracelet%' THEN {_by_model('strap', 'bracelet')} WHEN regexp_matches(pt, 'strap|nato|rubber') THEN 'T:strap:generic-strap:M'
  WHEN b IS NOT NULL THEN 'R:' || b ELSE 'U' END AS v FROM w WHERE vendor = 'watchandstyle'),
judged AS (SELECT f.*, CASE WHEN v LIKE 'T:case:%' AND regexp_matches(title, 'case ?back', 'i') AND NOT regexp_matches(title, 'with case ?back', 'i') THEN 'R:caseback' ELSE v END AS v FROM (FROM namoki UNION ALL FROM lucius UNION ALL FROM dlw UNION ALL FROM style) u JOIN f USING (part_id))"""


@query(rf"""{_VERDICTS} SELECT part_id, vendor, CASE v[1] WHEN 'T' THEN 'tagged' WHEN 'R' THEN 'rejected' WHEN 'U' THEN 'unmatched' END AS outcome, CASE WHEN v[1] = 'T' THEN split_part(v, ':', 2) END AS category, CASE WHEN v[1] = 'T' THEN split_part(v, ':', 3) END AS family,
 CASE split_part(v, ':', 4) WHEN 'H' THEN 'high' WHEN 'M' THEN 'medium' WHEN 'S' THEN 'medium' WHEN 'G' THEN 'low' WHEN 'W' THEN 'low' END AS confidence, CASE split_part(v, ':', 4) WHEN 'H' THEN 'vendor-stated' WHEN 'S' THEN 'vendor-stated' WHEN 'M' THEN 'family-inferred' WHEN 'W' THEN 'family-inferred' WHEN 'G' THEN 'manual' END AS spec_source,
 CASE WHEN v[1] = 'R' THEN substr(v, 3) END AS reason, nullif(split_part(v, ':', 5), '') AS attributes FROM judged""")
def vendor_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product of the four vendors' feeds: tagged with its family, rejected with a reason, or unmatched."""
    return vendor_rules.classify(products(spark, sf_dir)).select("part_id", "vendor", "outcome", "category", "family", "confidence", "spec_source", "reason", "attributes")


@query(rf"{_VERDICTS} SELECT vendor, product_type, count(*) AS n, min(part_id) AS example FROM judged WHERE v = 'U' GROUP BY ALL")
def vendor_unmatched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that no rule decides, with one example of each."""
    return vendor_rules.classify(products(spark, sf_dir)).where("outcome = 'unmatched'").groupBy("vendor", "product_type").agg(F.count("*").alias("n"), F.min("part_id").alias("example"))
