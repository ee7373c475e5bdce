"""Registered queries of strap picks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.operators import evaluate, straps
from fitloom.plans import mapping, oracle
from fitloom.plans.titles import choice
from fitloom.queries import query

# A curated list is a vendor's, with a build for each year that it shipped in: of case, movement and hands the first part by key
# (with all slots filled no build would pass the rules).
_LINES = f"SELECT DISTINCT l_suppkey AS collection, CAST(year(CAST(l_shipdate AS DATE)) AS BIGINT) AS position, l_partkey AS part_id FROM lineitem"
LOOK_SLOT_SQL = f"SELECT collection * 10000 + position AS build_id, collection, position, slot, min(c.part_id) AS part_id FROM ({_LINES}) l JOIN ({mapping.CATALOG_SQL}) c ON c.part_id = l.part_id WHERE slot IN ('case', 'movement', 'hands') GROUP BY collection, position, slot"
SLUGS = ["white-dial-dress", "night-dive", "field-watch", "gmt-traveller", "plain", "utility-seven", "skin-diver", "vintage-diver", "everyday"]
TAGS = ["", "green", "blue,dive-bezel", "dressy", "dressy,tool-watch", "pilot", "red", "cream,black", "vintage", "orange,sporty", "grey"]
CASES = ["SKX013 Case Black", "Turtle Case Polished", "SRP Case PVD", "SKX007 Case Steel", "Plain Case", "DLC Diver Case"]
NAMES = ["Pebbled Leather Strap", "Tropic Rubber Strap SKX007", "FKM Waffle Strap for SKX013", "Shell Cordovan Strap", "Steel Link Bracelet SKX007", "Turtle Steel Bracelet", "Ballistic NATO", "Canvas Band", "Silicone Strap Turtle", "Mesh", "SKX013 Solid Link Bracelet", "Suede Band"]
STRAP_TAGS = ["", "black", "brown", "silver-tone", "green,black", "blue", "red,black", "cream", "orange"]
KINDS = ["strap-band", "strap-nato", "strap-oyster", "strap-jubilee", "strap-bracelet", "strap-mesh"]
#: What the parts of looks and the straps are called; j is the part's number within its slot.
TOLD_SQL = f"SELECT part_id, slot, {choice('j * 3 + part_id % 10', TAGS)} AS tags, CASE WHEN slot = 'case' THEN {choice('j', CASES)} END AS case_name, {choice('j', NAMES)} AS strap_name, {choice('j * 5 + size', KINDS)} AS kind, {choice('j + size', STRAP_TAGS)} AS strap_tags FROM ({mapping.CATALOG_SQL}) c"
SLUG_SQL = choice("collection * 7 + position", SLUGS)


def look_slots(spark: SparkSession, sf_dir: str, catalog: DataFrame) -> DataFrame:
    """Rows of LOOK_SLOT_SQL; the least part of a slot needs no distinct lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    told = lines.select(F.col("l_suppkey").alias("collection"), F.year(F.col("l_shipdate").cast("date")).cast("long").alias("position"), F.col("l_partkey").alias("part_id"))
    parts = catalog.where("slot IN ('case', 'movement', 'hands')").select("part_id", "slot")
    least = told.join(parts, "part_id").groupBy("collection", "position", "slot").agg(F.min("part_id").alias("part_id"))
    return least.select((F.col("collection") * 10000 + F.col("position")).alias("build_id"), "collection", "position", "slot", "part_id")


_CASE = "list_has_any(tags, ['{0}'])"
_PAIR = 10_000_000
_HEAD, _FOUND = oracle.findings_sql(
    [k for k in [*oracle.conditions(), "family-exception"]],
    f"SELECT l.build_id * {_PAIR} + s.part_id AS build_id, l.slot, l.part_id FROM ({LOOK_SLOT_SQL}) l JOIN tried s ON s.build_id = l.build_id UNION ALL SELECT build_id * {_PAIR} + part_id, 'strap', part_id FROM tried",
)
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_ASKED = " UNION ALL ".join(f"SELECT '{k}' AS look, unnest({_LIST(v)}) AS kind, unnest(range({len(v)})) AS rank, {len(v)} AS size, '{straps.MATERIAL[k]}' AS material" for k, v in straps.KINDS.items())


@query(rf"""WITH RECURSIVE look_slots AS ({LOOK_SLOT_SQL}), told AS ({TOLD_SQL}),
looks AS (SELECT build_id, collection, position, {SLUG_SQL} AS slug, list_distinct(flatten(list(list_filter(string_split(tags, ','), lambda t: t <> '')))) AS tags, coalesce(max(case_name), '') AS case_name FROM look_slots JOIN told USING (part_id) GROUP BY build_id, collection, position),
typed AS (SELECT *, CASE WHEN slug LIKE '%dress%' THEN 'dress' WHEN slug LIKE '%field%' THEN 'field' WHEN regexp_matches(slug, 'gmt|traveller') THEN 'gmt' WHEN slug LIKE '%utility%' THEN 'utility' WHEN slug LIKE '%skin%' THEN 'skin' WHEN slug LIKE '%vintage%' THEN 'vintage'
  WHEN {_CASE.format('dressy')} AND NOT {_CASE.format('tool-watch')} THEN 'dress' WHEN {_CASE.format('pilot')} THEN 'field' ELSE 'dive' END AS look, regexp_matches(case_name, 'black|pvd|dlc', 'i') AS dark, CASE WHEN case_name ILIKE '%skx013%' THEN 'SKX013' WHEN regexp_matches(case_name, 'turtle|srp', 'i') THEN 'Turtle' ELSE 'SKX007' END AS plat,
  list_filter(tags, lambda t: t IN ('green', 'blue', 'brown', 'orange', 'red', 'cream', 'grey')) AS colours FROM looks),
asked AS ({_ASKED}), strap AS (SELECT part_id, kind, strap_name AS name, list_filter(string_split(strap_tags, ','), lambda t: t <> '') AS st, regexp_matches(strap_name, '\b(leather|cordovan|suede|calf|pebbled|shell)\b', 'i') AS leather, regexp_matches(strap_name, '\b(rubber|fkm|silicone|tropic|waffle)\b', 'i') AS rubber FROM told WHERE slot = 'strap'),
tried AS MATERIALIZED (SELECT t.build_id, s.part_id, s.kind, t.collection, t.position,
  (a.size - a.rank) * 100 + CASE WHEN s.kind <> 'strap-band' THEN 0 ELSE CASE a.material WHEN 'leather' THEN CASE WHEN leather THEN 120 WHEN rubber THEN -40 ELSE 0 END WHEN 'rubber' THEN CASE WHEN rubber THEN 120 WHEN leather THEN 30 ELSE 0 END ELSE CASE WHEN leather OR rubber THEN 60 ELSE 0 END END
    + CASE WHEN t.look = 'vintage' AND name ILIKE '%tropic%' THEN 60 ELSE 0 END END
  + CASE WHEN list_has_any(colours, st) THEN 30 WHEN list_has_any(st, ['black', 'brown']) THEN 14 ELSE 0 END + CASE WHEN dark AND list_contains(st, 'black') THEN 10 ELSE 0 END
  + CASE WHEN s.kind IN ('strap-band', 'strap-nato') THEN 0 WHEN dark THEN CASE WHEN list_contains(st, 'black') THEN 8 ELSE 0 END ELSE CASE WHEN len(st) = 0 OR list_contains(st, 'silver-tone') THEN 14 ELSE 0 END - CASE WHEN list_contains(st, 'black') THEN 30 ELSE 0 END END
  + CASE WHEN contains(lower(name), lower(plat)) THEN 18 ELSE 0 END AS score
  FROM typed t JOIN asked a ON a.look = t.look JOIN strap s ON s.kind = a.kind),
{_HEAD.removeprefix('WITH ')},
refused AS (SELECT DISTINCT build_id FROM ({_FOUND}) f WHERE severity = 'error' OR (severity = 'warning' AND rule_key NOT IN ({_LIST(straps.CATALOG_WIDE)[1:-1]}))),
good AS MATERIALIZED (SELECT * FROM tried WHERE build_id * {_PAIR} + part_id NOT IN (SELECT build_id FROM refused)),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY position) AS i FROM typed),
fold(collection, i, used, kinds, pick) AS (
  SELECT DISTINCT collection, 0::BIGINT, []::BIGINT[], []::VARCHAR[], NULL::STRUCT(s BIGINT, part_id BIGINT, kind VARCHAR) FROM typed
  UNION ALL
  SELECT collection, i, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.part_id) END, CASE WHEN p IS NULL THEN kinds ELSE list_append(kinds, p.kind) END, p FROM (
    SELECT f.collection, n.i, f.used, f.kinds, min({{'s': -(g.score - CASE WHEN list_contains(f.used, g.part_id) THEN 250 ELSE 0 END - 22 * len(list_filter(f.kinds, lambda k: k = g.kind)))::BIGINT, 'part_id': g.part_id::BIGINT, 'kind': g.kind}}) FILTER (WHERE g.part_id IS NOT NULL) AS p
    FROM fold f JOIN numbered n ON n.collection = f.collection AND n.i = f.i + 1 LEFT JOIN good g ON g.build_id = n.build_id GROUP BY f.collection, n.i, f.used, f.kinds) x)
SELECT n.collection, n.position, n.build_id, n.look, f.pick.part_id AS part_id, f.pick.kind AS kind, -f.pick.s AS score FROM fold f JOIN numbered n USING (collection, i)""")
def strap_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strap for each build of each vendor's list, in the order of years, by all rules and with reuse penalties."""
    catalog, listings, exceptions = mapping.catalog(spark, sf_dir), mapping.listings(spark, sf_dir), mapping.exceptions(spark, sf_dir)
    slots, told = look_slots(spark, sf_dir, catalog), mapping.view(spark, sf_dir, TOLD_SQL).select(F.inline(F.array(F.struct("*"))))
    words = lambda c: F.filter(F.split(c, ","), lambda t: t != "")
    builds = (
        slots.join(told.select("part_id", "tags", "case_name"), "part_id").groupBy("build_id", "collection", "position").agg(F.array_distinct(F.flatten(F.collect_set(words("tags")))).alias("tags"), F.max("case_name").alias("case_name"))
        .withColumn("slug", F.expr(SLUG_SQL))
    )
    read = evaluate.fields_read(straps.refusing())
    severities = lambda p: F.sort_array(F.transform(p["own_exceptions"], lambda e: e["severity"])).alias("exceptions")
    own = catalog.where("slot = 'strap'").select(F.col("part_id").alias("build_id"), "slot", "part_id")
    single = evaluate.wide_builds(own, catalog, listings, exceptions, {"strap": read["strap"]}).select(F.col("build_id").alias("part_id"), "p_strap")
    strap = F.col("p_strap")
    single = single.withColumn("fit_class", F.to_json(F.struct(*[strap[c].alias(c) for c in ("family", "lug_width_mm", "vendor_scope", "spec_source")], severities(strap))))
    known = told.where("slot = 'strap'").select("part_id", F.col("strap_name").alias("name"), "kind", words("strap_tags").alias("tags")).join(single.select("part_id", "fit_class"), "part_id")
    samples = single.groupBy("fit_class").agg(F.min_by("p_strap", "part_id").alias("p_strap"))
    base = straps.passing(evaluate.wide_builds(slots.select("build_id", "slot", "part_id"), catalog, listings, exceptions, read))
    # Cases are alike for straps by what the strap's rules read of them; of who sells them, those vendors that some strap keeps to.
    scopes = F.broadcast(single.agg(F.collect_set("p_strap.vendor_scope").alias("scopes")))
    case, sold = F.col("p_case"), F.coalesce(F.col("p_case.vendors"), F.array().cast("array<bigint>"))
    like = F.to_json(F.struct(case.isNotNull().alias("case"), *[case[c].alias(c) for c in ("family", "lug_width_mm", "spec_source")], severities(case), (F.size(sold) > 0).alias("sold"), F.sort_array(F.array_intersect(sold, "scopes")).alias("vendors")))
    alike = base.join(scopes).select("build_id", like.alias("fits_like"))
    return straps.pick_straps(builds.join(alike, "build_id", "left"), known, lambda pairs: straps.fitting(base, samples, pairs))
