"""Registered queries of listing texts and of the ingest, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitloom.functions import listing, text
from fitloom.plans import mapping
from fitloom.plans.titles import TITLE_SQL, titles
from fitloom.queries import query, table

_T = f"WITH t AS ({TITLE_SQL})"


# ---- what a listing's text states -------------------------------------------------------

_MODEL = "CASE WHEN regexp_matches({0}, '\\bssk\\b') AND NOT contains({0}, 'ssk023') THEN 'ssk-gmt' WHEN contains({0}, 'srpe') THEN 'srpe' WHEN contains({0}, 'skx013') THEN 'skx013' WHEN contains({0}, 'skx007') OR contains({0}, 'srpd') THEN 'skx007' WHEN contains({0}, 'turtle') THEN 'srp-turtle' END"
_SCOPE = r"""CASE WHEN regexp_matches(x, '\bmiyota\b') THEN 'miyota' WHEN regexp_matches(x, '\borient\b') THEN 'orient' WHEN regexp_matches(x, '\btweezers?\b|\bbergeon\b|\bscrewdriver|\bhand.?press|\bcase.?opener|\bmovement holder') THEN 'tool' WHEN contains(x, 'diy watchmaking kit') THEN 'kit' WHEN regexp_matches(x, '\bgasket\b') THEN 'gasket'
 WHEN category IN ('movement', 'dial', 'hands') THEN NULL WHEN regexp_matches(x, '\bssk023\b') THEN 'ssk023' WHEN regexp_matches(x, '\bsnxs\b') THEN 'snxs' WHEN regexp_matches(x, '\bsumo\b') THEN 'sumo' WHEN regexp_matches(x, '\bmm300\b') THEN 'mm300' WHEN regexp_matches(x, '\bsamurai\b') THEN 'samurai'
 WHEN regexp_matches(x, '\burchin\b|\bsnzf\b') THEN 'sea urchin' WHEN regexp_matches(x, '\b62mas\b') THEN '62mas' WHEN regexp_matches(x, '\bmako\b|\bray\b') THEN 'mako or ray' END"""


@query(_T + rf""" SELECT part_id, {_MODEL.format('x')} AS model, regexp_matches(x, 'case ?back') AND NOT regexp_matches(x, 'with case ?back') AS caseback, regexp_matches(x, 'day.?wheel|date.?wheel|\brotor\b|\bbridge\b|corrector|\bwheel\b|washer|\bscrews?\b|\bbarrel\b|mainspring|\bc clip\b|\bsnap\b|\bspacer\b|\bpinion\b|\bgasket\b|movement stem|\bstem\b|holding spacer') AS spare, {_SCOPE} AS scope
FROM (SELECT *, lower(title) AS x FROM t) y""")
def listing_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case model, backs and spare parts, and why a listing is out of scope."""
    low = F.lower("title")
    return titles(spark, sf_dir).select("part_id", listing.case_model(low).alias("model"), listing.is_caseback(F.col("title")).alias("caseback"), listing.is_spare(F.col("title")).alias("spare"), listing.out_of_scope(low, F.col("category")).alias("scope"))


@query(_T + r""" SELECT part_id, CASE WHEN contains(x, 'ceramic') THEN 'ceramic' WHEN contains(x, 'sapphire') THEN 'sapphire' WHEN contains(x, 'aluminium') OR contains(x, 'aluminum') THEN 'aluminum' WHEN contains(x, 'steel bezel insert') OR contains(x, 'steel insert') THEN 'steel' WHEN contains(x, 'carbon') THEN 'carbon' WHEN contains(x, 'glass') THEN 'glass' END AS material,
 CASE WHEN contains(b, 'no lume') THEN false WHEN contains(b, 'lume') OR contains(b, 'bgw9') OR contains(b, 'c3') OR contains(b, 'luminous') THEN true END AS lumed, CASE WHEN regexp_matches(x, 'double.?dome|domed') THEN 'domed' WHEN regexp_matches(x, '\bsloped?\b') THEN 'slope' WHEN regexp_matches(x, '\bflat\b') THEN 'flat' END AS profile,
 nullif(upper(regexp_extract(title, '\b(NH(?:3[4568]|7[012]))(?:A?\b)', 1, 'i')), '') AS caliber, nullif(concat(regexp_extract(title, '\((\d(?:\.\d)?) o''clock crown case\)', 1, 'i'), regexp_extract(title, '@ (\d)H Crown', 1, 'i')), '') AS crown,
 CASE WHEN regexp_matches(x, 'day[\s\-/]?date') THEN true WHEN contains(x, 'no date') THEN false WHEN regexp_matches(x, '\bdate\b') THEN true END AS has_date, CASE WHEN regexp_matches(x, 'day[\s\-/]?date') THEN true WHEN regexp_matches(x, 'no date|\bdate\b') THEN false END AS has_day,
 CAST(nullif(regexp_extract(title, '(?:^|[^\w.])(\d{2}(?:\.\d)?)\s*mm\b', 1, 'i'), '') AS DOUBLE) AS mm FROM (SELECT *, lower(title) AS x, lower(concat(title, ' ', tags)) AS b FROM t) y""")
def listing_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material, lume, profile, caliber, crown, windows and first size of a title."""
    title, windows = F.col("title"), text.complication(F.col("title"))
    return titles(spark, sf_dir).select(
        "part_id", text.material(title).alias("material"), listing.lumed(title, F.col("tags")).alias("lumed"), text.profile(title).alias("profile"), text.caliber(title).alias("caliber"), listing.movement_crown(title).alias("crown"),
        windows["has_date"].alias("has_date"), windows["has_day"].alias("has_day"), text.first_mm(title).alias("mm"),
    )


@query(_T + r""" SELECT part_id, CASE WHEN problem IS NULL THEN CASE WHEN ebay THEN 'ebay' ELSE 'aliexpress' END END AS platform, CASE WHEN problem IS NULL THEN item END AS item_id, problem FROM (SELECT *, CASE WHEN scheme NOT IN ('http', 'https') THEN 'not a web link' WHEN contains(authority, '@') OR regexp_matches(authority, ':\d+$') THEN 'extra parts' WHEN NOT ebay AND NOT ali THEN 'other shop' WHEN item = '' THEN 'not a single listing' END AS problem FROM (
 SELECT *, CASE WHEN ebay THEN regexp_extract(path, '^/itm/(?:[^/]+/)?(\d{9,15})/?$', 1) WHEN ali THEN regexp_extract(path, '^/item/(\d{6,20})\.html$', 1) ELSE '' END AS item FROM (SELECT *, regexp_matches(host, '^(www\.|m\.)?ebay\.(com|co\.uk|de|fr|it|es|nl|be|at|ch|ie|ca|com\.au|pl)$') AS ebay, regexp_matches(host, '^((www|m|de|fr|es|it|nl|pl|pt|ja|ko)\.)?aliexpress\.(com|us)$') AS ali FROM (
 SELECT part_id, lower(regexp_extract(u, '^([a-z]+)://', 1)) AS scheme, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) AS authority, lower(regexp_extract(u, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT part_id, CASE WHEN regexp_matches(url, '^[a-z]+://') THEN url END AS u FROM t) a WHERE u IS NOT NULL) b) c) d) e
 UNION ALL SELECT part_id, NULL, NULL, 'not a link' FROM t WHERE NOT regexp_matches(url, '^[a-z]+://')""")
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marketplace links: platform and item, or why a link is refused."""
    return titles(spark, sf_dir).select("part_id", listing.listing_link(F.col("url")).alias("l")).select("part_id", "l.*")


@query(_T + r""" SELECT part_id, CASE WHEN h <> '' THEN concat(regexp_replace(lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)), '^www\.', ''), '/products/', lower(h)) END AS link FROM (SELECT *, regexp_extract(regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1), '/products/+([^/]+)', 1) AS h FROM (SELECT part_id, CASE WHEN url LIKE 'http%' THEN url ELSE 'https://' || url END AS u FROM t) a) b""")
def product_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to products in one spelling; null for any other link."""
    return titles(spark, sf_dir).select("part_id", text.product_url(F.col("url")).alias("link"))


def _families() -> list[str]:
    """Families that the catalog knows."""
    shaped = [f"{p}-{s}" for p in ("skx007", "skx013", "srpe", "ssk-gmt") for s in ("case", "insert", "crystal", "chapter-ring", "crown", "bezel", "bracelet")]
    return [*shaped, "nh3x-movement", "vk6x-movement", "nh3x-dial-standard", "nh3x-dial-feetless", "vk6x-dial", "nh3x-hands-standard", "vk6x-hands", "generic-strap"]


_FACTS = _T + rf""", a AS (SELECT *, regexp_replace(lower(title), '\s+', ' ', 'g') AS x FROM t),
b AS (SELECT *, list_filter([CASE WHEN regexp_matches(x, '\bbezel insert\b|\binsert\b') THEN 'bezelInsert' END, CASE WHEN regexp_matches(x, '\bchapter ring\b|\brehaut\b') THEN 'chapterRing' END, CASE WHEN NOT regexp_matches(x, '\bbezel insert\b|\binsert\b') AND regexp_matches(replace(x, 'bezel insert', '#'), '\bbezel\b') THEN 'bezel' END,
 CASE WHEN regexp_matches(x, '\bcrystal\b|\bsapphire glass\b') THEN 'crystal' END, CASE WHEN regexp_matches(regexp_replace(regexp_replace(x, '(o''?clock |\dh )crown\b', '#', 'g'), '\bcrown (at|@|position)\b', '#', 'g'), '\bcrown\b') THEN 'crown' END, CASE WHEN regexp_matches(x, '\bhands?\b') THEN 'hands' END, CASE WHEN regexp_matches(x, '\bdial\b') THEN 'dial' END,
 CASE WHEN regexp_matches(x, '\bmovement\b') THEN 'movement' END, CASE WHEN regexp_matches(x, '\bcase\b') THEN 'case' END, CASE WHEN regexp_matches(x, '\bstrap\b|\bbracelet\b|\bband\b') THEN 'strap' END], lambda s: s IS NOT NULL) AS named,
 list_distinct(list_transform(regexp_extract_all(upper(title), '(?:^|[^\w.])(NH(?:3[4568]|7[012])|VK6[34])A?\b', 1), lambda m: m)) AS moves,
 CASE WHEN regexp_matches(x, '\bfeetless\b|\bno (?:dial )?feet\b|\bwithout feet\b') THEN false WHEN regexp_matches(x, '\bwith (?:dial )?feet\b|\bfeet at\b') THEN true END AS has_feet FROM a),
c AS (SELECT *, CASE WHEN len(named) = 1 THEN named[1] END AS slot, list_distinct(list_filter(list_transform(regexp_split_to_array(x, '[\s,/|&+()]+'), lambda w: {_MODEL.format('w')}), lambda m: m IS NOT NULL)) AS models FROM b),
d AS (SELECT * EXCLUDE (category), CASE slot WHEN 'bezelInsert' THEN 'bezel_insert' WHEN 'chapterRing' THEN 'chapter_ring' ELSE slot END AS category FROM c),
e AS (SELECT *, {_SCOPE} AS scope, CASE slot WHEN 'case' THEN 'case' WHEN 'bezelInsert' THEN 'insert' WHEN 'crystal' THEN 'crystal' WHEN 'chapterRing' THEN 'chapter-ring' WHEN 'crown' THEN 'crown' WHEN 'bezel' THEN 'bezel' WHEN 'strap' THEN 'bracelet' END AS suffix,
 len(moves) > 0 AND len(list_filter(moves, lambda m: m LIKE 'NH%')) = len(moves) AS nh, len(moves) > 0 AND len(list_filter(moves, lambda m: m LIKE 'VK%')) = len(moves) AS vk FROM d)"""


@query(_FACTS + r""" SELECT part_id, slot, CASE WHEN slot IS NULL OR scope IS NOT NULL THEN 'unknown' WHEN suffix IS NOT NULL THEN CASE WHEN len(models) = 1 AND models[1] IN ('skx007', 'skx013', 'srpe', 'ssk-gmt') THEN concat(models[1], '-', suffix) WHEN slot = 'strap' AND len(models) = 0 AND regexp_matches(x, '\bstrap\b') THEN 'generic-strap' ELSE 'unknown' END
 WHEN slot = 'movement' THEN CASE WHEN nh THEN 'nh3x-movement' WHEN vk THEN 'vk6x-movement' ELSE 'unknown' END WHEN slot = 'dial' THEN CASE WHEN nh AND has_feet = false THEN 'nh3x-dial-feetless' WHEN nh THEN 'nh3x-dial-standard' WHEN vk THEN 'vk6x-dial' ELSE 'unknown' END WHEN slot = 'hands' THEN CASE WHEN nh THEN 'nh3x-hands-standard' WHEN vk THEN 'vk6x-hands' ELSE 'unknown' END ELSE 'unknown' END AS family,
 CASE WHEN len(moves) = 1 THEN moves[1] END AS caliber, has_feet, coalesce(nullif(concat(regexp_extract(title, '\((\d(?:\.\d)?) o''clock crown case\)', 1, 'i'), regexp_extract(title, '@ (\d)H Crown', 1, 'i')), ''), nullif(concat(regexp_extract(title, '(?:^|[^\w.])(\d(?:\.\d)?)\s*(?:o''?clock|h)\s+crown\b', 1, 'i'), regexp_extract(title, '\bcrown\s+(?:at|@)\s*(\d(?:\.\d)?)\b', 1, 'i')), '')) AS crown,
 CASE WHEN cd BETWEEN 30 AND 50 THEN cd END AS case_mm, CASE WHEN dd BETWEEN 20 AND 40 THEN dd END AS dial_mm, CASE WHEN lw BETWEEN 10 AND 30 THEN lw END AS lug_mm FROM (SELECT *, TRY_CAST(coalesce(nullif(regexp_extract(title, '\bcase\s+(?:size|diameter)?:?\s*(\d{2}(?:\.\d)?)\s*mm\b', 1, 'i'), ''), nullif(regexp_extract(title, '(?:^|[^\w.])(\d{2}(?:\.\d)?)\s*mm\s+(?:watch\s+)?case\b', 1, 'i'), '')) AS DOUBLE) AS cd,
 TRY_CAST(coalesce(nullif(regexp_extract(title, '\bdial\s+(?:size|diameter):?\s*(\d{2}(?:\.\d)?)\s*mm\b', 1, 'i'), ''), nullif(regexp_extract(title, '(?:^|[^\w.])(\d{2}(?:\.\d)?)\s*mm\s+dial\b', 1, 'i'), '')) AS DOUBLE) AS dd, TRY_CAST(coalesce(nullif(regexp_extract(title, '(?:^|[^\w.])(\d{2})\s*mm\s+(?:[a-z]+\s+){0,2}(?:lugs?|strap|band|bracelet)\b', 1, 'i'), ''), nullif(regexp_extract(title, '\blug\s+width:?\s*(\d{2})\s*mm\b', 1, 'i'), '')) AS DOUBLE) AS lw FROM e) f""")
def listing_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot, family, sizes and movement facts that a listing's title states."""
    got = titles(spark, sf_dir).select("part_id", F.inline(F.array(listing.facts(F.col("title"), _families()))))
    return got.select("part_id", "slot", "family", "caliber", "has_feet", "crown", F.col("caseDiameterMm").alias("case_mm"), F.col("diameterMm").alias("dial_mm"), F.col("lugWidthMm").alias("lug_mm"))


# ---- vocabularies over texts in which each entry occurs -------------------------------------


def _tags_sql(column: str, category: str | None) -> str:
    made = ", ".join("CASE WHEN %sregexp_matches(%s, '%s', 'i') THEN '%s' END" % (f"{category} IN ({', '.join(repr(s) for s in slots)}) AND " if category else "", column, pattern, tag) for tag, pattern, slots in text.STYLE_TAGS)
    return f"array_to_string(list_filter([{made}], lambda g: g IS NOT NULL), ',')"


@query(_T + f" SELECT part_id, {_tags_sql('title', 'category')} AS tags FROM t")
def title_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("part_id", F.array_join(text.style_tags(F.col("title"), F.col("category")), ",").alias("tags"))


@query(_T + f", g AS (SELECT part_id, category, string_split({_tags_sql('title', 'category')}, ',') AS tags FROM t) SELECT category, count(*) AS n, round(avg(CASE WHEN tags = [''] THEN 0 ELSE len(tags) END), 6) AS tags_per_part, count(*) FILTER (WHERE tags = ['']) AS untagged FROM g GROUP BY category")
def tags_per_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = titles(spark, sf_dir).select("category", F.size(text.style_tags(F.col("title"), F.col("category"))).alias("k"))
    return tagged.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("tags_per_part"), F.count_if(F.col("k") == 0).alias("untagged"))


@query(_T + ", r AS (SELECT unnest([" + ", ".join("'%s'" % x for x in text.RESERVED) + "]) AS term) SELECT term, count(part_id) AS n FROM r LEFT JOIN t ON contains(' ' || regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(term, '[^a-z0-9]+', ' ', 'g') || ' ') GROUP BY term")
def reserved_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many titles name each reserved term; terms that none names count 0."""
    found = titles(spark, sf_dir).select(F.explode(text.reserved_terms(F.col("title"))).alias("term")).groupBy("term").agg(F.count("*").alias("k"))
    return spark.createDataFrame([(x,) for x in text.RESERVED], "term string").join(found, "term", "left").select("term", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def _shape_sql() -> str:
    by_tag = " ".join(f"WHEN category = '{c}' AND list_contains(g, '{t}') THEN '{s}'" for c, shapes in text.SHAPES.items() for s, _ in shapes for t, of in text.SHAPE_OF_TAG.items() if of == s)
    by_text = " ".join(f"WHEN category = '{c}' AND regexp_matches(title, '{p}', 'i') THEN '{s}'" for c, shapes in text.SHAPES.items() for s, p in shapes)
    last = " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in text.FALLBACK.items())
    return f"SELECT part_id, category, coalesce(m, CASE category {last} END) AS shape, m IS NULL AS fallback FROM (SELECT *, CASE {by_tag} {by_text} END AS m FROM (SELECT *, string_split({_tags_sql('title', 'category')}, ',') AS g FROM t) a WHERE category IN ({', '.join(repr(c) for c in text.FALLBACK)})) b"


@query(_T + " " + _shape_sql())
def shape_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn shape of each part: its tags before its text, its text before the fallback, which is noted."""
    t, category = titles(spark, sf_dir).where(F.col("category").isin(*text.FALLBACK)), F.col("category")
    # A generator of one row keeps the long expressions from being copied into each that reads them.
    tagged = t.select("part_id", "category", "title", F.explode(F.array(text.style_tags(F.col("title"), category))).alias("tags"))
    matched = tagged.select("part_id", "category", F.explode(F.array(text.matched_shape(F.col("title"), F.col("tags"), category))).alias("m"))
    return matched.select("part_id", "category", F.coalesce("m", text.fallback(category)).alias("shape"), F.col("m").isNull().alias("fallback"))


@query(_T + f", s AS ({_shape_sql()}), v AS (SELECT unnest([{', '.join(repr(s) for shapes in text.SHAPES.values() for s, _ in shapes)}]) AS shape) SELECT v.shape, count(s.shape) AS n, count(s.shape) = 0 AS dead FROM v LEFT JOIN s USING (shape) GROUP BY v.shape")
def shape_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each shape is drawn; a shape that nothing draws is dead."""
    used = shape_backfill(spark, sf_dir).groupBy("shape").agg(F.count("*").alias("k"))
    vocabulary = spark.createDataFrame([(s,) for shapes in text.SHAPES.values() for s, _ in shapes], "shape string")
    return vocabulary.join(used, "shape", "left").select("shape", F.coalesce("k", F.lit(0)).cast("long").alias("n"), F.col("k").isNull().alias("dead"))


_WISH = "concat(lower(ending), CASE j % 3 WHEN 0 THEN ' 1,250 quid or £900' WHEN 1 THEN ' £40.50' ELSE '' END)"


@query(_T + rf""" SELECT part_id, {_tags_sql('q', None)} AS tags, CASE WHEN m > 0 THEN CAST(round(m * 100) AS BIGINT) END AS budget_minor, CASE WHEN regexp_matches(q, '\bno date\b|dateless|without a date') THEN false WHEN regexp_matches(q, '\bdate\b') THEN true END AS requires_date
FROM (SELECT *, CASE j % 3 WHEN 0 THEN 1250.0 WHEN 1 THEN 40.5 END AS m FROM (SELECT *, {_WISH} AS q FROM t) a) b""")
def title_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wishes in words: tags, the first amount and the date."""
    got = titles(spark, sf_dir).select("part_id", text.intent(F.expr(_WISH)).alias("i"))
    return got.select("part_id", F.array_join("i.tags", ",").alias("tags"), "i.budget_minor", "i.requires_date")
