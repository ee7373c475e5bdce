"""Registered queries of the ingest, review, matching service and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitloom.functions import listing, text, values
from fitloom.ingest_queries import _SCOPE, _T, _tags_sql
from fitloom.operators import dataquality, service
from fitloom.plans import mapping
from fitloom.plans.titles import titles
from fitloom.queries import query, table

_L = f"l AS ({mapping.LISTING_SQL}), v AS ({mapping.VENDOR_SQL})"
_SC = f"s AS (SELECT *, {_SCOPE} AS reason FROM (SELECT *, lower(title) AS x FROM t) y)"


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("*", F.explode(F.array(listing.out_of_scope(F.lower("title"), F.col("category")))).alias("reason"))


# ---- import and review ------------------------------------------------------------------


@query(_T + f", {_SC} SELECT part_id, reason, review_state <> 'rejected' AS fresh FROM s WHERE reason IS NOT NULL")
def reject_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of rejected products after a run: what it had (parts rejected before) and what is new, once each."""
    found = _scoped(spark, sf_dir).where("reason is not null")
    return service.log_rejects(found.where("review_state = 'rejected'").select("part_id", "reason"), found.select("part_id", "reason"), ["part_id"])


@query(_T + f", {_SC} SELECT part_id, CASE WHEN review_state = 'pending' AND reason IS NOT NULL THEN 'rejected' ELSE review_state END AS review_state, CASE WHEN review_state = 'pending' AND reason IS NOT NULL THEN 'rejected during tagging: ' || reason END AS evidence FROM s")
def reject_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts after that run: only those still pending change their state."""
    parts = titles(spark, sf_dir).select("part_id", "review_state", F.lit(None).cast("string").alias("evidence"))
    return service.reject_pending(parts, _scoped(spark, sf_dir).where("reason is not null").select("part_id", "reason"))


_TAGGED27 = "sunburst matte textured lacquer applied-indices printed-indices sword-hands dauphine-hands syringe-hands mercedes-hands snowflake dive-bezel gmt gmt-bezel vintage-lume no-lume sterile day-date date-only no-date field-style dress-style military-style chronograph-style explorer-style alpinist-style vintage-diver".split()


@query(_T + f""", c AS (SELECT part_id AS k, family FROM ({mapping.CATALOG_SQL})), g AS (SELECT t.part_id, review_state, family, list_filter(string_split({_tags_sql('title', 'category')}, ','), lambda x: x <> '') AS tags FROM t JOIN c ON k = part_id)
SELECT part_id, CASE WHEN family IN ('unknown', 'loose') THEN 'unknown family' WHEN len(list_filter(tags, lambda x: x NOT IN ({', '.join(repr(x) for x in _TAGGED27)}))) > 0 THEN 'unknown tags' WHEN review_state <> 'pending' THEN 'already reviewed' ELSE 'imported' END AS outcome FROM g""")
def import_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each tagged row: families and tags that the import knows, and no human decision overwritten."""
    c = mapping.catalog(spark, sf_dir).select("part_id", "family")
    rows = titles(spark, sf_dir).join(c, "part_id").select("part_id", "review_state", "family", text.style_tags(F.col("title"), F.col("category")).alias("tags"))
    known = c.select("family").distinct().where("family not in ('unknown', 'loose')")
    return service.import_outcome(rows, known, _TAGGED27)


_CONFLICT = "CASE WHEN category NOT IN ('hands', 'dial', 'movement') AND regexp_matches(title, 'skx007|srpd', 'i') AND family NOT LIKE 'skx007-%' THEN 'skx007-' WHEN category NOT IN ('hands', 'dial', 'movement') AND regexp_matches(title, 'skx013', 'i') AND family NOT LIKE 'skx013-%' THEN 'skx013-' WHEN regexp_matches(title, '\\bnh35\\b', 'i') AND family NOT LIKE 'nh3x-%' THEN 'nh3x-' WHEN regexp_matches(title, '\\bnh36\\b', 'i') AND family NOT LIKE 'nh3x-%' THEN 'nh3x-' END"
_REVIEW = f"CASE WHEN confidence = 'low' THEN 'low confidence' WHEN category IN ('case', 'movement') THEN 'anchors every rule' WHEN {_CONFLICT} IS NOT NULL THEN 'name conflict' END"


def _with_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).join(mapping.catalog(spark, sf_dir).select("part_id", "family"), "part_id")


_WF = _T + f", w AS (SELECT t.*, family FROM t JOIN (SELECT part_id AS k, family FROM ({mapping.CATALOG_SQL})) c ON k = part_id)"


@query(_WF + f" SELECT part_id, family, {_CONFLICT} AS expected FROM w WHERE {_CONFLICT} IS NOT NULL")
def name_family_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name speaks for another family than theirs."""
    got = _with_family(spark, sf_dir).withColumn("expected", dataquality.name_family_conflict(F.col("title"), F.col("family"), F.col("category")))
    return got.where("expected is not null").select("part_id", "family", "expected")


@query(_WF + f" SELECT part_id, {_REVIEW} AS why, CASE WHEN review_state = 'pending' AND {_REVIEW} IS NULL THEN 'approved' ELSE review_state END AS review_state FROM w")
def bulk_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a part must be reviewed by hand, and its state once the others that are pending are accepted."""
    rows = _with_family(spark, sf_dir)
    why = service.mandatory_review(F.col("confidence"), F.col("category"), F.col("title"), F.col("family"))
    seen = rows.select("part_id", "review_state", F.explode(F.array(why)).alias("why"))
    return seen.select("part_id", "why", F.when((F.col("review_state") == "pending") & F.col("why").isNull(), "approved").otherwise(F.col("review_state")).alias("review_state"))


_DECIDED = "SELECT p_partkey AS part_id, CASE WHEN p_size < 20 THEN 'approve' ELSE 'reject' END AS decision, concat('size ', p_size) AS reason, p_brand AS reviewer FROM part WHERE p_type = 'PROMO' UNION ALL SELECT -s_suppkey, 'approve', 'none', s_name FROM supplier"


@query(_T + f", d AS ({_DECIDED}) SELECT d.part_id, CASE WHEN t.part_id IS NULL THEN 'not found' WHEN decision = 'approve' THEN 'approved' ELSE 'rejected' END AS outcome, CASE WHEN t.part_id IS NULL THEN NULL WHEN decision = 'approve' THEN concat('Reviewed by ', reviewer, ': ', d.reason) ELSE concat(d.reason, ' (reviewed by ', reviewer, ')') END AS note FROM d LEFT JOIN t USING (part_id)")
def apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of decisions applied to parts: approved with a note, rejected with a log entry, or not found."""
    part, vendor = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    decided = part.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("part_id"), F.when(F.col("p_size") < 20, "approve").otherwise("reject").alias("decision"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("reason"), F.col("p_brand").alias("reviewer"))
    strays = vendor.select((-F.col("s_suppkey")).alias("part_id"), F.lit("approve").alias("decision"), F.lit("none").alias("reason"), F.col("s_name").alias("reviewer"))
    return service.decide(titles(spark, sf_dir).select("part_id"), decided.unionByName(strays))


@query(_WF + " SELECT part_id, CASE WHEN family = 'ssk-gmt-crown' THEN 'shared-crown-tube' ELSE 'strap-is-lug-width-generic' END AS rule_key, 'info' AS severity FROM w WHERE (family = 'ssk-gmt-crown' OR family = 'generic-strap' AND regexp_matches(title, 'skx007|skx013|srpd', 'i')) AND part_id NOT IN (SELECT p_partkey FROM part WHERE p_size % 11 = 0)")
def seed_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions by family, for some by name too; a part that has one gets no other."""
    seeds = [("ssk-gmt-crown", "", "shared-crown-tube", "info"), ("generic-strap", "(?i)skx007|skx013|srpd", "strap-is-lug-width-generic", "info")]
    return service.seed_exceptions(_with_family(spark, sf_dir).withColumnRenamed("title", "name"), mapping.exceptions(spark, sf_dir), seeds).select("part_id", "rule_key", "severity")


@query(_T + ", p AS (SELECT t.*, p_size FROM t JOIN part ON p_partkey = part_id), x AS (SELECT part_id, category, p_size, CASE WHEN p_size BETWEEN 24 AND 46 THEN p_size::DOUBLE END AS o FROM p WHERE category IN ('bezel_insert', 'chapter_ring')) SELECT part_id, CASE WHEN o IS NULL THEN '{\"profile\":\"flat\"}' ELSE concat('{\"outer\":\"', o, '\",\"profile\":\"flat\"}') END AS attributes FROM x")
def dimension_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated sizes written into the attributes' JSON; an old value that no text supports goes."""
    rows = titles(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), "p_size"), "part_id").where("category in ('bezel_insert', 'chapter_ring')")
    d = text.dimensions(F.concat(F.lit("<p>Outer diameter: "), F.col("p_size").cast("string"), F.lit("mm")), F.col("category"))
    return rows.select("part_id", values.patch_json(F.lit('{"profile":"flat","outer":"31.0"}'), F.create_map(F.lit("outer"), d["outer"].cast("string"))).alias("attributes"))


# ---- lookups and overlays ------------------------------------------------------------


@query(_T + ", i AS (SELECT part_id, review_state, CASE j % 9 WHEN 0 THEN concat('shop', j % 7, '.com/products/item-', part_id) WHEN 1 THEN concat('shop', j % 7, '.com/products/item-', part_id) END AS link FROM t), q AS (SELECT c_custkey, concat('http://shop', c_custkey % 7, '.com/products/ITEM-', c_custkey, '?a=b') AS asked, concat('shop', c_custkey % 7, '.com/products/item-', c_custkey) AS link FROM customer) SELECT c_custkey, i.part_id, CASE WHEN i.part_id IS NULL THEN 'not in the catalog' WHEN review_state <> 'approved' THEN 'not approved yet' END AS problem FROM q LEFT JOIN i ON i.link = q.link UNION ALL SELECT s_suppkey, NULL, 'no product link' FROM supplier")
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to parts, or what is wrong with each link."""
    parts = titles(spark, sf_dir).select("part_id", "review_state", F.col("url").alias("source_url"))
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("http://shop"), (k % 7).cast("string"), F.lit(".com/products/ITEM-"), k.cast("string"), F.lit("?a=b")).alias("submitted"))
    wrong = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit("https://shop1.com/collections/all").alias("submitted"))
    none = parts.where("false").select("part_id", F.col("source_url").alias("url"))
    return service.resolve_links(asked.unionByName(wrong), service.link_index(none, parts), parts).select("c_custkey", "part_id", "problem")


@query("WITH a AS (SELECT o_custkey AS id, 'listing' AS origin, min(o_orderkey) AS part_id FROM orders GROUP BY o_custkey), b AS (SELECT c_custkey AS id, 'part' AS origin, c_custkey AS part_id FROM customer) SELECT coalesce(a.id, b.id) AS link, coalesce(a.part_id, b.part_id) AS part_id, coalesce(a.origin, b.origin) AS origin FROM a FULL JOIN b USING (id)")
def link_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of links: a listing's goes before a part's own, the smallest part of equals."""
    first = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("link"), F.col("o_orderkey").alias("part_id"), F.lit(0).alias("turn"))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("link"), F.col("c_custkey").alias("part_id"), F.lit(1).alias("turn"))
    best = first.unionByName(own).groupBy("link").agg(F.min(F.struct("turn", "part_id")).alias("b"))
    return best.select("link", "b.part_id", F.when(F.col("b.turn") == 0, "listing").otherwise("part").alias("origin"))


@query(_T + ", f AS (SELECT p_partkey, concat('https://cdn/', p_partkey, '.jpg?v=', p_size) AS image FROM part WHERE p_size > 10) SELECT part_id, regexp_replace(image, '[?&]v=\\d+', '') AS image_url FROM t LEFT JOIN f ON p_partkey = part_id")
def image_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of feed products brought to their parts, without cache keys; a part that no product matches has none."""
    feed = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("part_id"), F.concat(F.lit("https://cdn/"), F.col("p_partkey").cast("string"), F.lit(".jpg?v="), F.col("p_size").cast("string")).alias("image"))
    return titles(spark, sf_dir).select("part_id").join(feed, "part_id", "left").select("part_id", F.regexp_replace("image", r"[?&]v=\d+", "").alias("image_url"))


@query(f"WITH c AS ({mapping.CATALOG_SQL}), {_L}, u AS (SELECT DISTINCT l_partkey AS part_id FROM lineitem WHERE l_returnflag = 'A') SELECT part_id, spec_source, false AS submitted FROM c WHERE part_id NOT IN (SELECT part_id FROM u) UNION ALL SELECT part_id, 'user-entered', true FROM u")
def submitted_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with the submitted parts that builds name; a submitted part takes the place of one of its id."""
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("part_id"))
    c = mapping.catalog(spark, sf_dir).select("part_id", "spec_source")
    submitted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.lit("user-entered").alias("spec_source"), F.lit("pending").alias("review_state"))
    return service.overlay(c, submitted, used)


@query(_T + r""" SELECT part_id, concat('byo-', substr(sha256(concat('ebay/', 100000000 + part_id)), 1, 8)) AS id, 'ebay' AS platform, concat('https://www.ebay.com/itm/', 100000000 + part_id) AS source_url, 'user-entered' AS spec_source FROM t WHERE j % 9 = 2 UNION ALL SELECT part_id, concat('byo-', substr(sha256(concat('aliexpress/', 1000000 + part_id)), 1, 8)), 'aliexpress', concat('https://www.aliexpress.com/item/', 1000000 + part_id, '.html'), 'user-entered' FROM t WHERE j % 9 = 3""")
def submitted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for parts submitted by link: only single listings, under links rebuilt from their ids."""
    return service.submissions(titles(spark, sf_dir)).select("part_id", "id", "platform", "source_url", "spec_source")


@query("WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_size AS z FROM part), m AS (SELECT x.k AS a, y.k AS c, x.b = y.b AS linked, abs(x.z - y.z) AS distance FROM p x JOIN p y ON y.k = x.k + 1) SELECT a, c AS b, CASE WHEN linked AND distance <= 10 THEN 'both' WHEN linked THEN 'user-link' ELSE 'phash' END AS source, CASE WHEN distance <= 10 THEN distance END AS distance FROM m WHERE linked OR distance <= 10")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that users linked and pairs that images suggest, under the sorted pair; a pair of both sources is one row."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    near = p.join(p.select((F.col("k") - 1).alias("k"), F.col("brand").alias("brand2"), F.col("size").alias("size2")), "k").withColumn("distance", F.abs(F.col("size") - F.col("size2")).cast("long"))
    links = near.where("brand = brand2").select((F.col("k") + 1).alias("a"), F.col("k").alias("b"))
    images = near.where("distance <= 10").select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"), "distance")
    return service.promote(links, images)


@query(f"WITH c AS ({mapping.CATALOG_SQL}), {_L}, ok AS (SELECT part_id FROM c WHERE spec_source = 'vendor-stated') SELECT part_id, vendor_id, price_minor FROM l WHERE price_minor IS NOT NULL AND part_id IN (SELECT part_id FROM ok)")
def approved_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced listings of approved parts only."""
    ok = mapping.catalog(spark, sf_dir).where("spec_source = 'vendor-stated'").select("part_id")
    return mapping.listings(spark, sf_dir).where("price_minor is not null").join(ok, "part_id", "left_semi").select("part_id", "vendor_id", "price_minor")


@query(f"WITH c AS ({mapping.CATALOG_SQL}), {_L}, o AS (SELECT part_id, min(price_minor) AS price, max(in_stock) AS stocked FROM l GROUP BY part_id) SELECT part_id, price FROM c JOIN o USING (part_id) WHERE contains(lower(name), 'bolt') AND price <= 150000 AND stocked")
def picker_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a picker shows for a word, a highest price and stock."""
    o = mapping.listings(spark, sf_dir).groupBy("part_id").agg(F.min("price_minor").alias("price"), F.max("in_stock").alias("stocked"))
    return mapping.catalog(spark, sf_dir).join(o, "part_id").where(service.picked("bolt", 150_000)).select("part_id", "price")


@query(f"WITH c AS ({mapping.CATALOG_SQL}), {_L}, o AS (SELECT part_id, min(price_minor) AS price FROM l GROUP BY part_id), r AS (SELECT slot, part_id, price, CASE spec_source WHEN 'vendor-stated' THEN 0 WHEN 'manual' THEN 1 ELSE 2 END AS state FROM c LEFT JOIN o USING (part_id)) SELECT slot, part_id, row_number() OVER (PARTITION BY slot ORDER BY state, price NULLS LAST, part_id)::INTEGER AS turn FROM r")
def picker_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order within each slot's picker: state, then price, then key."""
    o = mapping.listings(spark, sf_dir).groupBy("part_id").agg(F.min("price_minor").alias("price"))
    state = F.when(F.col("spec_source") == "vendor-stated", 0).when(F.col("spec_source") == "manual", 1).otherwise(2)
    rows = mapping.catalog(spark, sf_dir).select("slot", "part_id", state.alias("state")).join(o, "part_id", "left")
    return rows.select("slot", "part_id", F.row_number().over(Window.partitionBy("slot").orderBy("state", F.col("price").asc_nulls_last(), "part_id")).alias("turn"))


@query(_T + r""" SELECT part_id, CASE category WHEN 'case' THEN NOT (regexp_matches(title, 'caseback|case back|gasket|tube|bezel|insert|ring|spacer', 'i') AND NOT regexp_matches(regexp_replace(regexp_replace(title, '\(with case ?back\)', '', 'gi'), '\bcase\s*back', '#', 'gi'), '\bcase\b', 'i')) WHEN 'hands' THEN NOT (regexp_matches(title, '\bcap\b', 'i') OR regexp_matches(title, '\b(seconds?|gmt) hand\b', 'i') AND NOT contains(title, '+')) AND NOT regexp_matches(title, '\bgmt\b|\bnh34\b|\bchrono|\bvk\d*\b', 'i')
 WHEN 'dial' THEN NOT regexp_matches(title, '\bgmt\b|\bnh34\b|\bchrono|\bvk\d*\b', 'i') WHEN 'movement' THEN regexp_matches(title, '\bNH3[56]A?\b', 'i') AND NOT regexp_matches(title, '\bNH34\b', 'i') AND NOT regexp_matches(title, '\(\d(\.\d)? o''clock crown case\)|@ \dH Crown', 'i') ELSE true END AS eligible FROM t""")
def first_build_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a first build may be offered each part, by its name, caliber and crown."""
    title = F.col("title")
    return titles(spark, sf_dir).select("part_id", listing.eligible(F.col("category"), title, text.caliber(title), listing.movement_crown(title)).alias("eligible"))


@query(_WF + r" SELECT part_id, category FROM w WHERE category = 'movement' AND regexp_matches(ending, '^Seiko \(TMI\) NH3', 'i') OR category = 'case' AND family LIKE 'skx%' AND NOT (regexp_matches(ending, 'caseback|case back|gasket|tube|bezel|insert|ring|spacer', 'i') AND NOT regexp_matches(regexp_replace(regexp_replace(ending, '\(with case ?back\)', '', 'gi'), '\bcase\s*back', '#', 'gi'), '\bcase\b', 'i'))")
def suggestion_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements and cases that suggestions are built on."""
    name = F.col("ending")
    good = ((F.col("category") == "movement") & name.rlike(r"(?i)^Seiko \(TMI\) NH3")) | ((F.col("category") == "case") & F.col("family").startswith("skx") & ~listing.is_case_component(name))
    return _with_family(spark, sf_dir).where(good).select("part_id", "category")


# ---- sets, texts and values ---------------------------------------------------------------


@query(_T + f", g AS (SELECT part_id, list_filter(string_split({_tags_sql('title', 'category')}, ','), lambda x: x <> '') AS tags FROM t) SELECT part_id, array_to_string(list_filter(['black', 'vintage', 'dive-bezel'], lambda x: NOT list_contains(tags, x)), ',') AS missed, CASE WHEN len(list_filter(tags, lambda x: x IN ('black', 'vintage', 'dive-bezel'))) = 0 THEN 'cheapest that fits the rest' ELSE 'chosen for ' || replace(array_to_string(list_filter(['black', 'vintage', 'dive-bezel'], lambda x: list_contains(tags, x)), ' and '), 'black and vintage and dive-bezel', 'black, vintage and dive-bezel') END AS why FROM g")
def tags_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted tags that a part lacks, and why it was chosen."""
    wanted = F.array(*[F.lit(x) for x in ("black", "vintage", "dive-bezel")])
    got = titles(spark, sf_dir).select("part_id", text.style_tags(F.col("title"), F.col("category")).alias("tags"))
    return got.select("part_id", F.array_join(F.array_except(wanted, "tags"), ",").alias("missed"), values.part_reason(F.array_intersect(wanted, F.col("tags"))).alias("why"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'black' ELSE 'black,gmt-bezel' END AS kept, CASE p_size % 3 WHEN 0 THEN p_type || ',invented' WHEN 1 THEN p_type ELSE '' END AS dropped FROM (SELECT p_partkey, p_size, lower(p_type) AS p_type FROM part) x")
def tag_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate tags split into those of the vocabulary and those dropped."""
    said = F.expr("case p_size % 3 when 0 then array(' Black', p_type, 'invented', 'black') when 1 then array('black', 'GMT-bezel ', p_type) else array('black', 'gmt-bezel') end")
    got = table(spark, sf_dir, "part").select("p_partkey", said.alias("c"))
    return got.select("p_partkey", F.array_join(text.known_tags(F.col("c")), ",").alias("kept"), F.array_join(text.dropped_tags(F.col("c")), ",").alias("dropped"))


@query("SELECT count(*) FILTER (WHERE b IS NULL) AS only_left, count(*) FILTER (WHERE a IS NULL) AS only_right, count(*) FILTER (WHERE a IS NULL OR b IS NULL) = 0 AS alike FROM (SELECT DISTINCT o_custkey AS a FROM orders) x FULL JOIN (SELECT c_custkey AS b FROM customer) y ON a = b")
def set_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two sets are the same, and how many members either has alone."""
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return service.parity(a, b, ["k"])


_REPLY = "concat(CASE p_size % 4 WHEN 0 THEN 'Sure: ```json ' ELSE 'here ' END, CASE p_size % 5 WHEN 0 THEN '{\"budgetMinor\":' || (p_size * 100) || ',\"currency\":\"gbp\",\"styleTags\":[\"black\",\" Invented \"],\"lo\":40,\"hi\":44}' WHEN 1 THEN '{\"budgetMinor\":null,\"currency\":\"USD\",\"styleTags\":[],\"lo\":' || (p_size + 15) || ',\"hi\":44}' WHEN 2 THEN 'no object' WHEN 3 THEN '{broken' ELSE '{\"budgetMinor\":-5,\"currency\":\"EUR\",\"styleTags\":[\"blue\"]}' END, CASE p_size % 4 WHEN 0 THEN ' ```' ELSE ' done' END)"


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' ELSE 'GBP' END AS currency, CASE WHEN p_size % 5 = 0 THEN (p_size * 100)::BIGINT END AS budget_minor, CASE WHEN p_size % 5 = 0 THEN 'black' ELSE '' END AS tags, CASE WHEN p_size % 5 = 0 THEN 'invented' ELSE '' END AS dropped, CASE WHEN p_size % 5 = 0 THEN 40.0 WHEN p_size % 5 = 1 AND p_size + 15 > 20 AND p_size + 15 <= 44 THEN (p_size + 15)::DOUBLE END AS size_from FROM part WHERE true")
def normalised_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wishes read from replies that hold a JSON object, fenced or among prose; what fails the schema is an empty wish."""
    got = table(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(values.intent_of_json(values.json_object(F.expr(_REPLY))))))
    return got.select("p_partkey", "currency", "budget_minor", F.array_join("tags", ",").alias("tags"), F.array_join("dropped", ",").alias("dropped"), "size_from")


@query(_T + r""" SELECT part_id, regexp_replace(title, '^(Namoki|DLW|Watch & Style|Lucius Atelier) ', '') AS name FROM t""")
def strip_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("part_id", F.regexp_replace("title", listing.VENDOR_PREFIX, "").alias("name"))


@query(_T + ", f AS (SELECT part_id, regexp_replace(title, '^(Namoki|DLW|Watch & Style|Lucius Atelier) ', '') AS name FROM t), a AS (SELECT DISTINCT ending FROM t WHERE review_state = 'approved') SELECT part_id, name FROM f WHERE name NOT IN (SELECT ending FROM a)")
def unresolved_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of reference builds that no approved part has, once the vendor's name before them is gone."""
    approved = titles(spark, sf_dir).where("review_state = 'approved'").select(F.col("ending").alias("name")).distinct()
    return strip_vendor(spark, sf_dir).join(approved, "name", "left_anti").select("part_id", "name")


@query(f"WITH {_L}, x AS (SELECT part_id, vendor_id, currency AS expected, CASE WHEN part_id % 7 = 0 THEN 'USD' ELSE currency END AS currency FROM l JOIN v USING (vendor_id)) SELECT part_id, vendor_id, currency, expected FROM x WHERE currency <> expected")
def dq_wrong_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in another currency than their vendor's."""
    v = mapping.vendors(spark, sf_dir)
    paid = mapping.listings(spark, sf_dir).join(v.select("vendor_id", F.col("currency").alias("own")), "vendor_id").withColumn("currency", F.when(F.col("part_id") % 7 == 0, "USD").otherwise(F.col("own")))
    return dataquality.wrong_currency(paid, v).select("part_id", "vendor_id", "currency", "expected")


@query("SELECT c_custkey, coalesce(nullif(trim(string_split(f, ',')[1]), ''), r, 'unknown') AS caller FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' 10.0.0.' || (c_custkey % 250) || ', 1.1.1.1' WHEN 1 THEN '' WHEN 2 THEN '10.1.1.1' END AS f, CASE c_custkey % 3 WHEN 0 THEN '9.9.9.9' END AS r FROM customer) x")
def caller_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who asks: the first forwarded address, else the real one, else unknown."""
    f = F.expr("case c_custkey % 4 when 0 then concat(' 10.0.0.', c_custkey % 250, ', 1.1.1.1') when 1 then '' when 2 then '10.1.1.1' end")
    return table(spark, sf_dir, "customer").select("c_custkey", values.caller(f, F.expr("case c_custkey % 3 when 0 then '9.9.9.9' end")).alias("caller"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' END AS mime, CASE p_size % 5 WHEN 3 THEN 'empty' WHEN 4 THEN 'not an image' END AS problem FROM part")
def image_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads judged by their first bytes, not by what they are called."""
    data = F.expr("case p_size % 5 when 0 then unhex('FFD8FFE000104A46') when 1 then unhex('89504E470D0A1A0A') when 2 then unhex('52494646AAAAAAAA574542505650') when 3 then unhex('') else unhex('255044462D') end")
    return table(spark, sf_dir, "part").select("p_partkey", values.image_kind(data).alias("k")).select("p_partkey", "k.mime", "k.problem")


@query("SELECT l_orderkey, l_linenumber, concat('£', (m // 100)::BIGINT, '.', lpad((m % 100)::VARCHAR, 2, '0')) AS price, m AS minor, strftime(l_shipdate, '%Y-%m-%d') AS day FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS m FROM lineitem) x")
def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in words and back to minor units, and ISO days."""
    m = F.round(F.col("l_extendedprice") * 100).cast("long")
    said = text.money(m)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", said.alias("price"), text.minor_units(F.regexp_replace(said, "£", "")).alias("minor"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))


@query(_T + f", g AS (SELECT part_id, string_split({_tags_sql('title', 'category')}, ',') AS tags FROM t) SELECT part_id, (" + " + ".join(f"CASE WHEN list_contains(tags, '{t}') THEN {1 << i}::BIGINT ELSE 0 END" for i, (t, _, _) in enumerate(text.STYLE_TAGS)) + ")::BIGINT AS mask FROM g")
def tag_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as bits, in the order of the vocabulary."""
    return titles(spark, sf_dir).select("part_id", values.tag_mask(text.style_tags(F.col("title"), F.col("category"))).alias("mask"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 4 <> 0 THEN CASE p_size % 3 WHEN 0 THEN 'black' WHEN 1 THEN 'blue' ELSE 'cream' END END, CASE p_size % 5 WHEN 0 THEN 'sunburst' WHEN 1 THEN 'enamel' WHEN 2 THEN 'matte' END, CASE WHEN p_size % 2 = 0 THEN 'roman-numerals' END, CASE p_size % 7 WHEN 0 THEN 'three-lobe-hands' WHEN 1 THEN 'sword-hands' END, 'plain-bezel'], lambda x: x IS NOT NULL), ',') AS tags FROM part")
def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes read from a picture brought to tags; those of low confidence are left out."""
    said = F.expr("""named_struct('colour', case p_size % 3 when 0 then 'Black' when 1 then 'navy' else 'ivory tone' end, 'texture', case p_size % 5 when 0 then 'sunburst' when 1 then 'lacquer' when 2 then 'matte' else 'odd' end, 'index', case when p_size % 2 = 0 then 'roman' end,
        'hands', case p_size % 7 when 0 then 'mercedes' when 1 then 'plongeur' else 'unknown' end, 'bezel', 'fixed')""")
    low = F.array(F.when(F.col("p_size") % 4 == 0, "colour"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(values.tags_of_attributes(said, low), ",").alias("tags"))


_PLATFORM = "CASE WHEN family LIKE 'skx007%' THEN '42.5mm diver' WHEN family LIKE 'skx013%' THEN '37mm diver' WHEN family LIKE 'srpe%' THEN 'modern diver' WHEN family LIKE 'ssk-gmt%' THEN 'GMT diver' ELSE 'Seiko mod build' END"


@query(f"WITH c AS ({mapping.CATALOG_SQL}), s AS ({mapping.BUILD_SLOT_SQL}), b AS (SELECT build_id, max(part_id) FILTER (WHERE slot = 'case') AS k, max(part_id) FILTER (WHERE slot = 'dial') AS d FROM s GROUP BY build_id), n AS (SELECT build_id, {_PLATFORM} AS base, nullif(trim(x.name), '') AS words FROM b LEFT JOIN c y ON y.part_id = k LEFT JOIN (SELECT part_id AS dp, name FROM c) x ON dp = d) SELECT build_id, CASE WHEN words IS NULL THEN upper(base[1]) || base[2:] ELSE words || ' ' || base END AS title FROM n")
def build_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title for each build: its dial's own words, without reserved ones, before the kind of case."""
    c = mapping.catalog(spark, sf_dir)
    held = mapping.build_slots(spark, sf_dir).where("slot in ('case', 'dial')").join(c.select("part_id", "family", "name"), "part_id")
    return values.build_titles(mapping.build_slots(spark, sf_dir).select("build_id").distinct(), held)


@query("WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(floor(z[1] * 128)::INTEGER - floor(z[2] * 128)::INTEGER)) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(list_avg(d), 6) AS mad, list_max(d)::INTEGER AS most, list_sort(d)[floor(0.99 * len(d))::INTEGER + 1]::INTEGER AS p99, len(list_filter(d, lambda x: x > 8))::INTEGER AS differing FROM p")
def image_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of neighbouring rows of values: mean, largest, 99th percentile, and how many exceed 8."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 128).cast("int")).alias("a"))
    return service.differences(e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")).select("vec_id", "mad", "most", "p99", "differing")


@query(_T + " SELECT category, count(*) AS total, count(*) FILTER (WHERE regexp_matches(title, '\\bblack\\b|\\bonyx\\b|\\bnoir\\b', 'i')) AS covered FROM t WHERE review_state = 'approved' GROUP BY category")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many approved rows of each category meet a predicate, and of how many."""
    return titles(spark, sf_dir).where("review_state = 'approved'").groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("title").rlike(r"(?i)\bblack\b|\bonyx\b|\bnoir\b")).alias("covered"))


@query(_T + f", {_SC}, n AS (SELECT reason, count(*) AS n, min(part_id) AS example FROM s WHERE reason IS NOT NULL GROUP BY reason) SELECT row_number() OVER (ORDER BY n DESC, reason)::INTEGER AS line, concat('| ', reason, ' | ', n, ' | ', example, ' |') AS text FROM n")
def reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in Markdown: a line for each reason, commonest first."""
    n = _scoped(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.min("part_id").alias("example"))
    line = F.concat(F.lit("| "), "reason", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("example").cast("string"), F.lit(" |"))
    return n.select(F.row_number().over(Window.orderBy(F.desc("n"), "reason")).alias("line"), line.alias("text"))
