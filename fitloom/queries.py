"""The registered queries of the engine itself, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitloom.functions import codecs, links, text
from fitloom.operators import dataquality, evaluate, matching, offers, pricing, raster, recommend, upsert
from fitloom.operators.rules import RULES
from fitloom.plans import mapping, oracle
from fitloom.streaming import limiter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its own name, or another."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def wide(spark: SparkSession, sf_dir: str, read: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Wide rows of all builds with the fields that are read; by default, those that all rules read."""
    read = read or {s: ("part_id", *fields) for s, fields in evaluate.fields_read().items()}
    return evaluate.wide_builds(mapping.build_slots(spark, sf_dir, tuple(read)), mapping.catalog(spark, sf_dir), mapping.listings(spark, sf_dir), mapping.exceptions(spark, sf_dir), read)


#: Parts of every slot, and what tools and plans read besides.
_FITTED = {s: ("part_id", "has_feet") if s == "dial" else ("part_id",) for s in mapping.SLOTS}


def _rule_query(rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Every finding of a rule needs a part in one of the slots that the rule reads.
        found = evaluate.findings(wide(spark, sf_dir, evaluate.fields_read((rule,))), (rule,))
        return found.select("build_id", "rule_key", "severity", "raw_severity", "tier", F.array_join("slots", ",").alias("slots"))

    return run


for _rule in RULES:
    _head, _body = oracle.findings_sql([_rule.key])
    query(_head + _body, "rule_" + _rule.key.replace("-", "_"))(_rule_query(_rule))

_HEAD, _ALL = oracle.findings_sql()


@query(_HEAD + f"""SELECT b.build_id, count(*) FILTER (WHERE severity = 'error') AS n_error, count(*) FILTER (WHERE severity = 'warning') AS n_warning, count(*) FILTER (WHERE severity = 'info') AS n_info,
CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'blocked' WHEN count(*) FILTER (WHERE severity = 'warning') > 0 THEN 'warnings' ELSE 'ok' END AS status
FROM b LEFT JOIN ({_ALL}) f USING (build_id) GROUP BY b.build_id""")
def build_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over every build, and the status that follows."""
    return evaluate.evaluate(wide(spark, sf_dir, evaluate.fields_read()))


@query(_HEAD + f"SELECT rule_key, tier, raw_severity, severity, count(*) AS n FROM ({_ALL}) f GROUP BY ALL")
def evidence_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings of each rule stand at each tier, before and after the evidence is weighed."""
    return evaluate.findings(wide(spark, sf_dir, evaluate.fields_read())).groupBy("rule_key", "tier", "raw_severity", "severity").agg(F.count("*").alias("n"))


@query(_HEAD + f"SELECT b.build_id, 'chapterRing' AS slot, cs.plat || '-chapter-ring' AS family {oracle.wide_sql()[1]} WHERE cs.requires_ring AND rg.part_id IS NULL AND dl.part_id IS NOT NULL")
def required_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = tuple(r for r in RULES if r.key == "requires-chapter-ring")
    read = evaluate.fields_read(ring)
    return evaluate.required_additions(wide(spark, sf_dir, read | {"case": (*read["case"], "family")}))


_T = {
    "case-back-opener": "mv.part_id IS NOT NULL AND cs.part_id IS NOT NULL", "movement-holder": "mv.part_id IS NOT NULL AND cs.part_id IS NOT NULL", "hand-press": "hd.part_id IS NOT NULL", "hand-removal-levers": "hd.part_id IS NOT NULL",
    "dial-dots": "dl.has_feet = false", "bezel-insert-tool": "bi.part_id IS NOT NULL", "spring-bar-tool": "st.part_id IS NOT NULL", "crystal-press": "cr.part_id IS NOT NULL",
}
_TOOLS = "list_filter(['blower', 'gloves', 'dust-cover', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in _T.items()) + "], lambda t: t IS NOT NULL)"


def _tool_price(k: int) -> str:
    return "list_sum(list_transform(t, lambda x: CASE x " + " ".join(f"WHEN '{n}' THEN {p[k] * 100}" for n, p in evaluate.TOOLS.items()) + " END))::BIGINT"


@query(_HEAD + f"SELECT build_id, len(t)::BIGINT AS n_tools, array_to_string(t, ',') AS tools, {_tool_price(0)} AS low_minor, {_tool_price(1)} AS high_minor FROM (SELECT b.build_id, {_TOOLS} AS t {oracle.wide_sql()[1]}) x")
def tools_and_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.tool_costs(wide(spark, sf_dir, _FITTED))


# ---- sources and projections -------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state predicate and a projection, both pushed into the scan."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 3, 7, 100, 101)")
def multi_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderkey").isin(1, 3, 7, 100, 101)).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'dial' WHEN 'STANDARD' THEN 'case' WHEN 'PROMO' THEN 'bezelInsert' WHEN 'SMALL' THEN 'chapterRing' WHEN 'MEDIUM' THEN 'crown' END AS slot FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO', 'SMALL', 'MEDIUM')")
def category_slot_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories renamed to slots; unknown categories drop out."""
    names = {"ECONOMY": "dial", "STANDARD": "case", "PROMO": "bezelInsert", "SMALL": "chapterRing", "MEDIUM": "crown"}
    slot = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("p_type")]
    return table(spark, sf_dir, "part").select("p_partkey", slot.alias("slot")).where("slot is not null")


@query(f"WITH v AS ({mapping.VENDOR_SQL}), l AS ({mapping.LISTING_SQL}) SELECT part_id, vendor_id, CAST(round(price_minor * (1 / fx_rate)) AS BIGINT) AS base_minor, CAST(round(shipping_flat_minor / coalesce(fx_rate, 1)) AS BIGINT) AS shipping_minor FROM l JOIN v USING (vendor_id) WHERE fx_rate IS NOT NULL")
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by the reciprocal of the rate, shipping by division; a listing without a rate is refused."""
    v = mapping.vendors(spark, sf_dir).select("vendor_id", "fx_rate", "shipping_flat_minor")
    rows = mapping.listings(spark, sf_dir).join(v, "vendor_id").where("fx_rate is not null")
    return rows.select("part_id", "vendor_id", F.round(F.col("price_minor") * (1 / F.col("fx_rate"))).cast("long").alias("base_minor"), F.round(F.col("shipping_flat_minor") / F.coalesce("fx_rate", F.lit(1.0))).cast("long").alias("shipping_minor"))


# ---- offers and upserts --------------------------------------------------------


@query(f"WITH l AS ({mapping.LISTING_SQL}) SELECT part_id, count(*) AS n_offers, arg_min(vendor_id, (price_minor, vendor_id)) AS cheapest_vendor, arg_min(vendor_id, (NOT in_stock, price_minor, vendor_id)) AS buy_vendor, min(price_minor) AS min_price, min(price_minor) FILTER (WHERE in_stock) AS min_in_stock, bool_or(in_stock) AS any_in_stock, array_to_string(list_sort(list(DISTINCT vendor_id)), ',') AS vendors FROM l GROUP BY part_id")
def part_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four readings of cheapest, and who sells the part."""
    got = offers.part_offers(mapping.listings(spark, sf_dir))
    return got.select("part_id", "n_offers", F.col("cheapest.vendor_id").alias("cheapest_vendor"), F.col("buy.vendor_id").alias("buy_vendor"), "min_price", "min_in_stock", "any_in_stock", F.array_join(F.col("vendors").cast("array<string>"), ",").alias("vendors"))


@query(mapping.LISTING_SQL)
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.listings(spark, sf_dir)


_OLD = "SELECT s_suppkey AS k, s_name AS name, CAST(s_nationkey AS BIGINT) AS n FROM supplier WHERE s_suppkey % 3 <> 0"
_NEW = "SELECT l_suppkey AS k, concat('v', l_linenumber) AS name, l_orderkey AS n FROM lineitem WHERE l_suppkey % 2 = 0 AND l_orderkey % 50 = 0"


@query(f"WITH o AS ({_OLD}), c AS (SELECT k, arg_max(name, (n, name)) AS name, max(n) AS n FROM ({_NEW}) GROUP BY k) SELECT coalesce(o.k, c.k) AS k, CASE WHEN o.k IS NULL THEN c.name ELSE o.name END AS name, CASE WHEN c.k IS NULL THEN o.n ELSE c.n END AS n FROM o FULL JOIN c ON o.k = c.k")
def upsert_listed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known keys take only the listed columns of the latest change; new keys come whole."""
    old = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("n"))
    new = table(spark, sf_dir, "lineitem").where("l_suppkey % 2 = 0 and l_orderkey % 50 = 0").select(F.col("l_suppkey").alias("k"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_orderkey").alias("n"))
    return upsert.upsert(old, new, ["k"], ["n", "name"], ["n"])


@query(f"WITH o AS ({_OLD}) SELECT * FROM o UNION ALL SELECT k, min(struct_pack(name := name, n := n)).name, min(struct_pack(name := name, n := n)).n FROM ({_NEW}) c WHERE k NOT IN (SELECT k FROM o) GROUP BY k")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("n"))
    new = table(spark, sf_dir, "lineitem").where("l_suppkey % 2 = 0 and l_orderkey % 50 = 0").select(F.col("l_suppkey").alias("k"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_orderkey").alias("n"))
    return upsert.insert_absent(old, new, ["k"])


# The same two writers over whole tables: every line changes its supplier, a known key, and its part, a new one.
_ALL_OLD = "SELECT 'supplier' AS kind, s_suppkey AS k, s_name AS name, CAST(s_nationkey AS BIGINT) AS n FROM supplier"
_ALL_NEW = "SELECT 'supplier' AS kind, l_suppkey AS k, concat('v', l_linenumber) AS name, l_orderkey AS n FROM lineitem UNION ALL SELECT 'part', l_partkey, concat('v', l_linenumber), l_orderkey FROM lineitem"


def _all_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("n"))
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), F.col(k).alias("k"))
    lines = table(spark, sf_dir, "lineitem").select(F.explode(F.array(key("supplier", "l_suppkey"), key("part", "l_partkey"))).alias("key"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_orderkey").alias("n"))
    return old, lines.select("key.*", "name", "n")


@query(f"WITH o AS ({_ALL_OLD}), c AS (SELECT kind, k, arg_max(name, (n, name)) AS name, max(n) AS n FROM ({_ALL_NEW}) GROUP BY kind, k) SELECT coalesce(o.kind, c.kind) AS kind, coalesce(o.k, c.k) AS k, CASE WHEN o.k IS NULL THEN c.name ELSE o.name END AS name, CASE WHEN c.k IS NULL THEN o.n ELSE c.n END AS n FROM o FULL JOIN c ON o.kind = c.kind AND o.k = c.k")
def upsert_all_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As upsert_listed_columns, but each line is applied to all suppliers and, as new keys, to parts."""
    return upsert.upsert(*_all_changes(spark, sf_dir), ["kind", "k"], ["n", "name"], ["n"])


@query(f"WITH o AS ({_ALL_OLD}) SELECT * FROM o UNION ALL SELECT kind, k, min(struct_pack(name := name, n := n)).name, min(struct_pack(name := name, n := n)).n FROM ({_ALL_NEW}) c WHERE (kind, k) NOT IN (SELECT (kind, k) FROM o) GROUP BY kind, k")
def insert_all_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As insert_if_absent, over all suppliers and all lines."""
    return upsert.insert_absent(*_all_changes(spark, sf_dir), ["kind", "k"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND c.k IS NOT NULL THEN 'T' ELSE o_orderstatus END AS o_orderstatus FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') c ON c.k = o_orderkey")
def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows still in the guarded state change."""
    changes = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("T").alias("o_orderstatus")).distinct()
    return upsert.update_where(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), changes, ["o_orderkey"], F.col("o_orderstatus") == "O", ["o_orderstatus"])


_MERGES = "SELECT p_partkey AS merged_id, p_partkey - 1 AS canonical_id FROM part WHERE p_partkey % 20 = 1 AND p_partkey > 1"


@query(f"WITH l AS ({mapping.LISTING_SQL}), m AS ({_MERGES}), t AS (SELECT l.*, m.canonical_id IS NULL AS own, l.part_id AS src, coalesce(m.canonical_id, l.part_id) AS pid FROM l LEFT JOIN m ON m.merged_id = l.part_id) SELECT pid AS part_id, vendor_id, arg_min(price_minor, (NOT own, src)) AS price_minor, arg_min(in_stock, (NOT own, src)) AS in_stock FROM t GROUP BY pid, vendor_id")
def merge_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings after duplicate parts are merged into their canonical part."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), "p_name")
    merges = parts.where("part_id % 20 = 1 and part_id > 1").select(F.col("part_id").alias("merged_id"), (F.col("part_id") - 1).alias("canonical_id"))
    return upsert.apply_merges(parts, mapping.listings(spark, sf_dir), merges)[1]


# ---- joins ---------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def parts_without_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(lines, "p_partkey", "left_anti")


@query("SELECT DISTINCT p_partkey, p_name, n_name FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2")
def tenant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that vendors of one region list; the keys are made distinct before names are joined."""
    sellers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").where("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    keys = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(sellers, "l_suppkey").select(F.col("l_partkey").alias("p_partkey"), "n_name").distinct()
    return keys.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", "p_name", "n_name")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(s_name, 'unknown') AS vendor FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0")
def listing_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(names, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "l_suppkey", F.coalesce("s_name", F.lit("unknown")).alias("vendor"))


@query("SELECT c_custkey, name, r.p_partkey, r.p_partkey IS NOT NULL AS resolved FROM (SELECT c_custkey, concat_ws(' ', 'almond', 'x', c_custkey % 5) AS name FROM customer UNION ALL SELECT c_custkey, p_name FROM customer JOIN part ON p_partkey = c_custkey) c LEFT JOIN (SELECT p_name, max(p_partkey) AS p_partkey FROM part GROUP BY p_name) r ON r.p_name = c.name")
def name_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to part ids: of parts that share a name the last; unresolved names stay visible."""
    people, parts = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    made = people.select("c_custkey", F.concat_ws(" ", F.lit("almond"), F.lit("x"), (F.col("c_custkey") % 5).cast("string")).alias("name"))
    real = people.join(parts, F.col("c_custkey") == F.col("p_partkey")).select("c_custkey", F.col("p_name").alias("name"))
    ids = parts.groupBy(F.col("p_name").alias("name")).agg(F.max("p_partkey").alias("p_partkey"))
    return made.unionByName(real).join(ids, "name", "left").select("c_custkey", "name", "p_partkey", F.col("p_partkey").isNotNull().alias("resolved"))


@query("SELECT n_name, r_name FROM nation FULL JOIN (SELECT * FROM region WHERE r_regionkey <> 3) r ON n_regionkey = r_regionkey WHERE n_name IS NULL OR r_name IS NULL")
def two_way_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack their partner on the other side."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where("r_regionkey <> 3")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "full_outer").where("n_name is null or r_name is null").select("n_name", "r_name")


# ---- text -----------------------------------------------------------------------


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;|&[a-z]+;', ' ', 'gi'), '\s+', ' ', 'g')) AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '/+$', '') AS path FROM pages")
def normalise_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text.url_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", parts["host"].alias("host"), parts["path"].alias("path"))


_KW = "list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ") AND NOT regexp_matches(w, '^[0-9]+$'))))"


@query(f"WITH k AS (SELECT p_type AS category, array_to_string({_KW}, ' ') AS kind, count(*) AS n FROM part WHERE len({_KW}) > 0 GROUP BY ALL), p AS (SELECT a.category, a.kind AS a, b.kind AS b, a.n AS n_a, b.n AS n_b, len(list_intersect(string_split(a.kind, ' '), string_split(b.kind, ' '))) AS i, len(list_distinct(list_concat(string_split(a.kind, ' '), string_split(b.kind, ' ')))) AS u FROM k a JOIN k b ON a.category = b.category AND a.kind < b.kind) SELECT category, a, b, round(i / u, 6) AS overlap, n_a, n_b FROM p WHERE i / u >= 0.28")
def keywords_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of names of one category that share enough words, through an index on words."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), text.keywords(F.col("p_name")).alias("words"))
    return matching.overlapping_names(parts).withColumn("overlap", F.round("overlap", 6))


def _tag_sql(column: str, category: str) -> str:
    made = ", ".join("CASE WHEN %s IN (%s) AND regexp_matches(%s, '%s', 'i') THEN '%s' END" % (category, ", ".join(f"'{s}'" for s in slots), column, pattern, tag) for tag, pattern, slots in text.STYLE_TAGS)
    return f"array_to_string(list_filter([{made}], lambda t: t IS NOT NULL), ',')"


@query(f"SELECT p_partkey, {_tag_sql('p_name', 'category')} AS tags FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'dial' WHEN 1 THEN 'hands' WHEN 2 THEN 'bezel_insert' WHEN 3 THEN 'strap' ELSE 'crown' END AS category FROM part) p")
def style_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(c) for c in ("dial", "hands", "bezel_insert", "strap", "crown")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.style_tags(F.col("p_name"), kind), ",").alias("tags"))


def _reserved_sql(column: str) -> str:
    made = ", ".join(f"CASE WHEN contains(' ' || regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g') || ' ', ' {re.sub('[^a-z0-9]+', ' ', t)} ') THEN '{t}' END" for t in text.RESERVED)
    return f"array_to_string(list_filter([{made}], lambda t: t IS NOT NULL), ',')"


@query(f"SELECT conv_id, turn, {_reserved_sql('text')} AS terms FROM conversations")
def reserved_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.reserved_terms(F.col("text")), ",").alias("terms"))


_ASK = "concat(p_name, CASE p_size % 5 WHEN 0 THEN ' under £' || (p_size * 10) WHEN 1 THEN ' for ' || (p_size * 7) || ' pounds, no date' WHEN 2 THEN ' ' || p_size || 'mm with date' WHEN 3 THEN ' GMT dual time' ELSE ' 42.5 mm' END)"


@query(rf"SELECT p_partkey, CASE WHEN m > 0 THEN CAST(round(m * 100) AS BIGINT) END AS budget_minor, CASE WHEN mm > 20 AND mm < 60 THEN mm - 2 END AS size_from, CASE WHEN mm > 20 AND mm < 60 THEN mm + 2 END AS size_to, CASE WHEN regexp_matches(t, '\bno date\b|dateless|without a date') THEN false WHEN regexp_matches(t, '\bdate\b') THEN true END AS requires_date, CASE WHEN regexp_matches(t, '\bgmt\b|second time ?zone|dual time|two time ?zone') THEN true END AS requires_gmt FROM (SELECT p_partkey, t, TRY_CAST(replace(coalesce(nullif(regexp_extract(t, '(?:£|gbp\s*)(\d[\d,]*(?:\.\d{{1,2}})?)', 1), ''), nullif(regexp_extract(t, '(\d[\d,]*)\s*(?:pounds|quid|gbp)', 1), '')), ',', '') AS DOUBLE) AS m, CAST(nullif(regexp_extract(t, '(\d{{2}}(?:\.\d)?)\s*mm', 1), '') AS DOUBLE) AS mm FROM (SELECT p_partkey, lower({_ASK}) AS t FROM part) a) b")
def parse_query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = F.concat("p_name", F.expr("case p_size % 5 when 0 then concat(' under £', p_size * 10) when 1 then concat(' for ', p_size * 7, ' pounds, no date') when 2 then concat(' ', p_size, 'mm with date') when 3 then ' GMT dual time' else ' 42.5 mm' end"))
    return table(spark, sf_dir, "part").select("p_partkey", text.intent(ask).alias("i")).select("p_partkey", "i.*").drop("tags")


_SAID = "concat(CASE p_size % 3 WHEN 0 THEN '<b>Outer&nbsp;Diameter</b>: ' WHEN 1 THEN 'outside dia. – ' ELSE 'Outer dia' END, p_size, 'mm Inner diameter: 31.5 mm Crown ', CASE p_size % 2 WHEN 0 THEN 'Diameter: ' ELSE 'width-' END, p_size % 15, ' mm ', CASE p_size % 4 WHEN 0 THEN 'hour / minute / second' ELSE 'H/M/S:' END, ' 8.5 / ', p_size % 20 + 1, 'mm / 12.75mm')"


@query(r"""WITH t AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(""" + _SAID + r""", '<[^>]+>', ' ', 'g'), '&nbsp;|&[a-z]+;', ' ', 'gi'), '\s+', ' ', 'g')) AS x FROM part),
n AS (SELECT p_partkey, TRY_CAST(regexp_extract(x, '(?:outer|outside)\s*(?:diameter|dia\.?)\s*[:\-–]?\s*(\d{1,2}(?:\.\d{1,2})?)\s*mm', 1, 'i') AS DOUBLE) AS o, TRY_CAST(regexp_extract(x, '(?:inner|inside)\s*(?:diameter|dia\.?)\s*[:\-–]?\s*(\d{1,2}(?:\.\d{1,2})?)\s*mm', 1, 'i') AS DOUBLE) AS i,
  TRY_CAST(regexp_extract(x, 'crown\s*(?:diameter|dia\.?|size|width)\s*[:\-–]?\s*(\d{1,2}(?:\.\d{1,2})?)\s*mm', 1, 'i') AS DOUBLE) AS c,
  regexp_extract(x, '(?:h\s*/\s*m\s*/\s*s|hour\s*/\s*minute\s*/\s*second)\s*[:\-–]?\s*(\d{1,2}(?:\.\d{1,2})?)\s*(?:mm)?\s*/\s*(\d{1,2}(?:\.\d{1,2})?)\s*(?:mm)?\s*/\s*(\d{1,2}(?:\.\d{1,2})?)\s*mm', ['h', 'm', 's'], 'i') AS w FROM t),
b AS (SELECT p_partkey, CASE WHEN o BETWEEN 24 AND 46 THEN o END AS o, CASE WHEN i BETWEEN 18 AND 40 THEN i END AS i, CASE WHEN c BETWEEN 4 AND 11 THEN c END AS c, CASE WHEN TRY_CAST(w.h AS DOUBLE) BETWEEN 4 AND 14 THEN CAST(w.h AS DOUBLE) END AS h, CASE WHEN TRY_CAST(w.m AS DOUBLE) BETWEEN 7 AND 17 THEN CAST(w.m AS DOUBLE) END AS m FROM n)
SELECT p_partkey, CASE WHEN NOT coalesce(i >= o, false) THEN o END AS outer_mm, CASE WHEN NOT coalesce(i >= o, false) THEN i END AS inner_mm, c AS diameter, CASE WHEN m > h THEN h END AS hour, CASE WHEN m > h THEN m END AS minute FROM b""")
def parse_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr(_SAID)
    d = text.dimensions(said)
    return table(spark, sf_dir, "part").select("p_partkey", d.alias("d")).select("p_partkey", F.col("d.outer").alias("outer_mm"), F.col("d.inner").alias("inner_mm"), "d.diameter", "d.hour", "d.minute")


# ---- pair matrix ---------------------------------------------------------------


@query(f"WITH c AS ({mapping.CATALOG_SQL}), k AS (SELECT slot, nullif(platform, '') AS p, count(*) AS n FROM c WHERE slot IN ('case', 'bezelInsert', 'crystal', 'crown', 'bezel') GROUP BY ALL) SELECT b.slot, CASE WHEN a.p IS NULL OR b.p IS NULL THEN 'unconfirmed' WHEN a.p = b.p THEN 'ok' ELSE 'blocked' END AS outcome, sum(a.n * b.n)::BIGINT AS pairs FROM k a JOIN k b ON a.slot = 'case' AND b.slot <> 'case' GROUP BY ALL")
def pair_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of every case with every insert, crystal, crown and bezel: distinct keys meet, weighted by their counts."""
    return matching.pair_outcomes(mapping.catalog(spark, sf_dir), "case", ["bezelInsert", "crystal", "crown", "bezel"])


@query(f"WITH c AS ({mapping.CATALOG_SQL}), k AS (SELECT slot, nullif(platform, '') AS p, count(*) AS n FROM c WHERE slot IN ('case', 'bezelInsert', 'crystal', 'crown', 'bezel') GROUP BY ALL), m AS (SELECT b.slot, CASE WHEN a.p IS NULL OR b.p IS NULL THEN 'unconfirmed' WHEN a.p = b.p THEN 'ok' ELSE 'blocked' END AS outcome, a.n * b.n AS pairs FROM k a JOIN k b ON a.slot = 'case' AND b.slot <> 'case') SELECT slot, outcome, sum(pairs)::BIGINT AS pairs FROM m GROUP BY ROLLUP (slot, outcome)")
def pair_rollup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_matrix(spark, sf_dir).rollup("slot", "outcome").agg(F.sum("pairs").alias("pairs"))


@query()
def pair_matrix_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot pair that a rule joins, all parts with all parts: outcomes of all rules together and of each."""
    return matching.judged_pairs(mapping.catalog(spark, sf_dir), mapping.listings(spark, sf_dir))


@query()
def pair_rollup_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those outcomes of all rules together, with totals of each slot pair and of all."""
    return pair_matrix_by_rules(spark, sf_dir).where("rule_key is null").rollup("slot_a", "slot_b", "outcome").agg(F.sum("pairs").alias("pairs"))


@query(f"WITH c AS ({mapping.CATALOG_SQL}) SELECT slot, count(*) AS n, round(count(diameter_mm) / count(*), 6) AS diameter_mm, round(count(caliber) / count(*), 6) AS caliber, round(count(profile) / count(*), 6) AS profile FROM c GROUP BY slot")
def attribute_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(F.count(c) / F.count("*"), 6).alias(c)
    return mapping.catalog(spark, sf_dir).groupBy("slot").agg(F.count("*").alias("n"), share("diameter_mm"), share("caliber"), share("profile"))


# ---- pricing ----------------------------------------------------------------------

_PRICED = f"""l AS ({mapping.LISTING_SQL}), v AS ({mapping.VENDOR_SQL}), s AS ({mapping.BUILD_SLOT_SQL}),
buy AS (SELECT part_id, arg_min(vendor_id, (NOT in_stock, price_minor, vendor_id)) AS vendor_id, arg_min(price_minor, (NOT in_stock, price_minor, vendor_id)) AS price_minor FROM l GROUP BY part_id),
items AS (SELECT s.build_id, s.slot, s.part_id, buy.vendor_id, buy.price_minor FROM s JOIN buy USING (part_id)),
g AS (SELECT build_id, vendor_id, count(*) AS n_items, sum(price_minor)::BIGINT AS subtotal_minor, any_value(v.shipping_flat_minor) AS shipping_minor FROM items JOIN v USING (vendor_id) GROUP BY build_id, vendor_id)"""


@query(f"WITH {_PRICED} SELECT * FROM g")
def vendor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.vendor_groups(pricing.priced_items(mapping.build_slots(spark, sf_dir), mapping.listings(spark, sf_dir)), mapping.vendors(spark, sf_dir))


@query(f"WITH {_PRICED} SELECT build_id, sum(subtotal_minor)::BIGINT AS parts_minor, sum(shipping_minor)::BIGINT AS shipping_minor, (sum(subtotal_minor) + sum(shipping_minor))::BIGINT AS total_minor, count(*) AS n_vendors FROM g GROUP BY build_id")
def build_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.totals(vendor_groups(spark, sf_dir))


@query(f"""WITH {_PRICED},
o AS (SELECT i.build_id, i.vendor_id AS source, t.vendor_id AS target, count(*) AS n, sum(t.price_minor - i.price_minor)::BIGINT AS extra FROM items i JOIN g ON g.build_id = i.build_id AND g.vendor_id <> i.vendor_id JOIN l t ON t.part_id = i.part_id AND t.vendor_id = g.vendor_id AND t.in_stock GROUP BY 1, 2, 3),
f AS (SELECT o.*, a.shipping_minor - o.extra AS net, b.subtotal_minor AS ts FROM o JOIN g a ON a.build_id = o.build_id AND a.vendor_id = o.source JOIN g b ON b.build_id = o.build_id AND b.vendor_id = o.target WHERE o.n = a.n_items AND a.shipping_minor - o.extra > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY build_id, source ORDER BY ts DESC, target) AS k FROM f)
SELECT build_id, source, target, extra AS extra_minor, net AS net_minor FROM r WHERE k = 1""")
def consolidation_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors that a build could do without, since another of its vendors has all their items."""
    items = pricing.priced_items(mapping.build_slots(spark, sf_dir), mapping.listings(spark, sf_dir))
    return pricing.savings(items, pricing.vendor_groups(items, mapping.vendors(spark, sf_dir)), mapping.listings(spark, sf_dir))


@query(f"WITH l AS ({mapping.LISTING_SQL}), s AS ({mapping.BUILD_SLOT_SQL}) SELECT build_id, slot, part_id FROM s WHERE part_id NOT IN (SELECT part_id FROM l WHERE in_stock)")
def unpriced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen parts that nobody has in stock."""
    return mapping.build_slots(spark, sf_dir).join(mapping.listings(spark, sf_dir).where("in_stock").select("part_id"), "part_id", "left_anti").select("build_id", "slot", "part_id")


# ---- recommendation --------------------------------------------------------------

_PRICE = f"prices AS (SELECT part_id, min(price_minor) AS price_minor FROM ({mapping.LISTING_SQL}) x GROUP BY part_id)"
_WISH = "wishes AS (SELECT dense_rank() OVER (ORDER BY p_brand) AS wish_id, p_brand AS brand, CASE WHEN dense_rank() OVER (ORDER BY p_brand) % 3 = 0 THEN 480000 END AS budget_minor FROM (SELECT DISTINCT p_brand FROM part) b)"


def _wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct()
    numbered = brands.withColumn("wish_id", F.dense_rank().over(Window.orderBy("brand")))
    return numbered.select("wish_id", "brand", F.when(F.col("wish_id") % 3 == 0, F.lit(480000)).alias("budget_minor"))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.listings(spark, sf_dir).groupBy("part_id").agg(F.min("price_minor").alias("price_minor"))


_WALK = f"""WITH c0 AS ({mapping.CATALOG_SQL}), {_PRICE}, {_WISH},
ranked AS (SELECT wish_id, slot, c0.part_id, price_minor, row_number() OVER (PARTITION BY wish_id, slot ORDER BY (c0.brand = w.brand) DESC, price_minor, c0.part_id) - 1 AS place FROM c0 JOIN prices USING (part_id) CROSS JOIN wishes w WHERE slot IN ('movement', 'case', 'dial', 'hands', 'bezelInsert')),
sizes AS (SELECT wish_id, slot, least(max(place), 13) AS final FROM ranked GROUP BY ALL),
chosen AS (SELECT s.wish_id, d AS depth, s.slot, r.part_id, r.price_minor FROM sizes s CROSS JOIN range(14) t(d) JOIN ranked r ON r.wish_id = s.wish_id AND r.slot = s.slot AND r.place = least(d, s.final)),
tuples AS (SELECT wish_id, depth, string_agg(part_id, '|' ORDER BY slot) AS k, sum(price_minor) AS total, count(*) AS n FROM chosen GROUP BY ALL),
good AS (SELECT wish_id, k, min(depth) AS depth, any_value(total) AS total FROM tuples WHERE n >= 3 GROUP BY ALL)
SELECT chosen.wish_id * 100 + chosen.depth AS build_id, slot, part_id FROM chosen JOIN good USING (wish_id, depth) JOIN wishes USING (wish_id) WHERE budget_minor IS NULL OR total <= budget_minor"""
_WALK_HEAD, _WALK_FOUND = oracle.findings_sql(None, _WALK)


@query(_WALK_HEAD + f""", bad AS (SELECT DISTINCT build_id FROM ({_WALK_FOUND}) f WHERE severity = 'error'),
turn AS (SELECT build_id, row_number() OVER (PARTITION BY build_id // 100 ORDER BY build_id) AS suggestion FROM (SELECT DISTINCT build_id FROM slot_rows WHERE build_id NOT IN (SELECT build_id FROM bad)) x)
SELECT (build_id // 100)::BIGINT AS wish_id, suggestion::INTEGER AS suggestion, slot, part_id FROM turn JOIN slot_rows USING (build_id) WHERE suggestion <= 3""")
def suggest_depth_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three builds for each wish: ranked pools walked in parallel, blocked builds left out."""
    wishes, catalog = _wishes(spark, sf_dir), mapping.catalog(spark, sf_dir)
    steps = recommend.walk(recommend.pools(catalog, _prices(spark, sf_dir), wishes), wishes)
    slots = steps.select((F.col("wish_id") * 100 + F.col("depth")).cast("long").alias("build_id"), "slot", "part_id")
    judged = evaluate.evaluate(evaluate.wide_builds(slots, catalog, mapping.listings(spark, sf_dir), mapping.exceptions(spark, sf_dir))).where("n_error = 0")
    wish = F.floor(F.col("build_id") / 100).cast("long")
    turn = judged.select("build_id", F.row_number().over(Window.partitionBy(wish).orderBy("build_id")).alias("suggestion")).where("suggestion <= 3")
    return turn.join(slots, "build_id").select(wish.alias("wish_id"), "suggestion", "slot", "part_id")


_STEP = """{name} AS (SELECT style_id, min(struct_pack(o := part_brand <> s.brand, p := price_minor, k := part_id, f := platform)) AS b FROM {state} s JOIN pr ON pr.slot = '{slot}' {fit} GROUP BY style_id)"""


@query(f"""WITH c0 AS ({mapping.CATALOG_SQL}), {_PRICE}, {_WISH}, st AS (SELECT wish_id AS style_id, brand FROM wishes), pr AS (SELECT slot, part_id, brand AS part_brand, platform, price_minor FROM c0 JOIN prices USING (part_id)),
{_STEP.format(name="a1", state="st", slot="movement", fit="")}, s1 AS (SELECT st.* FROM st JOIN a1 USING (style_id)),
{_STEP.format(name="a2", state="s1", slot="case", fit="AND platform <> ''")}, s2 AS (SELECT s1.*, a2.b.f AS plat FROM s1 JOIN a2 USING (style_id)),
{_STEP.format(name="a3", state="s2", slot="dial", fit="")}, s3 AS (SELECT s2.* FROM s2 JOIN a3 USING (style_id)),
{_STEP.format(name="a4", state="s3", slot="hands", fit="")}, s4 AS (SELECT s3.* FROM s3 JOIN a4 USING (style_id)),
{_STEP.format(name="a5", state="s4", slot="bezelInsert", fit="AND platform = s.plat")}
SELECT style_id, step, slot, b.k AS part_id, b.p AS price_minor FROM (SELECT *, 1 AS step, 'movement' AS slot FROM a1 UNION ALL SELECT *, 2, 'case' FROM a2 UNION ALL SELECT *, 3, 'dial' FROM a3 UNION ALL SELECT *, 4, 'hands' FROM a4 UNION ALL SELECT *, 5, 'bezelInsert' FROM a5) x""")
def greedy_first_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = _wishes(spark, sf_dir).select(F.col("wish_id").alias("style_id"), "brand")
    return recommend.greedy_first_build(mapping.catalog(spark, sf_dir), _prices(spark, sf_dir), styles)


@query()
def first_build_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best options of each step of each style's first build: every part in stock is tried under all rules."""
    styles = _wishes(spark, sf_dir).select(F.col("wish_id").alias("style_id"), "brand")
    return recommend.first_build_options(mapping.catalog(spark, sf_dir), mapping.listings(spark, sf_dir), mapping.exceptions(spark, sf_dir), styles)


@query()
def first_build_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As greedy_first_build, but of six steps, from parts in stock that no rule blocks."""
    return first_build_options(spark, sf_dir).where("rank = 1").drop("rank")


_STEPS = "list_filter(['prepare', CASE WHEN cr.part_id IS NOT NULL THEN 'press-crystal' END, CASE WHEN bi.part_id IS NOT NULL THEN 'seat-insert' END, CASE WHEN dl.part_id IS NOT NULL AND mv.part_id IS NOT NULL THEN 'fit-dial' END, CASE WHEN dl.has_feet = false THEN 'stick-dial' END, CASE WHEN hd.part_id IS NOT NULL THEN 'press-hands' END, CASE WHEN mv.part_id IS NOT NULL AND cs.part_id IS NOT NULL THEN 'case-movement' END, CASE WHEN cw.part_id IS NOT NULL THEN 'cut-stem' END, CASE WHEN st.part_id IS NOT NULL THEN 'fit-strap' END, 'test'], lambda x: x IS NOT NULL)"


@query(_HEAD + f"SELECT build_id, len(s)::BIGINT AS n_steps, array_to_string(s, ',') AS steps, least(5, 1 + len(list_intersect(s, ['press-crystal', 'stick-dial', 'press-hands', 'cut-stem'])))::BIGINT AS difficulty FROM (SELECT b.build_id, {_STEPS} AS s {oracle.wide_sql()[1]}) x")
def assembly_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.assembly_plan(wide(spark, sf_dir, _FITTED))


@query("SELECT * FROM (SELECT o_custkey AS build_id, o_orderkey AS part_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END DESC, o_totalprice, o_orderkey)::INTEGER AS rank FROM orders WHERE o_orderstatus <> 'P') x WHERE rank <= 6")
def first_build_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best candidates of each group, by score, warnings, price and key."""
    o = table(spark, sf_dir, "orders")
    score = F.when(F.col("o_orderpriority") == "1-URGENT", 2).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)
    rows = o.select(F.col("o_custkey").alias("build_id"), F.col("o_orderkey").alias("part_id"), score.alias("score"), F.lit(0).alias("n_warning"), F.col("o_totalprice").alias("price_minor"), "o_orderstatus")
    return recommend.picker(rows, F.col("o_orderstatus") != "P").select("build_id", "part_id", "rank")


# ---- matching --------------------------------------------------------------------

_BITS = "SELECT vec_id, label, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1)::INTEGER ELSE 0::HUGEINT END))::UBIGINT AS h FROM embeddings"
_DIST = f"WITH e AS ({_BITS}) SELECT q.vec_id AS seed, c.vec_id AS part, bit_count(xor(q.h, c.h))::INTEGER AS distance FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND c.label = q.label"


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-bit hash of each vector, of the signs of its components."""
    h = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.element_at("embedding", i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)).otherwise(F.lit(0).cast("long"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", h.alias("h"))


@query(_DIST)
def hash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the seeds (ids divisible by 100) to the parts of their category."""
    e = _hashes(spark, sf_dir)
    seeds = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("seed"), "label", F.col("h").alias("hq"))
    return e.join(seeds, "label").where("vec_id <> seed").select("seed", F.col("vec_id").alias("part"), F.bit_count(F.col("h").bitwiseXOR(F.col("hq"))).alias("distance"))


def _seeds_and_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(a, category, h) of the seeds (ids divisible by 100), and of all."""
    items = _hashes(spark, sf_dir).select(F.col("vec_id").alias("a"), F.col("label").alias("category"), "h")
    return items.where("a % 100 = 0"), items


@query(f"SELECT seed, part, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance <= 40 DESC, CASE WHEN distance <= 40 THEN distance END, part)::INTEGER AS rank FROM ({_DIST}) d WHERE distance <= 40) x WHERE rank <= 8")
def suggest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, items = _seeds_and_items(spark, sf_dir)
    pairs = matching.nearest(seeds, items.withColumnRenamed("a", "b"), 8, matching.CLOSE).select(F.col("a").alias("seed"), F.col("b").alias("part"), "distance", F.lit(0.0).alias("overlap"))
    return matching.suggestions(pairs).select("seed", "part", "distance", "rank")


@query(f"WITH d AS ({_DIST}), a AS (SELECT seed, arg_min(part, (distance, part)) AS part FROM d GROUP BY seed), b AS (SELECT part, arg_min(seed, (distance, seed)) AS seed FROM d GROUP BY part) SELECT d.seed AS a, d.part AS b, 64 - d.distance AS score FROM d JOIN a USING (seed, part) JOIN b USING (seed, part)")
def mutual_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seed's best part and each part's best seed, where they are the same pair."""
    seeds, items = _seeds_and_items(spark, sf_dir)
    other = lambda df: df.withColumnRenamed("a", "b")
    one = matching.nearest(seeds, other(items), 1).select("a", "b")
    two = matching.nearest(items, other(seeds), 1).select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = one.join(two, ["a", "b"]).join(seeds, "a").join(other(items).withColumnRenamed("h", "g"), ["b", "category"])
    return both.select("a", "b", (64 - F.bit_count(F.col("h").bitwiseXOR(F.col("g")))).alias("score"))


@query()
def suggest_all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlists of every part: others of its category and not of its brand, with a close 256-bit image or the same words."""
    images = phash(spark, sf_dir).groupBy("id").agg(F.min("phash").alias("phash"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_brand").alias("vendor"), text.keywords(F.col("p_name")).alias("words"))
    found = matching.suggestions(matching.candidates(parts.join(images, "id", "left").withColumn("bits", matching.hash_words(F.col("phash"))).drop("phash")))
    return found.select("seed", "part", "distance", F.round("overlap", 6).alias("overlap"), "rank")


@query(f"WITH e AS ({_BITS}), d AS (SELECT q.vec_id AS a, c.vec_id AS b, bit_count(xor(q.h, c.h))::INTEGER AS distance FROM e q JOIN e c ON c.vec_id <> q.vec_id AND c.label = q.label), m AS (SELECT a, arg_min(b, (distance, b)) AS b, min(distance) AS distance FROM d GROUP BY a) SELECT x.a, x.b, (64 - x.distance)::BIGINT AS score FROM m x JOIN m y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b")
def mutual_best_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As mutual_best_match, but every vector is a seed and a side's best is its best of all."""
    e = _hashes(spark, sf_dir)
    return matching.mutual(e.select(F.col("vec_id").alias("id"), F.col("label").alias("category"), F.lit(None).cast("string").alias("vendor"), F.array().cast("array<string>").alias("words"), F.array("h").alias("bits")))


@query(f"WITH d AS ({_DIST}), r AS (SELECT distance, row_number() OVER (ORDER BY distance) - 1 AS i, count(*) OVER () AS n FROM d) SELECT any_value(n) AS n, min(distance) AS least, max(distance) FILTER (WHERE i = floor(0.05 * n)) AS p05, max(distance) FILTER (WHERE i = floor(0.5 * n)) AS median, max(distance) AS most FROM r")
def order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics at index floor(q * n), from counts of each distance rather than a sorted list."""
    counts = hash_hamming(spark, sf_dir).groupBy("distance").agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(Window.orderBy("distance"))).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(1))))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * F.col("n")), F.col("distance")))
    return run.agg(F.max("n").alias("n"), F.min("distance").alias("least"), at(0.05).alias("p05"), at(0.5).alias("median"), F.max("distance").alias("most"))


@query(f"WITH d AS ({_DIST}) SELECT x.seed, round(avg(CASE WHEN d.distance < x.m THEN 1.0 ELSE 0.0 END), 6) AS percentile FROM (SELECT seed, min(distance) AS m FROM d GROUP BY seed) x CROSS JOIN d GROUP BY x.seed")
def null_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each seed's closest distance stands among all distances; these meet as counts by distance."""
    d = hash_hamming(spark, sf_dir)
    counts = d.groupBy("distance").agg(F.count("*").alias("c"))
    run = counts.select("distance", (F.sum("c").over(Window.orderBy("distance")) - F.col("c")).alias("below"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("n"))
    closest = d.groupBy("seed").agg(F.min("distance").alias("distance"))
    return closest.join(run, "distance").select("seed", F.round(F.col("below") / F.col("n"), 6).alias("percentile"))


@query("SELECT o_custkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_vendors, CASE WHEN count(DISTINCT l_partkey) < 2 THEN 'one part' WHEN count(DISTINCT p_type) > 1 THEN 'several categories' WHEN count(DISTINCT l_suppkey) < 2 THEN 'one vendor' ELSE 'ok' END AS gate FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_custkey")
def match_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a submitted group can't be a match, or that it can."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    got = rows.groupBy("o_custkey").agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_vendors"), F.count_distinct("p_type").alias("n_types"))
    gate = F.when(F.col("n_parts") < 2, "one part").when(F.col("n_types") > 1, "several categories").when(F.col("n_vendors") < 2, "one vendor").otherwise("ok")
    return got.select("o_custkey", "n_parts", "n_vendors", gate.alias("gate"))


# ---- data quality and tagging -------------------------------------------------------

_C = f"WITH c AS ({mapping.CATALOG_SQL}), l AS ({mapping.LISTING_SQL}), v AS ({mapping.VENDOR_SQL})"
_RANGES = " OR ".join(f"(slot = '{s}' AND price_minor NOT BETWEEN {a} AND {b})" for s, (a, b) in dataquality.PRICE_RANGE.items())
_SAYS = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(name), '{w}') AND platform <> '{p}' AND platform <> '' THEN '{p}' END" for w, p in dataquality.MARKERS) + ")"


@query(f"{_C} SELECT part_id, family FROM c WHERE family IN ('unknown', 'loose')")
def dq_unknown_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mapping.catalog(spark, sf_dir)
    return dataquality.unknown_family(c, c.select("family").distinct().where("family not in ('unknown', 'loose')")).select("part_id", "family")


@query(f"{_C} SELECT part_id FROM c WHERE caliber IS NULL AND diameter_mm IS NULL AND crown_position IS NULL")
def dq_empty_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataquality.empty_attributes(mapping.catalog(spark, sf_dir), ["caliber", "diameter_mm", "crown_position"]).select("part_id")


@query(f"{_C} SELECT part_id FROM c WHERE part_id NOT IN (SELECT part_id FROM l WHERE price_minor < 100000)")
def dq_unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataquality.unlisted(mapping.catalog(spark, sf_dir), mapping.listings(spark, sf_dir).where("price_minor < 100000")).select("part_id")


@query(f"{_C} SELECT part_id, platform, {_SAYS} AS says FROM c WHERE {_SAYS} IS NOT NULL")
def dq_name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataquality.name_conflicts(mapping.catalog(spark, sf_dir)).select("part_id", "platform", "says")


@query(f"{_C} SELECT part_id, vendor_id FROM l JOIN v USING (vendor_id) WHERE fx_rate IS NULL")
def dq_missing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataquality.missing_rate(mapping.listings(spark, sf_dir), mapping.vendors(spark, sf_dir)).select("part_id", "vendor_id")


@query(f"{_C} SELECT part_id, vendor_id, CASE WHEN price_minor <= 0 THEN 'not positive' ELSE 'out of range' END AS problem FROM l JOIN c USING (part_id) WHERE price_minor <= 0 OR {_RANGES}")
def dq_price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataquality.odd_prices(mapping.listings(spark, sf_dir), mapping.catalog(spark, sf_dir)).select("part_id", "vendor_id", "problem")


@query(f"{_C}, x AS (SELECT name, unnest([struct_pack(f := 'caliber', v := caliber), struct_pack(f := 'profile', v := profile), struct_pack(f := 'platform', v := platform)]) AS s FROM c) SELECT name, s.f AS field, count(DISTINCT s.v) AS n_values FROM x WHERE s.v IS NOT NULL GROUP BY ALL HAVING count(DISTINCT s.v) > 1")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataquality.merge_conflicts(mapping.catalog(spark, sf_dir), "name", ["caliber", "profile", "platform"])


@query(f"{_C} SELECT 'family' AS check, count(*) FILTER (WHERE family IN ('unknown', 'loose')) AS failures FROM c UNION ALL SELECT 'names', count(*) FILTER (WHERE {_SAYS} IS NOT NULL) FROM c UNION ALL SELECT 'prices', count(*) FROM l JOIN c USING (part_id) WHERE price_minor <= 0 OR {_RANGES}")
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataquality.summary({"family": dq_unknown_family(spark, sf_dir), "names": dq_name_conflicts(spark, sf_dir), "prices": dq_price_range(spark, sf_dir)})


_CLASS = "CASE WHEN p_type = 'PROMO' AND contains(p_name, 'a') THEN 'tagged' WHEN p_type = 'PROMO' THEN NULL WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'tagged' WHEN contains(p_name, 'bolt') THEN 'rejected' ELSE 'unmatched' END"


@query(f"SELECT p_partkey, {_CLASS} AS outcome FROM part")
def tag_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered branches; a branch may take a row and give it no outcome."""
    kind, name = F.col("p_type"), F.col("p_name")
    outcome = F.when((kind == "PROMO") & name.contains("a"), "tagged").when(kind == "PROMO", None).when(kind.isin("SMALL", "MEDIUM"), "tagged").when(name.contains("bolt"), "rejected").otherwise("unmatched")
    return table(spark, sf_dir, "part").select("p_partkey", outcome.alias("outcome"))


@query(f"SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS example FROM part WHERE {_CLASS} = 'unmatched' GROUP BY ALL")
def unmatched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").join(tag_classifier(spark, sf_dir).where("outcome = 'unmatched'"), "p_partkey", "left_semi")
    return rows.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("example"))


# ---- state -------------------------------------------------------------------------

_DAY_US = 86_400_000_000


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT key, id, us, k, us AS s, 1 AS c, true AS allowed FROM e WHERE k = 1
UNION ALL SELECT e.key, e.id, e.us, e.k, CASE WHEN e.us - r.s >= {_DAY_US} THEN e.us ELSE r.s END, CASE WHEN e.us - r.s >= {_DAY_US} THEN 1 WHEN r.c < 3 THEN r.c + 1 ELSE r.c END, e.us - r.s >= {_DAY_US} OR r.c < 3 FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
SELECT key, id, us, allowed FROM r""")
def rate_limit_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests a day for each user, the day starting with the first of them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return limiter.limit_requests(e, _DAY_US, 3)


@query("SELECT user_id, count(*) AS views FROM events GROUP BY user_id")
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.view_counts(table(spark, sf_dir, "events"))


@query("SELECT sha256(lower(trim(text))) AS key, count(*) AS asked, min(conv_id) AS first_conv FROM conversations WHERE role = 'user' GROUP BY ALL")
def dedupe_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("key")).agg(F.count("*").alias("asked"), F.min("conv_id").alias("first_conv"))


# ---- codecs ------------------------------------------------------------------------


@query("WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_size % 2 = 0 AS bit FROM part), b AS (SELECT p_brand, i // 8 AS byte, sum(CASE WHEN bit THEN 1 << (i % 8)::INTEGER ELSE 0 END) AS v FROM r GROUP BY ALL) SELECT p_brand, string_agg(printf('%02x', v::INTEGER), '' ORDER BY byte) AS mask FROM b GROUP BY p_brand")
def bitmask_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bit for each part of a brand, in the order of keys."""
    return codecs.bitmasks(table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("bit"))).withColumnRenamed("group", "p_brand")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY first)::BIGINT - 1 AS code FROM part JOIN (SELECT p_name, min(p_partkey) AS first FROM part GROUP BY p_name) f USING (p_name)")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of names in the order of their first appearance."""
    return codecs.dictionary(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))).select(F.col("id").alias("p_partkey"), "code")


@query("SELECT p_partkey, sha256(concat('{\"brand\":\"', p_brand, '\",\"name\":\"', p_name, '\",\"size\":\"', p_size, '\"}')) AS digest FROM part")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(codecs.canonical(m), 256).alias("digest"))


@query(f"WITH c AS ({mapping.CATALOG_SQL}), g AS (SELECT DISTINCT platform FROM c WHERE slot = 'case' AND platform <> ''), p AS (SELECT DISTINCT slot, family FROM c WHERE slot IN ('dial', 'hands', 'bezelInsert')) SELECT platform, slot, family, view, sha256(concat_ws('/', platform, slot, family, view)) AS job_id FROM g CROSS JOIN p CROSS JOIN (SELECT unnest(['front', 'side']) AS view)")
def manifest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render jobs: case geometries by part keys by views, each with a digest as its id."""
    c = mapping.catalog(spark, sf_dir)
    return codecs.manifest(c.where("slot = 'case' and platform <> ''").select("platform").distinct(), c.where("slot in ('dial', 'hands', 'bezelInsert')").select("slot", "family").distinct(), ["front", "side"])


# ---- rasters -----------------------------------------------------------------------


@query()
def phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hashes of the vectors drawn as 64 by 64 rasters."""
    return raster.hashes(raster.drawn(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


@query()
def raster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects in those rasters: count, largest area, fill and aspect."""
    return raster.subjects(raster.drawn(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


# ---- links, saved builds, vocabularies, samples -----------------------------------------


@query(f"WITH s AS ({mapping.BUILD_SLOT_SQL}) SELECT build_id, string_agg(slot || '=' || part_id, '&' ORDER BY slot) AS link FROM s GROUP BY build_id")
def build_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build as a query string, slots in order."""
    return links.encode(mapping.build_slots(spark, sf_dir))


@query(f"WITH s AS ({mapping.BUILD_SLOT_SQL}) SELECT build_id, slot, part_id, 'ok' AS verdict FROM s UNION ALL SELECT build_id, 'junk', NULL, 'unknown slot' FROM (SELECT DISTINCT build_id FROM s) x UNION ALL SELECT build_id, 'dial', NULL, 'malformed' FROM (SELECT DISTINCT build_id FROM s) x UNION ALL SELECT build_id, 'case', 999999999, 'unknown part' FROM (SELECT DISTINCT build_id FROM s) x")
def link_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with junk added, read back: what is malformed or unknown is reported, the rest is the build."""
    made = build_links(spark, sf_dir).withColumn("link", F.concat("link", F.lit("&junk=1&dial=x&case=999999999")))
    return links.decode(made, mapping.catalog(spark, sf_dir))


@query(_HEAD + f"""SELECT substr(sha256(concat('build-', build_id)), 1, 8) AS id, build_id FROM (SELECT b.build_id, count(*) FILTER (WHERE severity = 'error') AS e FROM b LEFT JOIN ({_ALL}) f USING (build_id) GROUP BY b.build_id) x WHERE e = 0""")
def saved_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds that may be saved, under ids that follow from their content; blocked ones are refused."""
    good = evaluate.evaluate(wide(spark, sf_dir)).where("status <> 'blocked'")
    return good.select(F.substring(F.sha2(F.concat(F.lit("build-"), F.col("build_id").cast("string")), 256), 1, 8).alias("id"), "build_id")


_TAGGED = f"SELECT p_partkey, unnest(string_split({_tag_sql('p_name', 'category')}, ',')) AS tag FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'dial' WHEN 1 THEN 'hands' WHEN 2 THEN 'bezel_insert' WHEN 3 THEN 'strap' ELSE 'crown' END AS category FROM part) p"


@query(f"SELECT tag, count(*) AS n FROM ({_TAGGED}) t WHERE tag <> '' GROUP BY tag")
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tags(spark, sf_dir).select(F.explode(F.split("tags", ",")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT v.tag FROM (SELECT unnest([" + ", ".join(f"'{t}'" for t, _, _ in text.STYLE_TAGS) + f"]) AS tag) v WHERE v.tag NOT IN (SELECT tag FROM ({_TAGGED}) t)")
def unused_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that no part carries."""
    vocabulary = spark.createDataFrame([(t,) for t, _, _ in text.STYLE_TAGS], "tag string")
    return vocabulary.join(tag_frequency(spark, sf_dir), "tag", "left_anti")


@query("SELECT p_type, p_size AS modal_size FROM (SELECT p_type, p_size, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_size) AS k FROM part GROUP BY p_type, p_size) x WHERE k = 1")
def modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest size of each category, the smallest of equals; from counts, never from a list of all rows."""
    counts = table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("n"))
    return counts.groupBy("p_type").agg(F.min_by("p_size", F.struct(-F.col("n"), "p_size")).alias("modal_size"))


@query("SELECT p_partkey, p_brand, tag::INTEGER AS tag FROM (SELECT p_partkey, p_brand, k, row_number() OVER (ORDER BY p_brand, k) AS tag FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS k FROM part) x WHERE k <= CASE WHEN p_brand LIKE '%1' THEN 3 ELSE 2 END) y")
def stratified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota of each class, the first by name, then numbered through."""
    ranked = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")).alias("k"))
    chosen = ranked.where(F.col("k") <= F.when(F.col("p_brand").endswith("1"), 3).otherwise(2))
    return chosen.select("p_partkey", "p_brand", F.row_number().over(Window.orderBy("p_brand", "k")).alias("tag"))


@query("SELECT p_partkey, md5(p_partkey::VARCHAR) AS draw FROM part QUALIFY row_number() OVER (ORDER BY md5(p_partkey::VARCHAR)) <= ceil(0.1 * count(*) OVER ())")
def spot_check_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the parts for review, drawn by a digest and so the same every time; a sampling operator."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.md5(F.col("p_partkey").cast("string")).alias("draw"))
    total = parts.agg(F.count("*").alias("_total"))
    ranked = codecs.numbered(parts, F.substring("draw", 1, 3), "draw", "p_partkey")
    return ranked.join(F.broadcast(total), F.col("k") <= F.ceil(F.col("_total") * 0.1)).select("p_partkey", "draw")


@query("SELECT o_orderstatus AS state, count(*) AS n, count(*) FILTER (WHERE c_custkey IS NULL) AS orphans FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 GROUP BY ROLLUP (o_orderstatus)")
def states_sum_to_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by state with their total, and how many lack their partner."""
    people = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("there"))
    joined = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("state")).join(people, "o_custkey", "left")
    return joined.rollup("state").agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("orphans"))


@query("SELECT lang, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS good_share, count(*) FILTER (WHERE toxic = 1) AS breaches, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall-like shares and breach counts of a labelled evaluation set."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.round(F.avg((F.col("quality") == 1).cast("int")), 6).alias("good_share"), F.count_if(F.col("toxic") == 1).alias("breaches"), F.count("*").alias("n"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(url, '/([^/?#]+)/?(?:[?#].*)?$', 1), ''), '') AS handle, regexp_replace(url, '[?&]v=\d+', '') AS clean FROM pages")
def url_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last segment of each link, and the link without its cache key."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"/([^/?#]+)/?(?:[?#].*)?$", 1).alias("handle"), F.regexp_replace("url", r"[?&]v=\d+", "").alias("clean"))
