"""Registered queries of suggestions for requests in words, and of their evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.functions import text
from fitloom.ingest_queries import _tags_sql
from fitloom.operators import advice, evaluate
from fitloom.operators.recommend import CORE
from fitloom.plans import mapping, oracle
from fitloom.plans.titles import TITLE_SQL, choice, titles
from fitloom.queries import query

# Requests are drawn from customers: words, tags that they must be read as, tags that would be nice.
WORDS = ["A blue sunburst dial for evenings", "plain black with big numerals", "an ivory face and gilt hands", "something old and faded", "green, for the field", "a brushed case, grey dial", "white enamel, roman", "for diving at night", "a cherry red dial with sword hands", "steel and a smooth bezel", "anything that keeps time", "a pilot's piece with a matte dial", "orange dial, polished hands", "brown leather look, retro"]
MUST_TAGS = ["blue,sunburst", "black,arabic-numerals", "cream,gold-tone", "vintage,aged-lume", "green,tool-watch", "brushed,grey", "white,enamel,roman-numerals", "dive-bezel,lumed", "red,sword-hands", "silver-tone,plain-bezel", "", "pilot,matte", "orange,polished", "brown,vintage"]
NICE_TAGS = ["dressy", "lumed", "", "brown,cream", "", "textured", "dressy,white", "black", "", "polished", "", "tool-watch", "lumed", "dressy"]
#: Tags that a model answers with; some are no tags.
ANSWERS = ["blue,sunburst,dressy", "black, Arabic-Numerals", "cream,gold-tone,golden-hour", "vintage,aged-lume", "green,tool-watch,field", "brushed,grey", "white,enamel,roman-numerals", "dive-bezel,lumed,night", "red,sword-hands", "silver-tone,plain-bezel", "", "pilot,matte,black", "orange,polished", "brown,vintage,leather"]
_BUDGET_MINOR = "CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 30000 ELSE 25000 END END"
REQUEST_SQL = f"""SELECT c_custkey AS k, concat({choice('k', WORDS)}, CASE WHEN k % 30 = 0 THEN ', no more than 300 euros' WHEN k % 6 = 0 THEN ', under £300' WHEN k % 3 = 0 THEN ', below £250' ELSE '' END,
  CASE WHEN k % 20 = 5 THEN ' and no calendar' WHEN k % 5 = 0 THEN ' with a date' WHEN k % 5 = 1 THEN ', no date' ELSE '' END, CASE WHEN k % 7 = 0 THEN ', gmt' WHEN k % 28 = 1 THEN ', for two cities' ELSE '' END, CASE WHEN k % 11 = 0 THEN ' 42mm' ELSE '' END) AS q,
  {choice('k', MUST_TAGS)} AS must_tags, {choice('k', NICE_TAGS)} AS nice_tags, {choice('k', ANSWERS)} AS answer, {_BUDGET_MINOR} AS must_budget, CASE WHEN k % 20 = 5 THEN false WHEN k % 5 = 0 THEN true WHEN k % 5 = 1 THEN false END AS must_date,
  CASE WHEN k % 7 = 0 OR k % 28 = 1 THEN true END AS must_gmt, CASE WHEN k % 11 = 0 THEN 41.0e0 END AS must_mm FROM (SELECT c_custkey, c_custkey AS k FROM customer) c"""


def _list(c: str) -> Column:
    return F.filter(F.split(c, ","), lambda t: F.trim(t) != "")


def _once(df: DataFrame) -> DataFrame:
    """df; a generator of one row keeps its long expressions from being copied into each that reads them."""
    return df.select(F.inline(F.array(F.struct("*"))))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request twice: as the keyword parser reads it, and as a model's answer does after the filter of tags."""
    rows = spark.sql(REQUEST_SQL.replace("FROM customer", "FROM {customer}"), customer=mapping.spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey"))
    rows = _once(rows)
    must = F.struct(_list("must_tags").alias("tags"), F.col("must_budget").cast("long").alias("budget_minor"), F.col("must_date").alias("requires_date"), F.col("must_gmt").alias("requires_gmt"), F.col("must_mm").alias("size_mm"))
    fields = ("tags", "budget_minor", "requires_date", "requires_gmt", "size_from", "size_to")
    read = text.intent(F.col("q"))
    words = rows.select((F.col("k") * 2).alias("wish_id"), F.lit("keywords").alias("mode"), must.alias("must"), _list("nice_tags").alias("nice"), read.alias("i"), F.array().cast("array<string>").alias("dropped"))
    words = _once(words).select("wish_id", "mode", "must", "nice", F.struct(*[F.col("i")[f].alias(f) for f in fields]).alias("intent"), "dropped")
    said = F.struct(text.known_tags(_list("answer")).alias("tags"), *[must[f].alias(f) for f in fields[1:4]], (must["size_mm"] - 2).alias("size_from"), (must["size_mm"] + 2).alias("size_to"))
    model = rows.select((F.col("k") * 2 + 1).alias("wish_id"), F.lit("model").alias("mode"), must.alias("must"), _list("nice_tags").alias("nice"), said.alias("intent"), text.dropped_tags(_list("answer")).alias("dropped"))
    return _once(words.unionByName(model))


def _suggested(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    catalog, listings, exceptions = mapping.catalog(spark, sf_dir), mapping.listings(spark, sf_dir), mapping.exceptions(spark, sf_dir)
    usable = F.col("slot").isin("dial", "hands", "bezelInsert") | ((F.col("slot") == "case") & F.col("family").startswith("skx")) | ((F.col("slot") == "movement") & (F.col("family") == "nh3x-movement"))
    other = F.coalesce(F.col("gmt"), F.lit(False)) | F.coalesce(F.col("has_subdials"), F.lit(False))
    shop = _once(catalog).where(usable).select("part_id", "slot", (F.col("size") % 3 != 0).alias("previewable"), other.alias("other_movement"), "gmt", "has_date")
    prices = listings.groupBy("part_id").agg(F.min("price_minor").alias("price_minor"))
    # A packed file of parts looks small enough to be sent to all from the driver, though its rows with their texts are not: all sides meet by key.
    named = titles(spark, sf_dir).select("part_id", "title", "category").hint("merge")
    priced = shop.join(prices.hint("merge"), "part_id").join(named, "part_id")
    tagged = _once(priced.withColumn("tags", text.style_tags(F.col("title"), F.col("category"))).drop("title", "category"))

    def judge(slots: DataFrame) -> DataFrame:
        """Of the catalog and the listings, only the builds' own parts are read."""
        own = slots.select("part_id").distinct()
        only = lambda df: df.join(own, "part_id", "left_semi")
        return evaluate.evaluate(evaluate.wide_builds(slots, only(catalog), mapping.listings(spark, sf_dir, own), only(exceptions)))

    return advice.tag_suggestions(tagged, asked.select("wish_id", "intent.*"), judge)


_VOCABULARY = "[" + ", ".join(f"'{t}'" for t, _, _ in text.STYLE_TAGS) + "]"
_WORDS = "list_filter(list_transform(string_split({0}, ','), lambda u: lower(trim(u))), lambda u: u <> '')"
_CORE = "CASE slot " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(CORE)) + " END"

_ASKED = rf"""r AS (SELECT *, lower(q) AS t FROM ({REQUEST_SQL}) x),
asked AS (SELECT k * 2 AS wish_id, 'keywords' AS mode, string_split(nullif({_tags_sql('t', None)}, ''), ',') AS tags, CAST(replace(nullif(regexp_extract(t, '£(\d[\d,]*)', 1), ''), ',', '') AS BIGINT) * 100 AS budget, CASE WHEN contains(t, 'no date') THEN false WHEN regexp_matches(t, '\bdate\b') THEN true END AS rdate,
    CASE WHEN regexp_matches(t, '\bgmt\b') THEN true END AS zone, CAST(nullif(regexp_extract(t, '(\d+)mm', 1), '') AS INTEGER) AS mm, []::VARCHAR[] AS dropped, r.* FROM r
  UNION ALL SELECT k * 2 + 1, 'model', list_filter({_WORDS.format('answer')}, lambda u: list_contains({_VOCABULARY}, u)), must_budget, must_date, must_gmt, must_mm, list_filter({_WORDS.format('answer')}, lambda u: NOT list_contains({_VOCABULARY}, u)), r.* FROM r),
intents AS MATERIALIZED (SELECT *, coalesce(tags, []) AS want, dense_rank() OVER (ORDER BY array_to_string(coalesce(tags, []), ','), budget, rdate, zone) AS cls FROM asked)"""
# One row for each class of requests, slot and part; the classes are few, the rank is by plain comparison of all.
_BUILDS = f"""WITH {_ASKED}, c0 AS ({mapping.CATALOG_SQL}), tl AS (SELECT part_id, list_filter(string_split({_tags_sql('title', 'category')}, ','), lambda t: t <> '') AS own FROM ({TITLE_SQL}) t),
prices AS (SELECT part_id, min(price_minor) AS price_minor FROM ({mapping.LISTING_SQL}) x GROUP BY part_id),
cls AS MATERIALIZED (SELECT DISTINCT cls, want, budget, rdate, zone FROM intents),
shop AS MATERIALIZED (SELECT c0.*, own, price_minor FROM c0 JOIN tl USING (part_id) JOIN prices USING (part_id) WHERE slot IN ('dial', 'hands', 'bezelInsert') OR (slot = 'case' AND family LIKE 'skx%') OR (slot = 'movement' AND family = 'nh3x-movement')),
ranked AS MATERIALIZED (SELECT cls, slot, part_id, price_minor, list_filter(own, lambda t: list_contains(want, t)) AS matched,
    row_number() OVER (PARTITION BY cls, slot ORDER BY CASE WHEN slot = 'movement' THEN 0 ELSE len(list_filter(own, lambda t: list_contains(want, t))) END DESC, CASE WHEN slot = 'movement' THEN 0 ELSE (size % 3 <> 0)::INT END DESC, price_minor, part_id) - 1 AS place
  FROM shop JOIN cls ON CASE slot WHEN 'movement' THEN (coalesce(zone, false) = false OR coalesce(gmt, false)) AND (rdate IS NULL OR rdate = coalesce(has_date, false)) WHEN 'dial' THEN coalesce(zone, false) OR NOT (coalesce(gmt, false) OR coalesce(has_subdials, false)) WHEN 'hands' THEN coalesce(zone, false) OR NOT (coalesce(gmt, false) OR coalesce(has_subdials, false)) ELSE true END),
sizes AS MATERIALIZED (SELECT cls, slot, least(max(place), 13) AS final FROM ranked GROUP BY ALL),
chosen AS MATERIALIZED (SELECT s.cls, d AS depth, s.slot, r.part_id, r.price_minor, r.matched FROM sizes s CROSS JOIN range(14) t(d) JOIN ranked r ON r.cls = s.cls AND r.slot = s.slot AND r.place = least(d, s.final)),
tuples AS (SELECT cls, depth, string_agg(part_id, '|' ORDER BY slot) AS k, sum(price_minor) AS total, count(*) AS n FROM chosen GROUP BY ALL),
good AS (SELECT cls, k, min(depth) AS depth, any_value(total) AS total FROM tuples WHERE n >= 3 GROUP BY ALL),
walked AS MATERIALIZED (SELECT chosen.cls * 100 + chosen.depth AS build_id, chosen.*, total FROM chosen JOIN good USING (cls, depth) JOIN cls USING (cls) WHERE budget IS NULL OR total <= budget)"""
_HEAD, _FOUND = oracle.findings_sql(None, f"{_BUILDS} SELECT build_id, slot, part_id FROM walked")
# The same steps again beside the findings, which need them as rows of slots.
_ALL = _HEAD + f""", {_BUILDS.removeprefix('WITH ').replace('c0', 'c9')}, errors AS (SELECT build_id, count(*) FILTER (WHERE severity = 'error') AS n_error, count(*) FILTER (WHERE severity = 'warning') AS n_warning FROM ({_FOUND}) f GROUP BY build_id),
gone AS (SELECT cls, build_id, total, flatten(list(matched ORDER BY {_CORE})) AS m, list(part_id ORDER BY {_CORE}) AS parts FROM walked GROUP BY cls, build_id, total),
firsts AS (SELECT cls, row_number() OVER (PARTITION BY cls ORDER BY build_id) AS suggestion, total::BIGINT AS total_minor, coalesce(n_error, 0) AS n_error, coalesce(n_warning, 0) AS n_warning, list_filter(m, lambda t, i: list_position(m, t) = i) AS matched, parts FROM gone LEFT JOIN errors USING (build_id) WHERE coalesce(n_error, 0) = 0),
told AS (SELECT wish_id, suggestion, total_minor, n_error, n_warning, matched, list_filter(want, lambda u: NOT list_contains(matched, u)) AS missed, parts FROM intents JOIN firsts USING (cls) WHERE suggestion <= 3)"""


def _english(c: str) -> str:
    spaced = f"list_transform({c}, lambda t: replace(t, '-', ' '))"
    return f"CASE WHEN len({c}) = 1 THEN {spaced}[1] ELSE concat(array_to_string({spaced}[:-2], ', '), ' and ', {spaced}[-1]) END"


_SAYS = f"concat(CASE WHEN len(matched) > 0 THEN concat('Nearest in stock: has ', {_english('matched')}, '.') ELSE 'No part carries the style asked for; this is the cheapest build that fits together.' END, CASE WHEN len(missed) > 0 THEN concat(' Nothing here has ', {_english('missed')}, '.') ELSE '' END)"
_CHECKS = """list_concat(list_transform(list_filter(string_split(must_tags, ','), lambda u: u <> ''), lambda u: {'name': u, 'ok': list_contains(want, u)}), list_filter([
  CASE WHEN must_budget IS NOT NULL THEN {'name': 'budget', 'ok': coalesce(abs(budget - must_budget) <= must_budget * 0.01, false)} END, CASE WHEN must_date IS NOT NULL THEN {'name': 'date', 'ok': coalesce(rdate = must_date, false)} END,
  CASE WHEN must_gmt IS NOT NULL THEN {'name': 'gmt', 'ok': coalesce(zone = must_gmt, false)} END, CASE WHEN must_mm IS NOT NULL THEN {'name': 'size', 'ok': coalesce(abs(mm - must_mm) <= 2, false)} END], lambda c: c IS NOT NULL))"""
_RESULTS = f"""{_ALL}, built AS (SELECT wish_id, count(*) AS n_builds, count(*) FILTER (WHERE told.n_error = 0) AS zero_error, count(*) FILTER (WHERE total_minor > must_budget) AS over_budget, arg_min(total_minor, suggestion) AS top_minor, arg_min({_SAYS}, suggestion) AS explanation FROM told JOIN intents USING (wish_id) GROUP BY wish_id),
checked AS (SELECT *, {_CHECKS} AS checks, list_filter(string_split(nice_tags, ','), lambda u: u <> '') AS nice FROM intents),
results AS (SELECT wish_id, mode, len(list_filter(checks, lambda c: c.ok))::BIGINT AS must_ok, len(checks)::BIGINT AS must_total, array_to_string(list_transform(list_filter(checks, lambda c: NOT c.ok), lambda c: c.name), ',') AS missed, len(list_filter(nice, lambda u: list_contains(want, u)))::BIGINT AS nice_ok, len(nice)::BIGINT AS nice_total,
  (len(want) + len(dropped))::BIGINT AS emitted, len(dropped)::BIGINT AS dropped, len(list_filter(want, lambda u: NOT list_contains({_VOCABULARY}, u)))::BIGINT AS invented, coalesce(n_builds, 0) AS n_builds, coalesce(zero_error, 0) AS zero_error, coalesce(over_budget, 0) AS over_budget, 0::BIGINT AS brand_hits, top_minor, explanation FROM checked LEFT JOIN built USING (wish_id))"""


@query(_ALL + " SELECT wish_id, suggestion::INTEGER AS suggestion, array_to_string(parts, ',') AS parts, total_minor, n_warning, array_to_string(matched, ',') AS matched, array_to_string(missed, ',') AS missed FROM told")
def tag_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three builds for each request in words: by tags, then pictures, then price, under all rules."""
    got = _suggested(spark, sf_dir, requests(spark, sf_dir))
    return got.select("wish_id", "suggestion", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"), "total_minor", "n_warning", F.array_join("matched", ",").alias("matched"), F.array_join("missed", ",").alias("missed"))


@query(_RESULTS + " SELECT * FROM results")
def request_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each request was recovered, in both readings, and what was suggested for it."""
    asked = requests(spark, sf_dir)
    return advice.evaluate_requests(asked, _suggested(spark, sf_dir, asked))


_SUMS = "must_ok must_total nice_ok nice_total emitted dropped invented n_builds zero_error over_budget brand_hits".split()


@query(_RESULTS + ", g AS (SELECT mode, count(*) AS n, count(*) FILTER (WHERE n_builds > 0) AS with_build, " + ", ".join(f"sum({s})::BIGINT AS {s}" for s in _SUMS) + """ FROM results GROUP BY mode)
SELECT *, round(must_ok / must_total, 6) AS must_recall, round(nice_ok / nice_total, 6) AS nice_recall, round(with_build / n, 6) AS build_share, round(zero_error / n_builds, 6) AS zero_error_share,
  CASE WHEN zero_error < n_builds OR invented > 0 OR over_budget > 0 OR brand_hits > 0 THEN 'fail' WHEN mode = 'model' AND (must_ok < 0.9 * must_total OR with_build < 0.9 * n) THEN 'below' ELSE 'pass' END AS verdict FROM g""")
def request_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation of both readings: recall, shares of builds, broken budgets, invented tags, and the verdict."""
    return advice.evaluation_report(request_results(spark, sf_dir))
