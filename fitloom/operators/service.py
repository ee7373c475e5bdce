"""The ingest's, the review's and the matching service's steps as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions import listing, text
from fitloom.operators import dataquality


def log_rejects(log: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The log with what it lacks of `found` (a key once, its least reason), `fresh` marking those rows; a second run adds nothing."""
    new = found.groupBy(*keys).agg(F.min("reason").alias("reason")).join(log.select(*keys), keys, "left_anti")
    return log.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))


def reject_pending(parts: DataFrame, rejects: DataFrame) -> DataFrame:
    """Parts that are pending and rejected change state; a human decision stays."""
    why = rejects.groupBy("part_id").agg(F.min("reason").alias("_why"))
    hit = (F.col("review_state") == "pending") & F.col("_why").isNotNull()
    return parts.join(why, "part_id", "left").select("part_id", F.when(hit, "rejected").otherwise(F.col("review_state")).alias("review_state"), F.when(hit, F.concat(F.lit("rejected during tagging: "), "_why")).otherwise(F.col("evidence")).alias("evidence"))


def import_outcome(rows: DataFrame, families: DataFrame, tags: list[str]) -> DataFrame:
    """(part_id, outcome): the first gate that a row fails, or imported."""
    known = families.select("family", F.lit(True).alias("_known"))
    strange = F.size(F.array_except("tags", F.array(*[F.lit(t) for t in tags]))) > 0
    outcome = F.when(F.col("_known").isNull(), "unknown family").when(strange, "unknown tags").when(F.col("review_state") != "pending", "already reviewed").otherwise("imported")
    return rows.join(known, "family", "left").select("part_id", outcome.alias("outcome"))


def mandatory_review(confidence: Column, category: Column, name: Column, family: Column) -> Column:
    """Why a human must look at a part; null if none must."""
    conflict = dataquality.name_family_conflict(name, family, category)
    return F.when(confidence == "low", "low confidence").when(category.isin("case", "movement"), "anchors every rule").when(conflict.isNotNull(), "name conflict")


def decide(parts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(part_id, outcome, note) of each decision."""
    joined = decisions.join(parts.select("part_id", F.lit(True).alias("_there")), "part_id", "left")
    outcome = F.when(F.col("_there").isNull(), "not found").when(F.col("decision") == "approve", "approved").otherwise("rejected")
    note = F.when(outcome == "approved", F.concat(F.lit("Reviewed by "), "reviewer", F.lit(": "), "reason")).when(outcome == "rejected", F.concat("reason", F.lit(" (reviewed by "), "reviewer", F.lit(")")))
    return joined.select("part_id", outcome.alias("outcome"), note.alias("note"))


def seed_exceptions(parts: DataFrame, known: DataFrame, seeds: list[tuple[str, str, str, str]]) -> DataFrame:
    """Exceptions (part_id, rule_key, severity) that seeds (family, pattern of the name, rule, severity) add; parts that have one are passed over."""
    table = parts.sparkSession.createDataFrame(seeds, "family string, pattern string, rule_key string, severity string")
    hit = parts.join(F.broadcast(table), "family").where(F.col("pattern").eqNullSafe("") | F.regexp_like("name", F.col("pattern")))
    return hit.join(known.select("part_id").distinct(), "part_id", "left_anti").select("part_id", "rule_key", "severity")


def link_index(listings: DataFrame, parts: DataFrame) -> DataFrame:
    """(link, part_id): listings' links first, then parts' own; the smallest part of equals."""
    both = listings.select("part_id", "url", F.lit(0).alias("turn")).unionByName(parts.select("part_id", F.col("source_url").alias("url"), F.lit(1).alias("turn")))
    keyed = both.select(text.product_url(F.col("url")).alias("link"), "part_id", "turn").where("link is not null")
    return keyed.groupBy("link").agg(F.min_by("part_id", F.struct("turn", "part_id")).alias("part_id"))


def resolve_links(asked: DataFrame, index: DataFrame, parts: DataFrame) -> DataFrame:
    """asked with part_id and problem: no product link, not in the catalog, or not approved yet."""
    rows = asked.withColumn("link", text.product_url(F.col("submitted"))).join(index, "link", "left").join(parts.select("part_id", "review_state"), "part_id", "left")
    problem = F.when(F.col("link").isNull(), "no product link").when(F.col("part_id").isNull(), "not in the catalog").when(F.col("review_state") != "approved", "not approved yet")
    return rows.withColumn("problem", problem).drop("review_state")


def overlay(catalog: DataFrame, submitted: DataFrame, used: DataFrame) -> DataFrame:
    """The catalog with submitted parts that are used and not rejected; these take the place of parts of their id."""
    extra = submitted.where("review_state <> 'rejected'").join(used.select("part_id").distinct(), "part_id", "left_semi").select(*catalog.columns, F.lit(True).alias("submitted"))
    return catalog.join(extra.select("part_id"), "part_id", "left_anti").withColumn("submitted", F.lit(False)).unionByName(extra)


def submissions(rows: DataFrame) -> DataFrame:
    """Rows of parts submitted by link (url): an id by what is listed, and a link rebuilt from it, so nothing else that was pasted is kept."""
    got = rows.withColumn("_l", listing.listing_link(F.col("url"))).where("_l.problem is null").select("*", "_l.platform", "_l.item_id").drop("_l")
    link = F.when(F.col("platform") == "ebay", F.concat(F.lit("https://www.ebay.com/itm/"), "item_id")).otherwise(F.concat(F.lit("https://www.aliexpress.com/item/"), "item_id", F.lit(".html")))
    key = F.concat(F.lit("byo-"), F.substring(F.sha2(F.concat_ws("/", "platform", "item_id"), 256), 1, 8))
    return got.withColumn("source_url", link).withColumn("id", key).withColumn("spec_source", F.lit("user-entered")).withColumn("review_state", F.lit("pending"))


def promote(links: DataFrame, images: DataFrame) -> DataFrame:
    """(a, b, source, distance) of pairs that users linked or images suggest, a < b; both sources make one row."""
    pair = lambda df: df.withColumn("_a", F.least("a", "b")).withColumn("b", F.greatest("a", "b")).withColumn("a", F.col("_a")).drop("_a")
    users = pair(links).select("a", "b").distinct().withColumn("_user", F.lit(True))
    seen = pair(images).groupBy("a", "b").agg(F.min("distance").alias("distance")).withColumn("_image", F.lit(True))
    source = F.when(F.col("_user").isNotNull() & F.col("_image").isNotNull(), "both").when(F.col("_user").isNotNull(), "user-link").otherwise("phash")
    return users.join(seen, ["a", "b"], "full_outer").select("a", "b", source.alias("source"), "distance")


def picked(word: str | None = None, most: int | None = None, stocked: bool = True) -> Column:
    """Filter of a picker over (name, price, stocked)."""
    good = F.lit(True)
    if word:
        good &= F.lower("name").contains(word.lower())
    if most is not None:
        good &= F.col("price") <= most
    return good & F.col("stocked") if stocked else good


def parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: members that a or b has alone, and whether there are none."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(True)).join(b.select(*keys).distinct().withColumn("_b", F.lit(True)), keys, "full_outer")
    got = both.agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"))
    return got.withColumn("alike", (F.col("only_left") + F.col("only_right")) == 0)


def differences(pairs: DataFrame, tolerance: int = 8) -> DataFrame:
    """Statistics of |a - b| of two arrays of whole numbers; p99 is the sorted value at floor(0.99 n)."""
    d = pairs.withColumn("_d", F.array_sort(F.zip_with("a", "b", lambda x, y: F.abs(x - y))))
    n = F.size("_d")
    mean = F.aggregate("_d", F.lit(0).cast("long"), lambda acc, x: acc + x) / n
    return d.withColumns({"mad": F.round(mean, 6), "most": F.element_at("_d", -1), "p99": F.element_at("_d", F.floor(n * 0.99).cast("int") + 1), "differing": F.size(F.filter("_d", lambda x: x > tolerance))}).drop("_d")
