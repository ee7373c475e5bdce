"""Suggested builds for requests in words, ranked by style tags, and how well they meet what was asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions import text
from fitloom.operators import recommend
from fitloom.sources.scratch import Scratch

#: Slots whose parts are ranked by tags; movements are chosen by what they do.
STYLED = ("case", "dial", "hands", "bezelInsert")
#: Shares that an evaluation has to reach; recall is held only against replies of a model.
ZERO_ERROR_SHARE, MUST_RECALL, BUILD_SHARE = 1.0, 0.9, 0.9


def _best(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each key, found in parts before they are shuffled."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def tag_pools(parts: DataFrame, asked: DataFrame, depth: int = recommend.DEPTH, scratch: Scratch | None = None) -> DataFrame:
    """(wish_id, slot, place, part_id, price_minor, matched): the best `depth` parts of each core slot for each request.

    parts: (part_id, slot, tags, price_minor, previewable, other_movement, gmt, has_date).
    asked: (wish_id, tags, requires_date, requires_gmt).
    Parts that carry more of the asked tags come first, then those with a picture, the cheaper, the
    smaller key; matched holds the tags in the part's order.  Dials and hands made for another movement are
    offered only where a second zone is asked for.  Movements follow the request's date and second zone, then price.

    Parts of equal tags rank alike in every request, so `depth` of each set of tags and slot are kept; requests of
    equal tags are ranked once; both meet through an index from tag to part.  Where fewer than `depth`
    parts share a tag, all of those are in the index, so the first 2 * depth - 1 of the slot hold every other part needed.
    Cases: no tags (null or empty) rank by picture and price; a part without price or slot takes no part; repeated tags count once.
    Those kept lie in a table in spark.checkpoint.dir: `depth` rows at most of each slot, set of tags, zone and date.
    """
    scratch = scratch or Scratch(parts.sparkSession, "advice")
    clean = lambda c: F.array_compact(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    zone = F.coalesce(F.col("requires_gmt"), F.lit(False))
    wishes = asked.select("wish_id", clean(F.col("tags")).alias("tags"), zone.alias("zone"), "requires_date")
    order = (F.desc("previewable"), F.col("price_minor"), F.col("part_id"))

    dated, moving = F.coalesce(F.col("has_date"), F.lit(False)), F.col("slot") == "movement"
    at = lambda z, d: F.struct(F.lit(z).alias("zone"), F.lit(d).alias("date"))
    does = F.array_compact(F.array(*[
        F.when(F.lit(not z) | F.coalesce(F.col("gmt"), F.lit(False)), F.when(met, at(z, d))) for z in (True, False) for d, met in (("", F.lit(True)), ("true", dated), ("false", ~dated))
    ]))
    other = F.col("slot").isin("dial", "hands") & F.coalesce(F.col("other_movement"), F.lit(False))
    offered = F.when(moving, does).when(other, F.array(at(True, ""))).otherwise(F.array(at(True, ""), at(False, "")))
    priced = parts.where("price_minor is not null").where(F.col("slot").isin("movement", *STYLED)).withColumn("tags", clean(F.col("tags")))
    kind = F.when(~moving, F.array_join(F.array_sort("tags"), ","))
    shelved = priced.select("slot", "part_id", "tags", "price_minor", (F.coalesce("previewable", F.lit(False)) & ~moving).alias("previewable"), kind.alias("kind"), F.inline(offered))
    # The parts are read here alone: all that follows stands on the few that this table keeps, with their tags.
    shelf = scratch.keep(_best(shelved, ["zone", "date", "slot", "kind"], depth, *order).drop("kind"), "shelf")

    styled = shelf.where(~moving).drop("date")
    looks = wishes.select("zone", F.array_sort("tags").alias("look")).distinct()
    columns = ("zone", "look", "slot", "part_id", "price_minor", "previewable", F.col("tags").alias("own"))
    hits = looks.withColumn("tag", F.explode("look")).join(styled.withColumn("tag", F.explode("tags")), ["zone", "tag"]).select(*columns, F.lit(1).alias("n"))
    rest = _best(styled, ["zone", "slot"], 2 * depth - 1, *order)
    fill = looks.join(F.broadcast(rest), "zone").select(*columns, F.lit(0).alias("n"))
    met = hits.unionByName(fill).groupBy("zone", "look", "slot", "part_id", "price_minor", "previewable").agg(F.sum("n").alias("n"), F.any_value("own").alias("own"))
    place = F.row_number().over(W.partitionBy("zone", "look", "slot").orderBy(F.desc("n"), *order)) - 1
    ranked = met.withColumn("place", place).where(F.col("place") < depth).select("zone", "look", "slot", "place", "part_id", "price_minor", "own")
    styled = wishes.withColumn("look", F.array_sort("tags")).join(ranked, ["zone", "look"])

    date = F.coalesce(F.col("requires_date").cast("string"), F.lit(""))
    moved = shelf.where(moving).withColumn("place", F.row_number().over(W.partitionBy("zone", "date").orderBy("price_minor", "part_id")) - 1).withColumnRenamed("tags", "own")
    moved = wishes.withColumn("date", date).join(F.broadcast(moved), ["zone", "date"])
    columns = ("wish_id", "slot", "place", "part_id", "price_minor", F.array_intersect("own", "tags").alias("matched"))
    return styled.select(*columns).unionByName(moved.select(*columns))


def tag_suggestions(parts: DataFrame, asked: DataFrame, judge: Callable[[DataFrame], DataFrame], wanted: int = recommend.WANTED, depth: int = recommend.DEPTH) -> DataFrame:
    """(wish_id, suggestion, parts, total_minor, n_error, n_warning, matched, missed): up to `wanted` builds for each request.

    The n-th best of each slot together, for each n; tuples met before, above the budget or blocked drop out.  judge takes
    (build_id, slot, part_id) and gives build_id, n_error and n_warning.  Matched tags stand by slot and part, missed ones as
    they were asked.  Requests that ask the same are answered once.  asked needs budget_minor besides the columns of `tag_pools`.

    Classes of requests, their pools, builds and suggestions are tables in spark.checkpoint.dir: each is read more than once by what
    follows, so as one plan the parts would be ranked dozens of times over, and the driver would not hold the plan.
    """
    scratch = Scratch(parts.sparkSession, "advice")
    terms = ["tags", "requires_date", "requires_gmt", "budget_minor"]
    key = F.sha2(F.to_json(F.struct(*terms), {"ignoreNullFields": "false"}), 256)
    told = asked.withColumn("_class", key)
    classes = scratch.keep(told.groupBy("_class").agg(*[F.any_value(c).alias(c) for c in terms]).withColumnRenamed("_class", "wish_id"), "classes")
    steps = recommend.walk(scratch.keep(tag_pools(parts, classes, depth, scratch), "pools"), classes, depth)
    number = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(recommend.CORE) for x in (s, i)]), F.col("slot"))
    builds = steps.groupBy("wish_id", "depth").agg(F.array_sort(F.collect_list(F.struct(number.alias("number"), "slot", "part_id", "price_minor", "matched"))).alias("p"))
    builds = scratch.keep(builds.withColumn("build_id", F.concat_ws("/", "wish_id", F.col("depth").cast("string"))), "builds")
    judged = judge(builds.select("build_id", F.explode("p").alias("p")).select("build_id", "p.slot", "p.part_id")).select("build_id", "n_error", "n_warning").where("n_error = 0")
    chosen = _best(builds.join(judged, "build_id"), ["wish_id"], wanted, "depth").withColumn("suggestion", F.row_number().over(W.partitionBy("wish_id").orderBy("depth")))
    found = chosen.select(
        F.col("wish_id").alias("_class"), "suggestion", F.transform("p", lambda x: x["part_id"]).alias("parts"), F.aggregate("p", F.lit(0).cast("long"), lambda t, x: t + x["price_minor"]).alias("total_minor"),
        "n_error", "n_warning", F.array_distinct(F.flatten(F.transform("p", lambda x: x["matched"]))).alias("matched"),
    )
    whole = classes.select(F.col("wish_id").alias("_class"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    found = scratch.keep(found.join(whole, "_class").withColumn("missed", F.array_except("tags", "matched")).drop("tags"), "found")
    return told.select("wish_id", "_class").join(found, "_class").drop("_class")


def describe_candidate(matched: Column, missed: Column) -> Column:
    """What a suggestion covers and lacks, in words; null lists count as empty."""
    words = lambda c: text.english_list(F.transform(c, lambda t: F.replace(t, F.lit("-"), F.lit(" "))))
    got = F.when(F.size(matched) > 0, F.concat(F.lit("Nearest in stock: has "), words(matched), F.lit("."))).otherwise("No part carries the style asked for; this is the cheapest build that fits together.")
    lacks = F.when(F.size(missed) > 0, F.concat(F.lit(" Nothing here has "), words(missed), F.lit("."))).otherwise("")
    return F.concat(got, lacks)


def must_checks(must: Column, intent: Column) -> Column:
    """(name, ok) of everything that a request must have recovered: tags, budget within 1 %, date, second zone, size within the range."""
    none = F.array().cast("array<string>")
    check = lambda given, name, ok: F.when(given.isNotNull(), F.struct(name.alias("name"), F.coalesce(ok, F.lit(False)).alias("ok")))
    budget, mm = must["budget_minor"], must["size_mm"]
    tags = F.transform(F.coalesce(must["tags"], none), lambda t: F.struct(t.alias("name"), F.array_contains(F.coalesce(intent["tags"], none), t).alias("ok")))
    rest = F.array_compact(F.array(
        check(budget, F.lit("budget"), F.abs(intent["budget_minor"] - budget) <= budget * 0.01), check(must["requires_date"], F.lit("date"), intent["requires_date"] == must["requires_date"]),
        check(must["requires_gmt"], F.lit("gmt"), intent["requires_gmt"] == must["requires_gmt"]), check(mm, F.lit("size"), (intent["size_from"] <= mm) & (mm <= intent["size_to"])),
    ))
    return F.concat(tags, rest)


def evaluate_requests(requests: DataFrame, suggested: DataFrame) -> DataFrame:
    """One row a request and mode: what was recovered, what was suggested, and which limits that breaks.

    requests: (wish_id, mode, must, nice, intent, dropped), wish_id being one for each mode; suggested: rows of `tag_suggestions`.
    Cases: a request without suggestions has zeros and null texts; null lists count as empty.
    """
    none = F.array().cast("array<string>")
    asked = requests.select("wish_id", "mode", must_checks(F.col("must"), F.col("intent")).alias("checks"), F.coalesce("nice", none).alias("nice"), F.coalesce("intent.tags", none).alias("tags"), F.coalesce("dropped", none).alias("dropped"), F.col("must.budget_minor").alias("limit"))
    said = suggested.withColumn("explanation", describe_candidate(F.col("matched"), F.col("missed")))
    built = said.groupBy("wish_id").agg(
        F.count("*").alias("n_builds"), F.count_if(F.col("n_error") == 0).alias("zero_error"), F.collect_list("total_minor").alias("totals"),
        F.sum(F.size(text.reserved_terms(F.col("explanation")))).alias("brand_hits"), F.min_by("total_minor", "suggestion").alias("top_minor"), F.min_by("explanation", "suggestion").alias("explanation"),
    )
    # Both sides have a row a request: neither may be taken for small and sent to the driver, which a guess from packed files does.
    out = asked.join(built.hint("merge"), "wish_id", "left").withColumn("over_budget", F.size(F.filter(F.coalesce("totals", F.array().cast("array<bigint>")), lambda t: t > F.col("limit"))))
    return out.select(
        "wish_id", "mode", F.size(F.filter("checks", lambda c: c["ok"])).cast("long").alias("must_ok"), F.size("checks").cast("long").alias("must_total"),
        F.array_join(F.transform(F.filter("checks", lambda c: ~c["ok"]), lambda c: c["name"]), ",").alias("missed"), F.size(F.array_intersect("nice", "tags")).cast("long").alias("nice_ok"), F.size("nice").cast("long").alias("nice_total"),
        (F.size("tags") + F.size("dropped")).cast("long").alias("emitted"), F.size("dropped").cast("long").alias("dropped"), F.size(F.array_except("tags", F.array(*[F.lit(t) for t, _, _ in text.STYLE_TAGS]))).cast("long").alias("invented"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_builds", "zero_error", "over_budget", "brand_hits")], "top_minor", "explanation",
    )


def evaluation_report(results: DataFrame) -> DataFrame:
    """One row a mode: the sums and shares of `evaluate_requests`, and whether each limit is kept; shares of nothing are null."""
    sums = ("must_ok", "must_total", "nice_ok", "nice_total", "emitted", "dropped", "invented", "n_builds", "zero_error", "over_budget", "brand_hits")
    got = results.groupBy("mode").agg(F.count("*").alias("n"), F.count_if(F.col("n_builds") > 0).alias("with_build"), *[F.sum(c).alias(c) for c in sums])
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return got.select(
        "mode", "n", "with_build", *sums, share("must_ok", "must_total").alias("must_recall"), share("nice_ok", "nice_total").alias("nice_recall"), share("with_build", "n").alias("build_share"), share("zero_error", "n_builds").alias("zero_error_share"),
        F.when((F.coalesce(share("zero_error", "n_builds"), F.lit(1.0)) < ZERO_ERROR_SHARE) | (F.col("invented") > 0) | (F.col("over_budget") > 0) | (F.col("brand_hits") > 0), "fail")
        .when((F.col("mode") == "model") & ((F.col("must_ok") < MUST_RECALL * F.col("must_total")) | (F.col("with_build") < BUILD_SHARE * F.col("n"))), "below").otherwise("pass").alias("verdict"),
    )
